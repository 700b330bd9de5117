import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quorate.llm.packing import ChunkIds, configuration_lp, pack, packing_plan, tokenized_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, rank int"


def ids_of(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_chunk_ids_equal_the_tokenizers():
    texts = ["", "it's, DON'T we'Ll ''' 's ... 3.14, 2. a.b. c,,", "a ² ¼ ªº ÀÉß İı ſ ß. É, x́, ñ.", "日本語 テスト 😀", "ΑΣ ΟΔΟΣ", "y" * 500, "\x00 a\x1cb \x85 <|endoftext|>", "__a_b1 12ab end.\n\nNext,\tone"]
    texts += ["a <|endoftext|> b", "A<|EndOfText|>b.", "<|startoftext|><|endoftext|>.", "<|endoftext|", "x" * 90 + ". y", "can't. 's, 1,000. (x). a., ..., İstanbul. x²,"]
    for most, together in ((3, 1), (3, 4), (700_000, 100)):
        encode = ChunkIds(PATH, most=most)
        got = [ids.tolist() for _ in range(3) for i in range(0, len(texts), together) for ids in encode([t.encode() for t in texts[i : i + together]])]
        assert got == ids_of(texts) * 3


def test_special_tokens_are_single_ids():
    assert ChunkIds(PATH)([b"a <|endoftext|> b"])[0].tolist() == [320, 49407, 321]


def test_plan_covers_the_counts_and_is_near_the_bound():
    rng = np.random.default_rng(2)
    for scale in (1, 50):
        counts = np.bincount(np.minimum(rng.lognormal(5, 1, 3000).astype(int) + 1, 2048), minlength=2049) * scale
        plan = packing_plan(counts, 2048)
        made = np.zeros(2049, int)
        for pattern, times in plan.items():
            assert sum(pattern) <= 2048 and times > 0
            for length in pattern:
                made[length] += times
        assert (made == counts).all()
        assert sum(plan.values()) <= 1.005 * (counts * np.arange(2049)).sum() / 2048 + 2


@pytest.mark.parametrize("lengths, weights, most", [((1055, 619, 558, 375), (1, 1, 1, 2), 9000), ((1025, 700, 683, 340, 300), (1, 1, 1, 1, 1), 9000), ((1500, 600, 540), (1, 1, 1), 8000), ((2048, 1, 2047), (1, 1, 1), 12_000)])
def test_patterns_that_leave_room_are_used_too(lengths, weights, most):
    for times in (6000, 60, 1):
        counts = np.zeros(2049, int)
        counts[list(lengths)] = np.array(weights) * times
        plan = packing_plan(counts, 2048)
        made = sum(n * np.bincount(pattern, minlength=2049) for pattern, n in plan.items())
        assert (made == counts).all() and sum(plan.values()) <= -(-most * times // 6000)


def test_linear_program_never_covers_more_than_there_is():
    counts = np.zeros(101, int)
    counts[[60, 40, 30, 10]] = [10, 10, 7, 3]
    covered = np.zeros(101)
    for pattern, times in configuration_lp(counts, 100).items():
        assert sum(pattern) <= 100
        for length in pattern:
            covered[length] += times
    assert (covered <= counts + 1e-6).all()


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack(spark, capacity):
    rows = [(i, " ".join(f"word{j * i % 97}" for j in range(i * 3 % 240)), 1, 2) for i in range(150)]
    rows += [(500, None, 1, 2), (501, "", 1, 2), (502, "long " * 5000, 1, 2), (503, "same", 1, 2), (503, "same", 1, 2)]
    want = {i: [*ids, 0] for (i, *_), ids in zip(rows, ids_of([r[1] or "" for r in rows]))}
    got = pack(spark.createDataFrame(rows, SCHEMA), PATH, capacity).collect()
    places = {}
    for r in got:
        ids = want[r.doc_id][r.piece * capacity : (r.piece + 1) * capacity]
        assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == sum(-(-len(want[r[0]]) // capacity) for r in rows)
    for runs in places.values():
        end = 0
        for offset, length in sorted(runs):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(places) <= sum(len(want[r[0]]) for r in rows) / capacity * 1.05 + 2


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_a_smaller_encoder_gives_the_same_ids():
    import public_tokenizers
    from quorate.llm.packing import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    small, large = encoder(path, most=50, most_bytes=1000), encoder(path)
    texts = [" ".join(f"word{i * 7 % 300} Other{i}," for i in range(n, n + 60)).encode() for n in range(0, 900, 30)]
    assert small is not large and small is encoder(path, most=50, most_bytes=1000)
    for i in range(0, len(texts), 3):
        assert [x.tolist() for x in small(texts[i : i + 3])] == [x.tolist() for x in large(texts[i : i + 3])]
    assert small.turn > 3


def test_workers_keep_no_words_after_packing(spark):
    def remembered(batches):
        from quorate.llm import packing

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._encoders)])], names=["n"])

    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(40)], "doc_id long, text string").repartition(8)
    assert tokenized_pieces(docs, PATH).count() == 40
    assert {r.n for r in spark.range(64).repartition(16).mapInArrow(remembered, "n long").collect()} == {0}
