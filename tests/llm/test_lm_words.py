from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quorate.llm.lm import Adam, Attention, Prior, Shape, windows, windows_of, word_table
from quorate.llm.packing import ChunkIds, WordIds, words_of

PATH = public_tokenizers.path("word_bpe_49k.json")
LATIN = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0x100)]))
TEXTS = [
    "Than then, don't stop. 12th a.b.. ,. x. \t\n\x0b\x0c\r end", "", " \n ", LATIN, " ".join(LATIN), "élan ÉLAN élan İstanbul ẞß œuvre ª º ÷ naïve. señor,",
    "日本 語。 word joined  wide \x1c\x1f", "<|endoftext|> and <|startoftext|>a", "word " * 50, "über $$$%%% mañana!!! ñandú's",
]


def test_words_equal_a_plain_split():
    odd = [bytes([c]) + b"a" + bytes([c, c]) + b"B" + bytes([c]) for c in range(256)] + [t.encode() for t in TEXTS] + [b"\xff\xfe x", bytes(range(256))]
    texts = pa.array([b"before", *odd, None, b"after"], pa.binary()).slice(1, len(odd) + 1)
    for at_once in (1, 40, 1 << 20):
        found = []
        for words, counts in words_of(texts, at_once):
            flat, ends = words.to_pylist(), np.cumsum(counts).tolist()
            assert len(flat) == sum(counts)
            found += [flat[a:b] for a, b in zip([0, *ends], ends)]
        assert found == [*(t.lower().split() for t in odd), []]


def test_ids_are_the_tokenizer_s():
    plain, encode = Tokenizer.from_file(PATH), WordIds(PATH, most=12)  # forgets at each turn
    texts = pa.array([t.encode() for t in TEXTS], pa.binary())
    for _ in range(3):
        for text, of in zip(TEXTS, encode.numbers(texts)):
            assert encode.ids(text.encode(), of).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert encode.turn == 2
    broken = [b"\xff\xfeab \xe9l", b"a\xcc"]
    assert [encode.ids(t, of).tolist() for t, of in zip(broken, encode.numbers(pa.array(broken, pa.binary())))] == [x.tolist() for x in ChunkIds(PATH)(broken)]


def test_words_are_counted_in_parts(spark):
    texts = [f"w{i % 7} w{i} W{i % 3}" for i in range(40)] + [None, ""]
    found = word_table(spark.createDataFrame([(t,) for t in texts], "text string"), most=3).collect()
    want = Counter(w.encode() for t in texts for w in (t or "").lower().split())
    assert {bytes(r.word): r.n for r in found} == want and len(found) == len(want)


def small():
    shape = Shape(top=30, others=3, kinds=2, width=4, scored=6, context=3, vocabulary=60, end=59)
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(0, 34 * 33 * 2, 300))
    return Prior(rng.integers(1, 50, 60), cells, np.ones(len(cells), np.float32), shape), shape, rng


def test_windows_of_several_texts():
    prior, shape, rng = small()
    texts = [rng.integers(0, 60, n).astype(np.uint16) for n in (1, 6, 7, 0, 40, 12)]
    every, n = windows_of(texts, prior)
    assert n.tolist() == [1, 1, 2, 0, 7, 2]
    assert (every == np.concatenate([windows(prior.index[t], prior.start, shape) for t in texts if len(t)])).all()
    assert windows_of([], prior)[0].shape == (0, shape.context + shape.scored + 1)


def test_a_step_makes_its_products_once():
    prior, shape, rng = small()
    model, made = Attention(prior, shape), []
    model._made = lambda: made.append(1) or Attention._made(model)
    Adam(model).step(windows(rng.integers(0, 33, 6 * 300).astype(np.int16), prior.start, shape), prior, 0.01)
    assert made == [1]  # one for each 128 windows before
    made.clear()
    model.log_probability([rng.integers(0, 60, 6 * 300).astype(np.uint16)], prior)
    assert made == [1]
