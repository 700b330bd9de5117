import zlib

import numpy as np
import public_tokenizers

from quorate.llm.common import settle
from quorate.llm.lm import Shape, fit, grid_counts, id_counts, lm_scores, numbering

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, score string, n_words int"
UNTRAINED = Shape(top=64, others=4, kinds=2, warm_passes=0)


def ordered(spark, texts):
    """Scores of two more rows with the same words, in the corpus's order and reversed."""
    some = iter(i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    right, wrong = next(some), next(some)
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(right, "one two three four " * 5, "s", 1), (wrong, "four three two one " * 5, "s", 1)]
    found = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(rows, SCHEMA), PATH, UNTRAINED).collect()}
    return found[right], found[wrong]


def test_counts_see_the_order_of_words(spark):
    right, wrong = ordered(spark, ["one two three four " * 10] * 40)
    assert right > wrong + 5


def test_attention_is_trained_on_every_learning_row(spark):
    rng, kind = np.random.default_rng(3), np.dtype("<u2")
    shape = UNTRAINED
    lists = [np.append(rng.integers(5, 90, rng.integers(0, 300)), shape.end).astype(kind) for _ in range(101)]
    frame = spark.createDataFrame([(i, i, bytearray(x.tobytes())) for i, x in enumerate(lists)], "row long, doc_id long, ids binary").repartition(3)
    _, model, seen = fit(settle(frame, "test-ids"), shape)
    assert seen == sum(-(-len(x) // shape.scored) for x in lists)
    assert np.abs(model.bias).max() > 0
    uni = id_counts(frame, shape)
    index, profiles = numbering(uni, shape)[1], rng.normal(0, 1, (2, shape.size)).astype(np.float32)
    cells, n = grid_counts(frame, index, profiles, shape, flush=50)
    want = np.zeros((2, shape.size + 1, shape.size))
    grids = want.copy()
    grids.reshape(-1)[cells] = n
    for x in lists:
        kind = (profiles @ np.bincount(index[x], minlength=shape.size)).argmax()
        np.add.at(want[kind], (np.append(shape.size, index[x][:-1]), index[x]), 1)
    assert (grids == want).all() and (want.sum(axis=(1, 2)) > 0).all()
    grid = grids.sum(axis=0)
    assert grid.sum() == sum(map(len, lists)) and grid[-1].sum() == len(lists)
    assert (uni == np.bincount(np.concatenate(lists), minlength=shape.vocabulary)).all()


def test_attention_is_asked_at_every_place():
    from types import SimpleNamespace

    from quorate.llm.lm import Attention, Shape

    shape = Shape()
    model = Attention(SimpleNamespace(start=shape.size), shape)
    assert model.asked.tolist() == list(range(shape.context, shape.context + shape.scored))
    token = np.random.default_rng(3).integers(0, shape.size, (1, shape.context + shape.scored))
    read, other = model._read(token), token.copy()
    other[0, shape.context + 5] += 1
    changed = np.abs(model._read(other) - read).max(axis=2)[0] > 0
    assert not changed[:5].any() and changed[5:8].all()  # the next token's shares know of it already


def test_kinds_come_from_every_learning_row(spark, monkeypatch):
    from quorate.llm import lm

    rng, shape, seen = np.random.default_rng(5), Shape(top=64, others=4, kinds=2, warm_rows=12, warm_passes=0), []
    lists = [np.append(rng.integers(*((5, 25) if i % 3 else (35, 55)), 60), shape.end).astype("<u2") for i in range(120)]
    frame = settle(spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(lists)], "row long, ids binary").repartition(3), "test-kinds")
    monkeypatch.setattr(lm, "grid_counts", lambda ids, index, profiles, shape, whole=lm.grid_counts: seen.append(profiles) or whole(ids, index, profiles, shape))
    fit(frame, shape)
    uni = np.bincount(np.concatenate(lists), minlength=shape.vocabulary)
    index = numbering(uni, shape)[1]
    whole = np.bincount(index, uni, shape.size) + 0.05
    want = [sum(np.bincount(index[x], minlength=shape.size) for i, x in enumerate(lists) if (i % 3 > 0) == kind) + 20 * whole / whole.sum() for kind in (True, False)]
    got = sorted(np.exp(seen[0]), key=lambda p: -p[index[10]])
    assert np.allclose(got, [w / w.sum() for w in want], rtol=1e-4)


def test_no_parameter_comes_from_a_few_rows_alone(spark):
    rng, shape = np.random.default_rng(6), Shape(top=64, others=4, kinds=2, warm_rows=1, warm_passes=2)
    lists = [np.append(rng.integers(5, 60, 200), shape.end).astype("<u2") for _ in range(40)]
    frame = settle(spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(lists)], "row long, ids binary").repartition(2), "test-few")
    _, _, seen = fit(frame, shape)
    windows = sum(-(-len(x) // shape.scored) for x in lists)
    assert seen == 2 * windows  # few steps for a task: all rows are gone through again, not some
