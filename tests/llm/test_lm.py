import math
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from quorate.llm.lm import Attention, Prior, SentPrior, Shape, kinds_of_texts, lm_scores, numbering, windows

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, score string, n_words int"
SMALL = Shape(top=64, others=4, kinds=3, warm_batch=16)


def corpus():
    rng = random.Random(5)
    kinds = [[f"{a}{b}" for a in heads for b in ("an", "er", "on", "et")] for heads in (("th", "wh", "st"), ("sch", "ver", "ge"))]
    rows = [(i, " ".join(rng.choices(rng.choice(kinds), k=rng.randint(5, 40))) + "\n End.", "s", 1) for i in range(400)]
    return rows + [(900, None, "s", 1), (901, "", "s", 1), (902, "THAN than " * 4000, "s", 1), (903, "é ñ 日本", "s", 1), (903, "é ñ 日本", "s", 1), (None, "than", "s", 1)]


def test_base_scores_equal_a_plain_count_and_the_model_is_better(spark):
    rows = corpus()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, text, *_ in rows:
        if not held(i):
            counts.update([*words(text), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    want = {}
    for i, text, *_ in rows:
        tokens = [*words(text), "\n"]
        base = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        want[i] = (held(i), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6))
    got = lm_scores(spark.createDataFrame(rows, SCHEMA), PATH, SMALL, frequent=8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) == want[r.doc_id]
        assert r.score < 0
    some = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)


def tiny():
    shape = Shape(top=4, others=3, kinds=2, width=4, scored=6, context=3, stride=2, vocabulary=12, end=11)
    uni = np.zeros(12, np.int64)
    uni[[3, 4, 5, 6, 8, 11]] = 60, 31, 12, 10, 2, 59
    index = numbering(uni, shape)[1]
    grids = np.zeros((2, 8, 7), np.float32)
    for kind, before, after, n in [(0, -1, 3, 50), (0, 3, 4, 30), (0, 3, 11, 20), (0, 4, 11, 30), (1, -1, 5, 10), (1, 5, 6, 10), (1, 6, 11, 10), (1, 6, 8, 2)]:
        grids[kind, 7 if before < 0 else index[before], index[after]] += n
    prior = pickle.loads(pickle.dumps(Prior(uni, np.flatnonzero(grids), grids[grids > 0], shape)))
    model = Attention(prior, shape)
    rng = np.random.default_rng(0)
    for name in model.names:
        setattr(model, name, rng.normal(0, 0.7, getattr(model, name).shape).astype(np.float32))
    return prior, model


def plain_log_probability(ids, prior, model):
    """Token by token, place by place: what the batches compute."""
    s, total = model.shape, 0.0
    tokens = [int(prior.index[i]) for i in ids]
    chance = prior.chance.reshape(prior.start + 1, prior.start, s.kinds)
    for t, token in enumerate(tokens):
        first = t // s.scored * s.scored  # of the window
        asked = first + (t - first) // s.stride * s.stride  # the last token that is read is the one before it
        span = [prior.start] * (s.context + 1) + tokens
        window = span[first : first + s.context + (asked - first) + 1]
        x = np.stack([model.embed[w] + model.place[i] for i, w in enumerate(window)]).astype(float)
        weight = np.exp((x @ model.key) @ (x[-1] @ model.query) * s.width**-0.5)
        read = np.tanh(weight @ (x @ model.value) / weight.sum())
        share = np.exp(model.gate @ read + model.bias)
        total += math.log(share @ chance[tokens[t - 1] if t else prior.start, token] / share.sum()) + prior.rest_log[ids[t]]
    return total


def test_prior_equals_a_plain_discount():
    shape = Shape(top=3, others=1, kinds=2, vocabulary=4, end=3)
    uni, grids = np.array([5, 4, 3, 9]), np.random.default_rng(2).integers(0, 3, (2, 5, 4)).astype(np.float32)
    prior = pickle.loads(pickle.dumps(Prior(uni, np.flatnonzero(grids), grids[grids > 0], shape)))
    seen = (grids > 0).sum(axis=1)
    of_all = (seen.sum(axis=0) + shape.smooth) / (seen.sum() + 4 * shape.smooth)

    def discounted(row, below):
        off = shape.discount * (row > 0).sum() + 0.01
        return [(max(n - shape.discount, 0) + off * b) / (row.sum() + 0.01) for n, b in zip(row, below)]

    for kind in (0, 1):
        own = (seen[kind] + 100 * of_all) / (seen[kind].sum() + 100)
        for row in range(5):
            below = shape.shared * np.array(discounted(grids[:, row].sum(axis=0), of_all)) + (1 - shape.shared) * own
            want = discounted(grids[kind, row], below)
            assert np.allclose(prior.chance.reshape(5, 4, 2)[row, :, kind], want, rtol=1e-5) and abs(sum(want) - 1) < 1e-6


def test_kinds_of_texts_are_told_apart():
    rng = np.random.default_rng(1)
    counts = np.array([rng.multinomial(60, np.roll([0.4, 0.3, 0.2, 0.1, 0, 0, 0, 0], 4 * (i % 2))) for i in range(80)], float)
    of = (counts @ kinds_of_texts(counts, 2).T).argmax(axis=1)
    assert len(set(of[::2])) == len(set(of[1::2])) == 1 and of[0] != of[1]
    assert np.allclose(np.exp(kinds_of_texts(np.zeros((0, 8)), 2)).sum(axis=1), 1)
    assert np.isfinite(kinds_of_texts(np.zeros((3, 8)), 5)).all()


def test_batched_windows_equal_a_plain_forward_pass():
    prior, model = tiny()
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(3, 9, n), 11).astype(np.uint16) for n in (0, 1, 5, 6, 7, 40)]
    got = model.log_probability(texts, prior, at_once=3)
    assert np.allclose(got, [plain_log_probability(t, prior, model) for t in texts], rtol=1e-4)


def test_probabilities_sum_to_one():
    prior, model = tiny()
    start = np.array([3, 4, 3, 5, 6, 3, 3, 4], np.uint32)
    texts = [np.append(start, np.uint32(i)) for i in range(12)]
    whole = model.log_probability([start], prior)[0]
    assert abs(np.exp(model.log_probability(texts, prior) - whole).sum() - 1) < 1e-4


def test_windows_score_each_token_once():
    prior, model = tiny()
    shape = model.shape
    index = np.arange(23, dtype=np.int32) % 4
    rows = windows(index, prior.start, shape)
    scored = rows[:, shape.context + 1 :].reshape(-1)
    assert scored[:23].tolist() == index.tolist() and (scored[23:] == -1).all()
    assert (rows[1:, : shape.context + 1] == rows[:-1, shape.scored :]).all()


def test_gradients():
    prior, model = tiny()
    rng = np.random.default_rng(1)
    prior.chance = prior.chance.astype(float)
    for name in (*model.names, "open"):
        setattr(model, name, getattr(model, name).astype(float))
    rows = windows(np.arange(13, dtype=np.int32) % 5, prior.start, model.shape)
    _, g = model.gradients(rows, prior)
    for name in model.names:
        value = getattr(model, name)
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(4)]:
            old, h = value[at], 1e-3
            value[at] = old + h
            up = model.gradients(rows, prior)[0]
            value[at] = old - h
            down = model.gradients(rows, prior)[0]
            value[at] = old
            assert abs((up - down) / (2 * h) - g[name][at]) < 5e-4


def test_large_arrays_are_kept():
    shape = Shape()
    rng = np.random.default_rng(3)
    uni, cells = rng.integers(1, 50, shape.vocabulary), np.unique(rng.integers(0, shape.size * (shape.size + 1), 1000))
    prior = SentPrior(Prior(uni, cells, np.ones(len(cells), np.float32), shape))
    model, rows = Attention(prior, shape), windows(rng.integers(0, shape.size, 128 * 64).astype(np.int16), prior.start, shape)
    for work in (model.gradients, model.log_of_windows):
        work(rows, prior)
        tracemalloc.start()
        work(rows, prior)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 2 << 20  # the weights of these windows alone are 2.5 MB


def test_large_weights_are_bounded():
    prior, model = tiny()
    model.query, model.key = 50 * model.query, 50 * model.key
    assert model._made()[1] and np.isfinite(model.log_probability([np.array([3, 4, 5, 6, 3, 11], np.uint16)], prior)).all()


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], SCHEMA), PATH, SMALL).collect() == []


def test_what_is_sent_is_near_what_was_counted():
    rng = np.random.default_rng(4)
    shape = Shape(top=30, others=3, kinds=2, vocabulary=60, end=59)
    uni = rng.integers(0, 50, 60)
    grids = rng.integers(0, 900, (2, 34 * 33)) * (rng.random((2, 34 * 33)) < 0.3)
    cells = np.flatnonzero(grids)
    prior = Prior(uni, cells, grids.reshape(-1)[cells].astype(np.float32), shape)
    sent = pickle.loads(pickle.dumps(SentPrior(prior)))
    pairs = np.arange(34 * 33)
    assert sent.coded.nbytes == 2 * 34 * 33 * 2 and not hasattr(sent, "cells")
    assert np.allclose(sent.of_pairs(pairs), prior.of_pairs(pairs), rtol=1 / 6000)
