import math
import random

import numpy as np

from quorate.llm.ann import grow, nearest
from quorate.llm.neardup import Codes, band_plan, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, links string"


def unit(rng, d=32):
    v = [rng.gauss(0, 1) for _ in range(d)]
    return [float(np.float32(x)) for x in v]


def near(rng, v, spread):
    return [float(np.float32(x + rng.gauss(0, spread))) for x in v]


def vectors(n=600):
    rng = random.Random(8)
    rows = []
    bases = [unit(rng) for _ in range(20)]
    for i in range(n):
        v = near(rng, rng.choice(bases), rng.choice([0, 0.1, 0.15, 0.2])) if rng.random() < 0.5 else unit(rng)
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2]), "x"))
    rows += [(5000 + i, bases[0], 1, "x") for i in range(40)]
    nan, inf = float("nan"), float("inf")
    rows += [(6000, None, 0, "x"), (6001, [0.0] * 32, 0, "x"), (6002, [nan] + [1.0] * 31, 0, "x"), (6003, [inf] + [1.0] * 31, 0, "x"), (6004, [None] + [1.0] * 31, 0, "x"), (6005, bases[1], None, "x"), (6006, [], 0, "x"), (6007, [1.0, 0.0], 0, "x"), (6008, [2.0, 0.0], 0, "x")]
    return rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_duplicates_equal_all_pairs(spark):
    rows = vectors()
    links, label = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    edges = []
    for i, (a, x, p, _) in enumerate(rows):
        for b, y, q, _ in rows[:i]:
            if p is not None and p == q and good(x) and good(y) and len(x) == len(y):
                if sum(s * t for s, t in zip(x, y)) >= 0.98 * math.sqrt(sum(s * s for s in x)) * math.sqrt(sum(t * t for t in y)):
                    edges.append((a, b))
                    links[a] += 1
                    links[b] += 1
    for _ in range(50):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((i, links[i], label[i], label[i] == i) for i in links)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    y = x + rng.normal(size=x.shape) * 0.5
    both = Codes(np.vstack([x, y]), 8, 4)
    i, j = np.arange(4000), np.arange(4000, 8000)
    true = (x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    off = np.einsum("ij,ij->i", both.code[i], both.turned[j]) - true
    assert abs(off.mean()) < 0.003 and (np.abs(off) <= 6 * both.spread[i]).all()
    assert both.may_reach(i, j, 0.98)[true >= 0.98].all()


def test_bands_grow_slowly():
    (b0, n0), (b1, n1) = band_plan(10**4, 0.98, 1e-5), band_plan(10**8, 0.98, 1e-5)
    assert b1 > b0 and n1 < 4 * n0


def brute_nearest(rows, k, every):
    """As the contract says; rows of 32 components only."""
    found = {}
    usable = [(i, v) for i, v, *_ in rows if good(v) and len(v) == 32]
    for i, v in usable:
        if i % every == 0:
            scores = sorted((-sum(s * t for s, t in zip(v, w)), j) for j, w in usable if j != i)
            found[i] = [(j, -s) for s, j in scores[:k]]
    return found


def test_nearest_finds_most_and_ranks_exactly(spark):
    rows = vectors()
    want = brute_nearest(rows, 20, 20)
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), leaf_rows=40, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    table = {i: v for i, v, *_ in rows}
    for i, found in got.items():
        assert [x[0] for x in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        assert all(abs(s - sum(a * b for a, b in zip(table[i], table[j]))) < 1e-9 for _, j, s in found)
        hits += len({x[1] for x in found} & {j for j, _ in want[i]})
    assert hits >= 0.9 * 20 * len(want)


def test_nearest_with_all_leaves_is_exact(spark):
    rows = vectors(200)
    want = brute_nearest(rows, 5, 20)
    got = nearest(spark.createDataFrame(rows, SCHEMA), k=5, share=1.0, leaf_rows=30).orderBy("query_id", "rank").collect()
    assert {i: [j for j, _ in v] for i, v in want.items()} == {i: [r.vec_id for r in got if r.query_id == i] for i in want}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == [] and nearest(empty).collect() == []


def test_small_tables_have_trees_too(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(25, 16))
    x = (centre[np.arange(500) % 25] + 0.3 * rng.normal(size=(500, 16))).astype(np.float32)
    assert grow(x.astype(float), 500, 9.0, 2, 2048).depth >= 3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    want = {i: set(np.argsort(-exact[i])[:20].tolist()) for i in range(0, 500, 20)}
    for share, least in ((0.3, 0.9), (0.55, 0.95)):
        found = {}
        for r in nearest(frame, share=share).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(found[i] & want[i]) / 20 for i in want]) >= least
