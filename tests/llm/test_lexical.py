"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm.lexical import Shard, ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def model(docs, items, k):
    counts = [(doc, Counter(words(text))) for doc, text in docs if words(text)]
    big_n, big_l = len(counts), sum(sum(c.values()) for _, c in counts)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(words(text))
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def tables():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "x" * 70, "X" * 70, "y" * 49, "١٢", "A1b"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", "-", "\n", "_", "\x00", "\x85", ". "]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 10, 40]))) for i in range(150)]
    docs += [(1000 + i, "w1 w2 w3 w4") for i in range(60)]  # ties
    docs += [(7, "w9 w9"), (7, "w9 w9"), (None, "w1 w2 w3 w4"), (None, None), (2000, ""), (2001, " - "), (2002, "w5 " * 20_000)]
    items = [(i, text(6)) for i in range(12)] + [(50, "w1 w2 w3 w4"), (51, None), (52, "--"), (53, "unheard of"), (54, "w7"), (54, "w8 W7"), (None, "w3"), (55, "X" * 70 + " " + "y" * 49)]
    return docs, items


@pytest.mark.parametrize("k, most_pairs, most_docs", [(5, 1 << 16, 4096), (3, 10, 7), (50, 20, 64), (400, 1 << 16, 100)])
def test_against_all_scores(spark, k, most_pairs, most_docs):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select("*", F.lit(1).alias("n"), F.lit("a").alias("terms"), F.lit(3).alias("score"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(2))
    with_arrow = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = [tuple(r) for r in ranked_search(d, i, k, most_pairs, most_docs).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_arrow)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(model(docs, items, k), key=order)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs.limit(0), items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_few_documents_are_scored():
    rng = np.random.default_rng(3)
    impacts = rng.integers(0, 1000, (20, 500)) * (rng.random((20, 500)) < 0.3)
    impacts[:, 77] = 990
    terms, docs = np.nonzero(impacts)
    shard = Shard(500, terms, docs, impacts[terms, docs])
    left, right = rng.integers(0, 500, 200), rng.integers(0, 501, 200)
    left, right = np.minimum(left, right), np.maximum(left, right)
    sums, tops = shard.bounds(np.arange(20), left, right)
    for a, b, s, t in zip(left, right, sums, tops):
        assert s == impacts[:, a:b].max(1, initial=0).sum() and (s == 0 or a <= t < b)
    asked = []
    bounds, shard.bounds = shard.bounds, lambda rows, a, b: (asked.extend(zip(a.tolist(), b.tolist())), bounds(rows, a, b))[1]
    hits, scores, _ = shard.search(np.arange(20), 1, np.zeros(1, np.int64), 1)
    assert (hits.tolist(), scores.tolist()) == ([77], [20 * 990]) and sum(b == a + 1 for a, b in asked) < 20


def test_terms():
    assert [t.decode() for t in terms_of("Ab-c9_É\u0085x y ßZ".encode())] == words("Ab-c9_É\u0085x y ßZ")
