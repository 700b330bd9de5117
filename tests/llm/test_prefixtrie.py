"""The prefix trie against a plain model."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quorate.llm.prefixtrie import prefix_nodes

SCHEMA = "conv_id long, turn long, role string, text string"


def model(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * words(p)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def rows_of():
    rows = []
    for c in range(0, 130):
        n = (c * 7) % 5
        rows += [(c, t, "user" if t % 2 else None, ["hello there", None, "a b  c", "x"][(c // 40 + t) % 4]) for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 330) for t in range(6)]  # copies
    rows += [(c, None if t == 0 else t, "user", f"same {t}" if t < 4 else f"{c} {t}") for c in range(400, 440) for t in range(9)]  # copies that part
    rows += [(600, t, "user", "again" if t % 2 else "and again") for t in range(700)]  # a long one
    rows += [(900, 0, "user", "one turn"), (905, 0, "user", "one turn"), (None, 0, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("most", [1, 3, 50, 10_000])
def test_against_a_model(spark, most):
    rows = rows_of()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", F.lit("x").alias("path"), F.lit(1).alias("head"), F.lit(2).alias("words"))
    got = sorted(tuple(-1 if v is None else v for v in r) for r in prefix_nodes(table, most).collect())
    assert got == model(rows)


def test_empty_table_and_turnless(spark):
    assert prefix_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its only turn goes, nothing comes
    assert [tuple(r) for r in prefix_nodes(spark.createDataFrame([(one, 0, "user", "hi")], SCHEMA)).collect()] == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]
