import zlib

import pytest

from quorate.llm.sharding import BinTree, best_fit_decreasing, shard_by_bytes, tightest_capacity

SCHEMA = "doc_id long, text string, shard string, size int"


def test_tree_takes_the_tightest():
    tree = BinTree()
    for key in [(5, 1), (9, 2), (7, 3), (7, 4)]:
        tree.insert(key)
    assert [tree.pop_tightest(6), tree.pop_tightest(6), tree.pop_tightest(6), tree.pop_tightest(6), tree.pop_tightest(1)] == [(7, 3), (7, 4), (9, 2), None, (5, 1)]


def test_best_fit_decreasing_equals_a_plain_scan():
    import random

    rng = random.Random(3)
    for _ in range(50):
        sizes, capacity = [rng.randint(1, 60) for _ in range(rng.randint(0, 80))], 60
        rooms, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
            if not fits:
                rooms.append(capacity)
                fits = [(capacity, len(rooms) - 1)]
            want[i] = min(fits)[1]
            rooms[want[i]] -= sizes[i]
        assert best_fit_decreasing(sizes, capacity) == want


def test_capacity_is_near_the_even_share():
    capacity, placed = tightest_capacity(list(range(1, 400)), 8)
    assert max(placed) < 8 and capacity <= 1.01 * sum(range(1, 400)) / 8


@pytest.mark.parametrize("hot", [0, 60])
def test_shards(spark, hot):
    rows = [(i, f"text {i % 150} " * (1 + i % 7), "s", 1) for i in range(900)] + [(1000 + i, "hot copy", "s", 1) for i in range(hot)]
    rows += [(2000, None, "s", 1), (2001, "", "s", 1), (2002, "x" * 5000, "s", 1), (2002, "x" * 5000, "s", 1), (None, "é", "s", 1)]
    got = shard_by_bytes(spark.createDataFrame(rows, SCHEMA), slices=16).collect()
    assert len(got) == len(rows)
    texts = {}
    for doc_id, text, *_ in rows:
        texts.setdefault(doc_id, text or "")
    shard_of, sizes, slots = {}, {}, {}
    for r in got:
        text = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        assert shard_of.setdefault(text, r.shard) == r.shard
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= 1.1 * max(sum(sizes.values()) / 8, 10_002)


def test_empty_table(spark):
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA)).collect() == []
