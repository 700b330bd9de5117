"""Sharding by best-fit decreasing over indivisible groups of equal texts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import settle


class BinTree:
    """Balanced (randomised treap) tree of open bins, ordered by (remaining capacity, bin)."""

    def __init__(self, seed: int = 7) -> None:
        self._random = random.Random(seed)
        self._root: list | None = None  # [key, priority, left, right]

    def insert(self, key: tuple[int, int]) -> None:
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, [key, self._random.random(), None, None]), right)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the smallest key with at least ``size`` of remaining capacity."""
        left, right = self._split(self._root, (size, -1))
        if right is None:
            self._root = left
            return None
        node, parent = right, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self._root = self._merge(left, right)
        return node[0]

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item. Items enter, largest first, the bin with the least room that still
    holds them; a new bin opens where none does. An item above the capacity gets its own bin."""
    tree, bins, placed = BinTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.pop_tightest(sizes[i])
        if found is None:
            found, bins = (max(capacity, sizes[i]), bins), bins + 1
        placed[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return placed


def tightest_capacity(sizes: list[int], shards: int, steps: int = 4096) -> tuple[int, list[int]]:
    """The smallest capacity, in steps of 1/``steps`` of the even share, for which best-fit
    decreasing needs no more than ``shards`` bins, and the bins. An item above the even share has a
    bin of its own, and the others share the rest evenly."""
    rest, bins = sum(sizes), shards
    for size in sorted(sizes, reverse=True):
        if bins == 1 or size * bins <= rest:
            break
        rest, bins = rest - size, bins - 1
    least = max(1, -(-rest // bins))
    step = max(1, least // steps)
    capacity = least
    while True:
        placed = best_fit_decreasing(sizes, capacity)
        if max(placed, default=0) < shards:
            return capacity, placed
        capacity += step


def shard_by_bytes(docs: DataFrame, shards: int = 8, bundles: int = 4096, large_per_shard: int = 512, slices: int = 1024) -> DataFrame:
    """Deal documents to ``shards`` shards of near-equal bytes, equal texts to the same shard.

    Groups of equal texts of at least 1/(shards * large_per_shard) of all bytes are placed one
    by one: there can be no more than shards * large_per_shard of them, at any input size. All
    smaller groups are dealt by their digest to ``bundles`` bundles, and each bundle is placed as
    one item. So the packing itself, on the driver, sees at most ``bundles + shards *
    large_per_shard`` sizes, and so many rows are broadcast.

    Size is the UTF-8 length plus one; a null text counts as empty and shares its group. Rows
    that repeat a doc_id are kept, each with a slot of its own. A group larger than an even share
    makes its shard larger than the others, as it may not be divided. An empty table gives an
    empty result. Columns of the input other than doc_id and text are ignored.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard)
    and grown_shard (null).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(text.cast("binary"))
    rows = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(digest).alias("group"),
            (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % bundles).alias("bundle"),
        ),
        "sharding-rows",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    floor = max(1, -(-total // (shards * large_per_shard)))
    groups = rows.groupBy("group", "bundle").agg(F.sum("size").alias("bytes"))
    is_large = F.col("bytes") >= floor
    units = (
        groups.groupBy(F.when(~is_large, F.col("bundle")).alias("bundle"), F.when(is_large, F.col("group")).alias("group"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # at most bundles + shards * large_per_shard rows
    )
    units.sort(key=lambda u: (-u.bytes, -1 if u.bundle is None else u.bundle, bytes(u.group or b"")))
    _, placed = tightest_capacity([u.bytes for u in units], shards)
    of_group = spark.createDataFrame([(bytes(u.group), s) for u, s in zip(units, placed) if u.group is not None], "group binary, group_shard int")
    of_bundle = spark.createDataFrame([(u.bundle, s) for u, s in zip(units, placed) if u.group is None], "bundle long, bundle_shard int")
    dealt = (
        rows.join(F.broadcast(of_group), "group", "left")
        .join(F.broadcast(of_bundle), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("group_shard", "bundle_shard").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"))
    )
    # Slots: ranks within (shard, slice), shifted by what the earlier slices of the shard hold.
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "slice")
        .agg(F.count("*").alias("n"))
        .select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # shards * slices rows
    )
    rank = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id")) - 1
    return (
        dealt.withColumn("rank", rank)
        .join(starts.hint("merge"), ["shard", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
