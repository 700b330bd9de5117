"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import settle
from quorate.llm.vectors import all_dots, matrix, usable

_NEIGHBOUR = "query_id long, vec_id long, score double"


@dataclass
class Forest:
    """Complete binary trees; node i of a tree has children 2i + 1 and 2i + 2. ``radius`` is the
    largest norm: an extra component sqrt(radius^2 - norm^2) makes large inner products small angles."""

    planes: np.ndarray  # trees x nodes x (dim + 1)
    cuts: np.ndarray  # trees x nodes
    depth: int
    radius: float
    sample: np.ndarray  # at most sample_rows x dim

    def bounds(self, queries: np.ndarray, visits: list[list[tuple[int, int]]], k: int) -> np.ndarray:
        """A score that the k-th candidate of each query reaches at least: of the sampled vectors in
        the leaves it visits, k others do (one may be the query's own)."""
        found = np.full(len(queries), -np.inf)
        leaf_of = self.leaves(self.sample)
        for start in range(0, len(queries), 128):
            scores = queries[start : start + 128] @ self.sample.T
            for i, row in enumerate(scores, start):
                visited = np.zeros((len(self.planes), 2**self.depth), bool)
                visited[tuple(zip(*visits[i]))] = True
                there = row[np.any(np.take_along_axis(visited, leaf_of, axis=1), axis=0)]
                if len(there) > k:
                    found[i] = np.partition(there, -(k + 1))[-(k + 1)]
        return found - 1e-9 * self.radius**2

    def _lifted(self, vectors: np.ndarray, as_query: bool) -> np.ndarray:
        rest = np.zeros(len(vectors)) if as_query else np.sqrt(np.maximum(0, self.radius**2 - (vectors**2).sum(axis=1)))
        return np.hstack([vectors, rest[:, None]])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree: trees x rows."""
        lifted = self._lifted(vectors, False)
        found = np.zeros((len(self.planes), len(vectors)), np.int64)
        for tree in range(len(self.planes)):
            for _ in range(self.depth):
                at = found[tree]
                found[tree] = 2 * at + 1 + ((lifted * self.planes[tree, at]).sum(axis=1) > self.cuts[tree, at])
        return found - (2**self.depth - 1)

    def visits(self, query: np.ndarray, population: np.ndarray, least: float) -> list[tuple[int, int]]:
        """Leaves in the order of one queue that all trees share, until they hold ``least`` rows. The
        queue is ordered by the squared margins by which a path left the query's own."""
        lifted = self._lifted(query[None], True)[0]
        margins = self.planes @ lifted - self.cuts
        inner, queue, seen, held = 2**self.depth - 1, [(0.0, t, 0) for t in range(len(self.planes))], [], 0
        heapq.heapify(queue)
        while queue and held < least:
            off, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree, node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (off + margin * margin, tree, 4 * node + 3 - near))
                node = near
            seen.append((tree, node - inner))
            held += population[tree, node - inner]
        return seen


def share_for(forest: Forest, k: int, recall: float, queries: int = 128) -> float:
    """The share of all trees' rows that visits must hold to find ``recall`` of the true neighbours: as
    measured on the first ``queries`` sampled vectors against the whole sample. Of more rows the k
    nearest are nearer, so it errs to the safe side."""
    sample = forest.sample
    leaf_of = forest.leaves(sample)
    population = np.stack([np.bincount(leaves, minlength=2**forest.depth) for leaves in leaf_of])
    asked = np.arange(min(queries, len(sample)))
    scores = sample[asked] @ sample.T
    scores[asked, asked] = -np.inf
    found_at = []
    for i in asked:
        near = np.argpartition(-scores[i], min(k, len(sample) - 1) - 1)[: min(k, len(sample) - 1)]
        held, at = 0, np.ones((len(forest.planes), 2**forest.depth))
        for tree, leaf in forest.visits(sample[i], population, np.inf):
            held += population[tree, leaf]
            at[tree, leaf] = held / population.sum()
        found_at.append(np.take_along_axis(at, leaf_of[:, near], axis=1).min(axis=0))
    return float(np.quantile(np.concatenate(found_at), recall)) if len(sample) > 1 else 1.0


def grow(sample: np.ndarray, rows: int, radius: float, trees: int, leaf_rows: int, seed: int = 3) -> Forest:
    """Trees cut at medians of random projections of the sample, as deep as ``leaf_rows`` asks for and
    three levels at least, but with 16 sampled rows in a leaf."""
    depth = max(0, min(max(3, math.ceil(math.log2(max(1, rows / leaf_rows)))), int(math.log2(max(1, len(sample) / 16)))))
    nodes, rng = 2**depth - 1, np.random.default_rng(seed)
    forest = Forest(rng.normal(size=(trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)), depth, radius, sample)
    forest.planes /= np.linalg.norm(forest.planes, axis=2, keepdims=True)
    lifted = forest._lifted(sample, False)
    for tree in range(trees):
        at = np.zeros(len(sample), np.int64)
        for node in range(nodes):
            here = np.flatnonzero(at == node)
            where = lifted[here] @ forest.planes[tree, node]
            forest.cuts[tree, node] = np.median(where) if len(here) else 0.0
            at[here] = 2 * node + 1 + (where > forest.cuts[tree, node])
    return forest


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 2, share: float | None = None, recall: float = 0.96, sample_rows: int = 16_000, leaf_rows: int = 2048, block: int = 4096
) -> DataFrame:
    """For each vector whose vec_id is divisible by ``every``, its ``k`` neighbours of largest inner
    product among the candidates found.

    The trees are fitted on a sample of at most ``sample_rows`` vectors (those whose hashed vec_id is
    least); every vector is put in a leaf of each. A query visits leaves until they hold ``share`` of
    all trees' rows; by default the share at which sampled queries find ``recall`` of their neighbours
    in the sample. Vectors without any structure, whose neighbours are hardly nearer than others, need
    more than half of all; clustered ones far less. Visited leaves are compared exactly: leaves and
    their visits are cut to blocks of ``block`` rows, and each pair of blocks is a group, so a leaf
    full of copies is not one task's. Each group returns at most ``k`` rows for a query, and none below
    the k-th score among the sampled vectors of the leaves visited.

    Vectors that are null, zero or hold null or non-finite components, have a null vec_id, or are of
    another length than most, take no part. Rows that repeat a vec_id are one candidate, with the
    nearest of their vectors; a query with several vectors uses the least of them. Ties go to the
    smaller vec_id. Empty tables give empty results. Other columns are ignored.

    Returns query_id, rank (from 1), vec_id, score (in double precision, component by component)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == lengths[0])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    radius = rows.agg(F.max(norm)).first()[0]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()  # at most sample_rows
    _, once = np.unique(sample.column("vec_id").to_numpy(), return_index=True)
    grown = grow(matrix(sample.column("embedding").combine_chunks())[once], lengths[1], radius, trees, leaf_rows)
    share = share_for(grown, k, recall) if share is None else share
    forest = spark.sparkContext.broadcast(grown)

    def put(batches):
        for batch in batches:
            for tree, leaf in enumerate(forest.value.leaves(matrix(batch.column("embedding")))) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), tree, np.int32)), pa.array(leaf.astype(np.int32)), *batch.columns], names=["tree", "leaf", "vec_id", "embedding"])

    placed = rows.mapInArrow(put, "tree int, leaf int, vec_id long, embedding array<float>")
    held = np.zeros((trees, 2**forest.value.depth), np.int64)
    for tree, leaf, count in placed.groupBy("tree", "leaf").count().collect():  # trees * leaves rows; leaves are at most sample_rows / 16
        held[tree, leaf] = count
    least = share * held.sum()

    def visit(batches):
        for batch in batches:
            asked = matrix(batch.column("query"))
            seen = [forest.value.visits(q, held, least) for q in asked] if batch.num_rows else []
            bound = forest.value.bounds(asked, seen, k) if batch.num_rows else np.zeros(0)
            at = np.repeat(np.arange(len(seen)), [len(s) for s in seen])
            tree, leaf = np.array([x for s in seen for x in s], np.int32).reshape(-1, 2).T
            for part in np.array_split(np.arange(len(at)), max(1, len(at) // 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(tree[part]), pa.array(leaf[part]), *(c.take(pa.array(at[part])) for c in batch.columns), pa.array(bound[at[part]])], names=["tree", "leaf", "query_id", "query", "bound"])

    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))
    visits = settle(queries.mapInArrow(visit, "tree int, leaf int, query_id long, query array<float>, bound double"), "ann-visits")
    sizes = spark.createDataFrame([(t, leaf, int(-(-held[t, leaf] // block))) for t in range(trees) for leaf in range(held.shape[1])], "tree int, leaf int, item_blocks int")
    asked = visits.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / block).cast("int").alias("query_blocks"))
    cuts = settle(sizes.join(F.broadcast(asked), ["tree", "leaf"]).where("item_blocks > 0"), "ann-cuts")  # a row for each leaf

    def blocks(df: DataFrame, own: str, key: str, other: str, mine: str, theirs: str) -> DataFrame:
        cut = df.join(F.broadcast(cuts), ["tree", "leaf"])
        cut = cut.withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return cut.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("item_blocks", "query_blocks")

    group = ["tree", "leaf", "i", "q"]
    items = blocks(placed, "item_blocks", "vec_id", "query_blocks", "i", "q")
    asks = blocks(visits, "query_blocks", "query_id", "item_blocks", "q", "i")

    def rank(asking: pa.Table, item: pa.Table) -> pa.Table:
        item = item.sort_by("vec_id")
        ids, query_ids = item.column("vec_id").to_numpy(), asking.column("query_id").to_numpy()
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(ids) or not len(query_ids):
            return kind.empty_table()
        bound = asking.column("bound").to_numpy()
        x, q = matrix(item.column("embedding").combine_chunks()), matrix(asking.column("query").combine_chunks())
        found = []
        for part in np.array_split(np.arange(len(query_ids)), -(-len(query_ids) // 256)):
            scores = all_dots(q[part], x)
            scores[query_ids[part][:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, : k + _repeats(ids)]
            best = np.take_along_axis(scores, top, axis=1)
            row, column = np.nonzero((best > -np.inf) & (best >= bound[part][:, None]))
            found.append((query_ids[part][row], ids[top[row, column]], best[row, column]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=kind)

    near = asks.groupBy(*group).cogroup(items.groupBy(*group)).applyInArrow(rank, _NEIGHBOUR)
    by_nearness = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(by_nearness)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _repeats(ids: np.ndarray) -> int:
    """By how many rows the repeats of ids can crowd out others of a block."""
    return len(ids) - len(np.unique(ids))
