"""Near-duplicate vectors by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import settle
from quorate.llm.components import components
from quorate.llm.vectors import matrix, row_dots, usable

#: Rotations whose codes and correction factors estimate inner products.
ESTIMATING = 2
#: Half-width of the confidence bound, in standard deviations of the estimate.
WIDTH = 6.0


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random rotations side by side: dim x (count * dim)."""
    rng = np.random.default_rng(dim)
    return np.hstack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)])


class Codes:
    """Binary codes of unit vectors: signs after each rotation, and for each estimating rotation the
    inner product of vector and code, by which an estimate is divided to be unbiased."""

    def __init__(self, vectors: np.ndarray, bits: int, bands: int) -> None:
        dim = vectors.shape[1]
        count = max(ESTIMATING, -(-bits * bands // dim))
        with np.errstate(invalid="ignore", divide="ignore"):
            largest = np.abs(vectors).max(axis=1, keepdims=True)
            unit = vectors / largest
            unit /= np.sqrt(row_dots(unit, unit))[:, None]
        turned = unit @ rotations(dim, count)
        signs = turned > 0
        packed = np.packbits(signs[:, : bits * bands].reshape(len(vectors), bands, bits), axis=2)
        wide = np.zeros((len(vectors), bands, 8), np.uint8)
        wide[:, :, : packed.shape[2]] = packed
        self.keys = wide.view(np.uint64)[:, :, 0]
        self.turned = turned[:, : ESTIMATING * dim]
        self.code = np.where(signs[:, : ESTIMATING * dim], 1.0, -1.0) / math.sqrt(dim)
        parts = (len(vectors), ESTIMATING, dim)
        self.factor = (self.code * self.turned).reshape(parts).sum(axis=2)
        self.code = (self.code.reshape(parts) / self.factor[:, :, None] / ESTIMATING).reshape(len(vectors), -1)
        self.spread = np.sqrt(((1 - np.minimum(self.factor, 1) ** 2) / self.factor**2).sum(axis=1) / max(dim - 1, 1)) / ESTIMATING

    def may_reach(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Is the upper confidence bound of the pairs' inner product at least ``least``?"""
        estimate = np.einsum("ij,ij->i", self.code[i], self.turned[j])
        return estimate + WIDTH * self.spread[i] >= least


def band_plan(n: int, least: float, missed: float) -> tuple[int, int]:
    """Bits of a band, growing with the logarithm of the rows, and the number of bands with which a
    pair at exactly ``least`` is missed with probability ``missed``."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log1p(-agree))


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position that each position is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, least: float = 0.98, missed: float = 1e-5, block: int = 1024) -> DataFrame:
    """Link vectors of equal label whose cosine is at least ``least``.

    1. Equal vectors of a label become one class with a count; copies are never paired.
    2. Each class has binary codes; bands of their bits, with the label, are its buckets. Two vectors
       at cosine 0.98 agree in 94 % of the bits, so the number of bands grows very slowly with the
       rows, and a pair at ``least`` shares none with probability ``missed`` (nearer ones with less).
    3. Buckets with more than ``block`` members are cut to blocks, and each pair of blocks is a task
       group of its own, so no label or cluster is one task's.
    4. In a group, estimates from codes and correction factors with their confidence bound rule pairs
       out; the others are computed exactly. A pair counts in the first band it shares, so it counts
       once. A group returns, for each member that has links, their number and one member it is
       connected with: never the pairs themselves.

    Vectors that are null, zero or hold null or non-finite components, or have a null label or
    vec_id, link with nothing; for them n_links is 0 and component_id their vec_id. Vectors of
    different lengths do not link. Rows that repeat a vec_id and vector are links of each other. The
    other columns are ignored. Returns vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding"))
    takes_part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # Two 64-bit hashes: at 10^10 vectors one alone would meet by chance.
    both = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "label", "embedding"))]
    rows = rows.withColumn("class", F.when(takes_part, F.unhex(F.concat(*both))))
    classes = settle(
        rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "neardup-classes",
    ).withColumn("dim", F.size("embedding"))
    n = classes.count()
    bits, bands = band_plan(n, least, missed)

    def banded(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                keys = Codes(matrix(part.column("embedding")), bits, bands).keys
                head = np.array([xxhash.xxh3_64_intdigest(f"{label}/{dim}") for label in part.column("label").to_pylist()], np.uint64)
                with np.errstate(over="ignore"):
                    for band in range(bands):
                        mixed = (head + keys[:, band] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(band * 0x2545F4914F6CDD1D & (2**64 - 1))
                        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                        yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(np.full(len(part), band, np.int32)), part.column("class")], names=["bucket", "band", "class"])

    buckets = classes.mapInArrow(banded, "bucket long, band int, class binary")
    crowded = settle(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "neardup-buckets")
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    members = (
        buckets.join(crowded.hint("merge"), "bucket")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "band", "class", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    group = ["bucket", "low", "high"]
    placed = settle(members, "neardup-members").join(classes.select("class", "copies", "embedding").hint("merge"), "class")
    placed = placed.select(*group, "band", "own", "class", "copies", "embedding").repartition(*group).sortWithinPartitions(*group)

    def compared(batches):
        def compare(table: pa.Table):
            """Of whole groups in order: the links of every pair within a group."""
            group_of = np.cumsum(np.concatenate([[False], np.any([np.diff(table.column(g).to_numpy()) != 0 for g in group], axis=0)]))
            size = np.bincount(group_of)
            last = np.cumsum(size)[group_of] - 1
            one_block = (table.column("low").to_numpy() == table.column("high").to_numpy())
            own, band = table.column("own").to_numpy(), table.column("band").to_numpy()
            dims = pa.compute.list_value_length(table.column("embedding")).to_numpy()
            vectors = matrix(table.column("embedding").combine_chunks()) if len(set(dims)) == 1 else None
            if vectors is None:
                for dim in np.unique(dims):  # never in one group
                    yield from compare(table.filter(pa.array(dims == dim)))
                return
            codes = Codes(vectors, bits, bands)
            norms = np.sqrt(row_dots(vectors, vectors))
            at, found = np.arange(len(table)), []
            for step in range(1, int(size.max())):
                at = at[at + step <= last[at]]
                for i in np.array_split(at, max(1, len(at) // 65536)):
                    j = i + step
                    i = i[one_block[i] | (own[i] != own[j])]
                    i = i[codes.may_reach(i, i + step, least)]
                    j = i + step
                    near = row_dots(vectors[i], vectors[j]) >= least * (norms[i] * norms[j])
                    i, j = i[near], j[near]
                    first = (codes.keys[i] == codes.keys[j]).argmax(axis=1) == band[i]
                    found.append((i, j, first))
            i, j, first = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
            if not len(i):
                return
            copies = table.column("copies").to_numpy()
            i, j = i[first], j[first]
            links = np.bincount(i, copies[j], len(table)) + np.bincount(j, copies[i], len(table))
            root = _local_roots(len(table), i, j)
            has = np.flatnonzero(links)
            names = table.column("class").combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(has)), pa.array(links[has].astype(np.int64)), names.take(pa.array(root[has]))], names=["class", "links", "with"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            ends = np.flatnonzero(np.any([np.diff(held.column(g).to_numpy()) != 0 for g in group], axis=0))
            if len(ends):
                cut = int(ends[-1]) + 1
                yield from compare(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield from compare(held)

    found = settle(placed.mapInArrow(compared, "class binary, links long, with binary"), "neardup-found")
    degree = found.groupBy("class").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("class").alias("a"), F.col("with").alias("b")))
    joined = settle(
        classes.select("class", "first_id", "copies").join(degree.hint("merge"), "class", "left").join(labels.select(F.col("node").alias("class"), "label").hint("merge"), "class", "left").withColumn("label", F.coalesce("label", "class")),
        "neardup-joined",
    )
    least_id = settle(joined.groupBy("label").agg(F.min("first_id").alias("component_id")), "neardup-least")
    named = settle(joined.join(least_id.hint("merge"), "label").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "neardup-named")
    return (
        rows.select("vec_id", "class")
        .join(named.hint("merge"), "class", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
