"""Running sums, numbers and bounded pieces of ordered rows, none of them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.sources.scratch import scratch_path


def dealt_by_ranges(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """The rows in ranges of ``order``, written, with ``_range`` and ``_place`` (from 0) in it.

    Ranges follow a sample of the rows and of a random number that breaks ties, so neither a far value
    nor one that most rows share makes a large one. The sorted table is written, as ranges may fall
    otherwise when computed anew. Nulls come first; tied rows are in no certain order."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the place in the lower 33
    tied = df.withColumn("_tie", F.rand(20_240_501))
    placed = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("_at", place)
    placed.write.parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    return written.withColumn("_range", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], label: str = "prefix-sums") -> DataFrame:
    """Add, for each name in ``values``, the sum of its column over the rows of the same ``keys`` that
    come before in ``order``; 0 for the first, nulls count as 0. Rows of equal ``order`` come one after
    the other.

    Each range sums what it has of a key; a key's sums, one for each of its ranges, are carried on by a
    window over these few rows; and the running sums within are of one key in one range. So a key with
    most rows, or no key at all, still is many tasks."""
    dealt = dealt_by_ranges(df, [*keys, *order], label)
    safe = {name: F.coalesce(value, F.lit(0)) for name, value in values.items()}
    by = ["_range", *keys]
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of_range = dealt.groupBy(*by).agg(*(F.sum(v).alias(f"_sum_{n}") for n, v in safe.items()))
    carried = of_range.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(by)), *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in safe))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & dealt[c].eqNullSafe(F.col(f"_c{i}"))
    within = Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(carried.hint("merge"), same)
    for name, value in safe.items():
        met = met.withColumn(name, F.col(f"_carry_{name}") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return met.select(*(c for c in df.columns if c not in values), *values)


def ordered_segments(df: DataFrame, keys: list[str], order: str, text: Column, limit: int = 16 << 20, sep: str = "", end: str = "") -> DataFrame:
    """(keys, segment, text): the texts of a key joined in order, in segments from 0 on that hold some
    ``limit`` bytes each; joined without anything between, the segments of a key are its whole text. A
    text counts to the segment in which it begins, so that no value is larger than ``limit`` and one
    text, however many rows a key has. Null texts are left out; ``sep`` stands between texts, ``end``
    after the last one. Equal places are in no certain order."""
    known = df.select(*keys, F.col(order).alias("_order"), text.alias("_text")).where("_text is not null")
    size = F.octet_length("_text") + len(sep.encode())
    summed = prefix_sums(known, keys, ["_order"], {"_before": size.cast("long"), "_row": F.lit(1).cast("long")}, "segments")
    # The first place is part of the sort key, as tied places may stand in several ranges.
    piece = F.struct("_row", F.when(F.col("_row") > 0, F.concat(F.lit(sep), "_text")).otherwise(F.col("_text")).alias("t"))
    cut = summed.groupBy(*keys, F.floor(F.col("_before") / limit).alias("_segment")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "").alias("text"))
    by = Window.partitionBy(*keys).orderBy("_segment")
    last = F.lead("_segment").over(by).isNull()
    return cut.withColumn("segment", F.row_number().over(by) - 1).withColumn("text", F.when(last, F.concat("text", F.lit(end))).otherwise(F.col("text"))).select(*keys, "segment", "text")
