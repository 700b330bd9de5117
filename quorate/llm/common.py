"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as a word everywhere: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set, a temporary one in local mode, as in tests;
    on a cluster that would be one machine's, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="quorate-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/quorate"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost
    executors, and gives the optimizer true sizes."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def gapless_rank(df: DataFrame, keys: list[str], order: list, slice_of: Column, slices: int, label: str, name: str = "rank") -> DataFrame:
    """Add a rank from 0, without gaps, within ``keys``: ranks within (keys, slice), shifted by the
    counts of the slices before. A key with most of the rows is so spread over ``slices`` groups.
    ``df`` should be a written table, as it is read twice."""
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(slice_of), F.lit(slices)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"),
        label,
    )
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)) - 1)
    return ranked.join(starts.hint("merge"), [*keys, "_slice"]).withColumn(name, F.col("_start") + F.col("_rank")).drop("_slice", "_start", "_rank")
