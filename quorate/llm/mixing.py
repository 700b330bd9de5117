"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import settle, word_count

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)


def _size_class(size: Column) -> Column:
    """Sorts as the size does: its number of binary digits, then its first three."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 3))


def _source_offset(source: Column, seed: int) -> Column:
    """One offset in [0, 1) for each source, a multiple of 2**-20 so that sums with it stay exact."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 5), 16, 10).cast("long") / F.lit(1048576.0)).cast("double")


def _slice_of(key: Column, slices: int) -> Column:
    """By a hash, so that ids in steps fall in all slices."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("long") % slices


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) -> with target: ``sum(source_size)`` shared by weight, where no target
    is above ``most`` times its source's size and what is cut off is shared again by weight.

    The level is found in closed form: sources sorted by the level at which they hit their cap;
    the first one whose cap is not hit, when all before it are capped, fixes the level."""
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("place", (F.row_number().over(by_name) - 1) % n)
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("place") == i, F.lit(float(w))).otherwise(weight)
    weighed = weighed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = weighed.select(
        "*",
        F.row_number().over(by_cap).alias("i"),
        F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
        F.sum("source_size").over(everything).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    fixed = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("i", "level"))).over(everything)
    return ranked.withColumn("at", fixed).select(
        "source",
        "source_size",
        F.when(F.col("i") < F.col("at.i"), F.col("cap").cast("double")).otherwise(F.col("at.level") * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, seed: int = 17, slices: int = 256) -> DataFrame:
    """Add to each row the number of copies that the mix takes of it.

    Within a source all documents expect the same number of copies, target / source_size. In the
    order of (size class, slice of doc_id, size, doc_id) their prefix sum, plus one offset of the
    source, crosses some integers; a document is taken once for each one crossed. Long and short
    documents are so taken in the right shares. Prefix sums need no global sort: ranks are taken
    within (source, size class, slice) and shifted by the counts of the groups before, so a source
    with a third of all rows is spread over ``slices`` times its number of size classes.

    Size is the number of words; a null text has none, and such rows and empty texts are taken as
    others are, to the same expectation, at no cost. A null source is a source, the last one. Ties
    go by doc_id; rows alike in all of these are interchangeable. Sources without any words have
    target 0 and no row is taken. An empty table gives an empty result. The input's columns stay,
    whatever their names; those named size, source_size, target, copies or taken are replaced.
    """
    names = docs.columns
    docs = docs.toDF(*(n if n in ("doc_id", "source", "text") else f"c{i}" for i, n in enumerate(names)))
    keys = ["_source", "_class", "_slice"]
    sized = (
        docs.withColumn("size", word_count(F.col("text")))
        .withColumn("_source", F.col("source"))
        .withColumn("_class", _size_class(F.col("size")))
        .withColumn("_slice", _slice_of(F.coalesce(F.col("doc_id").cast("string"), F.col("size").cast("string")), slices))
    )
    groups = settle(sized.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mixing-groups")
    totals = groups.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size"))
    targets = settle(source_targets(totals, weights, most), "mixing-targets").withColumnRenamed("source", "_of")
    before = Window.partitionBy("_source").orderBy("_class", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        groups.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(targets.hint("merge"), F.col("_source").eqNullSafe(F.col("_of")))
        .select(*(F.col(k).alias(f"{k}_g") for k in keys), "_start", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("size", F.col("doc_id").asc_nulls_first())) - 1
    on = F.col("_source").eqNullSafe(F.col("_source_g")) & (F.col("_class") == F.col("_class_g")) & (F.col("_slice") == F.col("_slice_g"))
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    joined = (
        sized.withColumn("_rank", rank)
        .join(placed.hint("merge"), on)
        .withColumn("_k", F.col("_start") + F.col("_rank"))
        .withColumn("_each", each)
        .withColumn("_offset", _source_offset(F.col("_source"), seed))
    )
    crossed = F.floor(F.col("_offset") + F.col("_each") * (F.col("_k") + 1)) - F.floor(F.col("_offset") + F.col("_each") * F.col("_k"))
    kept = [F.col(c).alias(n) for c, n in zip(docs.columns, names) if n not in ("size", "source_size", "target", "copies", "taken")]
    return joined.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).select(
        *kept,
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row repeated as often as it is taken, with the columns of ``docs``, whatever
    their names. Nulls, empty texts, ties and repeats are as in ``mix``."""
    names = docs.columns
    plain = docs.toDF(*(n if n in ("doc_id", "source", "text") else f"c{i}" for i, n in enumerate(names)))
    taken = mix(plain, **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*plain.columns).toDF(*names)


#: DuckDB SQL for what ``op3_source_mixing`` returns.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 3) AS class, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, size::VARCHAR)), 1, 4))::BIGINT % 256 AS slice FROM sized
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap FROM totals
), ranked AS (
  SELECT *, row_number() OVER o AS i,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    (sum(source_size) OVER ())::BIGINT AS total
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), levels AS (
  SELECT *, (total - capped)::DOUBLE / open_weight AS level FROM ranked
), fixed AS (
  SELECT i AS at_i, level AS at_level FROM levels WHERE level <= cap / weight ORDER BY i LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN i < at_i THEN cap::DOUBLE ELSE at_level * weight END AS target FROM levels, fixed
), placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
    ('0x' || substr(md5('17:' || coalesce(k.source, chr(0))), 1, 5))::BIGINT / 1048576.0::DOUBLE AS start,
    (row_number() OVER (PARTITION BY k.source ORDER BY k.class, k.slice, k.size, k.doc_id) - 1)::DOUBLE AS k
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(floor(start + each * (k + 1)) - floor(start + each * k), 3) * size)::BIGINT AS taken
FROM placed
"""
