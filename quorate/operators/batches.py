"""Batches of rows, predictions aligned to them, and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.operators.prefix import dealt_by_ranges


class PredictionError(ValueError):
    """A submission that breaks a rule; ``kind`` is its name in ``ERRORS``."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


# Error kinds and their codes.
ERRORS = {
    "UNSPECIFIED": 0,
    "SERVER_NEVER_STARTED": 1,
    "SERVER_CONNECTION_FAILED": 2,
    "SERVER_RAISED_EXCEPTION": 3,
    "SERVER_MISSING_ENDPOINT": 4,
    "GATEWAY_RAISED_EXCEPTION": 5,
    "INVALID_SUBMISSION": 6,
    "GRPC_DEADLINE_EXCEEDED": 7,
}


def row_numbers(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Number rows from 0 in ``order``, without one task that sees them all, even where all rows tie:
    a row's number is its place in its range plus the counts of the ranges before. Nulls come first."""
    dealt = dealt_by_ranges(df, order, "row-numbers")
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # ``starts`` has a row for each shuffle partition.
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def batch_slices(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Consecutive slices of ``n`` rows: batch_id and row_in_batch, both from 0."""
    return row_numbers(df, order, "_no").withColumn("batch_id", F.floor(F.col("_no") / n)).withColumn("row_in_batch", F.col("_no") % n).drop("_no")


def default_row_id(df: DataFrame, order: list[str], fmt: str | None = "prob_%d") -> DataFrame:
    """An id column where the table has none: the row's number in ``order``, formatted."""
    if "id" in df.columns:
        return df.withColumn("id", F.col("id").cast("string"))
    numbered = row_numbers(df, order, "_no")
    return numbered.withColumn("id", F.format_string(fmt, F.col("_no")) if fmt else F.col("_no").cast("string")).drop("_no")


def shuffle_key(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A permutation that depends on keys and seed only, not on partitions."""
    return df.orderBy(shuffle_key(F.col(key), seed), key)


def batch_row_check(expected: DataFrame, received: DataFrame) -> DataFrame:
    """(batch_id, expected, received, kind, message) of every batch; kind is null where all is well.

    ``expected`` and ``received`` have a row for each row with its batch_id, whatever else it holds. A
    batch without rows has one row that stands for it, with true in a column ``empty``."""

    def rows_of(df: DataFrame, name: str) -> DataFrame:
        here = ~F.coalesce("empty", F.lit(False)) if "empty" in df.columns else F.lit(True)
        return df.groupBy("batch_id").agg(F.count_if(here).alias(name))

    return check_counts(rows_of(expected, "expected").join(rows_of(received, "received"), "batch_id", "full"))


def check_counts(counts: DataFrame) -> DataFrame:
    """The same from (batch_id, expected, received); null where a side has no such batch."""
    none, missing = F.col("received").isNull(), F.coalesce("expected", F.lit(0)) == 0
    wrong = F.col("received") != F.col("expected")
    # The kinds and messages of a batch that fails.
    return counts.select(
        "batch_id",
        F.coalesce("expected", F.lit(0)).alias("expected"),
        "received",
        F.when(none, "INVALID_SUBMISSION").when(missing, "GATEWAY_RAISED_EXCEPTION").when(wrong, "INVALID_SUBMISSION").alias("kind"),
        F.when(none, "No prediction received")
        .when(missing, "Missing row IDs for batch")
        .when(wrong, F.format_string("Invalid predictions: expected %d rows but received %d", F.coalesce("expected", F.lit(0)), "received"))
        .alias("message"),
    )


def custom_checks(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for every row and rule that does not hold; null counts as not."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def attach_row_ids(ids: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids beside predictions of the same place: id columns first, which replace equal names."""
    place = ["batch_id", "row_in_batch"]
    id_columns = [c for c in ids.columns if c not in place]
    rest = [c for c in predictions.columns if c not in place and c not in id_columns]
    return ids.join(predictions.select(*place, *rest), place).select(*id_columns, *rest)


def order_columns(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.select(*ids, *(c for c in df.columns if c not in ids))


def relaxed_union(frames: list[DataFrame]) -> DataFrame:
    """One below the other, numbers widened; other differences of types or columns are errors."""
    first = frames[0]
    for frame in frames[1:]:
        if len(frame.columns) != len(first.columns):
            raise PredictionError("INVALID_SUBMISSION", "Inconsistent prediction column counts")
        for a, b in zip(first.schema.fields, (frame.schema[f.name] if f.name in frame.columns else None for f in first.schema.fields)):
            if b is None or (a.dataType != b.dataType and not (isinstance(a.dataType, T.NumericType) and isinstance(b.dataType, T.NumericType))):
                raise PredictionError("INVALID_SUBMISSION", "Inconsistent prediction types")
    out = first
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def outer_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def classify_error(message: Column, kind: Column, endpoint: Column) -> Column:
    """(kind, details) of a failed call, by the first rule that fits."""
    # What messages hold, and the details they become.
    raised = F.regexp_extract(message, '(?d)(?i)"Exception calling application: (.*)"', 1)
    has = lambda text: message.contains(text)

    def made(name: str, details: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), details.cast("string").alias("details"))

    return (
        F.when(kind.isin("gaierror", "RuntimeError") & has("Failed to connect to server after waiting"), made("SERVER_NEVER_STARTED", F.lit(None)))
        .when(message.contains(F.concat(F.lit("No listener for "), endpoint, F.lit(" was registered"))), made("SERVER_MISSING_ENDPOINT", F.concat(F.lit("Server did not register a listener for "), endpoint)))
        .when(has("Exception calling application"), made("SERVER_RAISED_EXCEPTION", F.when(raised != "", raised).otherwise(message)))
        .when(kind == "InactiveRpcError", made("SERVER_CONNECTION_FAILED", message))
        .when(kind == "DeadlineError", made("GRPC_DEADLINE_EXCEEDED", message))
        .otherwise(made("UNSPECIFIED", message))
    )


def error_code(kind: Column) -> Column:
    code = F.lit(None).cast("int")
    for name, number in ERRORS.items():
        code = F.when(kind == name, F.lit(number)).otherwise(code)
    return code


def run_status(violations: DataFrame) -> DataFrame:
    """One row from (batch_id, kind, message): the first failing batch decides."""
    worst = violations.where("kind is not null").agg(F.min(F.struct("batch_id", "kind", "message")).alias("w"))
    return worst.select(
        F.col("w").isNull().alias("Succeeded"),
        error_code(F.col("w.kind")).alias("ErrorType"),
        F.col("w.kind").alias("ErrorName"),
        F.nullif(F.substring("w.message", 1, 8000), F.lit("")).alias("ErrorDetails"),
    )
