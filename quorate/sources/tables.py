"""Reading problems and answers; writing submissions, traces and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quorate.functions.numeric import round_1
from quorate.functions.text import first_nonempty
from quorate.operators.attempts import assemble_trace
from quorate.operators.prefix import ordered_segments
from quorate.sources.scratch import scratch_path


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_no, record): the records of CSV files, which may hold line ends in quotes; one file
    is read by as many tasks as it has blocks.

    A line begins a record if an even number of quotes stands before it in its file. Quotes are counted
    for each block of a file, carried on over the blocks (few rows), and then from line to line within
    each block; so are the record numbers, from 0. Doubled quotes count twice and change nothing. Lines
    end with \\n; a \\r before it belongs to it outside quotes. A quote in the midst of an unquoted
    field is not CSV, and joins what follows. Empty lines between records are left out.

    Files are scanned once, and the lines written: where a scan cuts a file into blocks follows from how
    many cores there are at the time, so two scans may cut it otherwise."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    quotes = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))
    lines, scanned = lines.withColumn("quotes", quotes.cast("long")), scratch_path(spark, "csv-lines")
    lines.write.parquet(scanned)
    lines = spark.read.schema(lines.schema).parquet(scanned)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q")).select("file", "block", F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("quotes_before"))
    in_block = Window.partitionBy("file", "block").orderBy("at")
    before = F.col("quotes_before") + F.coalesce(F.sum("quotes").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (before % 2 == 0) & (F.rtrim("line", F.lit("\r")) != "")
    marked = lines.join(blocks.hint("merge"), ["file", "block"]).withColumn("inside", before % 2 == 1).withColumn("begins", starts.cast("long"))
    begun = marked.groupBy("file", "block").agg(F.sum("begins").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begun_before"))
    numbered = marked.join(begun.hint("merge"), ["file", "block"]).where("inside or begins = 1")
    numbered = numbered.withColumn("record_no", F.col("begun_before") + F.sum("begins").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "line"))), lambda p: p["line"])
    return numbered.groupBy("file", "record_no").agg(F.regexp_replace(F.array_join(parts, "\n"), "\\r$", "").alias("record"))


#: Without charToEscapeQuoteEscaping the parser takes it to be the character 0, and drops that from texts.
_CSV = {"escape": '"', "charToEscapeQuoteEscaping": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("maxCharsPerColumn", -1).csv(path, header=True, escape='"').columns


def scan_problems(spark: SparkSession, path: str, columns: str = "id string, problem string", empty_is_null: bool = True) -> DataFrame:
    """CSV files with header whose quoted fields may hold commas, quotes and line ends, in the order of the
    files' names and of their records; see ``csv_records``. Ids stay text. ``columns`` must be the header's.
    A missing or empty field is null; without ``empty_is_null``, one that is empty in quotes is an empty text."""
    names = _header(spark, path)
    wanted = StructType.fromDDL(columns).fieldNames()
    if [n.lower() for n in names] != [n.lower() for n in wanted]:
        raise ValueError(f"{path} has the columns {', '.join(names)}, not {', '.join(wanted)}")
    records = csv_records(spark, path).where("record_no > 0").orderBy("file", "record_no")  # the first of each file is its header
    if empty_is_null:
        return records.select(F.from_csv("record", columns, _CSV).alias("r")).select("r.*")
    # The parser takes a missing field, and a text that is the mark, for null; no text is both marks.
    first, second = (F.from_csv("record", columns, _CSV | {"nullValue": mark}) for mark in ("\0 null", "\0 none"))
    return records.select(*(F.coalesce(first[n], second[n]).alias(n) for n in wanted))


def scan_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, answer), or None where the file has no answers."""
    names = _header(spark, path)
    if "answer" not in names:
        return None
    return scan_problems(spark, path, ", ".join(f"`{n}` string" for n in names)).select("id", F.col("answer").try_cast("int").alias("answer"))


def problem_column(df: DataFrame) -> DataFrame:
    """The problem text from whichever of problem and question exist."""
    return df.withColumn("problem", first_nonempty(*(F.col(c) for c in ("problem", "question") if c in df.columns)))


def merge_page_text(pages: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Page texts by line ends in page order; a null text is empty. With ``limit`` in segments of so many
    bytes, see ``ordered_segments``: (keys, segment, text)."""
    if limit is not None:
        return ordered_segments(pages, keys, "page_no", F.coalesce("text", F.lit("")), limit, "\n")
    parts = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def choose_source(verified: DataFrame, extracted: DataFrame, min_rows: int = 10) -> DataFrame:
    """The verified table if it has ``min_rows`` rows, else the extracted one; decided in the plan."""
    enough = F.broadcast(verified.agg((F.count("*") >= min_rows).alias("_enough")))  # one row
    return verified.join(enough).where("_enough").drop("_enough").unionByName(extracted.join(enough).where("not _enough").drop("_enough"))


def write_submission_csv(df: DataFrame, path: str, ids: tuple = ("id",), values: tuple = ("answer",)) -> None:
    df.select(*ids, *values).write.option("header", True).csv(path)


def write_submission_parquet(df: DataFrame, path: str, ids: list[str]) -> None:
    df.select(*ids, *(c for c in df.columns if c not in ids)).write.parquet(path)


def trace_records(problems: DataFrame, scored: DataFrame, messages: DataFrame, attempts: DataFrame) -> DataFrame:
    """(id, problem, answer, expected, correct, time_s, attempts): a record for each scored problem.

    ``problems`` has problem_id and problem, ``scored`` what ``join_expected`` gives, with time_s (to one
    decimal here); attempts and their messages are nested as ``assemble_trace`` does. Correct is null
    where nothing is expected; attempts where a problem has none."""
    told = scored.select("problem_id", "answer", "expected", "correct", round_1(F.col("time_s")).alias("time_s")).join(problems.select("problem_id", "problem"), "problem_id", "left")
    nested = assemble_trace(messages, attempts, told)
    return nested.select(F.col("problem_id").alias("id"), "problem", "answer", "expected", "correct", "time_s", "attempts")


def write_traces(df: DataFrame, path: str) -> None:
    """A JSON record for each problem, nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_score_summary(summary: DataFrame, path: str, results: DataFrame | None = None, most_results: int = 100_000) -> bool:
    """One JSON record: the row of ``summary`` with ``results`` in it, in the order of their first column.

    An array in one record is bounded: where there are more than ``most_results`` of them, they are
    written beside it, to ``path``/results, a record each. Returns whether they are in the record, which
    is in ``path``/summary."""
    within = results is not None and results.limit(most_results + 1).count() <= most_results
    if within:
        listed = results.agg(F.array_sort(F.collect_list(F.struct(*results.columns))).alias("results"))
        summary = summary.join(F.broadcast(listed))  # one row each
    elif results is not None:
        results.write.option("ignoreNullFields", "false").json(f"{path}/results")
    summary.coalesce(1).write.option("ignoreNullFields", "false").json(f"{path}/summary")
    return within
