"""Lines that many documents share, dropped from all of them but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import settle

#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased and nothing else. Where all is ASCII,
    ``lower`` does the same for less."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _digest(text: Column) -> Column:
    """128 bits of SHA-256: no two keys of a corpus meet by chance or by intent."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def kept_text(lines: Column, dropped: Column) -> Column:
    """The lines without those at the sorted places ``dropped``, joined by line ends: the runs between
    dropped places, so the work is linear in the lines however many go."""
    n = F.size(dropped)
    before = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get(dropped, i - 1) + 1).alias("at"), F.when(i == n, F.size(lines)).otherwise(F.get(dropped, i)).alias("to")))
    runs = F.transform(F.filter(before, lambda r: r["to"] > r["at"]), lambda r: F.array_join(F.slice(lines, r["at"] + 1, r["to"] - r["at"]), "\n"))
    return F.when(n == 0, F.array_join(lines, "\n")).otherwise(F.array_join(runs, "\n"))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): whole texts split at line ends, without the lines whose key
    has ``least_chars`` code points or more and stands in ``least_docs`` documents or more. The largest
    doc_id that holds a key keeps all its lines of that key.

    One row for each row of ``docs``; other columns, whatever their names, play no part. A null or empty
    text is one empty line. Rows of one doc_id are one document, each with a result of its own; equal
    rows have equal results. Rows without doc_id are one document, smaller than all others. A text that
    loses every line becomes empty. An empty table gives none.

    Keys are exploded and hashed once, and written; counts are of (key, document) pairs, summed in part
    before each shuffle, so a key in a third of all documents is no large group. The join that marks
    places is a merge join of written tables, whose hot keys adaptive execution splits. Texts move once,
    to meet the places that they lose."""
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = known.select("doc_id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha"))
    lines = texts.select("doc_id", "text_sha", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keyed = lines.select("doc_id", "text_sha", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    hashed = settle(keyed.select("doc_id", "text_sha", "place", _digest(F.col("key")).alias("key")), "line-keys")
    pairs = hashed.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    repeated = pairs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= least_docs)
    repeated = settle(repeated.select("key", "keeper"), "repeated-lines")
    gone = hashed.join(repeated.hint("merge"), "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    places = gone.groupBy("doc_id", "text_sha").agg(F.sort_array(F.collect_set("place")).alias("dropped"))
    places = settle(places.select(F.col("doc_id").alias("_doc"), F.col("text_sha").alias("_sha"), "dropped"), "dropped-lines")
    met = texts.join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_sha") == F.col("_sha")), "left")
    split = met.select("doc_id", F.split("text", "\n").alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    return split.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), kept_text(F.col("lines"), F.col("dropped")).alias("kept"))


def line_dedup_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document, see ``dedup_lines``."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH rows_ AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM rows_),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
many AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 5),
marked AS (SELECT k.*, m.key IS NOT NULL AND k.doc_id IS DISTINCT FROM m.keeper AS gone FROM keyed k LEFT JOIN many m ON k.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id"""
