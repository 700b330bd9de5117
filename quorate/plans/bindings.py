"""The driver's tables seen as replies, attempts, chunks, logs and so on.

Each binding is one SQL text that both Spark and the oracle run, over whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_BOX = "chr(92) || 'boxed' || chr(123)"
_FENCE = "chr(96) || chr(96) || chr(96)"

BOUND = {
    # Texts as replies: every way an answer, a think block or code can stand in them.
    "replies": f"""
SELECT doc_id, CASE doc_id % 10
  WHEN 0 THEN text
  WHEN 1 THEN '<think>' || text || '</think> So ' || {_BOX} || CAST(doc_id AS STRING) || chr(125)
  WHEN 2 THEN text || ' ' || {_BOX} || ' 1,' || CAST(100 + doc_id % 900 AS STRING) || ' ' || chr(125) || ' or ' || {_BOX} || CAST(doc_id AS STRING) || '00000' || chr(125)
  WHEN 3 THEN text || ' The FINAL  answer is: ' || CAST(doc_id AS STRING) || '.'
  WHEN 4 THEN '<think>' || text || {_BOX} || '5' || chr(125)
  WHEN 5 THEN '<think>' || {_BOX} || '7' || chr(125) || '</think>' || text || {_BOX} || '0' || chr(125) || '  '
  WHEN 6 THEN {_FENCE} || 'python' || chr(10) || 'x = ' || CAST(doc_id AS STRING) || chr(10) || {_FENCE} || text || {_FENCE} || 'python ' || chr(10) || 'print(x)' || chr(10) || {_FENCE}
  WHEN 7 THEN '<think>' || {_FENCE} || 'python' || chr(10) || 'y = 1' || chr(10) || {_FENCE} || '</think> ' || text
  WHEN 8 THEN text || {_BOX} || ',' || chr(125) || ' so the final answer is 4'
  ELSE '  ' || text || ' ' || chr(92) || 'BOXED ' || chr(123) || '12' || chr(125) || ' Final answer is 13' || chr(10)
END AS reply, text, lang, source FROM documents""",
    # Twelve attempts a problem, in the order of events.
    "attempts": """
SELECT CAST(floor(event_id / 12) AS BIGINT) AS problem_id, CAST(event_id % 12 AS INT) AS attempt, event_id AS completion_seq,
  CASE WHEN event_type = 'error' OR CAST(floor(event_id / 12) AS BIGINT) % 50 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 3 AS INT) END AS answer,
  CASE WHEN event_id % 11 = 0 OR CAST(floor(event_id / 12) AS BIGINT) % 17 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS entropy,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS tokens, value, event_type, user_id, ts FROM events""",
    # Turns of an attempt: the events of a user.
    "turns": """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS turn, event_type,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS tokens, event_type IN ('purchase', 'error') AS is_call, event_type = 'error' AS is_error,
  CASE WHEN event_type = 'view' THEN CAST(CAST(floor(value) AS BIGINT) % 100 AS INT) END AS answer, value, ts, event_id FROM events""",
    # Words of texts as chunks of one turn, with boxed numbers split over some of them.
    "chunks": f"""
SELECT doc_id AS problem_id, CAST(0 AS INT) AS attempt, CAST(0 AS INT) AS turn, chunk_no, CAST(CASE WHEN chunk_no % 13 = 5 THEN 0 ELSE 1 END AS INT) AS n_tokens,
  CASE WHEN doc_id % 4 = 0 AND chunk_no = 20 THEN {_BOX} WHEN doc_id % 4 = 0 AND chunk_no = 21 + doc_id % 40 THEN chr(125)
    WHEN doc_id % 4 = 0 AND chunk_no BETWEEN 21 AND 62 THEN CASE WHEN chunk_no = 22 THEN '7' ELSE ' ' END
    WHEN doc_id % 4 = 1 AND chunk_no = 30 THEN {_BOX} || CAST(doc_id AS STRING) || chr(125) WHEN chunk_no = 40 THEN chr(125) ELSE word END AS text
FROM (SELECT doc_id, CAST(place AS INT) AS chunk_no, word FROM WORDS)""",
    # Messages of a run: the events of a user on a day.
    "exec_log": """
SELECT CAST(user_id AS STRING) || ' ' || substring(CAST(ts AS STRING), 1, 10) AS exec_id, event_id AS seq, CAST(user_id % 5 AS STRING) AS parent_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'execute_result' WHEN 'signup' THEN 'status' ELSE 'stream' END AS msg_type,
  CASE event_type WHEN 'view' THEN 'stdout' WHEN 'click' THEN 'stderr' END AS stream_name,
  CASE WHEN event_id % 9 = 0 THEN ' ' ELSE event_type || CAST(event_id AS STRING) || CASE WHEN event_id % 2 = 0 THEN chr(10) ELSE '' END END AS text,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN CAST(value AS STRING) || chr(10) ELSE CAST(event_id AS STRING) END END AS plain_text,
  CASE WHEN event_type = 'error' THEN chr(27) || '[31mError' || chr(27) || '[0m' || CAST(event_id AS STRING) END AS frame_a,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'File "lib.py"' ELSE 'File "ipython-input-1"' END END AS frame_b,
  CASE WHEN event_type = 'signup' THEN 'idle' END AS execution_state, value AS elapsed_s FROM events""",
    "pages": "SELECT conv_id AS doc, turn AS page_no, CASE WHEN turn % 7 = 3 THEN NULL ELSE text END AS text FROM conversations",
    "outputs": "SELECT conv_id, turn, role, CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 5 = 1 THEN '  ' ELSE text || chr(10) END AS stdout, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN NULL ELSE 'warn' || chr(10) || ' ' END AS stderr, text FROM conversations",
    "code": """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || chr(10) || 'x' WHEN 1 THEN text || chr(10) || '# done' WHEN 2 THEN 'a = 1' || chr(10) || '   a + ' || CAST(doc_id AS STRING) || chr(10) || chr(10)
  WHEN 3 THEN 'sprinting' WHEN 4 THEN '  ' ELSE 'import math' || chr(10) || text END AS code FROM documents""",
    # Problem collections: labelled parts of different lengths.
    "problem_texts": """
SELECT doc_id, 'Intro' || chr(10) || 'Problem ' || CAST(doc_id % 200 AS STRING) || '.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Problem: ' ELSE 'problem:  ' END || text || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN 'Answer: 5' WHEN doc_id % 3 = 1 THEN 'Solution: see' ELSE 'End' END || chr(10) || 'Problem  7' || chr(10) || 'Problem: too short' || chr(10) || 'Answer: 1' AS text FROM documents""",
    "expected_rows": "SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS batch_id, CASE WHEN CAST(floor(o_orderkey / 10) AS BIGINT) % 41 = 7 THEN NULL ELSE o_orderkey END AS id FROM orders",
    "received_rows": "SELECT DISTINCT CAST(floor(l_orderkey / 10) AS BIGINT) AS batch_id, l_orderkey AS id FROM lineitem WHERE CAST(floor(l_orderkey / 10) AS BIGINT) % 29 <> 3",
    "failures": """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'gaierror' WHEN 4 THEN 'InactiveRpcError' WHEN 5 THEN 'DeadlineError' ELSE 'RuntimeError' END AS kind, 'predict' AS endpoint,
  CASE doc_id % 7 WHEN 0 THEN 'Failed to connect to server after waiting ' || text WHEN 1 THEN text || ' No listener for predict was registered'
    WHEN 2 THEN 'x "Exception calling application: bad "value" ' || CAST(doc_id AS STRING) || '" y' WHEN 3 THEN 'Exception calling application, ' || text ELSE text END AS message FROM documents""",
    "path_list": """
SELECT CASE page_id % 9 WHEN 0 THEN path || '/.hidden' WHEN 1 THEN path || '/../x' WHEN 2 THEN path || '//y' WHEN 3 THEN path || '/' WHEN 4 THEN '/same/path' WHEN 5 THEN path || '/./z' ELSE path || '/p' || CAST(page_id AS STRING) END AS path, page_id
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '/$', '') AS path FROM pages)""",
    "runs": "SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS generated_tokens, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE CAST(l_linenumber AS BIGINT) END AS prompt_tokens, CASE WHEN l_suppkey % 10 = 0 THEN 0.0 ELSE round(l_extendedprice) END AS elapsed_s FROM lineitem",
}
_WORDS = {
    "spark": "SELECT doc_id, posexplode(split(text, ' ')) AS (place, word) FROM {documents}",
    "duckdb": "SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS place FROM documents",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = BOUND[name].replace("FROM WORDS", f"FROM ({_WORDS['spark']})")
    sql = re.sub(rf"FROM ({'|'.join(TABLES)})\b", r"FROM {\1}", sql)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def with_bound(sql: str, *names: str) -> str:
    """The oracle's SQL with bindings before it."""
    parts = [f"b_{n} AS ({BOUND[n].replace('FROM WORDS', 'FROM (' + _WORDS['duckdb'] + ')')})" for n in names]
    return ("WITH " if parts else "") + ", ".join(parts) + ("" if not parts else (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)) if parts else sql


def query(sql: str | None, *names: str):
    """Register a query by its function's name, with the oracle's SQL over the named bindings."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_bound(sql, *names)
        return f

    return register
