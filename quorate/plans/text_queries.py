"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions import numeric as N
from quorate.functions import text as T
from quorate.plans.bindings import bound, query, table

# The patterns of answers, think blocks and code, as the oracle's engine writes them.
_S = T.SPACE
_STRIP = rf"regexp_replace(@, '\A[{_S}]+|[{_S}]+$', '', 'g')"
_RSTRIP = rf"regexp_replace(@, '[{_S}]+$', '')"
_STATED = rf"f[iIıİ]nal[{_S}]+an[sSſ]wer[{_S}]+[iIıİ][sSſ][{_S}]*@([0-9,]+)"


def sql_strip(x):
    return _STRIP.replace('@', x)


def _sql_number(x, pattern):
    d = rf"try_cast(replace(regexp_extract_all({x}, '{pattern}', 1)[-1], ',', '') AS DECIMAL(38,0))"
    return f"CASE WHEN {d} BETWEEN 0 AND 99999 THEN {d}::INT END"


def sql_answer(x, variant="colon"):
    return f"coalesce({_sql_number(x, '(?i)' + T.BOXED)}, {_sql_number(x, '(?i)' + _STATED.replace('@', f'[:{_S}]*' if variant == 'colon' else ''))})"


def sql_think(x):
    return sql_strip(rf"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')")


def sql_blocks(x):
    return rf"regexp_extract_all({x}, '{T.CODE_BLOCK}', 1)"


@query(f"SELECT doc_id, {sql_answer('reply')} AS answer, {sql_answer('reply', 'strict')} AS strict FROM b_replies", "replies")
def extract_answer(spark, d):
    return bound(spark, d, "replies").select("doc_id", T.extract_answer(F.col("reply")).alias("answer"), T.extract_answer(F.col("reply"), "strict").alias("strict"))


@query(rf"SELECT doc_id, regexp_extract_all(reply, '(?i){T.BOXED}', 1)[-1] AS found FROM b_replies", "replies")
def last_match(spark, d):
    return bound(spark, d, "replies").select("doc_id", T.last_match(F.col("reply"), f"(?iu){T.BOXED}").alias("found"))


@query("SELECT doc_id, doc_id * 7 BETWEEN 0 AND 99999 AS fits FROM documents")
def answer_in_range(spark, d):
    return table(spark, d, "documents").select("doc_id", T.in_range(F.col("doc_id") * 7).alias("fits"))


@query(f"SELECT doc_id, md5({sql_think('reply')}) AS digest FROM b_replies", "replies")
def strip_think(spark, d):
    return bound(spark, d, "replies").select("doc_id", F.md5(T.strip_think(F.col("reply")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len({sql_blocks('reply')})::INT AS n, array_to_string({sql_blocks('reply')}, '|') AS code FROM b_replies", "replies")
def extract_code_blocks(spark, d):
    blocks = T.extract_code_blocks(F.col("reply"))
    return bound(spark, d, "replies").select("doc_id", F.size(blocks).alias("n"), F.array_join(blocks, "|").alias("code"))


@query(f"SELECT doc_id, coalesce(nullif({sql_answer('clean')}, 0), {sql_answer('reply')}) AS answer FROM (SELECT *, {sql_think('reply')} AS clean FROM b_replies)", "replies")
def answer_clean_or_raw(spark, d):
    return bound(spark, d, "replies").select("doc_id", T.answer_clean_or_raw(F.col("reply")).alias("answer"))


@query(f"SELECT doc_id, array_to_string(CASE WHEN len({sql_blocks('clean')}) > 0 THEN {sql_blocks('clean')} ELSE {sql_blocks('reply')} END, '|') AS code FROM (SELECT *, {sql_think('reply')} AS clean FROM b_replies)", "replies")
def code_clean_or_raw(spark, d):
    return bound(spark, d, "replies").select("doc_id", F.array_join(T.code_clean_or_raw(F.col("reply")), "|").alias("code"))


@query("SELECT conv_id, turn, CASE WHEN coalesce(stderr, '') <> '' THEN '<think>' || stderr || '</think>' || chr(10) || coalesce(stdout, '') ELSE coalesce(stdout, '') END AS reply FROM b_outputs", "outputs")
def wrap_reasoning(spark, d):
    return bound(spark, d, "outputs").select("conv_id", "turn", T.wrap_reasoning(F.col("stderr"), F.col("stdout")).alias("reply"))


@query("SELECT conv_id, turn, coalesce(nullif(stdout, ''), nullif(stderr, ''), '') AS problem FROM b_outputs", "outputs")
def first_nonempty(spark, d):
    return bound(spark, d, "outputs").select("conv_id", "turn", T.first_nonempty(F.col("stdout"), F.col("stderr")).alias("problem"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS preview FROM documents")
def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.text_preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, length(text)::INT AS n FROM documents WHERE length(text) > 300")
def min_length_filter(spark, d):
    return table(spark, d, "documents").where(F.length("text") > 300).select("doc_id", F.length("text").alias("n"))


@query("SELECT item_id, text || ' Answer with one integer.' AS prompt FROM benchmark")
def append_suffix(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.append_suffix(F.col("text"), "Answer with one integer.").alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id < 10 THEN 'prob_0' || doc_id ELSE 'prob_' || doc_id END AS id FROM documents")
def problem_id_from_num(spark, d):
    return table(spark, d, "documents").select("doc_id", T.problem_id(F.col("doc_id")).alias("id"))


@query("SELECT page_id, '20240102_030405_' || replace(regexp_extract(url, '[^/]*$', 0), '.gguf', '') AS name FROM pages")
def run_name(spark, d):
    return table(spark, d, "pages").select("page_id", T.run_name(F.col("url"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("name"))


@query("SELECT event_id, 42 + event_id AS plus, ((42 + event_id) * (42 + event_id))::BIGINT AS squared FROM events")
def attempt_seed(spark, d):
    return table(spark, d, "events").select("event_id", N.attempt_seed(F.col("event_id")).alias("plus"), N.attempt_seed(F.col("event_id"), "power").alias("squared"))


@query(r"SELECT seq, regexp_replace(frame_a, '\x1b\[[0-9;]*m', '', 'g') AS clean FROM b_exec_log WHERE frame_a IS NOT NULL", "exec_log")
def strip_ansi(spark, d):
    return bound(spark, d, "exec_log").where("frame_a is not null").select("seq", T.strip_ansi(F.col("frame_a")).alias("clean"))


@query(r"SELECT seq, regexp_replace(frame_a, '\x1b\[[0-9;]*m', '', 'g') || CASE WHEN contains(frame_b, 'ipython-input') THEN frame_b ELSE '' END AS tool, regexp_replace(frame_a, '\x1b\[[0-9;]*m', '', 'g') || chr(10) || frame_b AS plain FROM b_exec_log WHERE frame_a IS NOT NULL", "exec_log")
def filter_traceback(spark, d):
    frames = F.array("frame_a", "frame_b")
    return bound(spark, d, "exec_log").where("frame_a is not null").select("seq", T.filter_traceback(frames).alias("tool"), T.filter_traceback(frames, "plain").alias("plain"))


_O, _E = "coalesce(stdout, '')", "coalesce(stderr, '')"


def sql_output(o, e, variant):
    if variant == "plain":
        o, e = _RSTRIP.replace('@', o), _RSTRIP.replace('@', e)
        return f"CASE WHEN {e} <> '' AND {o} <> '' THEN {o} || chr(10) || {e} WHEN {e} <> '' THEN {e} WHEN {o} <> '' THEN {o} ELSE '{T.NO_OUTPUT['plain']}' END"
    return f"CASE WHEN {e} <> '' AND {o} <> '' THEN {_RSTRIP.replace('@', o)} || chr(10) || {e} WHEN {e} <> '' THEN {e} WHEN {sql_strip(o)} <> '' THEN {o} ELSE '{T.NO_OUTPUT['tool']}' END"


@query(f"SELECT conv_id, turn, {sql_output(_O, _E, 'plain')} AS plain, {sql_output(_O, _E, 'tool')} AS tool FROM b_outputs", "outputs")
def format_exec_output(spark, d):
    return bound(spark, d, "outputs").select("conv_id", "turn", *(T.format_exec_output(F.col("stdout"), F.col("stderr"), v).alias(v) for v in ("plain", "tool")))


@query(f"SELECT conv_id, '{T.FEEDBACK[0]}' || string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) || '{T.FEEDBACK[1]}' AS message FROM conversations GROUP BY conv_id")
def join_exec_outputs(spark, d):
    from quorate.operators.attempts import ordered_texts

    return ordered_texts(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("text")).select("conv_id", T.join_exec_outputs(F.col("texts")).alias("message"))


@query(
    f"""SELECT doc_id, CASE WHEN contains(l, 'print') OR contains(l, 'import') OR l = '' OR starts_with(l, '#') THEN code
    ELSE array_to_string(list_append(p[1:len(p) - 1], 'print(' || l || ')'), chr(10)) END AS code
    FROM (SELECT *, {sql_strip('p[-1]')} AS l FROM (SELECT doc_id, code, string_split({sql_strip('code')}, chr(10)) AS p FROM b_code))""",
    "code",
)
def ensure_last_print(spark, d):
    return bound(spark, d, "code").select("doc_id", T.ensure_last_print(F.col("code")).alias("code"))


@query("SELECT conv_id, turn, starts_with(m, '[ERROR]') OR contains(m, 'Traceback') AS failed FROM (SELECT *, CASE turn % 4 WHEN 0 THEN '[ERROR] ' || text WHEN 1 THEN text || ' Traceback' ELSE text END AS m FROM conversations)")
def is_tool_error(spark, d):
    m = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("[ERROR] "), "text")).when(F.col("turn") % 4 == 1, F.concat("text", F.lit(" Traceback"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_tool_error(m).alias("failed"))


@query("SELECT seq, CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END AS text FROM b_exec_log", "exec_log")
def ensure_trailing_newline(spark, d):
    return bound(spark, d, "exec_log").select("seq", T.ensure_trailing_newline(F.col("text")).alias("text"))


_CUT = "b"
for _marker in ("Answer:", "Solution:"):
    _CUT = sql_strip(f"string_split({sql_strip(_CUT)}, '{_marker}')[1]")


@query(
    rf"""SELECT doc_id, num, problem FROM (
    SELECT doc_id, n::INT AS num, regexp_replace({_CUT}, '(?i)^Problem:[{_S}]*', '') AS problem FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '\bProblem[{_S}]+([0-9]+)\b', 1)) AS n, unnest(regexp_split_to_array(text, '\bProblem[{_S}]+[0-9]+\b')[2:]) AS b FROM b_problem_texts)
    ) WHERE length(problem) > 20""",
    "problem_texts",
)
def split_problems_by_header(spark, d):
    return bound(spark, d, "problem_texts").select("doc_id", F.inline(T.split_problems(F.col("text"))))


@query(
    rf"""SELECT doc_id, CASE WHEN n::INT < 10 THEN 'prob_0' || n::INT ELSE 'prob_' || n::INT END AS id, {sql_strip('body')} AS problem FROM (
    SELECT doc_id, regexp_extract(text, '(?s)Problem[{_S}]+([0-9]+)[{_S}]*[.\n][{_S}]*Problem:', 1) AS n,
      regexp_extract(text, '(?s)Problem[{_S}]+[0-9]+[{_S}]*[.\n][{_S}]*Problem:[{_S}]*(.*?)(\nAnswer:|\nSolution:)', 1) AS body FROM b_problem_texts)
    WHERE n <> '' AND length({sql_strip('body')}) > 30""",
    "problem_texts",
)
def extract_problem_blocks(spark, d):
    return bound(spark, d, "problem_texts").select("doc_id", F.inline(T.extract_problem_blocks(F.col("text"))))




@query(
    """SELECT vec_id, round(sum(-exp(lp) * log2(exp(lp))), 6) AS entropy FROM (
    SELECT vec_id, (i - 1) // 8 AS position, -abs(e::DOUBLE) * 10 AS lp FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))
    WHERE exp(lp) > 0 GROUP BY vec_id"""
)
def token_entropy(spark, d):
    logs = F.transform("embedding", lambda e: -F.abs(e.cast("double")) * 10)
    return table(spark, d, "embeddings").select("vec_id", F.round(N.token_entropy(logs), 6).alias("entropy"))


@query(
    """SELECT v.vec_id, coalesce(m, CAST('Infinity' AS DOUBLE)) AS entropy FROM embeddings v LEFT JOIN (
    SELECT vec_id, round(avg(h), 6) AS m FROM (
      SELECT vec_id, position, sum(-exp(lp) * log2(exp(lp))) AS h FROM (
        SELECT vec_id, (i - 1) // 8 AS position, -abs(e::DOUBLE) * 10 AS lp FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))
      WHERE vec_id % 10 <> 3 AND NOT (position = 2 AND vec_id % 3 = 0) GROUP BY vec_id, position) GROUP BY vec_id) m ON v.vec_id = m.vec_id"""
)
def mean_entropy(spark, d):
    logs = F.transform("embedding", lambda e: -F.abs(e.cast("double")) * 10)
    none = F.array().cast("array<double>")
    positions = F.array(*(F.when((F.lit(p == 2) & (F.col("vec_id") % 3 == 0)) | (F.col("vec_id") % 10 == 3), none).otherwise(F.slice(logs, 8 * p + 1, 8)) for p in range(8)))
    return table(spark, d, "embeddings").select("vec_id", F.round(N.mean_entropy(positions), 6).alias("entropy"))


@query("SELECT vec_id, len(list_filter(range(0, 8), lambda p: NOT (p = 2 AND vec_id % 3 = 0)))::INT AS positions FROM embeddings")
def skip_empty_logprobs(spark, d):
    none = F.array().cast("array<float>")
    positions = F.array(*(F.when(F.lit(p == 2) & (F.col("vec_id") % 3 == 0), none).otherwise(F.slice("embedding", 8 * p + 1, 8)) for p in range(8)))
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter(positions, lambda m: F.size(m) > 0)).alias("positions"))


@query("SELECT event_id, format('{:.1f}', value)::DOUBLE AS seconds, format('{:.1f}', floor(value * 20) / 20)::DOUBLE AS halves FROM events")
def round_1(spark, d):
    return table(spark, d, "events").select("event_id", N.round_1(F.col("value")).alias("seconds"), N.round_1(F.floor(F.col("value") * 20).cast("double") / 20).alias("halves"))


@query(
    """SELECT source, printf('%.0f', 100.0 * count(*) FILTER (lang = 'en') / count(*)) AS share FROM documents GROUP BY source
    UNION ALL SELECT 'eighths ' || doc_id, printf('%.0f', 100.0 * (doc_id % 9) / 8) FROM documents"""
)
def percent(spark, d):
    docs = table(spark, d, "documents")
    eighths = docs.select(F.concat(F.lit("eighths "), F.col("doc_id").cast("string")).alias("source"), N.percent(F.col("doc_id") % 9, F.lit(8)).alias("share"))
    return docs.groupBy("source").agg(N.percent(F.count_if(F.col("lang") == "en"), F.count("*")).alias("share")).unionByName(eighths)


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<think>' || role || '</think>' || chr(10) || text ELSE text END AS reply FROM conversations")
def chat_reply(spark, d):
    message = F.struct(F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("reasoning_content"))
    response = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.chat_reply(response).alias("reply"))
