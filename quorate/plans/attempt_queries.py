"""Queries over attempts, votes, turns, chunks and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions import text as T
from quorate.operators import attempts as A
from quorate.operators import scoring, votes
from quorate.plans.bindings import bound, query, table
from quorate.plans.text_queries import sql_answer, sql_output

_RANKS = """ranks AS (
  SELECT problem_id, answer, count(*) AS votes, min(completion_seq) AS first_seq,
    row_number() OVER (PARTITION BY problem_id ORDER BY count(*) DESC, min(completion_seq))::INT AS rank
  FROM {} WHERE answer IS NOT NULL GROUP BY problem_id, answer)"""


def _cut(k):
    return f"""counted AS (
  SELECT *, CASE WHEN answer IS NOT NULL THEN count(answer) OVER (PARTITION BY problem_id, answer ORDER BY completion_seq ROWS UNBOUNDED PRECEDING) END AS rc FROM b_attempts
), cut AS (
  SELECT * EXCLUDE (rc, stop) FROM (SELECT *, min(CASE WHEN rc >= {k} THEN completion_seq END) OVER (PARTITION BY problem_id) AS stop FROM counted) WHERE stop IS NULL OR completion_seq <= stop)"""


def _selected(source, k):
    """Two steps: candidates by rank and tie, then least finite entropy."""
    return f"""{_RANKS.format(source)}, tops AS (
  SELECT problem_id, max(votes) AS top_votes, min(answer) FILTER (rank = 1) AS top, min(votes) FILTER (rank = 2) AS second_votes, min(answer) FILTER (rank = 2) AS second FROM ranks GROUP BY problem_id
), chosen AS (
  SELECT t.problem_id, arg_min(a.answer, (a.entropy, a.completion_seq)) AS best FROM tops t JOIN {source} a ON a.problem_id = t.problem_id
    AND (a.answer = t.top OR (t.second_votes = t.top_votes AND a.answer = t.second)) WHERE a.entropy < CAST('Infinity' AS DOUBLE) GROUP BY t.problem_id
), selected AS (
  SELECT p.problem_id, coalesce(CASE WHEN t.top_votes >= greatest(4, {k}) OR c.best IS NULL THEN t.top ELSE c.best END, 0) AS answer
  FROM (SELECT DISTINCT problem_id FROM {source}) p LEFT JOIN tops t USING (problem_id) LEFT JOIN chosen c USING (problem_id))"""


@query(f"WITH {_RANKS.format('b_attempts')} SELECT p.problem_id, coalesce(r.answer, 0) AS answer, r.answer IS NOT NULL AS has_answer FROM (SELECT DISTINCT problem_id FROM b_attempts) p LEFT JOIN ranks r ON r.problem_id = p.problem_id AND r.rank = 1", "attempts")
def majority_vote(spark, d):
    return votes.majority_vote(bound(spark, d, "attempts"))


@query(f"WITH {_RANKS.format('b_attempts')} SELECT problem_id, list(answer ORDER BY first_seq) AS answers, list(votes ORDER BY first_seq) AS votes FROM ranks GROUP BY problem_id", "attempts")
def vote_histogram(spark, d):
    return votes.vote_histogram(bound(spark, d, "attempts"))


@query(f"WITH {_RANKS.format('b_attempts')} SELECT * FROM ranks WHERE rank <= 2", "attempts")
def first_seen_rank(spark, d):
    return votes.first_seen_rank(bound(spark, d, "attempts"), 2)


@query(f"WITH {_cut(3)} SELECT problem_id, completion_seq, answer FROM cut", "attempts")
def early_stop_cut(spark, d):
    return votes.early_stop_cut(bound(spark, d, "attempts"), 3).select("problem_id", "completion_seq", "answer")


for _k in (1, 5):

    def _select(spark, d, k=_k):
        return votes.select_answer(bound(spark, d, "attempts"), k)

    _select.__name__ = f"select_answer_{_k}"
    query(f"WITH {_selected('b_attempts', _k)} SELECT problem_id, answer FROM selected", "attempts")(_select)

_SCORED = f"""WITH {_cut(4)}, {_selected('cut', 4)}, scored AS (
  SELECT s.problem_id, s.answer, l.quality AS expected, s.answer = l.quality AS correct, t.time_s
  FROM selected s LEFT JOIN labels l ON l.doc_id = s.problem_id JOIN (SELECT problem_id, sum(value) AS time_s FROM cut GROUP BY problem_id) t ON t.problem_id = s.problem_id)"""


def scored(spark, d):
    """Early stop, answer choice, and the expected answers beside them."""
    kept = votes.early_stop_cut(bound(spark, d, "attempts"), 4)
    answers = votes.select_answer(kept, 4).join(kept.groupBy("problem_id").agg(F.sum("value").alias("time_s")), "problem_id")
    expected = table(spark, d, "labels").select(F.col("doc_id").alias("problem_id"), F.col("quality").alias("answer"))
    return scoring.join_expected(answers, expected, "problem_id")


@query(f"{_SCORED} SELECT problem_id, answer, expected, correct FROM scored", "attempts")
def join_expected(spark, d):
    return scored(spark, d).select("problem_id", "answer", "expected", "correct")


@query(
    f"{_SCORED} SELECT count(*) AS attempted, count(*) FILTER (correct) AS correct, CASE WHEN count(expected) > 0 THEN count(*) FILTER (correct) / count(*) END AS accuracy, CASE WHEN count(expected) > 0 THEN count(*) FILTER (correct) / count(expected) END AS accuracy_labelled, round(sum(time_s), 3) AS total_time_s FROM scored",
    "attempts",
)
def accuracy_summary(spark, d):
    return scoring.accuracy_summary(scored(spark, d)).withColumn("total_time_s", F.round("total_time_s", 3))


# Labels come twice: a later row overrides an earlier one.
_TWICE = "SELECT doc_id AS problem_id, (1 - quality)::INT AS answer, 0 AS line FROM labels UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE quality END, 1 FROM labels"


@query(f"WITH {_cut(4)}, {_selected('cut', 4)}, twice AS ({_TWICE}) SELECT count(*) AS correct FROM selected s WHERE s.answer = (SELECT arg_max(t.answer, t.line) FROM twice t WHERE t.problem_id = s.problem_id)", "attempts")
def count_correct(spark, d):
    kept = votes.early_stop_cut(bound(spark, d, "attempts"), 4)
    labels = table(spark, d, "labels")
    early = labels.select(F.col("doc_id").alias("problem_id"), (1 - F.col("quality")).cast("int").alias("answer"), F.lit(0).alias("line"))
    late = labels.select(F.col("doc_id").alias("problem_id"), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(F.col("quality")).cast("int").alias("answer"), F.lit(1).alias("line"))
    return scoring.count_correct(votes.select_answer(kept, 4), early.unionByName(late), "problem_id", "line")


@query("SELECT l_suppkey, sum(generated_tokens)::BIGINT AS generated, CASE WHEN sum(elapsed_s) > 0 THEN sum(generated_tokens) / sum(elapsed_s) ELSE 0.0 END AS tokens_per_s, CASE WHEN sum(prompt_tokens) > 0 AND sum(elapsed_s) > 0 THEN (sum(generated_tokens) + sum(prompt_tokens)) / sum(elapsed_s) END AS overall_per_s FROM b_runs GROUP BY l_suppkey", "runs")
def throughput_summary(spark, d):
    return scoring.throughput_summary(bound(spark, d, "runs"), ["l_suppkey"])


@query("SELECT item_id, attempt::INT AS attempt FROM benchmark, range(0, 8) r(attempt)")
def fan_out_attempts(spark, d):
    return A.fan_out_attempts(table(spark, d, "benchmark").select("item_id"), 8)


@query("SELECT user_id, sum(tokens)::BIGINT AS response_length, count(*) FILTER (is_call) AS python_calls, count(*) FILTER (is_error) AS python_errors, arg_max(answer, turn) FILTER (answer IS NOT NULL) AS answer, count(*) AS turns FROM b_turns GROUP BY user_id", "turns")
def attempt_metrics(spark, d):
    return A.attempt_metrics(bound(spark, d, "turns"), ["user_id"])


@query("SELECT conv_id, max(turn) + 1 AS turns FROM conversations GROUP BY conv_id")
def turns_used(spark, d):
    return A.turns_used(table(spark, d, "conversations"), ["conv_id"])


@query("SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS full_response FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def full_response(spark, d):
    return A.full_response(table(spark, d, "conversations").where("role = 'assistant'").withColumnRenamed("text", "content"), ["conv_id"])


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id")
def render_chat_prompt(spark, d):
    return A.render_chat_prompt(table(spark, d, "conversations").withColumnRenamed("text", "content"), ["conv_id"])


@query("SELECT a.conv_id, a.turn, md5(a.text) AS call, md5(b.text) AS output FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'user' WHERE a.role = 'assistant'")
def pair_calls_outputs(spark, d):
    said = table(spark, d, "conversations")
    calls = said.where("role = 'assistant'").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("call"))
    outputs = said.where("role = 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5(F.col("text").cast("binary")).alias("output"))
    return A.pair_calls_outputs(calls, outputs, ["conv_id", "turn"])


@query("SELECT seq, exec_id FROM b_exec_log WHERE parent_id <> '3'", "exec_log")
def drop_foreign_messages(spark, d):
    log = bound(spark, d, "exec_log")
    return A.drop_foreign_messages(log, log.select("exec_id", "parent_id").distinct().where("parent_id <> '3'")).select("seq", "exec_id")


def _fold_sql(variant, words):
    clean = r"regexp_replace(frame_a, '\x1b\[[0-9;]*m', '', 'g')"
    error = f"{clean} || chr(10) || frame_b" if variant == "plain" else f"{clean} || CASE WHEN contains(frame_b, 'ipython') THEN frame_b ELSE '' END"
    return f"""WITH cut AS (SELECT *, min(CASE WHEN execution_state = 'idle' THEN seq END) OVER (PARTITION BY exec_id) AS idle FROM b_exec_log),
    parts AS (SELECT exec_id, seq, idle, elapsed_s, idle IS NULL OR seq < idle AS used,
      CASE WHEN stream_name = 'stdout' THEN text WHEN msg_type = 'execute_result' THEN CASE WHEN ends_with(plain_text, chr(10)) THEN plain_text ELSE plain_text || chr(10) END END AS o,
      CASE WHEN stream_name = 'stderr' THEN text WHEN msg_type = 'error' THEN {error} END AS e FROM cut),
    folded AS (SELECT exec_id, max(idle) AS idle, max(elapsed_s) AS elapsed_s, coalesce(string_agg(o, '' ORDER BY seq) FILTER (used), '') AS o, coalesce(string_agg(e, '' ORDER BY seq) FILTER (used), '') AS e FROM parts GROUP BY exec_id)
    SELECT exec_id, CASE WHEN idle IS NULL OR elapsed_s > 300 THEN '{words}' ELSE {sql_output('o', 'e', variant)} END AS output FROM folded"""


def _log(spark, d):
    return bound(spark, d, "exec_log").withColumn("traceback", F.when(F.col("frame_a").isNotNull(), F.array("frame_a", "frame_b")))


@query(_fold_sql("plain", "[ERROR] Timed out after 300s"), "exec_log")
def fold_exec_log(spark, d):
    return A.fold_exec_log(_log(spark, d), "plain", 300.0)


@query(_fold_sql("tool", "[ERROR] Execution timed out after 300 seconds"), "exec_log")
def fold_exec_log_tool(spark, d):
    return A.fold_exec_log(_log(spark, d), "tool", 300.0)


for _variant, _words in (("plain", "[ERROR] Timed out after 300s"), ("tool", "[ERROR] Execution timed out after 300 seconds")):

    def _fold_segments(spark, d, variant=_variant):
        segments = A.fold_exec_log_segments(_log(spark, d), variant, 300.0, 40)
        parts = F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda p: p["text"])
        return segments.groupBy("exec_id").agg(F.array_join(parts, "").alias("output"))

    _fold_segments.__name__ = "fold_exec_log_segments" + ("_tool" if _variant == "tool" else "")
    query(_fold_sql(_variant, _words), "exec_log")(_fold_segments)


@query("SELECT conv_id AS problem_id, (turn % 2)::INT AS attempt, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS whole, count(*) AS turns FROM conversations GROUP BY ALL")
def trace_segments(spark, d):
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("problem_id"), (F.col("turn") % 2).cast("int").alias("attempt"), "turn", "role", F.col("text").alias("content"))
    segments = A.trace_segments(said, 500).groupBy("problem_id", "attempt").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment", "messages"))), lambda s: s["messages"])).alias("m"))
    joined = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return segments.select("problem_id", "attempt", F.md5(joined.cast("binary")).alias("whole"), F.size("m").cast("long").alias("turns"))


@query("SELECT source, doc_id // 1000 AS part, sum(1)::BIGINT AS attempts, string_agg(doc_id || ':' || lang, ' ' ORDER BY doc_id) AS digest FROM documents GROUP BY source, doc_id // 1000")
def assemble_trace(spark, d):
    docs = table(spark, d, "documents").select("source", F.expr("doc_id div 1000").alias("part"), "doc_id", "lang").withColumn("problem_id", F.concat_ws("/", "source", "part"))
    attempts = docs.select("problem_id", F.col("doc_id").alias("attempt"), F.lit(1).alias("answer"), F.lit(1).alias("turns"), F.lit(None).cast("string").alias("error"))
    messages = docs.select("problem_id", F.col("doc_id").alias("attempt"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("lang").alias("content"))
    trace = A.assemble_trace(messages, attempts, docs.select("problem_id", "source", "part").distinct())
    each = F.transform("attempts", lambda a: F.concat(a["attempt"].cast("string"), F.lit(":"), a["messages"][0]["content"]))
    return trace.select("source", "part", F.size("attempts").cast("long").alias("attempts"), F.array_join(each, " ").alias("digest"))


_KEYS = ["problem_id", "attempt", "turn"]


@query(
    f"""WITH seen AS (SELECT *, string_agg(text, '') OVER (PARTITION BY problem_id, attempt, turn ORDER BY chunk_no ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS recent FROM b_chunks WHERE n_tokens > 0),
    hits AS (SELECT problem_id, attempt, turn, chunk_no, {sql_answer('recent', 'strict')} AS answer FROM seen WHERE contains(text, chr(125)))
    SELECT problem_id, attempt, turn, min(chunk_no) AS chunk_no, arg_min(answer, chunk_no) AS answer FROM hits WHERE answer IS NOT NULL GROUP BY problem_id, attempt, turn""",
    "chunks",
)
def rolling_chunk_scan(spark, d):
    return A.rolling_chunk_scan(bound(spark, d, "chunks"), _KEYS)


@query(
    """SELECT problem_id, attempt, round(greatest(270.0::DOUBLE, least(900.0::DOUBLE, left_s - greatest(12 - attempt - 1, 0) * 270.0::DOUBLE)), 6) AS budget FROM (
    SELECT *, 3600.0::DOUBLE - coalesce(sum(value) OVER (PARTITION BY problem_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS left_s FROM b_attempts)""",
    "attempts",
)
def time_budget(spark, d):
    runs = bound(spark, d, "attempts").select("problem_id", F.col("attempt").alias("problem_no"), F.col("value").alias("elapsed_s"))
    return A.time_budget(runs, 3600.0, problems=12, keys=["problem_id"]).select("problem_id", F.col("problem_no").alias("attempt"), F.round("budget", 6).alias("budget"))


@query(
    """WITH b AS (SELECT user_id, turn, 2000 - coalesce(sum(tokens) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS max_tokens FROM b_turns)
    SELECT user_id, turn, max_tokens::BIGINT AS max_tokens FROM b WHERE turn < coalesce((SELECT min(turn) FROM b x WHERE x.user_id = b.user_id AND x.max_tokens < 512), 1000000)""",
    "turns",
)
def context_budget(spark, d):
    return A.context_budget(bound(spark, d, "turns"), ["user_id"], 2000).select("user_id", "turn", "max_tokens")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3")
def turn_cap(spark, d):
    return A.turn_cap(table(spark, d, "conversations"), ["conv_id"], 3).select("conv_id", "turn")


@query("WITH dl AS (SELECT user_id, min(ts) + INTERVAL 7 DAY AS deadline FROM events WHERE user_id % 3 <> 0 GROUP BY user_id) SELECT e.event_id, e.user_id FROM events e LEFT JOIN dl USING (user_id) WHERE deadline IS NULL OR ts <= deadline")
def finished_or_late(spark, d):
    events = table(spark, d, "events")
    deadlines = events.where("user_id % 3 <> 0").groupBy("user_id").agg((F.min("ts") + F.expr("interval 7 days")).alias("deadline"))
    return A.finished_or_late(events, deadlines, "user_id").select("event_id", "user_id")




def _next_sql():
    from quorate.plans.text_queries import sql_blocks, sql_think

    return f"""WITH r AS (SELECT doc_id, (doc_id % 16)::INT AS turn, reply, {sql_think('reply')} AS clean FROM b_replies), a AS (SELECT *, coalesce(nullif({sql_answer('clean')}, 0), {sql_answer('reply')}) AS answer FROM r)
    SELECT doc_id, answer, CASE WHEN answer IS NOT NULL THEN 'finish' WHEN turn >= 15 THEN 'last_chance' WHEN len({sql_blocks('clean')}) > 0 OR len({sql_blocks('reply')}) > 0 THEN 'run' ELSE 'nudge' END AS action FROM a"""


@query(_next_sql(), "replies")
def next_action(spark, d):
    replies = bound(spark, d, "replies").select("doc_id", (F.col("doc_id") % 16).cast("int").alias("turn"), F.col("reply").alias("content"))
    return A.next_action(replies).select("doc_id", "answer", "action")


@query(
    f"""SELECT doc_id, CASE WHEN early IS NOT NULL OR tokens = 0 OR channel = 'final' THEN 'finish' WHEN recipient = 'python' THEN 'run' ELSE 'next_turn' END AS action, coalesce(early, CASE WHEN tokens > 0 AND channel = 'final' THEN {sql_answer('reply', 'strict')} END) AS answer
    FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 5 END AS early, doc_id % 7 AS tokens, CASE WHEN doc_id % 3 = 0 THEN 'final' END AS channel, CASE WHEN doc_id % 2 = 0 THEN 'python' END AS recipient FROM b_replies)""",
    "replies",
)
def next_action_tool(spark, d):
    i = F.col("doc_id")
    replies = bound(spark, d, "replies").select(
        "doc_id", F.col("reply").alias("content"), F.when(i % 11 == 0, 5).alias("early_answer"), (i % 7).alias("tokens"), F.when(i % 3 == 0, "final").alias("channel"), F.when(i % 2 == 0, "python").alias("recipient")
    )
    return A.next_action_tool(replies).select("doc_id", "action", "answer")


@query("SELECT doc, string_agg(coalesce(text, ''), chr(10) ORDER BY page_no) AS text FROM b_pages GROUP BY doc", "pages")
def merge_page_text(spark, d):
    from quorate.sources.tables import merge_page_text as merge

    return merge(bound(spark, d, "pages"), ["doc"])


# Segments of a run: the joined text is that of the whole, and no segment but the last is short of the limit.
_SEGMENTS = "SELECT conv_id, md5(string_agg({}, '{}' ORDER BY turn) || {}) AS whole FROM conversations {} GROUP BY conv_id"


def _rejoined(segments, key):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda p: p["text"])
    return segments.groupBy(key).agg(F.md5(F.array_join(parts, "").cast("binary")).alias("whole"))


@query(_SEGMENTS.format("text || chr(10)", "", "''", "WHERE role = 'assistant'"))
def full_response_segments(spark, d):
    return _rejoined(A.full_response(table(spark, d, "conversations").where("role = 'assistant'").withColumnRenamed("text", "content"), ["conv_id"], limit=500), "conv_id")


@query("SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) || chr(10) || '<|assistant|>' || chr(10)) AS whole FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id")
def render_chat_prompt_segments(spark, d):
    return _rejoined(A.render_chat_prompt(table(spark, d, "conversations").withColumnRenamed("text", "content"), ["conv_id"], limit=500), "conv_id")


@query("SELECT doc, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY page_no)) AS whole FROM b_pages GROUP BY doc", "pages")
def merge_page_text_segments(spark, d):
    from quorate.sources.tables import merge_page_text as merge

    return _rejoined(merge(bound(spark, d, "pages"), ["doc"], limit=500), "doc")


@query(
    """SELECT event_id, round(greatest(270.0::DOUBLE, least(900.0::DOUBLE, 1e6::DOUBLE - used - greatest(50 - i - 1, 0) * 270.0::DOUBLE)), 4) AS budget FROM (
    SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, coalesce(sum(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS used FROM events)"""
)
def time_budget_one_run(spark, d):
    from quorate.operators.batches import row_numbers

    runs = row_numbers(table(spark, d, "events").select("event_id", F.col("value").alias("elapsed_s")), ["event_id"], "problem_no")
    return A.time_budget(runs, 1e6).select("event_id", F.round("budget", 4).alias("budget"))
