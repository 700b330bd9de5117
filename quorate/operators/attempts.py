"""Attempts, their turns, chunks and logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import text as T
from quorate.operators.prefix import ordered_segments, prefix_sums


def fan_out_attempts(problems: DataFrame, n: int) -> DataFrame:
    """Each problem with the attempt numbers 0 to n - 1."""
    return problems.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def attempt_metrics(turns: DataFrame, keys: list[str], order: str = "turn") -> DataFrame:
    """Per attempt: tokens, tool calls, tool errors, last answer (by ``order``), turns used."""
    return turns.groupBy(*keys).agg(
        F.sum("tokens").alias("response_length"),
        F.count_if(F.col("is_call")).alias("python_calls"),
        F.count_if(F.col("is_error")).alias("python_errors"),
        F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col(order))).alias("answer"),
        F.count("*").alias("turns"),
    )


def turns_used(turns: DataFrame, keys: list[str]) -> DataFrame:
    return turns.groupBy(*keys).agg((F.max("turn") + 1).alias("turns"))


def ordered_texts(df: DataFrame, keys: list[str], order: str, text: Column, name: str = "texts") -> DataFrame:
    """Per key the array of texts in order; equal places by text."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(*keys).agg(F.transform(parts, lambda p: p["t"]).alias(name))


def full_response(replies: DataFrame, keys: list[str], order: str = "turn", limit: int | None = None) -> DataFrame:
    """All replies of an attempt, each followed by a line end. With ``limit`` in segments of so many
    bytes, see ``ordered_segments``: (keys, segment, text)."""
    if limit is not None:
        return ordered_segments(replies, keys, order, F.concat("content", F.lit("\n")), limit)
    return ordered_texts(replies, keys, order, F.concat("content", F.lit("\n"))).select(*keys, F.array_join("texts", "").alias("full_response"))


def render_chat_prompt(messages: DataFrame, keys: list[str], order: str = "turn", limit: int | None = None) -> DataFrame:
    """The conversation as text with role marks, open for the assistant; other roles are dropped. With
    ``limit`` in segments of so many bytes, see ``ordered_segments``: (keys, segment, text)."""
    known = messages.where(F.col("role").isin("system", "user", "assistant"))
    part = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"))
    if limit is not None:
        return ordered_segments(known, keys, order, part, limit, "\n", "\n<|assistant|>\n")
    return ordered_texts(known, keys, order, part).select(*keys, F.concat(F.array_join("texts", "\n"), F.lit("\n<|assistant|>\n")).alias("prompt"))


def pair_calls_outputs(calls: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Each code request with its output; requests without one keep null."""
    return calls.join(outputs, keys, "left")


def drop_foreign_messages(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Log messages whose parent is the request of their execution."""
    return log.join(requests.select("exec_id", "parent_id"), ["exec_id", "parent_id"], "left_semi")


def _log_parts(log: DataFrame, variant: str) -> tuple[Column, Column]:
    """What a message adds to its run's output, and to its errors; null where nothing."""
    stream = F.when(F.col("msg_type") == "stream", F.col("text")).when(F.col("msg_type").isin("execute_result", "display_data") & (F.coalesce("plain_text", F.lit("")) != ""), T.ensure_trailing_newline(F.col("plain_text")))
    to_out = (F.col("msg_type") != "stream") | (F.col("stream_name") == "stdout")
    error = F.when(F.col("msg_type") == "error", T.filter_traceback(F.coalesce("traceback", F.array().cast("array<string>")), variant)).when((F.col("msg_type") == "stream") & (F.col("stream_name") != "stdout"), F.col("text"))
    return F.when(to_out, stream), error


def _idle(log: DataFrame) -> Column:
    """The number of a message that says the run is idle."""
    return F.when((F.col("msg_type") == "status") & (F.col("execution_state") == "idle"), F.col("seq"))


def _timed_out(variant: str, timeout_s: float) -> str:
    # What a run that takes too long writes.
    return (f"[ERROR] Timed out after {timeout_s:g}s", f"[ERROR] Execution timed out after {timeout_s:g} seconds")[variant == "tool"]


def fold_exec_log(log: DataFrame, variant: str = "plain", timeout_s: float | None = None) -> DataFrame:
    """(exec_id, output): messages up to the first idle status folded to one text.

    A run that is not idle within ``timeout_s`` gets an error instead. A run's output is one value; for
    runs of any length see ``fold_exec_log_segments``."""
    until = F.min(_idle(log)).over(Window.partitionBy("exec_id"))
    cut = log.withColumn("_idle", until)
    used = F.col("_idle").isNull() | (F.col("seq") < F.col("_idle"))
    out, error = _log_parts(log, variant)

    def gathered(text: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(used & text.isNotNull(), F.struct(F.col("seq").alias("o"), text.alias("t")))))
        return F.array_join(F.transform(parts, lambda p: p["t"]), "")

    folded = cut.groupBy("exec_id").agg(gathered(out).alias("out"), gathered(error).alias("err"), F.max("_idle").alias("idle"), F.max("elapsed_s").alias("elapsed_s"))
    output = T.format_exec_output(F.col("out"), F.col("err"), variant)
    if timeout_s is not None:
        output = F.when(F.col("idle").isNull() | (F.col("elapsed_s") > timeout_s), F.lit(_timed_out(variant, timeout_s))).otherwise(output)
    return folded.select("exec_id", output.alias("output"))


def fold_exec_log_segments(log: DataFrame, variant: str = "plain", timeout_s: float | None = None, limit: int = 16 << 20) -> DataFrame:
    """(exec_id, segment, text): what ``fold_exec_log`` gives, in segments of some ``limit`` bytes, however
    long a run's log is. Messages of one number are in no certain order.

    What a run's messages come to (idle, where its output and its errors end in something other than white
    space) is an aggregate of few bytes, joined back; white space at the ends goes message by message."""
    idle = log.groupBy("exec_id").agg(F.min(_idle(log)).alias("_idle"), F.max("elapsed_s").alias("_took"))
    known = log.join(idle.hint("merge"), "exec_id")
    out, error = _log_parts(log, variant)
    used = F.col("_idle").isNull() | (F.col("seq") < F.col("_idle"))
    both = known.select("exec_id", "seq", F.explode(F.array(F.struct(F.lit(0).alias("stream"), out.alias("text")), F.struct(F.lit(1).alias("stream"), error.alias("text")))).alias("p"), used.alias("_used"))
    parts = both.where("_used").select("exec_id", F.struct("p.stream", "seq").alias("at"), F.col("p.stream").alias("stream"), F.col("p.text").alias("text")).where("text <> ''")

    def last(stream: int, kept: Column) -> Column:
        return F.max(F.when((F.col("stream") == stream) & kept, F.col("at")))

    full = T.strip(F.col("text")) != ""
    ends = parts.groupBy("exec_id").agg(last(0, full).alias("out_end"), last(1, full).alias("err_end"), last(0, F.lit(True)).alias("out_last"), last(1, F.lit(True)).alias("err_last"))
    # Which errors and which output there are: with white space only they count in one variant.
    has_err = F.col("err_end" if variant == "plain" else "err_last").isNotNull()
    has_out = F.col("out_end").isNotNull()
    bare_out = F.lit(True) if variant == "plain" else has_err
    out_until = F.when(bare_out, F.col("out_end")).otherwise(F.when(has_out, F.col("out_last")))
    err_until = F.col("err_end" if variant == "plain" else "err_last")
    met = parts.join(ends.hint("merge"), "exec_id")
    stays = F.when(F.col("stream") == 0, F.col("at") <= out_until).otherwise(F.col("at") <= err_until)
    strips = F.when(F.col("stream") == 0, bare_out & (F.col("at") == F.col("out_end"))).otherwise(F.lit(variant == "plain") & (F.col("at") == F.col("err_end")))
    # In the tool variant output that is all white space still parts from the errors by a line end.
    text = F.when(strips, T.strip_right(F.col("text"))).otherwise(F.col("text"))
    text = F.when((F.col("stream") == 0) & (F.col("at") == F.col("out_end")) & has_err, F.concat(text, F.lit("\n"))).otherwise(text)
    told = met.where(stays).select("exec_id", "at", text.alias("text"))
    if variant == "tool":
        blank = ends.where(F.col("out_end").isNull() & F.col("out_last").isNotNull() & has_err).select("exec_id", F.struct(F.lit(0).alias("stream"), F.col("out_last.seq").alias("seq")).alias("at"), F.lit("\n").alias("text"))
        told = told.unionByName(blank)
    late = F.lit(False) if timeout_s is None else F.col("_idle").isNull() | (F.col("_took") > timeout_s)
    state = idle.join(ends.hint("merge"), "exec_id", "left").select("exec_id", F.coalesce(late, F.lit(False)).alias("late"), (~has_err & ~has_out).alias("silent"))
    fixed = F.when(F.col("late"), F.lit(_timed_out(variant, timeout_s or 0.0))).otherwise(F.lit(T.NO_OUTPUT[variant]))
    whole = state.where("late or silent").select("exec_id", F.lit(0).alias("segment"), fixed.alias("text"))
    told = told.join(state.where("not late and not silent").hint("merge"), "exec_id", "left_semi")
    return ordered_segments(told, ["exec_id"], "at", F.col("text"), limit).unionByName(whole)


def assemble_trace(messages: DataFrame, attempts: DataFrame, problems: DataFrame) -> DataFrame:
    """Problems with their attempts, and these with their messages, in order."""
    inner = messages.groupBy("problem_id", "attempt").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    inner = inner.select("problem_id", "attempt", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    outer = attempts.join(inner, ["problem_id", "attempt"], "left").groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "answer", "turns", "messages", "error"))).alias("attempts"))
    return problems.join(outer, "problem_id", "left")


def trace_segments(messages: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """(problem_id, attempt, segment, messages): an attempt's messages in order, cut to segments of some
    ``limit`` bytes of content, for attempts too long to be one value of ``assemble_trace``."""
    keys = ["problem_id", "attempt"]
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    summed = prefix_sums(messages.select(*keys, "turn", "role", "content"), keys, ["turn"], {"_before": size, "_row": F.lit(1).cast("long")}, "trace-segments")
    cut = summed.groupBy(*keys, F.floor(F.col("_before") / limit).alias("_segment")).agg(F.array_sort(F.collect_list(F.struct("_row", "role", "content"))).alias("m"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_segment")) - 1
    return cut.withColumn("segment", number).select(*keys, "segment", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def _near_braces(chunks: DataFrame, keys: list[str], look_back: int) -> DataFrame:
    """Chunks with tokens that some brace may look back on. Of chunks of a turn that come together with
    numbers that follow each other, which no other chunk can stand between, these are the ``look_back``
    that end at a brace, and the last ones, for braces that come after them. So the last ``look_back``
    before any brace are those of the whole turn."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            follows = np.zeros(n, bool)
            number = batch.column("chunk_no")
            follows[1:] = pc.fill_null(pc.equal(pc.subtract(number.slice(1), number.slice(0, n - 1)), 1), False).to_numpy(zero_copy_only=False)
            for column in (batch.column(k) for k in keys):
                follows[1:] &= pc.fill_null(pc.equal(column.slice(0, n - 1), column.slice(1)), False).to_numpy(zero_copy_only=False)
            carrying = pc.fill_null(pc.greater(batch.column("n_tokens"), 0), False)
            run = np.cumsum(~follows)[carrying.to_numpy(zero_copy_only=False)]
            some = batch.filter(carrying)
            if not len(run):
                continue
            at, none = np.arange(len(run)), len(run) + look_back
            brace = pc.fill_null(pc.match_substring(some.column("text"), "}"), False).to_numpy(zero_copy_only=False)
            next_brace = np.minimum.accumulate(np.where(brace, at, none)[::-1])[::-1]
            last = np.searchsorted(run, run, side="right") - 1
            keep = (next_brace - at < look_back) | (last - at < look_back)
            kept = some.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in names], names)

    names = [*keys, "chunk_no", "text"]
    out = chunks.select(*names).schema
    return chunks.select(*names, "n_tokens").mapInArrow(near, out)


def rolling_chunk_scan(chunks: DataFrame, keys: list[str], look_back: int = 32) -> DataFrame:
    """Per turn the first chunk, with tokens and a closing brace, whose last ``look_back`` texts hold
    an answer: keys, chunk_no, answer. A null text is empty. A number comes once in a turn.

    Chunks that no brace can look back on are left out where they lie, before anything is sorted.
    A turn's chunks with tokens are put together in blocks by number, partly before the one shuffle, by
    ``keys``. A block and those before it that end within twice ``look_back`` chunks hold all that its
    braces look back on. So texts are copied a few times only, and only braces make windows, each
    scanned once."""
    seen = _near_braces(chunks, keys, look_back).select(*keys, "chunk_no", F.coalesce("text", F.lit("")).alias("text"))
    blocks = seen.groupBy(*keys, F.floor(F.col("chunk_no") / look_back).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "text"))).alias("_parts"))
    by_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("_end", F.sum(F.size("_parts")).over(by_block))  # of the chunks with tokens so far
    near = Window.partitionBy(*keys).orderBy("_end").rangeBetween(1 - 2 * look_back, 0)
    blocks = blocks.withColumn("_all", F.flatten(F.collect_list("_parts").over(near))).withColumn("_first", F.size("_all") - F.size("_parts"))
    braces = F.filter(F.sequence(F.col("_first"), F.size("_all") - 1), lambda i: F.get("_all", i)["text"].contains("}"))

    def scanned(i: Column) -> Column:
        from_place = F.greatest(i - (look_back - 1), F.lit(0))
        recent = F.array_join(F.transform(F.slice("_all", from_place + 1, i - from_place + 1), lambda p: p["text"]), "")
        return F.struct(F.get("_all", i)["chunk_no"].alias("chunk_no"), T.extract_answer(recent, "strict").alias("answer"))

    hits = F.filter(F.transform(braces, scanned), lambda h: h["answer"].isNotNull())
    found = blocks.groupBy(*keys).agg(F.min(F.try_element_at(hits, F.lit(1))).alias("h"))
    return found.where("h is not null").select(*keys, "h.chunk_no", "h.answer")


def time_budget(timings: DataFrame, limit: float, base: float = 270.0, high: float = 900.0, problems: int = 50, keys: list[str] = ()) -> DataFrame:
    """Seconds that the next problem of each run may take; ``problem_no`` counts from 0. Without
    ``keys`` all is one run, whose earlier seconds are summed range by range, not in one task."""
    if keys:
        before = Window.partitionBy(*keys).orderBy("problem_no").rowsBetween(Window.unboundedPreceding, -1)
        timed = timings.withColumn("_used", F.coalesce(F.sum("elapsed_s").over(before), F.lit(0.0)))
    else:
        timed = prefix_sums(timings, [], ["problem_no"], {"_used": F.col("elapsed_s").cast("double")})
    left = F.lit(float(limit)) - F.col("_used")
    others = F.greatest(F.lit(problems) - F.col("problem_no") - 1, F.lit(0))
    return timed.withColumn("budget", F.greatest(F.lit(float(base)), F.least(F.lit(float(high)), left - others * base))).drop("_used")


def context_budget(turns: DataFrame, keys: list[str], context: int = 65_536, least: int = 512) -> DataFrame:
    """Turns that still have ``least`` tokens of context, with max_tokens."""
    running = Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(context) - F.coalesce(F.sum("tokens").over(running), F.lit(0))
    stop = F.min(F.when(F.col("max_tokens") < least, F.col("turn"))).over(Window.partitionBy(*keys))
    return turns.withColumn("max_tokens", left).withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("turn") < F.col("_stop"))).drop("_stop")


def turn_cap(turns: DataFrame, keys: list[str], n: int = 16) -> DataFrame:
    return turns.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("turn"))).where(F.col("_n") <= n).drop("_n")


def finished_or_late(events: DataFrame, deadlines: DataFrame, key: str) -> DataFrame:
    """Events up to the deadline of their key; keys without one keep all."""
    return events.join(deadlines, key, "left").where(F.col("deadline").isNull() | (F.col("ts") <= F.col("deadline"))).drop("deadline")


def next_action(replies: DataFrame, max_turns: int = 16) -> DataFrame:
    """What follows a reply: finish, run, nudge, or last_chance when no turn is left."""
    answer, code = T.answer_clean_or_raw(F.col("content")), T.code_clean_or_raw(F.col("content"))
    more = F.col("turn") < max_turns - 1
    return replies.withColumn("answer", answer).withColumn(
        "action", F.when(F.col("answer").isNotNull(), "finish").when(~more, "last_chance").when(F.size(code) > 0, "run").otherwise("nudge")
    )


def next_action_tool(replies: DataFrame) -> DataFrame:
    """The same for replies with channels: an early hit, no tokens, a final message or a tool call."""
    said = T.extract_answer(F.col("content"), "strict")
    return replies.withColumn(
        "action",
        F.when(F.col("early_answer").isNotNull() | (F.col("tokens") == 0) | (F.coalesce("channel", F.lit("")) == "final"), "finish").when(F.coalesce("recipient", F.lit("")) == "python", "run").otherwise("next_turn"),
    ).withColumn("answer", F.coalesce("early_answer", F.when((F.col("tokens") > 0) & (F.coalesce("channel", F.lit("")) == "final"), said)))
