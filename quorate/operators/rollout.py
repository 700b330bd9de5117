"""Rollouts of attempts that call tools, end at their first answer, and stop each other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import text as T
from quorate.functions.numeric import token_entropy
from quorate.operators.attempts import next_action_tool
from quorate.operators.predict import batch_predict, checked
from quorate.operators.votes import vote_cuts

#: What a model returns for a prompt: its chunks, and the last message that they make.
REPLY = "chunks array<struct<n_tokens:int,text:string,top_logprobs:array<map<string,double>>>>, channel string, recipient string, content string, elapsed_s double"
_STATE = ["problem_id", "attempt", "prompt", "budget_s", "tokens", "calls", "errors", "bits", "positions", "elapsed_s"]


def first_hit(chunks: Column, look_back: int = 32) -> Column:
    """(at, answer): place from 0 of the first chunk with a closing brace at which the last ``look_back``
    texts that carry tokens hold an answer; null without one. ``rolling_chunk_scan`` for one array."""
    carrying = F.filter(F.transform(chunks, lambda c, i: F.struct(i.alias("at"), F.coalesce(c["text"], F.lit("")).alias("text"), c["n_tokens"].alias("n"))), lambda c: c["n"] > 0)

    def found(carrying: Column) -> Column:
        braces = F.filter(F.transform(carrying, lambda c, i: F.struct(i.alias("i"), c["at"].alias("at"), c["text"].alias("text"))), lambda c: c["text"].contains("}"))

        def scanned(brace: Column) -> Column:
            start = F.greatest(brace["i"] - (look_back - 1), F.lit(0))
            recent = F.array_join(F.transform(F.slice(carrying, start + 1, brace["i"] - start + 1), lambda c: c["text"]), "")
            return F.struct(brace["at"].alias("at"), T.extract_answer(recent, "strict").alias("answer"))

        return F.try_element_at(F.filter(F.transform(braces, scanned), lambda h: h["answer"].isNotNull()), F.lit(1))

    return F.try_element_at(F.transform(F.array(carrying), found), F.lit(1))  # made once, not once for each brace


def _after_reply(replied: DataFrame) -> DataFrame:
    """Counts of a turn, up to its first hit: what comes after it was never asked for."""
    seen = replied.withColumn("hit", first_hit(F.col("chunks")))
    used = F.when(F.col("hit").isNull(), F.col("chunks")).otherwise(F.slice("chunks", 1, F.col("hit.at") + 1))
    seen = seen.withColumn("used", F.filter(F.coalesce(used, F.array().cast("array<struct<n_tokens:int,text:string,top_logprobs:array<map<string,double>>>>")), lambda c: c["n_tokens"] > 0))
    given = F.filter(F.flatten(F.transform("used", lambda c: F.coalesce(c["top_logprobs"], F.array().cast("array<map<string,double>>")))), lambda m: m.isNotNull() & (F.size(m) > 0))
    new_tokens = F.aggregate("used", F.lit(0).cast("long"), lambda n, c: n + c["n_tokens"])
    return seen.select(
        *(c for c in replied.columns if c not in ("chunks", "tokens", "bits", "positions")),
        F.col("hit.answer").alias("early_answer"),
        new_tokens.alias("new_tokens"),
        (F.col("tokens") + new_tokens).alias("all_tokens"),
        (F.col("bits") + F.aggregate(given, F.lit(0.0), lambda t, m: t + token_entropy(F.map_values(m)))).alias("bits"),
        (F.col("positions") + F.size(given)).alias("positions"),
        F.array_join(F.transform("used", lambda c: c["text"]), "").alias("said"),
    )


def _result(rows: DataFrame, turn: Column, status: Column, answer: Column, tokens: str, *kept: str) -> DataFrame:
    entropy = F.when(F.col("positions") > 0, F.col("bits") / F.col("positions")).otherwise(F.lit(float("inf")))
    # In a turn all attempts go at once: they complete in the order of their numbers.
    seq = (turn.cast("long") * F.lit(1 << 32) + F.col("attempt")).alias("completion_seq")
    return rows.select("problem_id", "attempt", answer.cast("int").alias("answer"), turn.cast("int").alias("turns"), F.col("calls").alias("python_calls"), F.col("errors").alias("python_errors"), F.col(tokens).cast("long").alias("response_length"), entropy.alias("entropy"), status.alias("status"), seq, *kept)


def tool_rollout(
    problems: DataFrame,
    complete: Callable,
    run_tool: Callable,
    checkpoint: Callable[[DataFrame], DataFrame],
    attempts: int = 8,
    early_stop: int = 4,
    max_turns: int = 160,
    context: int = 65_536,
    least_context: int = 512,
    count_tokens: Callable[[Column], Column] = F.length,
    seed: int = 42,
) -> DataFrame:
    """(problem_id, attempt, answer, turns, python_calls, python_errors, response_length, entropy, status,
    completion_seq) of ``attempts`` attempts at each problem (problem_id, prompt, and budget_s or null).

    ``complete(prompt, seed, max_tokens)`` returns the columns of ``REPLY``, ``run_tool(content)`` a text;
    both take series. In each turn every running attempt of every problem is one row of one job:

    - it ends without an answer when its context has less than ``least_context`` tokens left ("context"),
      its seconds are used up ("late"), or a reply has no tokens ("silent");
    - it ends with its answer at the first chunk whose last texts hold one ("early"), and with what its
      message holds, if anything, on the channel "final" ("final");
    - a message to "python" is run, and its output follows it in the prompt; an output that tells an
      error counts;
    - a call that fails ends it as an error ("failed"), and so does ``max_turns`` ("turns").

    After each turn the votes of ended attempts are counted in the order of completion; where some answer
    has ``early_stop`` of them, the problem's other attempts are "stopped": those running, and those that
    completed after it in that turn, which keep no answer. Such a set is what ``select_answer`` takes. Each
    turn is checkpointed twice: its replies, and then, joined once with the votes, what came of all
    attempts, from which the next turn and the result are read; only problems that go on are read again. Repeated problem_ids are one
    problem with more attempts; an empty table has no attempts."""
    checked(complete)
    checked(run_tool)

    def replied(prompt: pd.Series, seed: pd.Series, max_tokens: pd.Series) -> pd.DataFrame:
        return complete(prompt, seed, max_tokens)

    def ran(content: pd.Series) -> pd.Series:
        return run_tool(content)

    zero = F.lit(0).cast("long")
    budget = F.col("budget_s").cast("double") if "budget_s" in problems.columns else F.lit(None).cast("double")
    active = problems.select("problem_id", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"), F.coalesce("prompt", F.lit("")).alias("prompt"), budget.alias("budget_s"))
    active = active.select("*", zero.alias("tokens"), zero.alias("calls"), zero.alias("errors"), F.lit(0.0).alias("bits"), zero.alias("positions"), F.lit(0.0).alias("elapsed_s"))
    # Ended attempts of problems that go on, and those of problems that are over.
    voted, over = None, []
    for turn in range(max_turns):
        number = F.lit(turn)
        room = F.lit(context) - count_tokens(F.col("prompt"))
        timed = active.withColumn("max_tokens", room.cast("int")).withColumn("seed", F.pow(F.lit(seed) + F.col("attempt"), F.lit(2)).cast("long"))
        short, late = F.col("max_tokens") < least_context, F.coalesce(F.col("elapsed_s") > F.col("budget_s"), F.lit(False))
        ended = [_result(timed.where(short | late), number, F.when(late, "late").otherwise("context"), F.lit(None), "tokens")]
        asked = timed.where(~(short | late))
        reply = batch_predict(asked, replied, ["prompt", "seed", "max_tokens"], REPLY.replace("elapsed_s", "took_s"), [*_STATE], made=["chunks", "channel", "recipient", "content", "took_s"])
        reply = checkpoint(_after_reply(reply.withColumn("elapsed_s", F.col("elapsed_s") + F.coalesce("took_s", F.lit(0.0))).drop("took_s")))
        failed = F.col("error").isNotNull()
        ended.append(_result(reply.where(failed).withColumn("errors", F.col("errors") + 1), number + 1, F.lit("failed"), F.lit(None), "all_tokens"))
        acted = next_action_tool(reply.where(~failed).withColumn("tokens", F.col("new_tokens")))
        finished = acted.where("action = 'finish'")
        how = F.when(F.col("early_answer").isNotNull(), "early").when(F.col("new_tokens") == 0, "silent").otherwise("final")
        ended.append(_result(finished, number + 1, how, F.col("answer"), "all_tokens"))
        calls = acted.where("action = 'run'")
        ran_out = batch_predict(calls, ran, ["content"], "output string", [*(c for c in _STATE if c != "tokens"), "all_tokens", "said"])
        output = F.coalesce("output", F.concat(F.lit("[ERROR] "), F.col("error")), F.lit(""))
        ran_out = ran_out.withColumn("calls", F.col("calls") + 1).withColumn("errors", F.col("errors") + T.is_tool_error(output).cast("long")).withColumn("next", F.concat(F.lit("\n<|python|>\n"), output))
        talked = acted.where("action = 'next_turn'").withColumn("next", F.lit(""))
        columns = [*(c for c in _STATE if c != "tokens"), "all_tokens", "said", "next"]
        going = ran_out.select(*columns).unionByName(talked.select(*columns))
        going = going.withColumn("prompt", F.concat("prompt", F.lit("\n<|assistant|>\n"), "said", "next")).withColumnRenamed("all_tokens", "tokens").select(*_STATE)
        last = turn == max_turns - 1
        going = _result(going, number + 1, F.lit("turns" if last else "going"), F.lit(None), "tokens", "prompt", "budget_s", "bits", "positions", "elapsed_s")
        ended = reduce(DataFrame.unionByName, ended if voted is None else [voted, *ended])
        attempted = ended.unionByName(going, allowMissingColumns=True)
        attempted = checkpoint(attempted.join(vote_cuts(ended, early_stop).hint("merge"), "problem_id", "left"))
        # Problems that are over: what came after the deciding vote keeps no answer.
        after = (F.col("status") == "going") | (F.col("completion_seq") > F.col("cut"))
        closed = attempted.where("cut is not null").withColumn("answer", F.when(~after, F.col("answer"))).withColumn("status", F.when(after, F.lit("stopped")).otherwise(F.col("status")))
        over.append(closed.select(*ended.columns))
        voted = attempted.where("cut is null and status <> 'going'").select(*ended.columns)
        active = attempted.where("cut is null and status = 'going'").withColumnsRenamed({"response_length": "tokens", "python_calls": "calls", "python_errors": "errors"}).select(*_STATE)
        if last or active.isEmpty():
            break
    return reduce(DataFrame.unionByName, [voted, *over])
