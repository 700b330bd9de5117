"""User functions over batches of rows, and multi-turn rollouts."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions import text as T


def checked(fn: Callable) -> Callable:
    if not inspect.isfunction(fn) or fn.__name__ == "<lambda>":
        raise TypeError("predict must be a named function")
    return fn


def batch_predict(df: DataFrame, fn: Callable, inputs: list[str], schema: str, keep: list[str], made: list[str] | None = None) -> DataFrame:
    """Call ``fn(**columns)`` for each Arrow batch; it returns a frame with a row for each row, with the
    columns of ``schema`` (their names are ``made``, where its types have commas).

    A batch that fails, or returns another number of rows, does not fail the job: its rows have null
    predictions and the reason in ``error``."""
    checked(fn)
    made = made or [c.strip().split()[0] for c in schema.split(",")]
    kept = df.select(*keep).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), schema, "error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = batch[keep].copy()
            try:
                found = fn(**{c: batch[c] for c in inputs})
                found = found if isinstance(found, pd.DataFrame) else pd.DataFrame({made[0]: found})
                if len(found) != len(batch):
                    raise ValueError(f"expected {len(batch)} rows but received {len(found)}")
                result[made] = found[made].to_numpy(dtype=object)
                result["error"] = None
            except Exception as failure:  # a row with the error text stands for it
                result[made] = None
                result["error"] = f"{type(failure).__name__}: {failure}"
            yield result

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, out)


def capture_failures(df: DataFrame, fn: Callable, inputs: list[str], schema: str, keep: list[str]) -> DataFrame:
    """As ``batch_predict``, row by row: a row that fails does not touch its neighbours."""
    checked(fn)

    def each(**columns):
        rows, names = [], list(columns)
        for values in zip(*columns.values()):
            try:
                rows.append((fn(**dict(zip(names, values))), None))
            except Exception as failure:
                rows.append((None, f"{type(failure).__name__}: {failure}"))
        return pd.DataFrame(rows, columns=[schema.split()[0], "failure"])

    return batch_predict(df, each, inputs, f"{schema}, failure string", keep).withColumn("error", F.coalesce("error", "failure")).drop("failure")


def multi_turn_rollout(problems: DataFrame, predict: Callable, run_code: Callable, max_turns: int = 16, checkpoint: Callable[[DataFrame], DataFrame] = DataFrame.checkpoint) -> DataFrame:
    """(problem_id, attempt, answer, turns): reply, look for an answer, run code, go on.

    ``predict(prompt)`` and ``run_code(code)`` take and return series. All active rows take a turn
    together; each turn is one job over them, and its result is checkpointed."""
    active = problems.select("problem_id", "attempt", F.concat(F.lit("<|user|>\n"), F.col("problem"), F.lit("\n<|assistant|>\n")).alias("prompt"), F.lit("").alias("said"))
    done = None

    def replied(prompt: pd.Series) -> pd.Series:
        return predict(prompt)

    def ran(code: pd.Series) -> pd.Series:
        return run_code(code)

    for turn in range(max_turns):
        reply = batch_predict(active, replied, ["prompt"], "reply string", ["problem_id", "attempt", "prompt", "said"])
        reply = reply.withColumn("said", F.concat("said", F.coalesce("reply", F.lit("")), F.lit("\n"))).withColumn("answer", T.answer_clean_or_raw(F.col("reply"))).withColumn("code", F.array_join(T.code_clean_or_raw(F.coalesce("reply", F.lit(""))), "\n"))
        reply = checkpoint(reply)
        last = turn == max_turns - 1
        ended = reply.where(F.col("answer").isNotNull() | F.col("error").isNotNull() | F.lit(last))
        ended = ended.select("problem_id", "attempt", F.coalesce("answer", T.extract_answer(F.col("said"))).alias("answer") if last else "answer", F.lit(turn + 1).alias("turns"))
        done = ended if done is None else done.unionByName(ended)
        if last:
            break
        going = reply.where(F.col("answer").isNull() & F.col("error").isNull())
        if going.isEmpty():
            break
        output = batch_predict(going.where("code <> ''"), ran, ["code"], "output string", ["problem_id", "attempt", "prompt", "said", "reply"])
        told = output.select("problem_id", "attempt", "said", "prompt", "reply", T.join_exec_outputs(F.array(F.coalesce("output", F.concat(F.lit("[ERROR] "), F.col("error"))))).alias("next"))
        nudged = going.where("code = ''").select("problem_id", "attempt", "said", "prompt", "reply", F.lit(T.NUDGE).alias("next"))
        active = told.unionByName(nudged).select("problem_id", "attempt", F.concat("prompt", "reply", F.lit("\n<|user|>\n"), "next", F.lit("\n<|assistant|>\n")).alias("prompt"), "said")
        active = checkpoint(active)
    return done
