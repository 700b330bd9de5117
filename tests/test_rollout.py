"""Rollouts with tools: how attempts end, and how they stop each other."""

import math

import pandas as pd
from pyspark.sql import functions as F

from quorate.operators.rollout import first_hit, tool_rollout
from quorate.operators.votes import select_answer


def kept_in(spark, folder):
    def kept(df):
        path = str(folder / f"t{len(list(folder.iterdir()))}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return kept


def test_first_hit(spark):
    kind = "array<struct<n_tokens:int,text:string>>"
    cases = [
        ([(1, "\\boxed{"), (0, "}"), (1, "7"), (1, "}"), (1, "\\boxed{8}")], (3, 7)),
        ([(1, "\\boxed{7")] + [(1, "")] * 30 + [(1, "}")], (31, 7)),
        ([(1, "\\boxed{7")] + [(1, "")] * 31 + [(1, "}")], None),
        ([(1, "}"), (1, None)], None),
        ([], None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, c {kind}")
    got = [r[0] for r in df.select("i", first_hit(F.col("c")).alias("h")).orderBy("i").select("h").collect()]
    assert [tuple(h) if h else None for h in got] == [w for _, w in cases]


def test_ways_to_end(spark, tmp_path):
    chunk = lambda n, text, *maps: {"n_tokens": n, "text": text, "top_logprobs": list(maps) or None}

    def complete(prompt: pd.Series, seed: pd.Series, max_tokens: pd.Series) -> pd.DataFrame:
        rows = []
        for text in prompt:
            way, turn = text.split()[0], text.count("<|assistant|>")
            if way == "fails":
                raise ValueError("no reply")
            said, channel, recipient, content = [chunk(2, "hm ")], None, None, ""
            if way == "early":
                said = [chunk(1, "\\boxed{5", {"a": math.log(0.5), "b": math.log(0.5)}), chunk(3, "}", {}, {"a": 0.0}), chunk(9, "unasked")]
            elif way == "silent":
                said = []
            elif way == "final":
                channel, content = "final", "the final answer is 12"
            elif way == "nothing":
                channel, content = "final", "who knows"
            elif way == "tools":
                recipient, content = "python", ["1/0", "raise", "boom", "2+2"][min(turn, 3)]
                if "four" in text:
                    said = [chunk(1, "\\boxed{4}")]
            elif way == "long":
                said = [chunk(5, "w" * 300)]
            rows.append((said, channel, recipient, content, 4.0))
        return pd.DataFrame(rows, columns=["chunks", "channel", "recipient", "content", "took_s"])

    def run_tool(content: pd.Series) -> pd.Series:
        if (content == "boom").any():
            raise RuntimeError("kernel died")
        return content.map({"1/0": "Traceback: division", "raise": "[ERROR] x", "2+2": "four"})

    ways = ["early", "silent", "final", "nothing", "tools", "talks", "long", "late", "fails"]
    problems = spark.createDataFrame([(i, f"{w} please", 10.0 if w == "late" else None) for i, w in enumerate(ways)] + [(50, None, None)], "problem_id int, prompt string, budget_s double").repartition(10, "problem_id")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        problems = problems.where("problem_id <> 50")
        got = {ways[r.problem_id]: r for r in tool_rollout(problems, complete, run_tool, kept_in(spark, tmp_path), 1, 4, 6, 1500, 500).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    plain = {w: (r.answer, r.turns, r.python_calls, r.python_errors, r.response_length, r.status) for w, r in got.items()}
    assert plain == {
        "early": (5, 1, 0, 0, 4, "early"),
        "silent": (None, 1, 0, 0, 0, "silent"),
        "final": (12, 1, 0, 0, 2, "final"),
        "nothing": (None, 1, 0, 0, 2, "final"),
        "tools": (4, 5, 4, 3, 9, "early"),
        "talks": (None, 6, 0, 0, 12, "turns"),
        "long": (None, 4, 0, 0, 20, "context"),
        "late": (None, 3, 0, 0, 6, "late"),
        "fails": (None, 1, 0, 1, 0, "failed"),
    }
    assert abs(got["early"].entropy - 0.5) < 1e-9 and got["final"].entropy == math.inf


def test_attempts_stop_each_other(spark, tmp_path):
    chunk = lambda n, text: {"n_tokens": n, "text": text, "top_logprobs": None}

    def complete(prompt: pd.Series, seed: pd.Series, max_tokens: pd.Series) -> pd.DataFrame:
        rows = []
        for text, s in zip(prompt, seed):
            attempt, turn = round(s**0.5) - 42, text.count("<|assistant|>")
            script = {"a": {0: (0, 3), 1: (1, 8), 2: (1, 3), 3: (1, 9), 4: (5, 1)}, "b": {0: (0, 1), 1: (1, 2)}}[text[0]]
            at, answer = script.get(attempt, (99, 0))
            rows.append(([chunk(1, f"\\boxed{{{answer}}}" if turn == at else "x")], None, None, "", 1.0))
        return pd.DataFrame(rows, columns=["chunks", "channel", "recipient", "content", "took_s"])

    def run_tool(content: pd.Series) -> pd.Series:
        return content

    problems = spark.createDataFrame([(1, "a"), (2, "b")], "problem_id int, prompt string")
    found = tool_rollout(problems, complete, run_tool, kept_in(spark, tmp_path), 5, 2, 3)
    got = {(r.problem_id, r.attempt): (r.answer, r.turns, r.status) for r in found.collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0): (3, 1, "early"), (1, 1): (8, 2, "early"), (1, 2): (3, 2, "early"), (1, 3): (None, 2, "stopped"), (1, 4): (None, 2, "stopped")}
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, 0): (1, 1, "early"), (2, 1): (2, 2, "early"), (2, 2): (None, 3, "turns"), (2, 3): (None, 3, "turns"), (2, 4): (None, 3, "turns")}
    assert {tuple(r) for r in select_answer(found, 2).collect()} == {(1, 3), (2, 1)}
    (tmp_path / "none").mkdir()
    assert tool_rollout(problems.limit(0), complete, run_tool, kept_in(spark, tmp_path / "none"), 5, 2, 3).collect() == []


def test_a_turn_is_written_twice_and_joined_once(spark, tmp_path):
    def complete(prompt: pd.Series, seed: pd.Series, max_tokens: pd.Series) -> pd.DataFrame:
        rows = []
        for text, s in zip(prompt, seed):
            at = {"a": (0, 3), "b": (0, 4), "c": (99, 0)}[text[0]]
            turn = text.count("<|assistant|>")
            rows.append(([{"n_tokens": 1, "text": f"\\boxed{{{at[1]}}}" if turn == at[0] and s == 42**2 else "x", "top_logprobs": None}], None, None, "", 1.0))
        return pd.DataFrame(rows, columns=["chunks", "channel", "recipient", "content", "took_s"])

    def run_tool(content: pd.Series) -> pd.Series:
        return content

    # Two answers of one problem are complete at once.
    problems = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "a")], "problem_id int, prompt string")
    found = tool_rollout(problems, complete, run_tool, kept_in(spark, tmp_path), 2, 1, 3)
    got = sorted(((r.problem_id or 0, r.attempt, r.answer or 0, r.turns, r.status) for r in found.collect()))
    assert got == [(0, 0, 3, 1, "early"), (0, 1, 0, 3, "turns"), (1, 0, 3, 1, "early"), (1, 0, 4, 1, "early"), (1, 1, 0, 1, "stopped"), (1, 1, 0, 1, "stopped"), (2, 0, 0, 3, "turns"), (2, 1, 0, 3, "turns")]
    assert len(list(tmp_path.iterdir())) == 2 * 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
