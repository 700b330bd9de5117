import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.operators import attempts, batches, manifest, predict, scoring, votes
from quorate.plans import batch_queries
from quorate.sources import tables

ATTEMPTS = "problem_id int, completion_seq int, answer int, entropy double"


def choose(rows, k):
    """Early stop, then the choice, in plain Python."""
    kept, counts = [], Counter()
    for _, _, answer, entropy in rows:
        kept.append((answer, entropy))
        if answer is not None:
            counts[answer] += 1
            if counts[answer] >= k:
                break
    if not counts:
        return 0
    leading = counts.most_common(2)
    if leading[0][1] >= max(4, k) or len(leading) == 1:
        return leading[0][0]
    tied = {a for a, n in leading if n == leading[0][1]}
    surest = min(((entropy, place, answer) for place, (answer, entropy) in enumerate(kept) if answer in tied), default=None)
    return surest[2] if surest and surest[0] < float("inf") else leading[0][0]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_early_stop_and_choice(spark, k):
    rng = random.Random(k)
    problems = {p: [(p, s, rng.choice([None, 1, 2, 3]), rng.choice([float("inf"), 0.1, 0.2, 0.3])) for s in range(rng.randint(1, 9))] for p in range(150)}
    df = spark.createDataFrame([r for rows in problems.values() for r in rows], ATTEMPTS)
    got = votes.select_answer(votes.early_stop_cut(df, k), k).collect()
    assert {r.problem_id: r.answer for r in got} == {p: choose(rows, k) for p, rows in problems.items()}


def test_majority_keeps_the_answer_seen_first(spark):
    df = spark.createDataFrame([(1, 0, 9, 0.0), (1, 1, 4, 0.0), (1, 2, 4, 0.0), (1, 3, 9, 0.0), (2, 0, None, 0.0)], ATTEMPTS)
    assert sorted(map(tuple, votes.majority_vote(df).collect())) == [(1, 9, True), (2, 0, False)]


def test_batch_row_check_branches_and_status(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (4, "d")], "batch_id int, id string").withColumn("empty", F.col("batch_id") == 3)
    received = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "x")], "batch_id int, id string")
    checked = batches.batch_row_check(expected, received)
    got = {r.batch_id: (r.kind, r.message) for r in checked.collect()}
    assert got == {1: (None, None), 2: ("INVALID_SUBMISSION", "Invalid predictions: expected 1 rows but received 2"), 3: ("GATEWAY_RAISED_EXCEPTION", "Missing row IDs for batch"), 4: ("INVALID_SUBMISSION", "No prediction received")}
    assert tuple(batches.run_status(checked).first()) == (False, 6, "INVALID_SUBMISSION", "Invalid predictions: expected 1 rows but received 2")
    assert tuple(batches.run_status(checked.where("kind is null")).first()) == (True, None, None, None)


def test_unions(spark):
    whole, real, text = spark.sql("select 1 answer"), spark.sql("select 1.5D answer"), spark.sql("select 'x' answer")
    assert batches.relaxed_union([whole, real]).dtypes == [("answer", "double")]
    with pytest.raises(batches.PredictionError, match="types"):
        batches.relaxed_union([whole, text])
    with pytest.raises(batches.PredictionError, match="column counts"):
        batches.relaxed_union([whole, spark.sql("select 1 answer, 2 b")])
    assert batches.outer_union([whole, spark.sql("select 2 b")]).count() == 2


def test_slices_and_positions(spark):
    df = spark.range(100, 137).withColumnRenamed("id", "key")
    got = batches.batch_slices(df, 5, ["key"]).orderBy("key").collect()
    assert [(r.batch_id, r.row_in_batch) for r in got] == [divmod(i, 5) for i in range(37)]
    assert [r.id for r in batches.default_row_id(df, ["key"]).orderBy("key").limit(2).collect()] == ["prob_0", "prob_1"]


def test_shuffle_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    one, two = (batches.seeded_shuffle(df.repartition(n), "id", 3).collect() for n in (2, 9))
    assert one == two and one != df.orderBy("id").collect()


def test_manifest(spark):
    paths = ["a/.h", "a/../b", "a..b", "a//b", "a/", "./a", "gone", "dup", "dup", "ok/x", "/abs"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = Counter((r.path, r.error, r.out_path) for r in manifest.path_manifest_check(df, df.where("path <> 'gone'"), "/s/").collect())
    assert got[("dup", "duplicate", None)] == 2
    assert {(p, e) for p, e, _ in got} == {("a/.h", "hidden"), ("a/../b", "parent"), ("a..b", "parent"), ("a//b", "not normalized"), ("a/", "not normalized"), ("./a", "not normalized"), ("gone", "missing"), ("dup", "duplicate"), ("ok/x", None), ("/abs", None)}
    assert {o for *_, o in got if o} == {"/s/work/ok/x", "/s/abs"}


def test_failures_become_rows(spark):
    def half(x: pd.Series) -> pd.Series:
        if (x == 13).any():
            raise ValueError("unlucky")
        return x / 2

    df = spark.createDataFrame([(13,), (4,)], "x int").repartition(1)
    assert {r.error for r in predict.batch_predict(df, half, ["x"], "answer double", ["x"]).collect()} == {"ValueError: unlucky"}
    with pytest.raises(TypeError):
        predict.batch_predict(df, lambda x: x, ["x"], "answer double", ["x"])


def test_accuracy_without_labels_is_null(spark):
    df = spark.sql("select 1 id, 5 answer, 2.0D time_s")
    none = scoring.join_expected(df, spark.sql("select 9 id, 5 answer"), "id")
    assert scoring.accuracy_summary(none).first()[:4] == (1, 0, None, None)


def test_last_expected_row_counts(spark):
    expected = spark.createDataFrame([(1, 5, 0), (1, 7, 1)], "id int, answer int, line int")
    assert scoring.join_expected(spark.sql("select 1 id, 7 answer"), expected, "id", "line").select("expected", "correct").first() == (7, True)


@pytest.mark.parametrize("n, verified", [(9, False), (10, True), (11, True)])
def test_choose_source(spark, n, verified):
    got = tables.choose_source(spark.range(n), spark.range(100, 103)).count()
    assert got == (n if verified else 3)


def test_problem_files(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('id,problem\n000123,"a, ""b""\nc $x$"\n0e64,""\n')
    assert [tuple(r) for r in tables.scan_problems(spark, str(path)).collect()] == [("000123", 'a, "b"\nc $x$'), ("0e64", None)]
    assert tables.scan_answers(spark, str(path)) is None


def test_problems_come_in_the_order_of_files_and_records(spark, tmp_path):
    for name, first in (("b", 20), ("a", 0)):
        (tmp_path / f"{name}.csv").write_text("id,problem\n" + "".join(f'{i},"p\n{i}"\n' for i in range(first, first + 20)))
    assert [r.id for r in tables.scan_problems(spark, str(tmp_path)).collect()] == [str(i) for i in range(40)]


def test_problems_keep_empty_texts_nulls_and_every_character(spark, tmp_path):
    texts = [None, "", " ", "\r", "a\r", "\n", "a\r\n", '"', '"\n"', ",", "\\", '\\"', "\0", 'a\0b\0"', "\0 null", "\0 none", "\ufeff", "  a\t", "#", 'a, ""b"" \r\n\r\n c']
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.problem for r in batch_queries.scan_problems(spark, str(tmp_path)).collect()}
    assert got == {str(i): t for i, t in enumerate(texts)}


def test_problem_files_are_cut_into_blocks_by_one_scan(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('id,problem\n1,"a\nb"\n')
    assert "Scan text" not in tables.scan_problems(spark, str(path))._jdf.queryExecution().executedPlan().toString()


def test_exec_log_cut_at_idle(spark):
    rows = [("e", 1, "stream", "stdout", "a", None, None, None, 1.0), ("e", 2, "status", None, None, None, None, "idle", 1.0), ("e", 3, "stream", "stdout", "late", None, None, None, 1.0), ("f", 1, "error", None, None, ["\x1b[31mE\x1b[0m", 'File "x"'], None, None, 1.0)]
    df = spark.createDataFrame(rows, "exec_id string, seq int, msg_type string, stream_name string, text string, traceback array<string>, plain_text string, execution_state string, elapsed_s double")
    assert sorted(map(tuple, attempts.fold_exec_log(df).collect())) == [("e", "a"), ("f", 'E\nFile "x"')]
    assert {r.exec_id: r.output for r in attempts.fold_exec_log(df, "tool", 6.0).collect()} == {"e": "a", "f": "[ERROR] Execution timed out after 6 seconds"}


def test_rolling_scan_looks_back_32_chunks(spark):
    rows = [(p, i, 1, "\\boxed{7" if i == 0 else "}" if i == at else "") for p, at in ((1, 31), (2, 32)) for i in range(40)]
    got = attempts.rolling_chunk_scan(spark.createDataFrame(rows, "p int, chunk_no int, n_tokens int, text string"), ["p"]).collect()
    assert [tuple(r) for r in got] == [(1, 31, 7)]


def test_time_budget(spark):
    df = spark.createDataFrame([(i, 400.0) for i in range(60)], "problem_no int, elapsed_s double")
    left, want = 17_400.0, []
    for i in range(60):
        want.append(max(270.0, min(900.0, left - max(0, 50 - i - 1) * 270.0)))
        left -= 400.0
    assert [r.budget for r in attempts.time_budget(df, 17_400.0).orderBy("problem_no").collect()] == want


def test_unlike_errors(spark):
    df = spark.createDataFrame([("Failed to connect to server after waiting 5", "gaierror"), ("No listener for p was registered", "E"), ('z "Exception calling application: a "b" c" d', "E"), ("m", "DeadlineError"), ("m", "other")], "m string, k string")
    got = [r.c.kind for r in df.select(batches.classify_error(F.col("m"), F.col("k"), F.lit("p")).alias("c")).collect()]
    assert got == ["SERVER_NEVER_STARTED", "SERVER_MISSING_ENDPOINT", "SERVER_RAISED_EXCEPTION", "GRPC_DEADLINE_EXCEEDED", "UNSPECIFIED"]


def test_rounding_is_by_the_exact_binary_value(spark):
    from quorate.functions.numeric import percent, round_1

    values = [0.35, 0.25, 0.45, 0.75, 12.25, 0.05, 0.15, 1234567.85, 2.675, -0.35, -0.25, 0.0, 1e15, 1e300, 0.9999999999999999, 99.95, None, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(round_1(F.col("x"))).collect()]
    assert got == [None if v is None else v if v == float("inf") else round(v, 1) for v in values]
    halves = spark.createDataFrame([(1, 8), (5, 8), (3, 8), (1, 3), (0, 5), (5, 5)], "a int, b int")
    assert [r[0] for r in halves.select(percent(F.col("a"), F.col("b"))).collect()] == ["12", "62", "38", "33", "0", "100"]


def test_row_numbers_with_a_far_value_and_any_type(spark):
    ids = [*range(3000), 10**12, *range(-5, 0)]
    frame = spark.createDataFrame([(i, f"k{i % 7}") for i in ids], "id long, kind string").repartition(5)
    assert {r.id: r.row_no for r in batches.row_numbers(frame, ["id"]).collect()} == {v: n for n, v in enumerate(sorted(ids))}
    by_text = sorted(((f"k{i % 7}", i) for i in ids))
    assert {r.id: r.row_no for r in batches.row_numbers(frame, ["kind", "id"]).collect()} == {v: n for n, (_, v) in enumerate(by_text)}
    assert batches.row_numbers(frame.limit(0), ["id"]).collect() == []


def test_batches_are_checked_by_rows_not_ids(spark):
    expected = spark.createDataFrame([(1, "a", False), (1, "b", False), (2, None, True)], "batch_id int, id string, empty boolean")
    received = spark.createDataFrame([(1, None), (1, "b"), (2, "x")], "batch_id int, id string")
    got = {r.batch_id: (r.expected, r.received, r.kind) for r in batches.batch_row_check(expected, received).collect()}
    assert got == {1: (2, 2, None), 2: (0, 1, "GATEWAY_RAISED_EXCEPTION")}


def test_rollout_values(spark, tmp_path):
    import pandas as pd

    def model(prompt: pd.Series) -> pd.Series:
        def reply(text):
            if "boxed now" in text:
                return "\\boxed{11}"
            if "code please" in text:
                seen = text.count("Code execution output")
                return f"got \\boxed{{{40 + seen}}}" if "42" in text else "```python\nprint(42)\n```"
            if "fail" in text:
                raise ValueError("no reply")
            return "hm"

        return prompt.map(reply)

    def runner(code: pd.Series) -> pd.Series:
        return code.str.extract(r"print\((\d+)\)")[0]

    def kept(df):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    problems = spark.createDataFrame([(1, 0, "boxed now"), (2, 0, "code please"), (3, 0, "never")], "problem_id int, attempt int, problem string")
    got = {r.problem_id: (r.answer, r.turns) for r in predict.multi_turn_rollout(problems, model, runner, 3, kept).collect()}
    assert got == {1: (11, 1), 2: (41, 2), 3: (None, 3)}
    failing = spark.createDataFrame([(4, 0, "fail")], "problem_id int, attempt int, problem string")
    assert [(r.answer, r.turns) for r in predict.multi_turn_rollout(failing, model, runner, 3, kept).collect()] == [(None, 1)]
