"""Running sums, numbers and segments, where one key or tie has most rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quorate.operators import attempts, batches
from quorate.operators.prefix import dealt_by_ranges, ordered_segments, prefix_sums
from quorate.sources import tables


@pytest.fixture
def small_parts_stay(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_over_a_hot_key(spark, small_parts_stay):
    rows = [("hot", i, i % 7) for i in range(3000)] + [(None, i, 1) for i in range(40)] + [(f"k{i % 9}", i, None if i % 5 == 0 else i) for i in range(90)]
    frame = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    got = {(r.k, r.o): r.s for r in prefix_sums(frame, ["k"], ["o"], {"s": F.col("v")}).collect()}
    want, so_far = {}, defaultdict(int)
    for k, o, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[k, o] = so_far[k]
        so_far[k] += v or 0
    assert got == want
    assert dealt_by_ranges(frame.where("k = 'hot'"), ["k", "o"], "t").select("_range").distinct().count() > 1
    assert prefix_sums(frame.limit(0), ["k"], ["o"], {"s": F.col("v")}).collect() == []


def test_ties_are_spread_over_ranges(spark, small_parts_stay):
    tied = spark.range(200_000).withColumn("same", F.lit(1)).repartition(4)
    ranges = [r["count"] for r in dealt_by_ranges(tied, ["same"], "ties").groupBy("_range").count().collect()]
    assert len(ranges) > 1 and max(ranges) < 100_000
    numbers = batches.row_numbers(tied, ["same"]).select("row_no")
    assert numbers.distinct().count() == 200_000 and tuple(numbers.agg(F.min("row_no"), F.max("row_no")).first()) == (0, 199_999)


@pytest.mark.parametrize("limit", [1, 7, 100, 1 << 20])
def test_segments(spark, limit):
    rows = [(1, i, "é" * (i % 4) + str(i)) for i in range(60)] + [(2, 0, "one"), (3, 0, None), (3, 1, ""), (4, 0, "x" * 500), (4, 1, "y")]
    frame = spark.createDataFrame(rows, "k int, o int, t string").repartition(3)
    found = defaultdict(dict)
    for r in ordered_segments(frame, ["k"], "o", F.col("t"), limit, "|", "!").collect():
        found[r.k][r.segment] = r.text
    for k in (1, 2, 3, 4):
        texts = [t for kk, _, t in sorted(rows) if kk == k and t is not None] if k != 3 else [""]
        assert "".join(found[k][i] for i in range(len(found[k]))) == "|".join(texts) + "!"
        longest = max(len(t.encode()) for t in texts)
        assert all(len(t.encode()) <= limit + longest + 2 for t in found[k].values())
    assert len(found[1]) > 1 or limit > 100


def test_long_attempts_as_segments(spark):
    said = spark.createDataFrame([(1, 0, t, "user", f"{t:05d}") for t in range(50)] + [(1, 1, 0, "user", None)], "problem_id int, attempt int, turn int, role string, content string")
    got = sorted(attempts.trace_segments(said, 60).collect())
    assert [r.segment for r in got if r.attempt == 0] == list(range(5)) and [m.content for r in got if r.attempt == 0 for m in r.messages] == [f"{t:05d}" for t in range(50)]
    assert [len(r.messages) for r in got if r.attempt == 1] == [1]
    whole = attempts.full_response(said.where("attempt = 0"), ["problem_id"]).first().full_response
    assert "".join(r.text for r in sorted(attempts.full_response(said.where("attempt = 0"), ["problem_id"], limit=17).collect(), key=lambda r: r.segment)) == whole


def test_one_run_of_budgets_is_many_tasks(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(400)], "problem_no int, elapsed_s double").repartition(4)
    got = {r.problem_no: r.budget for r in attempts.time_budget(df, 17_400.0).collect()}
    used = 0.0
    for i in range(400):
        assert got[i] == max(270.0, min(900.0, 17_400.0 - used - max(0, 50 - i - 1) * 270.0))
        used += i % 3
    plan = attempts.time_budget(df, 17_400.0)._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [i for i, line in enumerate(plan) if "SinglePartition" in line]
    assert len(single) == 1 and any("HashAggregate(keys=[_range" in line for line in plan[single[0] + 1 : single[0] + 3])  # a row for each range


def test_a_csv_file_cut_in_blocks(spark, tmp_path):
    rows = [(f"{i:05d}", f'p {i}, "quoted"\n\nline\r\nend {"x" * (i % 300)}' if i % 3 else f"plain {i}") for i in range(400)] + [("last", "")]
    text = "id,problem\r\n" + "".join('{},"{}"\r\n'.format(i, p.replace('"', '""')) if "\n" in p or not p else f"{i},{p}\n" for i, p in rows)
    path = tmp_path / "p.csv"
    path.write_bytes((text + "\n\n").encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "3000")
    try:
        got = tables.scan_problems(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        assert sorted(tuple(r) for r in got.collect()) == sorted((i, p or None) for i, p in rows)
        records = tables.csv_records(spark, str(path)).select("record_no").collect()
        assert sorted(r[0] for r in records) == list(range(402))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(ValueError, match="has the columns"):
        tables.scan_problems(spark, str(path), "id string, question string")


@pytest.mark.parametrize("variant", ["plain", "tool"])
@pytest.mark.parametrize("timeout", [None, 6.0])
def test_folded_logs_in_segments(spark, variant, timeout):
    said = [["out  ", " \n"], [" \n", "\t"], ["a\n", "b ", "  "], [], ["", "x"]]
    errs = [["bad ", " \n"], [" "], [], ["e1\n", "e2 \n", " "]]
    rows = []
    for i, out in enumerate(said):
        for j, err in enumerate(errs):
            texts = [("stdout", t) for t in out] + [("stderr", t) for t in err]
            texts = texts[::2] + texts[1::2] if (i + j) % 2 else texts
            rows += [(f"{i}{j}", n, "stream", name, t, None, None, None, float(i + j)) for n, (name, t) in enumerate(texts)]
            rows += [(f"{i}{j}", 50, "execute_result", None, None, None, "7" if (i + j) % 3 == 0 else "", None, 1.0)]
            rows += [(f"{i}{j}", 60, "error", None, None, ["tb", 'File "lib"'], None, None, 1.0)] if (i + j) % 4 == 0 else []
            rows += [(f"{i}{j}", 70 if j % 2 else 55, "status", None, None, None, None, "idle", 1.0)] if i != 1 else []
    log = spark.createDataFrame(rows, "exec_id string, seq int, msg_type string, stream_name string, text string, traceback array<string>, plain_text string, execution_state string, elapsed_s double")
    want = {r.exec_id: r.output for r in attempts.fold_exec_log(log, variant, timeout).collect()}
    for limit in (1, 1 << 20):
        found = defaultdict(dict)
        for r in attempts.fold_exec_log_segments(log, variant, timeout, limit).collect():
            found[r.exec_id][r.segment] = r.text
        assert {k: "".join(v[i] for i in range(len(v))) for k, v in found.items()} == want
