"""Streams give the same whatever way their input is cut into micro-batches, and leave no state behind."""

import glob
import os
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.functions.text import extract_answer
from quorate.operators.attempts import time_budget
from quorate.operators.predict import batch_predict
from quorate.streaming import watch

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, parts, schema, make, folder):
    """The stream's rows; a micro-batch for each part, in order."""
    source, target = str(folder / "in"), str(folder / "out")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for path in glob.glob(f"{source}/*.parquet"):
            if os.stat(path).st_mtime > 1e9 + 1e6:
                os.utime(path, (1e9 + i, 1e9 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(target).collect())


def left_in_state(spark, folder, name):
    return spark.read.format("statestore").option("path", str(folder / "state")).option("stateVarName", name).load().count()


VOTES = "problem_id long, completion_no int, completion_seq long, answer int, ts timestamp"


@pytest.mark.parametrize("order", ["all at once", "later half first"])
def test_early_stop(spark, tmp_path, order):
    rows = [(1, no, 100 + no, answer) for no, answer in enumerate([1, 1, 2, 2, None])] + [(2, 0, 7, 3), (2, 1, 9, None)] + [(3, 1, 5, 8), (3, 2, 6, 8)]
    rows += [(4, no, 40 + no, answer) for no, answer in enumerate([None, 6, 5, None, 5])]
    rows = [(*r, at(r[1])) for r in rows]
    parts = [rows] if order == "all at once" else [[r for r in rows if r[1] >= 2], [r for r in rows if r[1] < 2]]
    got = run(spark, parts, VOTES, lambda s: watch.stream_early_stop(s, 2), tmp_path)
    assert got == [(1, 101, 1), (4, 44, 5)]  # problem 3 waits for its first attempt
    assert left_in_state(spark, tmp_path, "state") == 4


def test_a_missing_completion_is_given_up_and_keys_end(spark, tmp_path):
    rows = [(3, 1, 5, 8, at(10)), (3, 2, 6, 8, at(11)), (4, 0, 1, 7, at(12))]
    late = [(3, 0, 4, 8, at(5))]  # in time it would have ended the vote with the attempt before
    parts = [rows, [(9, 0, 1, 1, at(3000))], [(9, 0, 1, 1, at(3001))], late, [(9, 1, 2, 1, at(20_000))], [(9, 2, 3, 1, at(20_001))]]
    got = run(spark, parts, VOTES, lambda s: watch.stream_early_stop(s, 2, delay="10 minutes", idle_ms=600_000), tmp_path)
    assert got == [(3, 6, 8), (9, 2, 1)]
    assert left_in_state(spark, tmp_path, "state") == 1  # that of 9


CHUNKS = "problem_id long, attempt int, turn int, chunk_no int, n_tokens int, text string, ts timestamp"


@pytest.mark.parametrize("cut", [0, 3, 5])
def test_first_hit_of_chunks_in_any_order(spark, tmp_path, cut):
    texts = ["a", "\\boxed{", "7", "}", "and", "\\boxed{9}", "}"]
    rows = [(5, 0, 0, no, 1, text, at(no)) for no, text in enumerate(texts)] + [(6, 0, 0, 0, 0, "\\boxed{1}", at(0)), (6, 0, 0, 1, 1, "}", at(1)), (6, 0, 0, 2, None, None, at(1))]
    assert run(spark, [rows[cut:], rows[:cut]], CHUNKS, watch.stream_answer_watch, tmp_path) == [(5, 0, 0, 3, 7)]


def test_a_missing_chunk_is_given_up(spark, tmp_path):
    rows = [(5, 0, 0, no, 1, text, at(no)) for no, text in ((0, "\\boxed{"), (2, "8"), (3, "}"), (7, "\\boxed{2}"))]
    late = [(5, 0, 0, 1, 1, "9", at(1))]
    other = lambda s: [(1, 0, 0, 0, 1, "x", at(s))]
    got = run(spark, [rows, other(1000), other(1001), late, other(9000), other(9001)], CHUNKS, lambda s: watch.stream_answer_watch(s, delay="1 minute", idle_ms=60_000), tmp_path)
    assert got == [(5, 0, 0, 3, 8)]
    assert left_in_state(spark, tmp_path, "state") == 1  # of the other problem's last chunk


def test_the_watch_reads_answers_as_the_batch_does(spark):
    texts = ["\\boxed{ 1,234 }", "\\BOXED{5} \\boxed{123456}", "final\u2003answer is 12 or FINAL ANSWER IS 1,3", "final answer is: 4", "\\boxed{,}final anſwer iſ 9", "", "\\boxed{000000000007}", "\\boxed{\x1c8\u3000}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [r[0] for r in df.select("i", extract_answer(F.col("t"), "strict").alias("a")).orderBy("i").select("a").collect()]
    assert [watch.last_answer(t, watch.answer_patterns()) for t in texts] == want


def test_deadlines_from_budgets(spark, tmp_path):
    events = [(k, no, at(s)) for k in (1, 2, 3, 4) for no, s in enumerate((100, 299, 301, 2000))]
    late = [(1, 9, at(200)), (2, 9, at(200)), (1, 10, at(5000))]
    timings = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.0)], "problem int, problem_no int, elapsed_s double")
    deadlines = watch.deadlines_of(time_budget(timings, 1e6, base=300.0, high=300.0, problems=1, keys=["problem"]), "problem", F.lit(START))
    deadlines = deadlines.unionByName(spark.createDataFrame([(3, None)], "problem int, deadline timestamp"))
    make = lambda s: watch.stream_deadline_cut(s, deadlines, "problem", delay="1 minute").select("problem", "no")
    got = run(spark, [events, late, [(3, 11, at(9000))]], "problem int, no int, ts timestamp", make, tmp_path)
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (3, 3), (3, 11)]  # 4 has no deadline row
    assert left_in_state(spark, tmp_path, "deadline") == 1  # the one that never comes


def test_a_replayed_micro_batch_is_there_once(spark, tmp_path):
    def length_of(text: pd.Series) -> pd.Series:
        return text.str.len()

    rows = spark.createDataFrame([(i, i % 3, "x" * i) for i in range(30)], "id long, batch_id long, text string")
    source, target, counts, state = (str(tmp_path / x) for x in ("in", "out", "counts", "state"))
    rows.repartition(3).write.parquet(source)

    def go():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        predict = lambda batch: batch_predict(batch, length_of, ["text"], "answer long", ["id", "batch_id"])
        watch.stream_predict(stream, predict, target, counts).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        found = watch.predictions(spark, target, counts, "id long, batch_id long, answer long, error string")
        return sorted((r.id, r.answer) for r in found.collect()), sorted(tuple(r) for r in watch.prediction_checks(spark, counts).collect())

    first = go()
    assert first == ([(i, i) for i in range(30)], [(b, 10, 10, None, None) for b in range(3)])
    last = max(glob.glob(f"{state}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{target}/epoch={os.path.basename(last)}/part*")}
    for path in (last, f"{state}/commits/.{os.path.basename(last)}.crc"):  # as if the driver had died before the commit
        if os.path.exists(path):
            os.remove(path)
    assert go() == first
    assert before != {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{target}/epoch={os.path.basename(last)}/part*")}
    orphan = spark.createDataFrame([(99, 0, 1, None)], "id long, batch_id long, answer long, error string")
    orphan.write.parquet(f"{target}/epoch=77")  # predictions of a micro-batch that didn't get to its counts
    assert go() == first
