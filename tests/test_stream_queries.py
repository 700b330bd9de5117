"""Stream queries over tables as large copies are: ids far apart, and more keys than state rows."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quorate.plans import batch_queries, catalog
from quorate.ship import small_rows
from test_streams import CHUNKS, at, left_in_state, run
from quorate.streaming import watch


def events_apart(folder):
    """Copies of one event table under keys that lie 7,000,000 apart, so no problem begins at attempt 0."""
    rows = [(copy * 7_000_000 + i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i % 700), copy * 50 + i % 40, "view", float(i * 7 % 13), '{"k": 1}') for copy in range(5) for i in range(200)]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")


def test_early_stop_of_ids_far_apart(spark, tmp_path):
    events_apart(tmp_path)
    got = sorted(tuple(r) for r in catalog.QUERIES["stream_early_stop"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert got == sorted(db.execute(catalog.ORACLE["stream_early_stop"]).fetchall()) and len(got) > 50


def test_chunks_that_stand_together_travel_as_one(spark, tmp_path):
    rows = [(p, 0, 0, no, 1, "\\boxed{7}" if no == 3 else "x", at(no)) for p in (*range(20), None) for no in range(5)]
    df = spark.createDataFrame(rows, CHUNKS).coalesce(1)
    folded = watch._folded(df, ["problem_id", "attempt", "turn"], "ts", ["chunk_no", "text"]).collect()
    assert len(folded) < 30 and sum(len(r.text) for r in folded) == len(rows)
    assert {r.ts.second for r in folded if r.problem_id == 4} == {4}
    rows = [r for r in rows if r[0] is not None]
    got = run(spark, [[r for r in rows if r[3] % 2], [r for r in rows if r[3] % 2 == 0]], CHUNKS, lambda s: watch.stream_answer_watch(s, buckets=2), tmp_path)
    assert got == [(p, 0, 0, 3, 7) for p in range(20)]
    assert left_in_state(spark, tmp_path, "state") == 2


def test_a_late_chunk_beside_others_does_not_count(spark, tmp_path):
    rows = [(1, 0, 0, 0, 1, "x", at(5000)), (2, 0, 0, 0, 1, "x", at(5001))]
    both = [(1, 0, 0, 1, 1, "\\boxed{5}", at(10)), (1, 0, 0, 1, 1, "\\boxed{6}", at(5002))]
    got = run(spark, [rows, [(9, 0, 0, 0, 1, "x", at(5003))], both], CHUNKS, lambda s: watch.stream_answer_watch(s, delay="1 minute"), tmp_path)
    assert got == [(1, 0, 0, 1, 6)]


def test_deadlines_of_many_keys_are_few_states(spark, tmp_path):
    events = [(f"k {k}", no, at(s)) for k in range(60) for no, s in enumerate((100, 301))] + [(None, 0, at(1)), ("none", 0, at(1))]
    deadlines = spark.createDataFrame([(f"k {k}", at(200 + k % 2 * 200)) for k in range(60)] + [(None, at(900)), ("k 1", None)], "problem string, deadline timestamp")
    make = lambda s: watch.stream_deadline_cut(s, deadlines, "problem", delay="1 hour", buckets=4).select("problem", "no")
    got = run(spark, [events[:70], events[70:]], "problem string, no int, ts timestamp", make, tmp_path)
    assert got == sorted((f"k {k}", no) for k in range(60) for no in range(1 + k % 2))
    assert 0 < left_in_state(spark, tmp_path, "deadline") <= 4


def test_a_stream_is_written_by_all_tasks(spark, tmp_path):
    df = spark.range(1000, numPartitions=4).select((F.col("id") * 7 % 1000).alias("id"))
    assert batch_queries._written_in_parts(df, str(tmp_path / "in"), "id") == 4
    sizes = [spark.read.parquet(p).count() for p in spark.read.parquet(str(tmp_path / "in")).inputFiles()]
    assert sum(sizes) == 1000 and max(sizes) < 200
    assert batch_queries._written_in_parts(df.limit(0), str(tmp_path / "none"), "id") == 1
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_predictions_are_fed_by_all_tasks(spark, tmp_path, monkeypatch):
    docs = spark.range(400, numPartitions=4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int") % 9).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    paths = {}
    monkeypatch.setattr(batch_queries, "scratch_path", lambda spark, label: paths.setdefault(label, str(tmp_path / label)))
    assert {tuple(r) for r in catalog.QUERIES["stream_predict"](spark, str(tmp_path)).collect()} == {(i, i % 9) for i in range(400)}
    sizes = [spark.read.parquet(p).count() for p in spark.read.parquet(paths["predict-in"]).inputFiles()]
    assert sum(sizes) == 400 and max(sizes) <= 100  # a task's rows, not a third of all
    assert spark.read.parquet(paths["predict-counts"]).select("epoch").distinct().count() > 1


def packed_rows(chunks):
    """Rows as ``_packed`` makes them of (number, ms, tokens, text) that travel together."""
    lengths = [len(t.encode()) if n and n > 0 and t is not None else -1 for _, _, n, t in chunks]
    text = b"".join(t.encode() for (_, _, _, t), size in zip(chunks, lengths) if size >= 0)
    return [np.array([c[i] for c in chunks], np.int64).tobytes() for i in (0, 1)] + [np.array(lengths, np.int32).tobytes(), text]


def test_runs_of_chunks_are_looked_at_as_single_ones_are():
    rng, patterns, hits = np.random.default_rng(5), watch.answer_patterns(), 0
    words = ["x", "", None, "}", "\\boxed{", "7", "\\boxed{12}", "é", "the final answer is 5", "}}", "\\boxed{", "3"]
    for trial in range(300):
        n, watermark = int(rng.integers(1, 40)), int(rng.choice([0, 0, 1030]))
        texts = [words[i] for i in rng.choice(len(words), n, p=[0.45, 0.05, 0.05, 0.04, 0.08, 0.08, 0.06, 0.08, 0.01, 0.02, 0.04, 0.04])]
        rows = [(no, 1000 + int(rng.integers(0, 60)), int(rng.integers(0, 4)) if rng.random() < 0.9 else None, t) for no, t in enumerate(texts) if rng.random() < 0.97]
        rows += [(no, ms, n, "again}") for no, ms, n, _ in rows if rng.random() < 0.03]
        came = [rows[i : i + 7] for i in range(0, len(rows), 7)]
        came = [came[i] for i in rng.permutation(len(came))]
        hit = watch._FirstHit(5, 1000, patterns)
        of_key = [0, False, 0, {}, hit.begin()]
        parts = [p for run in came for p in hit.parts(packed_rows(run), watermark)[1]]
        one = {no: (tokens, text) for run in came for no, ms, tokens, text in run if not 0 < watermark >= ms}
        carrying = [(no, text) for no, (tokens, text) in sorted(one.items()) if tokens and tokens > 0 and text is not None]
        want = None
        for at, (no, text) in enumerate(carrying):
            if "}" in text and want is None and (answer := watch.last_answer("".join(t for _, t in carrying[max(0, at - 4) : at + 1]), patterns)) is not None:
                want = (no, answer)
        repeats = len({no for no, _, _, _ in rows}) < len(rows)
        half = 0 if repeats else len(parts) // 2  # what was looked at is not taken back by a repeat
        found = None
        for some in (parts[:half], parts[half:]):  # the rest waits for those before it
            if found is None:
                hit.put(of_key[3], of_key[0], some)
                found = hit._go_on(of_key, 0)
        if found is None:
            found = hit._go_on(of_key, 1 << 40)  # missing ones are given up
        assert found == want, trial
        hits += found is not None
    assert hits > 20


def test_runs_wait_as_one_part(spark):
    rows = [(1, 0, 0, no, no % 2, "abé", at(no)) for no in range(600)]
    row = watch._packed(spark.createDataFrame(rows, CHUNKS).coalesce(1), ["problem_id", "attempt", "turn"], "ts").collect()
    assert [len(r.lengths) // 4 for r in row] == [256, 256, 88] and row[0].text.decode() == "abé" * 128
    hit, waiting = watch._FirstHit(32, 1000, watch.answer_patterns()), {}
    hit.put(waiting, 0, hit.parts((row[1].numbers, row[1].times, row[1].lengths, row[1].text), 0)[1])
    assert list(waiting) == [256] and hit.count(waiting[256]) == 256


def test_bytes_are_not_counted_at_each_small_row(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(key)
    with small_rows(spark, 300):
        assert spark.conf.get(key) == bound
    with small_rows(spark, 40):
        assert int(spark.conf.get(key)) > 1 << 30
    assert spark.conf.get(key) == bound
    assert batch_queries._longest(spark.createDataFrame([(1, "é", None), (2, None, "abc")], "n int, a string, b string")) == 3


def test_deadlines_take_only_what_the_rows_need(spark, tmp_path, monkeypatch):
    events_apart(tmp_path)
    events = pd.read_parquet(tmp_path / "events.parquet")
    first = events.ts.min()
    events.assign(ts=(first + 2 * (events.ts - first)).astype("datetime64[us]")).to_parquet(tmp_path / "events.parquet")  # over 16 days
    paths = {}
    monkeypatch.setattr(batch_queries, "scratch_path", lambda spark, label: paths.setdefault(label, str(tmp_path / label)))
    got = sorted(tuple(r) for r in catalog.QUERIES["stream_deadline_cut"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert got == sorted(db.execute(catalog.ORACLE["stream_deadline_cut"]).fetchall()) and 0 < len(got) < 1000
    assert spark.read.parquet(paths["stream-in"]).columns == ["event_id", "user_id", "ts"]


def test_a_deadline_step_passes_no_empty_frames_on():
    step = watch._Deadline("who")
    step._read = lambda: (None, {"a": 5_000, "b": None})
    times = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 1_000})()
    rows = pd.DataFrame({"who": ["a", "a", "b", "c", "b"], "no": range(5), "time_ms": [5_000, 5_001, 9_000_000, 2_000, 1_000], "bucket_no": 0})
    found = list(step.handleInputRows(None, iter([rows, rows[1:2], rows[3:]]), times))
    assert [f.to_dict("list") for f in found] == [{"who": ["a", "b"], "no": [0, 2]}]
