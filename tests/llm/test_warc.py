import base64
import hashlib
import random

from pyspark.sql import functions as F

from quorate.llm.warc import archive_digests, chunked, read_chunks, record_plan, write_archives

SCHEMA = "page_id long, url string, html string, digest string, head long"


def pages():
    rows = [(i, f"http://h/{i}", f"<p>{i % 40}</p>\r\n\r\nWARC/1.1" * (1 + i % 3), "x", 1) for i in range(300)]
    return rows + [(900, None, None, "x", 1), (901, "u\r\nX: é", "", "x", 1), (902, "u", "é" * 200_000, "x", 1), (903, "u", "only", "x", 1), (903, "u", "only", "x", 1), (None, "u", "null id", "x", 1), (904, "u", "null id", "x", 1)]


def test_digests_of_what_was_written(spark, tmp_path):
    rows = pages()
    head = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            head[html or ""] = max(page_id, head.get(html or "", page_id))
    got = archive_digests(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a")).collect()
    want = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        first = head[html or ""]
        same = page_id != first
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if same else "response", first if same else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_small_payloads_are_all_responses(spark, tmp_path):
    got = archive_digests(spark.createDataFrame(pages(), SCHEMA), str(tmp_path / "b"), least_bytes=10**9).collect()
    assert {r.record_type for r in got} == {"response"} and len(got) == len(pages())


def test_chunks_join_to_the_payload(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    chunks = read_chunks(write_archives(record_plan(df, 10**9), str(tmp_path / "c")), chunk_bytes=1000, with_data=True)
    rows = chunks.where("page_id = 902").orderBy("chunk_no").collect()
    assert len(rows) == 400 and b"".join(r.data for r in rows).decode() == "é" * 200_000 and [r.last for r in rows] == [False] * 399 + [True]
    assert chunks.where("page_id = 901").select("url").first()[0] == "u\r\nX: é"
    assert chunks.where(F.col("last")).count() == len(pages())


def test_archives_are_read_by_a_task_each(spark, tmp_path):
    manifest = write_archives(record_plan(spark.createDataFrame(pages(), SCHEMA), 10**9).repartition(6), str(tmp_path / "e"))
    archives = manifest.count()
    readers = read_chunks(manifest).select(F.spark_partition_id().alias("p")).distinct().count()
    assert archives > 1 and readers == archives


def test_empty_table(spark, tmp_path):
    assert archive_digests(spark.createDataFrame([], SCHEMA), str(tmp_path / "d")).collect() == []


def test_payloads_beyond_an_arrow_batch_are_cut_before_python(spark, tmp_path):
    long = random.Random(1).randbytes(13_000_000).hex()
    df = spark.createDataFrame([(1, "u", long), (2, "u", "short"), (3, "u", long)], "page_id long, url string, html string").repartition(1)
    table = chunked(record_plan(df))
    sizes = {(r.page_id, r.chunk_no): r.n for r in table.select("page_id", "chunk_no", F.octet_length("data").alias("n")).collect()}
    assert sizes == {(1, 0): None, (2, 0): 5} | {(3, i): min(1 << 20, 26_000_000 - (i << 20)) for i in range(25)}
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in archive_digests(df, str(tmp_path / "f")).collect()}
    sha = base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
    assert got[1] == (26_000_000, "revisit", 3, sha) and got[3] == (26_000_000, "response", None, sha) and got[2][:3] == (5, "response", None)


def test_many_revisits_are_joined_not_sent(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    plain = [c for c in record_plan(df).columns]
    sent, joined = (sorted(map(str, record_plan(df, most_sent=n).collect())) for n in (10**6, 0))
    assert sent == joined and plain == ["page_id", "url", "record_type", "refers_to", "sha1", "size", "payload"]
    plan = record_plan(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
