"""Line dedup against a plain model."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quorate.llm.linededup import dedup_lines, line_dedup_digests

LONG = "a line of words that is long enough to be counted"


def model(rows, least_chars=40, least_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate(lower)
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(doc)
    keeper = {k: max(d for d in docs if d is not None) for k, docs in held.items() if len(docs) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def hard_rows():
    rows = [(i, f"own {i}\n {LONG.upper()}\t\nend\n{LONG}") for i in range(5)]
    rows += [(9, f"{LONG}\r\n\n{LONG}\x0b"), (10, None), (11, ""), (12, "\n\n"), (None, LONG), (None, f"{LONG}\nÄ")]
    rows += [(13, f"{LONG}x "), (14, "É" * 40), (15, "é" * 40), (16, "é" * 40)]
    rows += [(i, "É" * 40 + "\n" + "short line " * 2) for i in range(20, 25)]  # É is not é
    rows += [(3, f"own 3\n {LONG.upper()}\t\nend\n{LONG}")] * 2  # equal rows
    rows += [(40, "\n".join([LONG, "x"] * 3000)), (41, LONG)]  # very many lines, and a text that loses all
    rows += [(i, LONG[:40]) for i in range(50, 54)] + [(i, LONG[:39].strip() + "  ") for i in range(60, 66)]  # four documents only; 39 characters only
    return rows


def test_against_a_model(spark):
    rows = hard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", F.lit("x").alias("key"), F.lit(1).alias("place"), F.lit(2).alias("_doc"), F.lit(3).alias("dropped"))
    got = [tuple(r) for r in dedup_lines(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(model(rows), key=order)
    assert {(r[2], r[3]) for r in got if r[0] == 41} == {(0, LONG)} and (None, 1, 1, "") in got  # the largest holder, and one that loses all


def test_digest_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in line_dedup_digests(docs).collect()} == {(1, 2, 0, hashlib.sha256(b"a\nb").hexdigest()), (2, 1, 0, hashlib.sha256(b"").hexdigest())}
    assert line_dedup_digests(docs.limit(0)).count() == 0
    assert dedup_lines(docs).columns == ["doc_id", "n_lines", "n_dropped", "kept"]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    plan = line_dedup_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", ""))
