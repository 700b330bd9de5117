import re

from pyspark.sql import functions as F

from quorate.llm.mixing import mix, mixed_rows

SCHEMA = "doc_id long, source string, text string, size string, copies string"


def level_by_steps(sizes, weights=(5, 2, 1)):
    """Targets by sharing again and again what the caps cut off."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ones, rest = {}, set(names), float(sum(sizes.values()))
    while open_ones:
        each = rest / sum(weight[s] for s in open_ones)
        over = {s for s in open_ones if each * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: each * weight[s] for s in open_ones}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3.0 * sizes[s] for s in over)
        open_ones -= over
    return target


def corpus():
    rows = [(i, "abcdefghij"[i % 10 if i % 3 else 0], " ".join(["w"] * (1 + i * 7 % 40)), "x", "y") for i in range(1200)]
    return rows + [(5000 + i, None, "a b c", "x", "y") for i in range(9)] + [(6000, "k", "", "x", "y"), (6001, "k", None, "x", "y"), (6002, "é", "one", "x", "y"), (6002, "é", "one", "x", "y"), (None, "a", "q r", "x", "y")]


def test_targets_and_copies(spark):
    rows = corpus()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, source, text, *_ in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = level_by_steps(sizes)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.size == words(r.text) and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 90
    again = mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.taken) for r in got) == sorted((r.doc_id or -1, r.text or "", r.taken) for r in again)
    out = mixed_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got) and out.agg(F.sum(F.length("copies"))).first()[0] == out.count()


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_columns_of_any_name_come_back_as_they_were(spark):
    rows = [(i, "ab"[i % 2], "w " * (i % 9), f"s{i}", f"t{i}", f"x{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string, target string, _slice string")
    want = {r[0]: r for r in rows}
    got = mixed_rows(docs).collect()
    assert got and all(tuple(r) == want[r.doc_id] for r in got)


def test_mix_keeps_columns_named_like_its_own(spark):
    names = ["_rank", "_class", "_source", "_slice", "_k", "_each", "_offset", "_start", "_target", "c0"]
    rows = [(i, "ab"[i % 2], "w " * (i % 9), *(f"{n}{i}" for n in names)) for i in range(60)]
    docs = spark.createDataFrame(rows, ["doc_id", "source", "text", *names])
    got = mix(docs)
    assert got.columns == ["doc_id", "source", "text", *names, "size", "source_size", "target", "copies", "taken"]
    want = {r[0]: r for r in rows}
    assert all(tuple(r)[:13] == want[r.doc_id] for r in got.collect())
