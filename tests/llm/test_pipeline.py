"""The pipeline on a small corpus, stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorate.llm.jaccard import jaccard_components


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        text = rng.choices(words, k=rng.randint(8, 60)) + (["vile", "rotten", "foul"] * 2 if toxic else [])
        docs.append((i, " ".join(text), "en", f"src{i % 4}", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[1 + 6 * i][1], "en", "src1", 1) for i in range(20)] + [(2000, None, None, None, None), (2001, "", "en", "src0", 0), (2001, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, seen[-1], folder)
        assert out.columns == names
        out.write.parquet(f"{folder}/stage{k}")
        seen.append(spark.read.parquet(f"{folder}/stage{k}"))
    clean, single, mixed = seen[1:]
    gone = docs.join(clean, "doc_id", "left_anti")
    assert gone.where("doc_id % 6 = 0 and doc_id < 300").count() >= 45 and gone.where("doc_id % 6 <> 0 or doc_id >= 300").count() <= 3
    reps = jaccard_components(clean).where("doc_id = component_id").select("doc_id").distinct().count()
    assert single.count() == reps == single.select("doc_id").distinct().count()
    assert single.where("doc_id between 1000 and 1019").count() <= 1
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = corpus_pipeline.run(spark, folder).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert sum(r.piece == 0 for r in packed) == mixed.count()


def test_stages_take_empty_long_null_and_oddly_named_rows(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, signature string, _rank string, score string, copy string"
    rows = [(i, " ".join(f"w{(i * 7 + j) % 150}" for j in range(20)), "en", "a", 1, "s", "g", f"r{i}", "c", "p") for i in range(40)]
    rows += [(None, None, None, None, None, *"sgrcp"), (50, None, "en", None, 1, *"sgrcp"), (51, "", "en", "b", 1, *"sgrcp"), (52, "very long " * 60_000, "en", "b", 1, *"sgrcp"), (53, "tie", "en", "b", 1, *"sgrcp"), (53, "tie", "en", "b", 1, *"sgrcp")]
    for n, docs in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        names, want = docs.columns, {r[7] for r in rows}
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            docs = stage(spark, docs, folder)
            assert docs.columns == names
            docs.write.parquet(f"{folder}/odd{n}-{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/odd{n}-{k}")
            assert {r[0] for r in docs.select("_rank").collect()} <= want
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert bool(packed) == (n == 0) and sum(r.piece == 0 for r in packed) == docs.count()
