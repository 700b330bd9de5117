import math
import random
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quorate.llm.toxicity import Ftrl, features, fit, toxicity_scores, train, without_toxic

DOCS = "doc_id long, text string, lang string, score string, c0 string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1500):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        text = rng.choices(words, k=rng.randint(5, 60))
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vile,", "Rotten", "foul"]))
        docs.append((i, " ".join(text), "en", "s", "z"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_unusual_rows(spark):
    docs, labels = corpus()
    odd = [(5000, None, "en", "s", "z"), (5001, "", "en", "s", "z"), (5002, "w1 " * 30_000, "en", "s", "z"), (None, "vile rotten foul", "en", "s", "z"), (5003, "w5", "en", "s", "z"), (5003, "w5", "en", "s", "z")]
    truth = {i: y for i, _, y in labels}
    frame = spark.createDataFrame(docs + odd, DOCS)
    marks = spark.createDataFrame([*labels, (5001, 1, None), (None, 1, 1), (0, 1, None)], LABELS)
    got = toxicity_scores(frame, marks).collect()
    assert len(got) == len(docs) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert next(r for r in got if r.doc_id is None).predicted == 1
    kept = without_toxic(frame, marks)
    assert kept.columns == frame.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_weights_are_sparse():
    rng = np.random.default_rng(1)
    examples = [(y, np.unique(np.append(rng.integers(0, 1 << 16, 50), 7 if y else 8))) for y in rng.integers(0, 2, 400).tolist()]
    kept, weights, _ = train(examples, Ftrl(bits=16))
    assert len(kept) < 600 and weights[kept.tolist().index(7)] > 0.5


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], LABELS)
    got = toxicity_scores(spark.createDataFrame(corpus(5)[0], DOCS), none).collect()
    assert {r.score for r in got} == {0.5}
    assert toxicity_scores(spark.createDataFrame([], DOCS), none).collect() == []


def plain_ftrl(examples, settings):
    """The same, a coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= settings.l1:
            return 0.0
        return -(z[i] - math.copysign(settings.l1, z[i])) / ((settings.beta + math.sqrt(n[i])) / settings.alpha + settings.l2)

    order = np.random.default_rng(5)
    for _ in range(settings.epochs):
        for e in order.permutation(len(examples)):
            label, slots = examples[e]
            at = [*map(int, slots), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / settings.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_training_equals_ftrl_by_coordinates():
    rng = np.random.default_rng(7)
    examples = [(int(y), np.unique(np.append(rng.integers(0, 300, 12), 400 if y else 401))) for y in rng.integers(0, 2, 150)]
    for settings in (Ftrl(bits=10, epochs=4), Ftrl(bits=10, epochs=2, alpha=0.3, l1=0.5, l2=0.1)):
        kept, weights, bias = train(examples, settings)
        got = dict(zip(kept.tolist(), weights)) | ({"bias": bias} if bias else {})
        want = plain_ftrl(examples, settings)
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_features_are_words_starts_neighbours_and_skips():
    text, bits, mask = b"The quick, (brown) fox -- jumps OVER the", 18, (1 << 64) - 1
    words = [w.strip(b".,;:!?\"'()[]{}<>*#&%$|-_") or w for w in text.lower().split()]

    def spread(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    whole, start = [xxhash.xxh3_64_intdigest(w) for w in words], [xxhash.xxh3_64_intdigest(w[:5], seed=1) for w in words]
    pairs = [spread((a * (2 * gap + 1) + (b ^ gap)) & mask) for gap in (1, 2, 3) for a, b in zip(whole, whole[gap:])]
    assert sorted(features(text, bits).tolist()) == sorted(x >> (64 - bits) for x in whole + start + pairs)
    assert len(pairs) == 3 * len(words) - 6 and features(b"", bits).tolist() == []


def test_a_repeated_document_is_one_example(spark):
    docs, labels = corpus(60)
    frame = spark.createDataFrame(docs, DOCS)
    once = fit(frame, spark.createDataFrame(labels, LABELS), F.lit(True), Ftrl(l1=0.1))
    many = fit(frame.unionByName(frame.where("doc_id = 3").crossJoin(spark.range(50)).drop("id")), spark.createDataFrame(labels, LABELS), F.lit(True), Ftrl(l1=0.1))
    assert all(np.array_equal(a, b) for a, b in zip(once, many))
