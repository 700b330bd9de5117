"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import doc_crc, settle
from quorate.llm.words import WordTable, mixed

_EDGES = b".,;:!?\"'()[]{}<>*#&%$|-_"


@dataclass(frozen=True)
class Ftrl:
    """Settings. ``most_rows`` bounds the labelled rows that are learned from: those whose hashed
    doc_id is least."""

    bits: int = 20
    most_rows: int = 12_000
    epochs: int = 10
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0


def _codes(word: bytes) -> bytes:
    """A word without signs at its ends, and its first letters."""
    core = word.strip(_EDGES) or word
    return xxhash.xxh3_64_digest(core) + xxhash.xxh3_64_digest(core[:5], seed=1)


_words = WordTable(_codes, width=2)


def features(text: bytes, bits: int) -> np.ndarray:
    """Slots of a text's words, word starts, pairs of neighbours, and pairs with one or two words
    between, each slot as often as it is hit."""
    with np.errstate(over="ignore"):
        found = _words(text)
        if not len(found):
            return np.zeros(0, np.int64)
        word, start = found[:, 0], found[:, 1]
        parts = [word, start]
        for gap in (1, 2, 3):
            if len(word) > gap:
                parts.append(mixed(word[:-gap] * np.uint64(2 * gap + 1) + (word[gap:] ^ np.uint64(gap))))
        return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def train(examples: list[tuple[int, np.ndarray]], settings: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias, from (label, distinct slots)."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= settings.l1, 0.0, (np.sign(z[at]) * settings.l1 - z[at]) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))

    bias = size
    order = np.random.default_rng(5)
    for _ in range(settings.epochs):
        for i in order.permutation(len(examples)):
            label, slots = examples[i]
            at = np.append(slots, bias)
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            more = slope * slope
            z[at] += slope - (np.sqrt(n[at] + more) - np.sqrt(n[at])) / settings.alpha * w
            n[at] += more
    w = weights(np.arange(size + 1))
    kept = np.flatnonzero(w[:size])
    return kept, w[kept], float(w[size])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, settings: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from at most ``settings.most_rows`` labelled rows for which ``may_learn`` holds.

    Whole texts are turned to slots where they lie; one task reads the slots of these rows and
    learns. Only the sparse weights reach the driver. Rows with a null label or doc_id are not used,
    of labels that repeat a doc_id the largest counts, and of documents that do the least text. Without rows of both labels all scores
    are equal."""
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(may_learn)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.most_rows)
    )
    sample = settle(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    labelled = texts.join(F.broadcast(sample), "doc_id")  # most_rows rows at most
    labelled = labelled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one for each, however often a doc_id is repeated

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t.as_py() or b"", settings.bits)).astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "slots"])
        _words.forget()

    rows = settle(labelled.mapInArrow(slots, "doc_id long, toxic int, slots binary"), "toxicity-slots")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(i, y, np.frombuffer(s, np.int32)) for batch in batches for i, y, s in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "slots")))]
        examples.sort(key=lambda x: (x[0], x[1], len(x[2])))  # whatever order the rows came in
        kept, weight, bias = train([(y, s) for _, y, s in examples], settings)
        yield pa.RecordBatch.from_arrays([pa.array([kept.astype(np.int64).tobytes()]), pa.array([weight.tobytes()]), pa.array([bias])], names=["slots", "weights", "bias"])

    found = rows.coalesce(1).mapInArrow(learn, "slots binary, weights binary, bias double").first()
    if found is None:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(found[0], np.int64), np.frombuffer(found[1]), found[2]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = 20) -> DataFrame:
    """Add a column ``score`` in (0, 1) to ``docs``; the model's weights are broadcast (at most
    2**bits of them, most are zero and left out)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name != "score"]
    names = [f.name for f in fields]
    kept = docs.select(*names)
    schema = kept.withColumn("score", F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = sent.value
        table = np.zeros(1 << bits)
        table[slots] = weights
        used = table != 0
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                at = features(text.as_py() or b"", bits)
                total[i] += table[np.unique(at[used[at]])].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*names, "score"])
        _words.forget()  # workers stay, and the next stage may need the memory

    return kept.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(doc_crc(doc_id) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Ftrl = Ftrl()) -> DataFrame:
    """Score every whole text; learn from labels whose crc32(doc_id) mod 3 is not 1.

    Only the text is an input of a score. Null and empty texts get the score of the bias alone. Rows
    with a null doc_id are scored, and not held out. Rows that repeat are scored alike. Columns
    besides doc_id and text are ignored. Returns doc_id, held_out, score, predicted."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")), settings)
    return score(docs.select("doc_id", "text"), model, settings.bits).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Ftrl = Ftrl()) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns; learned as by
    ``toxicity_scores``."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" if n != "text" else n for i, n in enumerate(names)))
    model = fit(docs, labels, ~held_out(F.col("doc_id")), settings)
    return score(plain, model, settings.bits).where(F.col("score") < threshold).drop("score").toDF(*names)
