"""Ranked lexical search: the documents that score highest for each item, found interval by interval."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import settle

#: A-Z lower-cased; what is neither a letter or digit of ASCII nor beyond ASCII becomes a space.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
#: Terms of more bytes are known by a digest; it begins with a byte that no term holds.
_LONG = 48


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _digest(term: bytes) -> bytes:
    return b"\0" + xxhash.xxh3_128_digest(term)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch["text"].cast(pa.large_binary()).to_pylist()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [[t if len(t) <= _LONG else _digest(t) for t in dict.fromkeys(terms_of(text or b""))] for text in _texts(batch)]
        yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(keys, pa.list_(pa.binary()))], ["item_id", "keys"])


def _postings(vocabulary):
    """Of each document with a term: n, and number and count of the terms that items ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {key: i for i, key in enumerate(vocabulary.value)}
        any_long = any(key[:1] == b"\0" for key in known)
        for batch in batches:
            kept, sizes, ends, terms, counts = [], [], [0], [], []
            for row, text in enumerate(_texts(batch)):
                said = terms_of(text) if text else None
                if not said:
                    continue
                found = Counter(map(known.get, said))
                found.pop(None, None)
                if any_long:
                    found.update(known[d] for d in (_digest(t) for t in said if len(t) > _LONG) if d in known)
                kept.append(row)
                sizes.append(len(said))
                terms.extend(found.keys())
                counts.extend(found.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


class Shard:
    """Posting lists of some documents, numbered from 0, each with a sparse table of range maxima.

    ``bounds`` answers, for intervals of documents, the sum over terms of the greatest impact within."""

    def __init__(self, n_docs: int, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        some = impacts > 0
        terms, docs, impacts = terms[some], docs[some], impacts[some]
        order = np.argsort(terms * n_docs + docs, kind="stable")
        terms, self.docs, self.impacts = terms[order], docs[order], impacts[order]
        self.n_docs, self.terms = n_docs, np.unique(terms)
        row = np.searchsorted(self.terms, terms)
        self.starts = np.searchsorted(row, np.arange(len(self.terms)))
        # Which documents a term has, as bits, and how many before each word of 64.
        width = n_docs // 64 + 1
        self.bits = np.zeros((len(self.terms), width), np.uint64)
        np.bitwise_or.at(self.bits, (row, self.docs >> 6), np.uint64(1) << (self.docs & 63).astype(np.uint64))
        self.before = np.zeros((len(self.terms), width), np.int32)
        np.cumsum(np.bitwise_count(self.bits)[:, :-1], axis=1, out=self.before[:, 1:])
        # table[j][i]: where the greatest of 2^j impacts from i on stands. Ranges stay within a list.
        longest = int(np.bincount(row).max(initial=1))
        level = np.arange(len(self.impacts), dtype=np.int32)
        self.table = [level]
        for j in range(1, longest.bit_length()):
            half = 1 << (j - 1)
            far = np.concatenate([level[half:], level[len(level) - half :]])[: len(level)]
            level = np.where(self.impacts[level] >= self.impacts[far], level, far)
            self.table.append(level)
        self.table = np.stack(self.table)
        self.log2 = np.zeros(longest + 1, np.int8)
        for i in range(2, longest + 1):
            self.log2[i] = self.log2[i >> 1] + 1

    def _rank(self, rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Place in the term's list of its first posting at ``doc`` or after."""
        word, below = doc >> 6, (np.uint64(1) << (doc & 63).astype(np.uint64)) - np.uint64(1)
        return self.starts[rows] + self.before[rows, word] + np.bitwise_count(self.bits[rows, word] & below)

    def bounds(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each [left, right): the summed range maxima of the terms, and the document of the
        greatest of these maxima. For one document the sum is its score."""
        column = rows[:, None]
        low, high = self._rank(column, left), self._rank(column, right)
        some = high > low
        j = self.log2[high - low]
        low, last = np.where(some, low, 0), np.where(some, high - (1 << j.astype(np.int64)), 0)
        a, b = self.table[j, low], self.table[j, last]
        best = np.where(self.impacts[a] >= self.impacts[b], a, b)
        most = np.where(some, self.impacts[best], 0)
        top = most.argmax(0)
        return most.sum(0), self.docs[best[top, np.arange(len(left))]]

    def search(self, rows: np.ndarray, k: int, best: np.ndarray, at_once: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, scores, best): up to ``k`` documents in the order of score and number, of those
        that may be among the best; ``best`` are the ``k`` greatest scores known, here or elsewhere.

        The intervals of greatest bound are taken first, ``at_once`` of them; each is split at its
        document of greatest impact, which is scored. What can't reach the k-th best score is dropped."""
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        left, right = np.zeros(1, np.int64), np.full(1, self.n_docs, np.int64)
        bound, split = self.bounds(rows, left, right)
        while True:
            least = max(int(best[-1]), 1)
            full = len(docs) == k and scores[-1] >= least
            live = (bound > least) | ((bound == least) & (left < docs[-1] if full else True))
            left, right, bound, split = left[live], right[live], bound[live], split[live]
            if not len(left):
                return docs, scores, best
            if len(left) > at_once:
                order = np.argpartition(-bound, at_once)
                first, rest = order[:at_once], order[at_once:]
            else:
                first, rest = slice(None), slice(0, 0)
            l, r, d = left[first], right[first], split[first]
            new_left, new_right = np.concatenate([d, l, d + 1]), np.concatenate([d + 1, d, r])
            sums, splits = self.bounds(rows, new_left, new_right)
            n = len(d)
            good = sums[:n] >= least
            if good.any():
                docs, scores = np.concatenate([docs, d[good]]), np.concatenate([scores, sums[:n][good]])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                best = -np.sort(-np.concatenate([best, sums[:n][good]]))[: len(best)]
            left, right = np.concatenate([left[rest], new_left[n:]]), np.concatenate([right[rest], new_right[n:]])
            bound, split = np.concatenate([bound[rest], sums[n:]]), np.concatenate([split[rest], splits[n:]])


def _searched(sent, k: int, most_docs: int, most_postings: int):
    """The best documents of each shard: batches are gathered to shards of bounded size. Scores found
    so far serve as bounds for the shards that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, starts, asked, weights, n_docs, n_terms = sent.value
        best = np.zeros((len(item_ids), k), np.int64)

        def shard_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            whole = whole.take(pc.sort_indices(whole["doc_id"], null_placement="at_end"))
            lists = whole["terms"].combine_chunks()
            terms = lists.flatten().to_numpy().astype(np.int64)
            tfs = whole["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            docs = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            # n may be large, and so may all documents: exact beyond 64 bits
            m = np.array([50 + (50 * n * n_docs) // n_terms for n in whole["n"].to_pylist()], np.int64)
            shard = Shard(len(lists), terms, docs, weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[docs])))
            found = [(np.empty(0, np.int64),) * 3]
            place = np.full(len(weights), -1)
            place[shard.terms] = np.arange(len(shard.terms))
            for item in range(len(item_ids)):
                rows = place[asked[starts[item] : starts[item + 1]]]
                rows = rows[rows >= 0]
                if len(rows):
                    hits, scores, best[item] = shard.search(rows, k, best[item])
                    found.append((np.full(len(hits), item), hits, scores))
            items, hits, scores = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([item_ids.take(pa.array(items)), whole["doc_id"].combine_chunks().take(pa.array(hits)), pa.array(scores)], ["item_id", "doc_id", "score"])

        held, postings = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                postings += len(batch["terms"].flatten())
                if sum(map(len, held)) >= most_docs or postings >= most_postings:
                    yield shard_of(held)
                    held, postings = [], 0
        if held:
            yield shard_of(held)

    return run


def _in_blocks(terms: DataFrame, most_pairs: int) -> list[DataFrame]:
    """Items in blocks of at most ``most_pairs`` terms in all; an item of more is one of its own."""
    each = settle(terms.groupBy("item_id").agg(F.count("*").alias("n")), "item-sizes")
    total = each.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / most_pairs))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
        sizes = each.groupBy(block.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("items")).where((F.col("n") > most_pairs) & (F.col("items") > 1))
        if sizes.isEmpty():
            return [terms.where(block == b) for b in range(blocks)] if total else []
        blocks *= 2


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, most_pairs: int = 1 << 16, most_docs: int = 4096, most_postings: int = 1 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of greatest score above 0, ties
    by ascending doc_id. Exact: no document is passed over but by a bound on its score.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns play no part. Terms are runs
    of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. Each row of ``docs`` is a
    document; rows of one doc_id rank one after the other, a null doc_id after equal scores. Rows of one
    item_id are one item with the terms of all. Null or empty texts have no terms; items without terms
    or hits have no rows, and so do empty tables.

    Items go in blocks of bounded size, which are what is broadcast. For a block one pass over the texts
    writes, for each document, the counts of the block's terms, and each task searches what it has of
    them in shards of ``most_docs`` documents or ``most_postings`` postings (one batch more at most), in
    place: only the best of each shard move. In a shard, posting lists have sparse tables of range
    maxima; intervals of documents are taken best bound first, see ``Shard.search``."""
    spark = docs.sparkSession
    told = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    terms = told.mapInArrow(_item_terms, f"item_id {kind(items, 'item_id')}, keys array<binary>").select("item_id", F.explode("keys").alias("key")).distinct()
    terms = settle(terms, "item-terms")
    nothing = spark.createDataFrame([], f"item_id {kind(items, 'item_id')}, rank int, doc_id {kind(docs, 'doc_id')}, score long")
    found = []
    for block in _in_blocks(terms, most_pairs):
        pairs = block.toArrow()  # at most most_pairs rows, or one item's
        if not len(pairs):
            continue
        pairs = pairs.take(pc.sort_indices(pairs, [("item_id", "ascending"), ("key", "ascending")]))
        vocabulary = pc.unique(pairs["key"]).sort()
        at = pc.index_in(pairs["key"], vocabulary).to_numpy().astype(np.int64)
        item_ids = pc.unique(pairs["item_id"])
        item_of = pc.index_in(pairs["item_id"], item_ids).to_numpy()
        starts = np.searchsorted(item_of, np.arange(len(item_ids) + 1))
        sent = spark.sparkContext.broadcast(vocabulary.to_pylist())
        index = docs.select("doc_id", "text").mapInArrow(_postings(sent), f"doc_id {kind(docs, 'doc_id')}, n long, terms array<int>, tfs array<int>")
        index = settle(index, "postings")
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row for each of the block's terms
        weights = np.zeros(len(vocabulary), np.int64)
        weights[held["term"].to_numpy()] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held["df"].to_pylist()]
        asked = spark.sparkContext.broadcast((item_ids, starts, at, weights, n_docs, n_terms))
        found.append(index.mapInArrow(_searched(asked, k, most_docs, most_postings), f"item_id {kind(items, 'item_id')}, doc_id {kind(docs, 'doc_id')}, score long"))
    if not found:
        return nothing
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


RANKED_SEARCH_SQL = r"""
WITH said AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
lower_az AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
sizes AS (SELECT r, doc_id, len(terms) AS n FROM said WHERE len(terms) > 0), totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
asked AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), (SELECT a FROM lower_az), (SELECT b FROM lower_az)) AS term FROM benchmark),
counts AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, translate(unnest(terms), (SELECT a FROM lower_az), (SELECT b FROM lower_az)) AS term FROM said) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term),
impacts AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))) AS impact FROM counts JOIN weights USING (term) JOIN sizes USING (r), totals),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) JOIN sizes USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50"""
