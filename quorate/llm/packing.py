"""Best-fit packing of token sequences by a configuration linear program."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import gapless_rank, settle
from quorate.llm.sharding import BinTree

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Numbers(dict):
    """Numbers words as they come; ``fresh`` are those that came since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class ChunkIds:
    """Token ids of texts, as the unmodified tokenizer gives them.

    The tokenizer lower-cases, and never joins what ASCII white space divides, so each word between
    white space is encoded once, numbered and remembered. Beyond ``most`` words or ``most_bytes`` the
    half that was met least is forgotten, and turn, by which numbers hold, goes up. A full stop or comma at a word's end, after a letter or digit, is a token of its own, so the word
    without it serves. New words of letters alone go to the tokenizer as one line, and its marks of
    word ends tell which ids belong to which word; other new words go to it one by one. The
    tokenizer's special tokens are found in the text as it stands, before it is lower-cased, so a
    text that may hold one goes to it whole."""

    def __init__(self, tokenizer_path: str, most: int = 700_000, most_bytes: int = 32 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)).encode() or rb"(?!)", re.IGNORECASE)
        self._heads = {t[:2].lower().encode() for t in special}
        self._most, self._most_bytes = most, most_bytes
        self.turn, self.names, self.words, self._bytes = 0, [], Numbers(), 0
        self._start, self._length, self._ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self._met, self._used = np.zeros(1 << 16, np.int32), 0

    def _forget(self, longest: int = 64) -> None:
        n = len(self.names)
        kept = np.sort(np.argsort(-self._met[:n], kind="stable")[: min(n, self._most) // 2])
        kept = np.array([i for i in kept.tolist() if len(self.names[i]) <= longest], np.int64)
        length, ids = self._length[kept], self._joined(kept)
        self._start[: len(kept)], self._length[: len(kept)], self._met[: len(kept)] = np.cumsum(length) - length, length, self._met[kept] // 2
        self._met[len(kept) :] = 0
        self._ids, self._used = ids, len(ids)
        self.names, self.words = [self.names[i] for i in kept.tolist()], Numbers()
        self.words.update(zip(self.names, range(len(kept))))
        self._bytes = sum(map(len, self.names)) + 4 * len(ids)
        self.turn += 1

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        length = np.take(self._length, numbers)
        at = np.repeat(np.take(self._start, numbers) - np.cumsum(length) + length, length)
        at += np.arange(len(at))
        return np.take(self._ids, at)

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [array("I", found.ids).tobytes() for found in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _line(self, words: list[str]) -> list[bytes]:
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = 4 * (np.flatnonzero(self._ends[ids]) + 1)
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return self._one_by_one(words)
        packed, ends = ids.tobytes(), ends.tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        words, others, found = {}, {}, {}
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            (words if text.isalpha() else others)[chunk] = text
        for some, encode in ((words, self._line), (others, self._one_by_one)):
            keys, texts = list(some.keys()), list(some.values())
            for i in range(0, len(keys), 4096):
                found.update(zip(keys[i : i + 4096], encode(texts[i : i + 4096])))
        return found

    def _learn(self) -> None:
        """Ids of the words that are new."""
        fresh, self.words.fresh = self.words.fresh, []
        if not fresh:
            return
        cores = [w[:-1] if w[-1] in b".," and w[-2:-1].isalnum() else w for w in fresh]
        found = self._encode(list({*cores, b".", b","}))
        packed = [found[c] if c is w else found[c] + found[w[-1:]] for w, c in zip(fresh, cores)]
        length = np.fromiter(map(len, packed), np.int32, len(packed)) // 4
        first, n, ids = len(self.words) - len(fresh), len(self.words), np.frombuffer(b"".join(packed), np.uint32)
        wanted = ((self._start, n), (self._length, n), (self._met, n), (self._ids, self._used + len(ids)))
        self._start, self._length, self._met, self._ids = (_room(x, want) for x, want in wanted)
        self.names += fresh
        self._length[first:n] = length
        self._start[first:n] = self._used + np.cumsum(length) - length
        self._ids[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        self._bytes += sum(map(len, fresh)) + 4 * len(ids)

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """Numbers of the words of each text; they hold until ``turn`` changes."""
        if len(self.words) > self._most or self._bytes > self._most_bytes:
            self._forget()
        found = []
        for text in texts:
            words = text.lower().split()
            found.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        self._learn()
        if found:
            met = np.bincount(np.concatenate(found), minlength=1)
            self._met[: len(met)] += met.astype(np.int32)
        return found

    def ids(self, text: bytes, numbers: np.ndarray) -> np.ndarray:
        """Ids of a text, given the numbers of its words."""
        if any(head in text for head in self._heads) and self._special.search(text):
            return np.array(self._tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
        return self._joined(numbers)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        return [self.ids(text, numbers) for text, numbers in zip(texts, self.numbers(texts))]


def words_of(texts: pa.Array, at_once: int = 4 << 20) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of binary texts, lower-cased in A-Z, one text's after another's, and how many each text has;
    for texts of about ``at_once`` bytes at a time."""
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(length) // at_once
    for first, end in zip(cut := [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()], [*cut[1:], len(texts)]):
        if first == end:
            continue
        some = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(first, end - first), b"").view(pa.string())))
        words = pc.ascii_split_whitespace(some)
        counts, words = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), words.flatten().view(pa.binary())
        empty = pc.equal(pc.binary_length(some), 0)  # has an empty word
        if empty.true_count:
            counts -= empty.to_numpy(zero_copy_only=False)
            words = words.filter(pc.greater(pc.binary_length(words), 0))
        yield words, counts


class WordIds(ChunkIds):
    """The same ids, numbered by Arrow: each different word of some texts is looked up once. New words of
    small letters of Latin-1 alone, in which the tokenizer has nothing to normalize or to split, go to it
    without that."""

    _plain = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch

    def numbers(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.words) > self._most or self._bytes > self._most_bytes:
            self._forget()
        found = []
        for words, counts in words_of(texts):
            coded = words.dictionary_encode()
            different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            of = np.fromiter(map(self.words.__getitem__, different), np.int32, len(different))
            every = np.take(of, coded.indices.to_numpy()) if len(of) else of
            self._learn()
            if len(every):
                met = np.bincount(every)
                self._met[: len(met)] += met.astype(np.int32)
            ends = np.cumsum(counts).tolist()
            found += [every[a:b] for a, b in zip([0, *ends], ends)]
        return found

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        from tokenizers import pre_tokenizers

        tokenizer, plain, others, is_plain = self._tokenizer, {}, [], self._plain
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            if is_plain(text):
                plain[chunk] = text
            else:
                others.append(chunk)
        found = super()._encode(others)
        usual = tokenizer.normalizer, tokenizer.pre_tokenizer
        bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        tokenizer.normalizer, tokenizer.pre_tokenizer = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_])
        try:
            keys, texts = list(plain), list(plain.values())
            for i in range(0, len(keys), 4096):
                found.update(zip(keys[i : i + 4096], self._line(texts[i : i + 4096])))
        finally:
            tokenizer.normalizer, tokenizer.pre_tokenizer = usual
        return found


def _room(values: np.ndarray, want: int) -> np.ndarray:
    """At least ``want`` places, the old values first."""
    if want <= len(values):
        return values
    more = np.zeros(max(want, 2 * len(values)), values.dtype)
    more[: len(values)] = values
    return more


_encoders: dict[tuple, ChunkIds] = {}


def encoder(tokenizer_path: str, made: type[ChunkIds] = ChunkIds, **limits: int) -> ChunkIds:
    """One for each Python worker, so that what it remembers serves later tasks."""
    key = (tokenizer_path, made, *sorted(limits.items()))
    if key not in _encoders:
        _encoders[key] = made(tokenizer_path, **limits)
    return _encoders[key]


def encoder_at_rest() -> None:
    """Forget what this worker's encoders remember, and give memory back: for stages that are followed by
    others with large tables of their own."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Documents as runs of ids, each ended by id 0, cut only where longer than ``capacity``.

    A null text is an empty one: its only id is 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path, most=350_000, most_bytes=16 << 20)  # other stages have left workers large
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of([t.as_py() or b"" for t in batch.column(1)])):
                ids = np.append(ids, np.uint32(0))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    some = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(some), zlib.crc32(some.astype("<u4").data)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder_at_rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, _PIECES)


def _knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity, items in any number; and the item taken last, 0 for none."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(values > 0)
    worth = values[lengths]
    for c in range(1, capacity + 1):
        fits = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if fits:
            total = worth[:fits] + best[c - lengths[:fits]]
            i = int(total.argmax())
            if total[i] > best[c]:
                best[c], last[c] = total[i], lengths[i]
    return best, last


def configuration_lp(counts: np.ndarray, capacity: int, rounds: int = 12, slack: float = 0.002, rate: float = 1.0) -> dict[tuple[int, ...], float]:
    """Patterns of lengths (largest first) with the fractional number of sequences of each.

    Multiplicative weights: the price of a length is its size times exp(rate * lag), where lag is
    how far its cover stands behind the mean cover. In each round one knapsack dynamic program
    prices all patterns; for each length the best pattern that holds it is used, for a
    1/``rounds`` share of its count, if its value is within ``slack`` of the best. What the LP leaves
    uncovered is packed after rounding."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return {}
    left = counts.astype(float)
    used: dict[tuple[int, ...], float] = defaultdict(float)
    for turn in range(2 * rounds):
        open_ones = lengths[left[lengths] > 1e-9]
        if not len(open_ones):
            break
        cover = 1 - left[open_ones] / counts[open_ones]
        price = np.zeros(capacity + 1)
        price[open_ones] = open_ones / capacity * np.exp(rate * (cover.mean() - cover))
        best, last = _knapsack(price, capacity)
        for length in open_ones[np.lexsort((-open_ones, cover))]:
            if price[length] + best[capacity - length] < (1 - slack * (1 + turn)) * best[capacity]:
                continue
            pattern, room = [int(length)], capacity - length
            while room > 0:
                if last[room] and best[room] > best[room - 1]:
                    pattern.append(int(last[room]))
                    room -= last[room]
                else:
                    room -= 1
            need = Counter(pattern)
            step = min(min(left[k] / a, max(counts[k] / rounds, 1.0) / a) for k, a in need.items())
            if step <= 1e-9:
                continue
            used[tuple(sorted(pattern, reverse=True))] += step
            for k, a in need.items():
                left[k] = max(0.0, left[k] - a * step)
    return used


def packing_plan(counts: np.ndarray, capacity: int, **options) -> dict[tuple[int, ...], int]:
    """Whole numbers of sequences by pattern, covering ``counts`` exactly: the linear program's
    patterns rounded down, and best-fit decreasing for the rest (at most a few for each pattern). Where
    best-fit decreasing alone needs fewer sequences than that, its plan."""
    counts = counts.astype(np.int64)
    left, plan = counts.copy(), Counter()
    # A length that fills a sequence alone needs no search, however many there are.
    if left[capacity]:
        plan[(capacity,)] += int(left[capacity])
        left[capacity] = 0
    plain = plan + _best_fit_runs(left, capacity)
    for pattern, times in sorted(configuration_lp(left, capacity, **options).items(), key=lambda x: (-x[1], x[0])):
        need = Counter(pattern)
        whole = min(int(times + 1e-6), *(int(left[k]) // a for k, a in need.items()))
        if whole > 0:
            plan[pattern] += whole
            for k, a in need.items():
                left[k] -= a * whole
    plan += _best_fit_runs(left, capacity)
    return dict(min(plan, plain, key=Counter.total))


def _best_fit_runs(left: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing over runs of equal sequences: all sequences with the same content are
    one entry, so the work follows the number of lengths, not of documents."""
    tree, runs, found = BinTree(), {}, Counter()
    key = 0
    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        while todo:
            got = tree.pop_tightest(length)
            if got is None:
                each = capacity // length
                whole, rest = divmod(todo, each)
                for times, a in ((whole, each), (1 if rest else 0, rest)):
                    if times:
                        key += 1
                        runs[key] = ((length,) * a, times)
                        tree.insert((capacity - a * length, key))
                break
            room, at = got
            pattern, times = runs.pop(at)
            each = min(room // length, -(-todo // times))
            full = min(times, todo // each)
            for more, a in ((full, each), (times - full, 0)):
                if more:
                    key += 1
                    runs[key] = (pattern + (length,) * a, more)
                    tree.insert((room - a * length, key))
            todo -= full * each
    for pattern, times in runs.values():
        found[tuple(sorted(pattern, reverse=True))] += times
    return found


def place_pieces(pieces: DataFrame, capacity: int = 2048, slices: int = 256) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces.

    The plan is made on the driver from the histogram of lengths (at most ``capacity`` rows), and
    sent to the tasks as slots: runs of equal places, a few for each pattern. The piece with rank r
    among those of its length takes the r-th slot of that length."""
    histogram = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row[0]] = row[1]
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken, base = Counter(), 0
    for pattern, times in sorted(packing_plan(counts, capacity).items(), reverse=True):
        at = 0
        for length in pattern:
            slots[length].append((taken[length], base, at))
            taken[length] += times
            at += length
        base += times
    sent = pieces.sparkSession.sparkContext.broadcast({k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in slots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, start, at = table[int(length[rows[0]])]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = start[run] + rank[rows] - first[run], at[run]
            keep = [batch.column(n) for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])

    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], F.struct("doc_id", "piece"), slices, "packing-ranks")
    return ranked.select(*pieces.columns, "rank").mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Pack documents into as few sequences of at most ``capacity`` tokens as can be.

    Null and empty texts are the single id 0. Texts of any length are cut into pieces of
    ``capacity`` ids, the last one shorter. Rows that repeat a doc_id are packed each. An empty table
    gives an empty result. Columns besides doc_id and text are ignored.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place_pieces(settle(tokenized_pieces(docs, tokenizer_path, capacity), "packing-pieces"), capacity)
