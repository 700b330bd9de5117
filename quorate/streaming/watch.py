"""Structured Streaming forms of the operators that decide while attempts run.

State is kept by event time and ends: what a key waits for is given up once the watermark has passed what
stands after it, and a key that is silent for ``idle`` leaves nothing behind. Rows without a time, and rows
behind the watermark, don't count."""

from __future__ import annotations

import pickle
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quorate.functions import text as T
from quorate.operators.batches import check_counts


def _with_state(df: DataFrame, buckets: int, keys: list[str], processor: StatefulProcessor, out: str, time: str, delay: str, initial: DataFrame | None = None) -> DataFrame:
    """``df`` by event time, through a processor that holds the state of all keys of a bucket at once: a
    call of Python, its frames and its state cost more than the rows of most keys. Workers of state
    processors don't see what the session ships to executors, so the processor's code is pickled with it."""
    bucket = F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket_no")  # pandas renames what begins with _
    timed = df.withWatermark(time, delay).select("*", bucket)
    here = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(here)
    try:
        return timed.groupBy("bucket_no").transformWithStateInPandas(processor, out, "append", "eventTime", initial.select("*", bucket).groupBy("bucket_no") if initial is not None else None)
    finally:
        cloudpickle.unregister_pickle_by_value(here)


def _timed(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withColumn("time_ms", F.unix_millis(time))


def _runs(batch: pa.RecordBatch, keys: list[str], time: str, most: int | None = None) -> tuple[np.ndarray, list[pa.Array]]:
    """Where rows of a key that stand together begin, ``most`` at most; their keys, and the latest time of each."""
    n, times = batch.num_rows, batch.column(time)
    begins = np.zeros(n, bool)
    begins[:: most or n] = True
    for column in (batch.column(k) for k in keys):
        begins[1:] |= pc.fill_null(pc.not_equal(column.slice(0, n - 1), column.slice(1)), True).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(begins)
    latest = pa.array(np.maximum.reduceat(times.cast(pa.int64()).to_numpy(zero_copy_only=False), starts)).cast(times.type)
    return starts, [*(batch.column(k).take(pa.array(starts)) for k in keys), latest]


def _folded(df: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """Rows of a key that stand together become one: lists of ``columns``, and the latest time. A row
    that is late stays in its list, with its own time in ``time_ms``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            starts, first = _runs(batch, keys, time)
            offsets = pa.array(np.append(starts, n).astype("int32"))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*first, *lists], [*keys, time, *columns])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [*(f"`{c}` {types[c]}" for c in [*keys, time]), *(f"`{c}` array<{types[c]}>" for c in columns)]
    return df.select(*keys, time, *columns).mapInArrow(fold, ", ".join(out))


_NO_NUMBER = np.iinfo("int64").min
_PACKED = ("numbers", "times", "lengths", "text")


def _packed(df: DataFrame, keys: list[str], time: str, most: int = 256) -> DataFrame:
    """As ``_folded``, for chunks: their numbers and times in milliseconds (64 bits each), the bytes of each
    text (32 bits; -1 of a chunk without text or tokens), and the texts one after the other, as bytes. So
    the work on a run of chunks is a few calls, however many chunks it has. A row has ``most`` of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            starts, first = _runs(batch, keys, time, most)
            ends = np.append(starts, n)
            carrying = pc.fill_null(pc.and_(pc.greater(batch.column("n_tokens"), 0), pc.is_valid(batch.column("text"))), False)
            text = pc.if_else(carrying, batch.column("text"), "").cast(pa.binary())
            at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1]
            lengths = np.where(carrying.to_numpy(zero_copy_only=False), np.diff(at), -1).astype("int32")
            numbers = pc.fill_null(batch.column("chunk_no").cast(pa.int64()), _NO_NUMBER).to_numpy()
            times = batch.column(time).cast(pa.int64()).to_numpy() // 1000

            def cut(offsets: np.ndarray, data) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), data])

            columns = [*(cut(ends * a.itemsize, pa.py_buffer(np.ascontiguousarray(a))) for a in (numbers, times, lengths)), cut(at[ends], text.buffers()[2] or pa.py_buffer(b""))]
            yield pa.RecordBatch.from_arrays([*first, *columns], [*keys, time, *_PACKED])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [*(f"`{c}` {types[c]}" for c in [*keys, time]), *(f"{c} binary" for c in _PACKED)]
    return df.select(*keys, time, "chunk_no", "n_tokens", "text").mapInArrow(pack, ", ".join(out))


class _InOrder(StatefulProcessor):
    """Rows of a key in the order of a number from 0: they wait until those before them are there, or
    until the watermark has passed the first that waits, as a missing one would be late by then.
    ``steps`` takes those that follow each other; when it returns a row, that is passed on and nothing
    more, and what was gathered goes at once. A key without rows for ``idle_ms`` ends; rows that still
    come begin anew. A bucket's state is one value, with one timer, for the first key that is due.

    What waits is held in parts: the number of the first row, with its time and what else there is of
    the part. Here a part is one row."""

    columns, out = (), ()

    def __init__(self, idle_ms: int) -> None:
        self._idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", "timer_ms long, held binary")

    def begin(self) -> list:
        """What is remembered at first."""
        raise NotImplementedError

    def steps(self, memory: list, parts: list[tuple]):
        """Take parts (number, time, values); return what is to be passed on, or None. ``memory`` may be changed."""
        raise NotImplementedError

    def parts(self, row: tuple, watermark: int) -> tuple[int | None, list[tuple]]:
        """Of a row that came, with lists of numbers, times and values: the latest time, and the parts, of
        what is in time; a latest time of None where nothing is."""
        in_time = [(int(no), *of) for no, *of in zip(*(c.tolist() for c in row)) if no is not None and no == no and not 0 < watermark >= of[0]]
        return max((part[1] for part in in_time), default=None), in_time

    def count(self, part: tuple) -> int:
        """How many rows a part has, given without its number."""
        return 1

    def put(self, waiting: dict[int, tuple], next_no: int, came: list[tuple]) -> None:
        """Let parts wait; of a repeated number the last holds."""
        waiting.update((no, tuple(part)) for no, *part in came if no >= next_no)

    def _read(self) -> tuple[int | None, dict[str, list]]:
        """By key: next number, whether it is done, time of its last row, rows that wait, memory."""
        if not self._state.exists():
            return None, {}
        timer_ms, held = self._state.get()
        return timer_ms, pickle.loads(held)

    def _wake(self, of_key: list) -> int:
        _, _, last_ms, waiting, _ = of_key
        return waiting[min(waiting)][0] if waiting else last_ms + self._idle

    def _go_on(self, of_key: list, watermark: int):
        next_no, _, _, waiting, memory = of_key
        found = None
        while found is None and waiting:
            if next_no not in waiting:
                first = min(waiting)
                if waiting[first][0] > watermark:
                    break
                next_no = first
            parts = []
            while next_no in waiting:
                parts.append((next_no, *waiting.pop(next_no)))
                next_no += self.count(parts[-1][1:])
            found = self.steps(memory, parts)
        of_key[0] = next_no
        if found is not None:
            of_key[1], of_key[3], of_key[4] = True, {}, self.begin()
        return found

    def _write(self, held: dict[str, list], timer_ms: int | None, expired: bool = False) -> None:
        wake = min(map(self._wake, held.values()), default=None)
        if timer_ms != wake or expired:
            if timer_ms is not None and not expired:
                self._handle.deleteTimer(timer_ms)
            if wake is not None:
                self._handle.registerTimer(wake)
        if held:
            self._state.update((wake, pickle.dumps(held, protocol=5)))
        else:
            self._state.clear()

    def _rows(self, hits: list[tuple]) -> Iterator[pd.DataFrame]:
        if hits:
            yield pd.DataFrame(hits, columns=["of_key", *self.out])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer_ms, held = self._read()
        watermark, came = timerValues.getCurrentWatermarkInMs(), {}
        for batch in rows:
            for who, *row in zip(batch["of_key"], *(batch[c] for c in self.columns)):
                latest, parts = self.parts(row, watermark)
                if latest is None:
                    continue
                of_key = held.setdefault(who, [0, False, 0, {}, self.begin()])
                of_key[2] = max(of_key[2], latest)
                if not of_key[1]:
                    came.setdefault(who, []).extend(parts)
        for who, parts in came.items():
            self.put(held[who][3], held[who][0], parts)
        hits = [(who, *found) for who in came if (found := self._go_on(held[who], watermark)) is not None]
        if held:
            self._write(held, timer_ms)
        yield from self._rows(hits)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self._state.exists():
            return
        _, held = self._read()
        watermark, hits = timerValues.getCurrentWatermarkInMs(), []
        for who, of_key in list(held.items()):
            if not of_key[3] and of_key[2] + self._idle <= watermark:
                del held[who]
            elif of_key[3] and (found := self._go_on(of_key, watermark)) is not None:
                hits.append((who, *found))
        self._write(held, None, expired=True)
        yield from self._rows(hits)

    def close(self) -> None:
        pass


def _in_order(folded: DataFrame, keys: list[str], processor: _InOrder, out: str, time: str, delay: str, buckets: int) -> DataFrame:
    of_keys = ", ".join(f"`{k}` {folded.schema[k].dataType.simpleString()}" for k in keys)
    one = folded.withColumn("of_key", F.to_json(F.struct(*keys))).drop(*keys)
    found = _with_state(one, buckets, ["of_key"], processor, f"of_key string, {out}", time, delay)
    return found.select(F.from_json("of_key", of_keys).alias("of_key"), *processor.out).select("of_key.*", *processor.out)


class _FirstHit(_InOrder):
    """The first chunk of a turn, with tokens and a closing brace, whose last texts hold an answer. A part
    are chunks whose numbers follow each other, as ``_packed`` has them: (number of the first, its time,
    times, lengths, texts)."""

    columns, out = _PACKED, ("chunk_no", "answer")

    def __init__(self, look_back: int, idle_ms: int, patterns: list[str]) -> None:
        super().__init__(idle_ms)
        self._look_back, self._patterns = look_back, patterns

    def begin(self) -> list:
        return [b"", b""]  # lengths and texts of the last that carry tokens

    def parts(self, row, watermark):
        numbers, times = (np.frombuffer(c, np.int64) for c in row[:2])
        there = numbers != _NO_NUMBER
        if watermark > 0:
            there &= times > watermark
        if not there.any():
            return None, []
        latest = int(times[there].max())
        there &= numbers >= 0
        if not there.any():
            return latest, []
        whole = (int(numbers[0]), int(times[0]), *row[1:])
        breaks = np.flatnonzero((np.diff(numbers) != 1) | ~there[1:] | ~there[:-1]) + 1
        if len(breaks) == 0:
            return latest, [whole]
        found = zip([0, *breaks.tolist()], [*breaks.tolist(), len(numbers)])
        return latest, [(int(numbers[i]), *self._cut(whole[1:], i, j)) for i, j in found if there[i]]

    def count(self, part):
        return len(part[1]) // 8

    def _cut(self, part: tuple, i: int, j: int) -> tuple:
        """Chunks ``i`` up to ``j`` of a part, given and returned without its number."""
        _, times, lengths, text = part
        sizes = np.maximum(np.frombuffer(lengths, np.int32), 0)
        start = int(sizes[:i].sum())
        times = times[8 * i : 8 * j]
        return int(np.frombuffer(times, np.int64)[0]), times, lengths[4 * i : 4 * j], text[start : start + int(sizes[i:j].sum())]

    def put(self, waiting, next_no, came):
        every = [*((no, *part) for no, part in waiting.items()), *came]
        spans = sorted((no, no + self.count(part)) for no, *part in every)
        if any(end > start for (_, end), (start, _) in zip(spans, spans[1:])):  # numbers repeat: chunk by chunk
            every = [(no + i, *self._cut(part, i, i + 1)) for no, *part in every for i in range(self.count(part))]
        waiting.clear()
        for no, *part in every:
            before = max(next_no - no, 0)
            if before < self.count(part):
                waiting[no + before] = self._cut(part, before, self.count(part)) if before else tuple(part)

    def steps(self, memory, parts):
        for no, _, _, lengths, text in parts:
            sizes = np.frombuffer(lengths, np.int32)
            places = np.flatnonzero(sizes >= 0)
            old = len(memory[0]) // 4
            sizes, texts = np.concatenate([np.frombuffer(memory[0], np.int32), sizes[places]]), memory[1] + text
            ends = np.cumsum(sizes, dtype=np.int64)
            brace = texts.find(b"}", len(memory[1]))
            while brace >= 0:
                at = int(np.searchsorted(ends, brace, "right"))
                first = max(0, at + 1 - self._look_back)
                answer = last_answer(texts[int(ends[first] - sizes[first]) : int(ends[at])].decode("utf-8", "replace"), self._patterns)
                if answer is not None:
                    return no + int(places[at - old]), answer
                brace = texts.find(b"}", int(ends[at]))
            last = sizes[-self._look_back :]
            memory[:] = last.tobytes(), texts[len(texts) - int(last.sum()) :]
        return None


class _Votes(_InOrder):
    """Counts answers of a problem, until one has ``k`` votes."""

    columns, out = ("completion_no", "time_ms", "completion_seq", "answer"), ("stop_seq", "answer")

    def __init__(self, k: int, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self._k = k

    def begin(self) -> list:
        return []  # the answers so far

    def steps(self, memory, parts):
        for _, _, seq, answer in parts:
            if answer is not None and answer == answer:  # a list with nulls comes as floats
                memory.append(int(answer))
                if memory.count(int(answer)) >= self._k:
                    return int(seq), int(answer)
        return None


def answer_patterns() -> list[str]:
    """The patterns of ``extract_answer``, strict, as Python writes them."""
    return [re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", p) for p in (T.BOXED, T.STATED_STRICT)]


def last_answer(text: str, patterns: list[str]) -> int | None:
    """As ``extract_answer``, strict: of each pattern the last match, if it is in range."""
    for pattern in patterns:
        found = re.findall(pattern, text, re.IGNORECASE)
        digits = found[-1].replace(",", "") if found else ""
        if digits and len(digits.lstrip("0")) <= 5:
            return int(digits)
    return None


def stream_answer_watch(chunks: DataFrame, look_back: int = 32, time: str = "ts", delay: str = "1 hour", idle_ms: int = 3_600_000, buckets: int = 4096) -> DataFrame:
    """A stream of (problem_id, attempt, turn, chunk_no, answer): the first answer of each turn, once.

    Chunks may come in any order and micro-batches: they wait for those before them, but for a missing
    one only until the watermark (``delay`` behind ``time``) has passed the chunk after it. The first
    hit drops all that was gathered of the turn. Turns are held in ``buckets``; chunks of a turn that
    come one after the other travel, wait and are looked at as one row."""
    keys, hit = ["problem_id", "attempt", "turn"], _FirstHit(look_back, idle_ms, answer_patterns())
    timed = chunks.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())
    return _in_order(_packed(timed, keys, time), keys, hit, "chunk_no int, answer int", time, delay, buckets)


def stream_early_stop(attempts: DataFrame, k: int, time: str = "ts", delay: str = "1 hour", idle_ms: int = 3_600_000, buckets: int = 4096) -> DataFrame:
    """A stream of (problem_id, stop_seq, answer): once for each problem that reaches ``k`` votes, in the
    order of completion: ``completion_no`` numbers the completed attempts of a problem from 0. A number
    that is missing is passed over once the watermark has passed the attempt after it. Attempts that
    come later than ``delay`` don't count, so it must cover the disorder of what is streamed."""
    votes = _Votes(k, idle_ms)
    folded = _folded(_timed(attempts, time), ["problem_id"], time, list(votes.columns))
    return _in_order(folded, ["problem_id"], votes, "stop_seq long, answer int", time, delay, buckets)


class _Deadline(StatefulProcessor):
    """Passes on rows up to the deadline of their key. A bucket's state are the deadlines of its keys
    that the watermark has not passed."""

    def __init__(self, key: str) -> None:
        self._key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("deadline", "timer_ms long, held binary")

    def _read(self) -> tuple[int | None, dict]:
        if not self._state.exists():
            return None, {}
        timer_ms, held = self._state.get()
        return timer_ms, pickle.loads(held)

    def _write(self, held: dict, timer_ms: int | None) -> None:
        wake = min((ms for ms in held.values() if ms is not None), default=None)
        if wake != timer_ms:
            if timer_ms is not None:
                self._handle.deleteTimer(timer_ms)
            if wake is not None:
                self._handle.registerTimer(wake)
        if held:
            self._state.update((wake, pickle.dumps(held, protocol=5)))
        else:
            self._state.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        timer_ms, held = self._read()
        watermark = timerValues.getCurrentWatermarkInMs()
        first = initialState.groupby(self._key)["deadline_ms"].min()
        for who, ms in zip(first.index.tolist(), first.tolist()):
            if not pd.isna(ms):
                held[who] = int(ms) if held.get(who) is None else min(held[who], int(ms))
            else:
                held.setdefault(who, None)
        self._write({who: ms for who, ms in held.items() if ms is None or ms > watermark}, timer_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, held = self._read()
        if not held:
            return
        never, none = np.iinfo("int64").max, np.iinfo("int64").min
        last = {who: never if ms is None else ms for who, ms in held.items()}
        watermark = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            times = batch["time_ms"].to_numpy()
            in_time = times <= np.fromiter((last.get(who, none) for who in batch[self._key].tolist()), np.int64, len(batch))
            if watermark > 0:
                in_time &= times > watermark  # Spark lets rows of the last micro-batch's lag through
            if in_time.any():
                yield batch.loc[in_time, [c for c in batch.columns if c not in ("time_ms", "bucket_no")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self._read()
        watermark = timerValues.getCurrentWatermarkInMs()
        self._write({who: ms for who, ms in held.items() if ms is None or ms > watermark}, None)
        return iter([])

    def close(self) -> None:
        pass


def stream_deadline_cut(events: DataFrame, deadlines: DataFrame, key: str, time: str = "ts", delay: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """Events up to the deadline of their key, from ``deadlines`` (``key``, deadline), such as
    ``deadlines_of`` makes them of time budgets. A null deadline never comes; of repeated ones the
    first holds. A key that ``deadlines`` doesn't have, or whose deadline the watermark has passed, has
    no state, and none of its events count: so a late one never does, nor one without a key."""
    first = deadlines.where(F.col(key).isNotNull()).select(key, F.unix_millis(F.col("deadline").cast("timestamp")).alias("deadline_ms"))
    out = ", ".join(f"`{f.name}` {'timestamp' if f.name == time else f.dataType.simpleString()}" for f in events.schema.fields)
    return _with_state(_timed(events.where(F.col(key).isNotNull()), time), buckets, [key], _Deadline(key), out, time, delay, first)


def deadlines_of(budgets: DataFrame, key: str, start: Column) -> DataFrame:
    """(key, deadline) from the time budgets of ``time_budget``: seconds after ``start``."""
    return budgets.select(key, F.timestamp_millis(F.unix_millis(start) + F.round(F.col("budget") * 1000).cast("long")).alias("deadline"))


def stream_predict(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, counts_path: str):
    """Each micro-batch: predict, count rows by batch_id, write both under the number of the micro-batch.
    One that is replayed, whole or half done, overwrites what it wrote: nothing is there twice. Read
    the two with ``predictions`` and ``prediction_checks``."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark, here = batch.sparkSession, f"{path}/epoch={epoch}"
        done = predict(batch)
        done.write.mode("overwrite").parquet(here)
        written = spark.read.schema(done.schema).parquet(here)
        counts = batch.groupBy("batch_id").agg(F.count("*").alias("expected")).join(written.groupBy("batch_id").agg(F.count("*").alias("received")), "batch_id", "full")
        counts.write.mode("overwrite").parquet(f"{counts_path}/epoch={epoch}")  # last: with it the micro-batch is there

    return rows.writeStream.foreachBatch(each)


def predictions(spark: SparkSession, path: str, counts_path: str, schema: str) -> DataFrame:
    """What ``stream_predict`` wrote, of micro-batches that are complete."""
    complete = spark.read.schema("batch_id long, expected long, received long, epoch long").parquet(counts_path).select("epoch").distinct()
    return spark.read.schema(f"{schema}, epoch long").parquet(path).join(complete.hint("merge"), "epoch", "left_semi").drop("epoch")


def prediction_checks(spark: SparkSession, counts_path: str) -> DataFrame:
    """``batch_row_check`` of what ``stream_predict`` wrote, over all its micro-batches: a batch may be
    spread over several."""
    counts = spark.read.schema("batch_id long, expected long, received long, epoch long").parquet(counts_path)
    return check_counts(counts.groupBy("batch_id").agg(F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.sum("received").alias("received")))
