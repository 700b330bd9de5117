"""Language-model scores: a causal self-attention model over subword ids, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import doc_crc, settle
from quorate.llm.packing import WordIds, encoder, encoder_at_rest, words_of

@dataclass(frozen=True)
class Shape:
    """Sizes of the model. ``top`` ids have a number of their own; every other id is seen as one of
    ``others`` by its remainder. Neighbours are counted by ``kinds`` of texts, whose profiles come from
    all learning rows; only where their search begins comes from about ``warm_rows`` of them. Every
    learning row is learned from, whole, ``warm_batch`` windows at a step, in ``rounds`` rounds of parameter
    averaging; where tasks have few steps, all rows are gone through up to ``warm_passes`` times."""

    top: int = 2048
    others: int = 16
    kinds: int = 6
    width: int = 8
    scored: int = 64
    context: int = 16
    stride: int = 1
    vocabulary: int = 49_408
    end: int = 49_407
    warm_rows: int = 1000
    warm_passes: int = 6
    warm_batch: int = 96
    rounds: int = 2
    rate: float = 0.03
    smooth: float = 0.05
    discount: float = 0.6
    shared: float = 0.15

    @property
    def size(self) -> int:
        """How many tokens the model tells apart."""
        return self.top + self.others


# ---- counts over the whole corpus -------------------------------------------------------------


def word_table(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, n) of all texts: words are counted where they lie, ``most`` different ones at a time,
    then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for words, _ in words_of(batch.column("text")):
                words, n = words.value_counts().flatten()
                held.append(pa.table([words, n], names=["word", "n"]))
                rows += len(words)
                if rows > 2 * most:
                    held = [summed()]
                    rows = len(held[0])
                    if rows > most:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if rows:
            yield from summed().to_batches()

    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(ids: DataFrame, shape: Shape) -> np.ndarray:
    """How often each id occurs in a table of id lists. At most one row for each id is collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(shape.vocabulary, np.int64)
        for batch in batches:
            if batch.num_rows:
                found += np.bincount(np.concatenate(list(_id_lists(batch, shape))), minlength=shape.vocabulary)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["id", "n"])

    table = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    uni = np.zeros(shape.vocabulary, np.int64)
    uni[table.column("id").to_numpy()] = table.column("n").to_numpy()
    return uni


def grid_counts(ids: DataFrame, index: np.ndarray, profiles: np.ndarray, shape: Shape, flush: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """How often a token number follows another in texts of each kind, over whole texts and so across
    words; the last row is for the first token of a text. A text is of the kind whose profile fits its
    tokens best. Each task gives out the cells of about ``flush`` tokens of one kind at a time, which are
    summed in Spark, so what is collected has the grids' size at most, whatever the input. Returns the
    cells that are not 0, by (kind, before, after) as one number, and their counts."""
    size, cells = shape.size, (shape.size + 1) * shape.size
    sent = ids.sparkSession.sparkContext.broadcast((index, np.ascontiguousarray(profiles.T)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, fits = sent.value
        parts, held = [[] for _ in profiles], [0] * len(profiles)

        def given(kind: int) -> Iterator[pa.RecordBatch]:
            found = np.bincount(np.concatenate([before.astype(np.int32) * size + after for before, after in parts[kind]]), minlength=cells)
            at = np.flatnonzero(found)
            for i in range(0, len(at), 1 << 18):
                some = at[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(some + kind * cells), pa.array(found[some])], names=["cell", "n"])
            parts[kind], held[kind] = [], 0

        for batch in batches:
            for row in _id_lists(batch, shape):
                after = of[row]
                kind = int((np.bincount(after, minlength=size) @ fits).argmax())
                before = np.append(after.dtype.type(size), after[:-1])
                for i in range(0, len(after), flush):  # a long text in parts
                    parts[kind].append((before[i : i + flush], after[i : i + flush]))
                    held[kind] += len(parts[kind][-1][0])
                    if held[kind] >= flush:
                        yield from given(kind)
        for kind in range(len(profiles)):
            if held[kind]:
                yield from given(kind)

    small = "int" if len(profiles) * cells < 1 << 31 else "long"
    table = settle(ids.select("ids").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "lm-grid")
    table = table.select(F.col("cell").cast(small), F.col("n").cast("float")).toArrow()  # as many rows as cells at most, of 8 bytes each
    at, n = (table.column(c).to_numpy() for c in ("cell", "n"))
    order = np.argsort(at)
    return at[order], n[order]


def _id_kind(shape: Shape) -> np.dtype:
    return np.dtype("<u2" if shape.vocabulary <= 1 << 16 else "<u4")


def _id_lists(batch: pa.RecordBatch, shape: Shape) -> Iterator[np.ndarray]:
    """The lists of ids of a batch, each with the end id last."""
    for row in batch.column("ids"):
        yield np.frombuffer(row.as_buffer(), _id_kind(shape))


# ---- the model --------------------------------------------------------------------------------


def numbering(uni: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The leading ids, and a token number for each id: its place among them, or that of "another id"."""
    leading = np.argsort(-uni, kind="stable")[: shape.top]
    index = (shape.top + np.arange(shape.vocabulary) % shape.others).astype(np.int16 if shape.size < 1 << 15 else np.int32)
    index[leading] = np.arange(len(leading))
    return leading, index


def kinds_of_texts(counts: np.ndarray, kinds: int, rounds: int = 10) -> np.ndarray:
    """Logarithms of the token shares of each kind of text, from the token counts of some texts: a
    mixture of multinomials, which starts from k-means. Its centres start far from each other."""
    whole = counts.sum(axis=0) + 0.05
    if not len(counts):
        return np.log(np.repeat(whole[None] / whole.sum(), kinds, axis=0)).astype(np.float32)
    unit = np.sqrt(counts)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    centre = unit.mean(axis=0, keepdims=True)
    while len(centre) < kinds:
        centre = np.concatenate([centre, unit[(unit @ centre.T).max(axis=1).argmin()][None]])
    for _ in range(rounds):
        of = (unit @ centre.T).argmax(axis=1)
        centre = np.stack([unit[of == c].sum(axis=0) if (of == c).any() else centre[c] for c in range(kinds)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    share = np.eye(kinds)[(unit @ centre.T).argmax(axis=1)]
    for _ in range(rounds):
        profile = share.T @ counts + 20 * whole / whole.sum()
        profile = np.log(profile / profile.sum(axis=1, keepdims=True))
        fit = counts @ profile.T + np.log((share.sum(axis=0) + 1) / (len(counts) + kinds))
        share = np.exp(fit - fit.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    return profile.astype(np.float32)


def _discounted(counts: np.ndarray, below: np.ndarray, discount: float) -> np.ndarray:
    """Absolute discounting of each row: what is taken off goes to ``below``, which sums to 1."""
    off = discount * (counts > 0).sum(axis=1, keepdims=True) + 0.01
    return (np.maximum(counts - discount, 0) + off * below) / (counts.sum(axis=1, keepdims=True) + 0.01)


class Prior:
    """What the counts alone say: for each kind of text the probability of each token after each other
    one, discounted towards how readily a token follows others in that kind, and towards the pairs of all
    kinds for the part ``shared``. ``chance`` has a row of kinds for each pair of tokens."""

    def __init__(self, uni: np.ndarray, cells: np.ndarray, n: np.ndarray, shape: Shape) -> None:
        """From the counts of the ids, and those of neighbours as ``grid_counts`` has them."""
        self.shape, self.cells, self.n = shape, cells, n
        leading, self.index = numbering(uni, shape)
        self.start = shape.size
        # Of "another id", which one.
        merged = np.isin(np.arange(shape.vocabulary), leading, invert=True)
        rest = np.where(merged, uni + shape.smooth, 0)
        total = np.bincount(self.index, rest, shape.size)[self.index]
        self.rest_log = np.where(merged, np.log(np.maximum(rest, 1e-30) / np.maximum(total, 1e-30)), 0).astype(np.float32)

    def __getstate__(self) -> dict:
        """Without ``chance``, which is made from the counts."""
        return {k: v for k, v in self.__dict__.items() if k != "chance"}

    @cached_property
    def chance(self) -> np.ndarray:
        return np.concatenate(list(self._blocks())).reshape(-1, self.shape.kinds)

    def of_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Rows of ``chance``."""
        return np.take(self.chance, pairs, axis=0)

    def _blocks(self) -> Iterator[np.ndarray]:
        """``chance`` for some tokens before at a time."""
        shape, size = self.shape, self.shape.size
        kind, place = np.divmod(self.cells, (size + 1) * size)
        anew = np.bincount(kind.astype(np.int64) * size + place % size, minlength=shape.kinds * size).reshape(shape.kinds, size).astype(float)  # a token is likely anew if it follows many others
        of_all = anew.sum(axis=0) + shape.smooth
        of_all /= of_all.sum()
        anew += 100 * of_all
        anew /= anew.sum(axis=1, keepdims=True)
        first = np.searchsorted(kind, np.arange(shape.kinds + 1))
        for at in range(0, size + 1, 64):
            end = min(at + 64, size + 1)
            some = np.zeros((shape.kinds, (end - at) * size))
            for k, (a, b) in enumerate(zip(first, first[1:])):
                a, b = a + np.searchsorted(place[a:b], (at * size, end * size))
                some[k, place[a:b] - at * size] = self.n[a:b]
            some = some.reshape(shape.kinds, end - at, size)
            together = _discounted(some.sum(axis=0), of_all, shape.discount)
            found = np.empty((end - at, size, shape.kinds), np.float32)
            for k, counts in enumerate(some):
                found[:, :, k] = _discounted(counts, shape.shared * together + (1 - shape.shared) * anew[k], shape.discount)
            yield found


class SentPrior(Prior):
    """A prior as tasks have it: each probability in 16 bits, by its logarithm down to 2e-9, so within
    1/6,000 of it. Half the bytes of ``chance``, and no counts; its size follows from the shape alone."""

    steps = np.exp(np.linspace(math.log(2e-9), 0, 1 << 16)).astype(np.float32)

    def __init__(self, prior: Prior) -> None:
        self.shape, self.index, self.start, self.rest_log = prior.shape, prior.index, prior.start, prior.rest_log
        step = -math.log(2e-9) / ((1 << 16) - 1)
        self.coded = np.concatenate([np.rint((np.log(np.maximum(block, 2e-9)) - math.log(2e-9)) / step).astype(np.uint16) for block in prior._blocks()]).reshape(-1, prior.shape.kinds)

    def of_pairs(self, pairs: np.ndarray) -> np.ndarray:
        return np.take(self.steps, np.take(self.coded, pairs, axis=0, mode="clip"), mode="clip")


def windows(index: np.ndarray, start: int, shape: Shape) -> np.ndarray:
    """Overlapping windows over the tokens of one text, as rows of ``context + scored + 1`` token
    numbers: the last ``scored`` are each predicted once (-1 where the text has ended)."""
    n = len(index)
    rows = -(-n // shape.scored)
    padded = np.full(shape.context + rows * shape.scored + 1, -1, index.dtype)
    padded[: shape.context + 1] = start
    padded[shape.context + 1 : shape.context + 1 + n] = index
    return np.lib.stride_tricks.sliding_window_view(padded, shape.context + shape.scored + 1)[:: shape.scored][:rows]


def windows_of(texts: list[np.ndarray], prior: Prior) -> tuple[np.ndarray, np.ndarray]:
    """The ``windows`` of several texts, given as ids, one text's after another's; and how many each has."""
    shape, length = prior.shape, np.array([len(ids) for ids in texts], np.int64)
    lead, n = shape.context + 1, -(-length // shape.scored)
    room = n * shape.scored + lead
    first = np.cumsum(room) - room
    padded = np.full(int(room.sum()), -1, prior.index.dtype)
    padded[(first[:, None] + np.arange(lead)).reshape(-1)] = prior.start
    for ids, at in zip(texts, (first + lead).tolist()):
        np.take(prior.index, ids, out=padded[at : at + len(ids)], mode="clip")
    at = np.repeat(first - (np.cumsum(n) - n) * shape.scored, n) + np.arange(int(n.sum())) * shape.scored
    return np.lib.stride_tricks.sliding_window_view(padded, lead + shape.scored)[at] if len(at) else np.zeros((0, lead + shape.scored), padded.dtype), n


def _flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def _tanh(x: np.ndarray) -> np.ndarray:
    """By one exponential, which takes half of numpy's own time."""
    y = np.minimum(x, 40)
    y += y
    np.exp(y, out=y)
    y += 1
    np.divide(-2, y, out=y)
    y += 1
    return y


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, kind: np.dtype, *shape: int) -> np.ndarray:
    """An array to write in, the same at each call: to get large ones from the system anew each time costs
    more than what is done in them."""
    n = math.prod(shape)
    if name not in _rooms or _rooms[name].size < n or _rooms[name].dtype != kind:
        _rooms[name] = np.empty(n, kind)
    return _rooms[name][:n].reshape(shape)


class Attention:
    """One head over the window, asked at every ``stride``-th place, by default at each: from what it
    reads come the shares of the kinds in the next ``stride`` tokens' probabilities. Windows are gone through
    ``part`` at a time, in arrays that are kept."""

    names = ("embed", "place", "query", "key", "value", "gate", "bias")
    most = 4.0  # of an output weight, so that exponentials stay far below what overflows
    part = 64

    def __init__(self, prior: Prior, shape: Shape, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        d, span = shape.width, shape.context + shape.scored
        self.shape = shape
        self.embed = rng.normal(0, 0.3, (prior.start + 1, d)).astype(np.float32)
        self.place = rng.normal(0, 0.1, (span, d)).astype(np.float32)
        self.query, self.key, self.value = (rng.normal(0, d**-0.5, (d, d)).astype(np.float32) for _ in range(3))
        self.gate, self.bias = rng.normal(0, 0.3, (shape.kinds, d)).astype(np.float32), np.zeros(shape.kinds, np.float32)
        self.asked = np.arange(shape.context, span, shape.stride)
        self.open = (np.arange(span)[None, :] <= self.asked[:, None]).astype(np.float32)

    def _made(self) -> tuple[np.ndarray, bool]:
        """What makes of a token its key, its value, a place for a 1, and its query, side by side; and
        whether a weight may be so large that its exponential has to be bounded."""
        d = self.shape.width
        longest = [sum(math.sqrt(((m @ to) ** 2).sum(axis=1).max()) for m in (self.embed, self.place)) for to in (self.query, self.key)]
        made = np.concatenate([self.key, self.value, np.zeros((d, 1), np.float32), self.query * np.float32(d**-0.5)], axis=1)
        return made, not longest[0] * longest[1] * d**-0.5 < 40

    def _read(self, token: np.ndarray, keep: dict | None = None, made: tuple[np.ndarray, bool] | None = None) -> np.ndarray:
        """What the head reads at each asked place, each number between -1 and 1: windows x places x width."""
        made, steep = made or self._made()
        s, n = self.shape, len(token)
        d, span = s.width, s.context + s.scored
        kind = np.result_type(self.embed, made)
        x = _room("x", kind, n, span, d)
        np.take(self.embed, token, axis=0, out=x, mode="clip")
        x += self.place
        all_ = _room("made", kind, n, span, 3 * d + 1)
        np.matmul(_flat(x), made, out=_flat(all_))
        all_[:, :, 2 * d] = 1
        k, v, q = all_[:, :, :d], all_[:, :, d : 2 * d + 1], all_[:, s.context :: s.stride, 2 * d + 1 :]
        a = np.matmul(q, k.transpose(0, 2, 1), out=_room("weights", kind, n, q.shape[1], span))
        if steep:
            np.minimum(a, 40, out=a)
        np.exp(a, out=a)
        a *= self.open
        o = np.matmul(a, v, out=_room("read", kind, n, q.shape[1], d + 1))  # the last number is the sum of the weights
        mean = np.divide(o[:, :, :d], o[:, :, d:], out=_room("mean", kind, n, q.shape[1], d))
        read = _tanh(mean)
        if keep is not None:
            keep.update(x=x, q=q, k=k, v=v, a=a, total=o[:, :, d:], mean=mean, read=read)
        return read

    def _mixed(self, tokens: np.ndarray, read: np.ndarray, prior: Prior):
        """For each asked place: whether there is a target, the probability of each target by kind times
        the kind's weight, and the weights, which are yet to be divided by their sum."""
        s = self.shape
        seen = np.maximum(tokens[:, s.context :], 0, dtype=np.intp)
        pairs = seen[:, :-1] * prior.start
        pairs += seen[:, 1:]
        joint = prior.of_pairs(pairs.reshape(-1)).reshape(len(read), s.stride, -1)
        share = read @ self.gate.T
        share += self.bias
        np.exp(share, out=share)
        joint *= share[:, None]
        return (tokens[:, s.context + 1 :] >= 0).reshape(len(read), s.stride), joint, share

    def log_of_windows(self, tokens: np.ndarray, prior: Prior, made: tuple[np.ndarray, bool] | None = None) -> np.ndarray:
        """Natural logarithm of the probability of each target; 0 where there is none."""
        made, logs = made or self._made(), np.zeros((len(tokens), self.shape.scored), np.float32)
        ones = np.ones(self.shape.kinds, np.float32)
        for i in range(0, len(tokens), self.part):
            some = tokens[i : i + self.part]
            read = _flat(self._read(np.maximum(some[:, :-1], 0, dtype=np.intp), made=made))
            there, joint, share = self._mixed(some, read, prior)
            found = (_flat(joint) @ ones).reshape(there.shape)
            found /= (share @ ones)[:, None]
            found[~there] = 1
            np.log(found.reshape(len(some), -1), out=logs[i : i + self.part])
        return logs

    def gradients(self, tokens: np.ndarray, prior: Prior) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch of windows and its slope in each parameter."""
        s, made = self.shape, self._made()
        each = np.float32(1 / max((tokens[:, s.context + 1 :] >= 0).sum(), 1))
        token, dx = np.maximum(tokens[:, :-1], 0, dtype=np.intp), _room("dx", self.embed.dtype, len(tokens), s.context + s.scored, s.width)
        loss, of_made, gate, bias = 0.0, np.zeros_like(made[0]), np.zeros_like(self.gate), np.zeros_like(self.bias)
        for i in range(0, len(tokens), self.part):
            part = slice(i, i + self.part)
            loss += self._slopes(tokens[part], token[part], prior, each, made, of_made, gate, bias, dx[part])
        d = s.width
        g = {"gate": gate, "bias": bias, "key": of_made[:, :d], "value": of_made[:, d : 2 * d], "query": of_made[:, 2 * d + 1 :] * np.float32(d**-0.5)}
        g["place"] = (np.ones(len(dx), dx.dtype) @ dx.reshape(len(dx), -1)).reshape(self.place.shape)
        columns = np.ascontiguousarray(_flat(dx).T)
        g["embed"] = np.stack([np.bincount(token.reshape(-1), column, len(self.embed)) for column in columns], axis=1).astype(np.float32)
        return loss, g

    def _slopes(self, tokens, token, prior, each, made, of_made, gate, bias, dx) -> float:
        """The loss of some windows; what they add to the slopes is added, or written to ``dx``."""
        s, kept = self.shape, {}
        d = s.width
        read = _flat(self._read(token, kept, made))
        there, joint, share = self._mixed(tokens, read, prior)
        ones = np.ones(s.kinds, share.dtype)
        found, total, owed = (_flat(joint) @ ones).reshape(there.shape), share @ ones, there * each
        joint *= (owed / found)[:, :, None]
        dz = share
        dz *= (owed.sum(axis=1) / total)[:, None]
        for i in range(s.stride):
            dz -= joint[:, i]
        gate += dz.T @ read
        bias += np.ones(len(dz), dz.dtype) @ dz
        q, k, v, a = (kept[i] for i in "qkva")
        do = dz @ self.gate
        np.multiply(read, read, out=read)
        np.subtract(1, read, out=read)
        do *= read
        do = do.reshape(kept["read"].shape)
        do /= kept["total"]
        both = _room("both", do.dtype, *do.shape[:2], d + 1)
        both[:, :, :d] = do
        back = kept["mean"]
        back *= do
        both[:, :, d] = (_flat(back) @ np.full(d, -1, do.dtype)).reshape(do.shape[:2])
        da = np.matmul(both, v.transpose(0, 2, 1), out=_room("da", do.dtype, *a.shape))
        da *= a
        x, width = kept["x"], (*token.shape, d)
        of_key = np.matmul(da.transpose(0, 2, 1), q, out=_room("of_key", do.dtype, *width))
        of_value = np.matmul(a.transpose(0, 2, 1), do, out=_room("of_value", do.dtype, *width))
        of_query = np.matmul(da, k, out=_room("of_query", do.dtype, *do.shape))
        asked = np.ascontiguousarray(x[:, s.context :: s.stride])
        for at, of, own in ((0, of_key, x), (d, of_value, x), (2 * d + 1, of_query, asked)):
            of_made[:, at : at + d] += _flat(own).T @ _flat(of)
        np.matmul(_flat(of_key), made[0][:, :d].T, out=_flat(dx))
        dx += (_flat(of_value) @ made[0][:, d : 2 * d].T).reshape(dx.shape)
        dx[:, s.context :: s.stride] += (_flat(of_query) @ made[0][:, 2 * d + 1 :].T).reshape(do.shape)
        logs = np.log(found / total[:, None])
        return -float((logs * there).sum() * each)

    def train_through(self, texts: Iterator[np.ndarray], prior: Prior, rate: float, turn: int = 0) -> int:
        """Adam once through the windows of all texts, mixed among 64 batches at a time. Returns how many
        windows there were."""
        s, rng, adam = self.shape, np.random.default_rng(17 + turn), Adam(self)
        held, some, n, seen = 64 * s.warm_batch, [], 0, 0

        def learn() -> int:
            found = windows_of(some, prior)[0]
            for first in range(0, len(found), held):
                every = found[first : first + held]
                order = rng.permutation(len(every))
                for i in range(0, len(every), s.warm_batch):
                    adam.step(every[order[i : i + s.warm_batch]], prior, rate * min(1.0, (len(every) - i) / s.warm_batch))
            return len(found)

        for ids in texts:
            some.append(ids)
            n += -(-len(ids) // s.scored)
            if n >= held:
                seen += learn()
                some, n = [], 0
        return seen + learn()

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.names])

    def put(self, flat: np.ndarray) -> None:
        """Take the parameters from one row of numbers."""
        at = 0
        for n in self.names:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def log_probability(self, texts: list[np.ndarray], prior: Prior, at_once: int = 128) -> np.ndarray:
        """Natural logarithm of the probability of each text, given as ids that end with the end id."""
        every, n = windows_of(texts, prior)
        owner, made = np.repeat(np.arange(len(texts)), n), self._made()
        total = np.array([np.take(prior.rest_log, ids, mode="clip").sum(dtype=np.float64) for ids in texts])
        for i in range(0, len(every), at_once):
            total += np.bincount(owner[i : i + at_once], self.log_of_windows(every[i : i + at_once], prior, made).sum(axis=1, dtype=np.float64), len(texts))
        return total


class Adam:
    """Steps of Adam on a model's parameters, as one row of numbers."""

    def __init__(self, model: Attention) -> None:
        self.model, self.t = model, 0
        size = sum(getattr(model, n).size for n in model.names)
        self.first, self.second, self.room = (np.zeros(size, np.float32) for _ in range(3))

    def step(self, rows: np.ndarray, prior: Prior, rate: float) -> None:
        _, g = self.model.gradients(rows, prior)
        slope = np.concatenate([g[name].reshape(-1) for name in self.model.names])
        self.t += 1
        self.first *= np.float32(0.9)
        self.first += np.float32(0.1) * slope
        slope *= slope
        slope *= np.float32(0.01)
        self.second *= np.float32(0.99)
        self.second += slope
        np.sqrt(self.second, out=self.room)
        self.room += np.float32(1e-6)
        np.divide(self.first, self.room, out=self.room)
        self.room *= np.float32(rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        at = 0
        for n in self.model.names:
            own = getattr(self.model, n)
            own -= self.room[at : at + own.size].reshape(own.shape)
            at += own.size
        for n in ("gate", "bias"):
            np.clip(getattr(self.model, n), -self.model.most, self.model.most, out=getattr(self.model, n))


# ---- the operator -----------------------------------------------------------------------------


def fit(ids: DataFrame, shape: Shape = Shape()):
    """From all of a written table of row and ids: the counts, broadcast, attention, and how many windows
    its rounds went through, which is every one of the table, each as often as the others."""
    uni = id_counts(ids, shape)
    index = numbering(uni, shape)[1]
    kinds = kinds_of_all(ids, uni, index, _first_kinds(ids, uni, index, shape), shape)
    prior = SentPrior(Prior(uni, *grid_counts(ids, index, kinds, shape), shape))
    model = Attention(prior, shape)
    sent = ids.sparkSession.sparkContext.broadcast(prior)
    steps = max(1, int(uni.sum()) // (shape.scored * shape.warm_batch * max(1, ids.rdd.getNumPartitions())))  # of a task in one pass, nearly
    seen, turns = 0, shape.rounds * max(1, min(shape.warm_passes, -(-150 // steps)))
    for turn in range(turns):
        rate = shape.rate * (1 - 0.8 * turn / max(turns - 1, 1))
        seen += _round(ids.where(F.pmod("row", F.lit(shape.rounds)) == turn % shape.rounds), model, sent, turn, rate)
    return sent, model, seen


def _first_kinds(ids: DataFrame, uni: np.ndarray, index: np.ndarray, shape: Shape) -> np.ndarray:
    """Profiles from about ``warm_rows`` rows, in one task, for ``kinds_of_all`` to begin with."""
    share = max(1, -(-int(uni[shape.end]) // max(shape.warm_rows, 1)))
    some = settle(ids.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select("row", "ids"), "lm-warm")

    def profiles(lists: list[np.ndarray]) -> np.ndarray:
        counts = [np.bincount(index[ids], minlength=shape.size) for ids in lists]
        return kinds_of_texts(np.array(counts, float).reshape(len(lists), shape.size), shape.kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(row, ids) for batch in batches for row, ids in zip(batch.column("row").to_pylist(), _id_lists(batch, shape))]
        yield pa.RecordBatch.from_arrays([pa.array([profiles([ids for _, ids in sorted(found, key=lambda x: x[0])]).tobytes()], pa.binary())], names=["made"])

    made = some.coalesce(1).mapInArrow(run, "made binary").first()
    return np.frombuffer(made[0], np.float32).reshape(shape.kinds, shape.size) if made else profiles([])


def kinds_of_all(ids: DataFrame, uni: np.ndarray, index: np.ndarray, profiles: np.ndarray, shape: Shape, passes: int = 20) -> np.ndarray:
    """The profiles of the kinds of all texts of a table: the mixture of ``kinds_of_texts``, from the given
    profiles on, every row at each step, until the texts' likelihood grows by less than a millionth."""
    whole, share, reached = np.bincount(index, uni, shape.size) + 0.05, np.zeros(shape.kinds), -np.inf
    for _ in range(passes):
        sent = ids.sparkSession.sparkContext.broadcast((index, np.ascontiguousarray(profiles.T, float), share))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            of, logs, share = sent.value
            n, total, of_kind, likelihood = 0, np.zeros((shape.kinds, shape.size)), np.zeros(shape.kinds), 0.0
            room = np.empty((64, shape.size))
            for batch in batches:
                lists = list(_id_lists(batch, shape))
                for i in range(0, len(lists), 64):
                    counts = room[: len(lists[i : i + 64])]
                    for at, row in zip(counts, lists[i : i + 64]):
                        at[:] = np.bincount(of[row], minlength=shape.size)
                    fit = counts @ logs + share
                    top = fit.max(axis=1, keepdims=True)
                    fit = np.exp(fit - top)
                    each = fit.sum(axis=1, keepdims=True)
                    fit /= each
                    total += fit.T @ counts
                    of_kind += fit.sum(axis=0)
                    likelihood += float((top + np.log(each)).sum())
                    n += len(counts)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([total.reshape(-1), of_kind, [likelihood]]).tobytes()], pa.binary())], names=["n", "numbers"])

        n, found = _summed(ids.select("ids").mapInArrow(expect, "n long, numbers binary"), ids.rdd.getNumPartitions(), profiles.size + shape.kinds + 1, "lm-kinds")
        sent.unpersist()
        if not n:
            break
        made = found[: profiles.size].reshape(profiles.shape) + 20 * whole / whole.sum()
        profiles = np.log(made / made.sum(axis=1, keepdims=True)).astype(np.float32)
        share = np.log((found[profiles.size : -1] + 1) / (n + shape.kinds))
        before, reached = reached, found[-1]
        if reached - before < 1e-6 * abs(reached):
            break
    return profiles


def _summed(found: DataFrame, parts: int, size: int, label: str, together: int = 32) -> tuple[int, np.ndarray]:
    """The sums of the rows (n, numbers) of ``parts`` tasks: in Spark, ``together`` by a task and then anew,
    so that no task and not the driver takes more, however many tasks there were."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size)
        for batch in batches:
            for weight, row in zip(batch.column("n").to_pylist(), batch.column("numbers")):
                n, total = n + weight, total + np.frombuffer(row.as_buffer())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "numbers"])

    found = settle(found, label)
    while parts > 1:
        parts = -(-parts // together)
        found = found.repartition(parts).mapInArrow(add, "n long, numbers binary")
    found = found.collect()
    return sum(r.n for r in found), sum((np.frombuffer(r.numbers) for r in found), np.zeros(size))


def _round(ids: DataFrame, model: Attention, sent, turn: int, rate: float) -> int:
    """Every task trains a copy of the model on all its rows; the model becomes their mean, weighted
    by windows."""
    start, shape = model.flat(), model.shape

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = sent.value
        own = Attention(prior, shape)
        own.put(start)
        n = own.train_through((x for batch in batches for x in _id_lists(batch, shape)), prior, rate, turn)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(own.flat() * np.float64(n)).tobytes()], pa.binary())], names=["n", "numbers"])

    n, total = _summed(ids.select("ids").mapInArrow(learn, "n long, numbers binary"), ids.rdd.getNumPartitions(), len(start), "lm-copies")
    if n:
        model.put(total / n)
    return n


def held_out(doc_id: Column) -> Column:
    return F.coalesce(doc_crc(doc_id) % 7 == 2, F.lit(False))


def lm_scores(docs: DataFrame, tokenizer_path: str, shape: Shape = Shape(), frequent: int = 1 << 20) -> DataFrame:
    """Score every whole text by an attention model and by word counts, both from the rows whose
    crc32(doc_id) mod 7 is not 2.

    The words of all those rows are counted for the base score, and so are their ids and neighbouring
    ids, across words too, by kind of text. From the tokens before, attention weighs the kinds, whose
    probabilities it mixes; it is trained on every one of the rows, whole. Words with more than 1/``frequent`` of all tokens
    (so fewer than ``frequent`` words, at any size) are broadcast with their counts; the others are
    summed by text and joined with the counts.

    A null text is an empty one, which has one token, the end. Rows with a null doc_id are learned
    from. Rows that repeat count each. If there is nothing to learn from, all counts are 0. Columns
    besides doc_id and text are ignored. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (both log10)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    learned = texts.where(~held_out(F.col("doc_id")))
    words = settle(word_table(learned), "lm-words")
    n_docs = learned.count()
    distinct, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, kinds = total + n_docs, distinct + (n_docs > 0)
    often = words.where(F.col("n") > tokens / frequent)
    common = {w: math.log10(n + 1) for w, n in zip(*(c.to_pylist() for c in often.toArrow().columns))}  # fewer than ``frequent``
    sent_words = docs.sparkSession.sparkContext.broadcast(common)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common, end = sent_words.value, np.array([shape.end], np.uint32)
        encode, turn, value = encoder(tokenizer_path, WordIds), -1, np.zeros(0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            numbers, rows, rare = encode.numbers(batch.column("text")), [], [np.zeros(0, np.int32)]
            known = len(value) if encode.turn == turn else 0
            more = encode.names[known:]
            turn, value = encode.turn, np.append(value[:known], np.fromiter((common.get(w, -1.0) for w in more), float, len(more)))
            for text, of in zip(batch.column("text"), numbers):
                each = value[of]
                seen = each >= 0
                others, times = np.unique(of[~seen], return_counts=True)
                rare.append(others)
                ids = np.append(encode.ids(text.as_py(), of), end).astype(_id_kind(shape)).tobytes()
                rows.append((row, len(of), int(seen.sum()), float(each[seen].sum()), times, ids))
                row += 1
            which, at = np.unique(np.concatenate(rare), return_inverse=True)
            words = pa.array([encode.names[i] for i in which.tolist()], pa.binary()).take(pa.array(at))
            ends = pa.array(np.cumsum([len(r) for r in rare]), pa.int32())
            columns = list(zip(*rows)) or [()] * 6
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([made[0], batch.column("doc_id"), *made[1:4], pa.ListArray.from_arrays(ends, words), *made[4:]], names=["row", "doc_id", "n_words", "n_common", "common_sum", "rare", "times", "ids"])
        encoder_at_rest()

    rows = settle(
        texts.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(encoded, "row long, doc_id long, n_words long, n_common long, common_sum double, rare array<binary>, times array<long>, ids binary"),
        "lm-rows",
    )
    sent, model, _ = fit(rows.where(~held_out(F.col("doc_id"))).select("row", "ids"), shape)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = sent.value
        for batch in batches:
            lists, held, found = [], 0, [np.zeros(0)]
            for ids in _id_lists(batch, shape):
                lists.append(ids)
                held += len(ids)
                if held >= 300_000:
                    found.append(model.log_probability(lists, prior))
                    lists, held = [], 0
            if lists:
                found.append(model.log_probability(lists, prior))
            keep = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(np.concatenate(found) / math.log(10))], names=[*keep, "score"])

    plain = ["row", "doc_id", "n_words", "n_common", "common_sum"]
    scores = settle(rows.select(*plain, "ids").mapInArrow(scored, "row long, doc_id long, n_words long, n_common long, common_sum double, score double"), "lm-scores")
    for used in (sent, sent_words):  # all that needs them is written
        used.unpersist()
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    known = rare.join(words.where(F.col("n") <= tokens / frequent).hint("merge"), "word")
    summed = settle(known.groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_sum")), "lm-rare")
    each = F.lit(math.log10(tokens + kinds + 1))
    return scores.join(summed.hint("merge"), "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("common_sum") + F.coalesce("rare_sum", F.lit(0.0)) + math.log10(n_docs + 1) - (F.col("n_words") + 1) * each).alias("base_score"),
        "score",
    )
