"""N-gram Jaccard join with token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.llm.common import settle
from quorate.llm.components import components
from quorate.llm.words import at_rest, mixed, shingle_set

#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
#: Leading bits of a hash by which shingles are counted, at most, and those of the slots in a range.
_SLOT_BITS, _RANGE_BITS = 28, 16


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _sets(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield doc_id, shingle_set(text.as_py() or b"", length)


def _packed_gaps(sorted_values: np.ndarray) -> bytes:
    """Gaps between sorted numbers in base 255: a byte below 255 ends a gap."""
    gaps = np.diff(sorted_values, prepend=sorted_values.dtype.type(0)).astype(np.int64)
    whole = gaps // 255
    out = np.full(int(whole.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(whole + 1) - 1] = gaps % 255
    return out.tobytes()


def _unpacked_gaps(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def sets_and_slots(docs: DataFrame, length: int = 5, together: int = 1 << 22) -> DataFrame:
    """One pass over the texts gives two kinds of rows. For each document doc_id, n_shingles and a
    128-bit digest of its set of shingles. And, with a range, what the shingles of many documents add
    to the counts: the leading 28 bits of their hashes in ranges of 2**16, as packed gaps."""
    names = ["doc_id", "n_shingles", "digest", "range", "gaps"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    shift = np.uint64(64 - _SLOT_BITS)

    def rows(*columns):
        n = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def work(batches):
        held, n = [], 0

        def flush():
            slots = np.concatenate(held)
            slots.sort()
            ranges = slots >> _RANGE_BITS
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            parts = np.split(slots & ((1 << _RANGE_BITS) - 1), cuts)
            return rows(None, None, None, ranges[np.concatenate([[0], cuts])], [_packed_gaps(p) for p in parts])

        for batch in batches:
            ids, sizes, digests = [], [], []
            for doc_id, s in _sets(batch, length):
                ids.append(doc_id)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    held.append((s >> shift).astype(np.int32))
                    n += len(s)
            if ids:
                yield rows(ids, sizes, digests, None, None)
            if n >= together:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()
        at_rest()

    return _texts(docs).mapInArrow(work, "doc_id long, n_shingles long, digest binary, range int, gaps binary")


def frequent_slots(packed: DataFrame, bits: int, least: int) -> np.ndarray:
    """A map of 2**bits bits over the leading bits of a shingle's hash: set where shingles of at
    least ``least`` documents fall. Every document counts. The counts are summed in ranges of
    2**16 slots, so by 4,096 tasks at most; the driver gets only the map, of fixed size."""
    range_bits, fold = min(_RANGE_BITS, bits), _SLOT_BITS - bits
    apart = _SLOT_BITS - max(_RANGE_BITS, bits)  # ranges of the packed gaps that fall together

    def counted(batches):
        """Ranges come sorted within a task: one count table is held at a time, and the gaps of one
        range are added to it together."""
        total, at, held, n = np.zeros(1 << range_bits, np.int64), None, [], 0

        def add():
            first = (at & ((1 << apart) - 1)) << _RANGE_BITS >> fold
            found = np.bincount(np.concatenate(held) >> fold)
            total[first : first + len(found)] += found

        for batch in batches:
            for key, packed in zip(batch.column("range").to_pylist(), batch.column("gaps")):
                if held and (key != at or n > 1 << 22):
                    add()
                    held, n = [], 0
                if at is not None and key >> apart != at >> apart:
                    yield done(at >> apart, total)
                    total[:] = 0
                at = key
                held.append(_unpacked_gaps(packed.as_py()))
                n += len(held[-1])
        if at is not None:
            add()
            yield done(at >> apart, total)

    def done(key, total):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["range", "map"])

    together = F.shiftright("range", apart)
    maps = packed.select("range", "gaps").withColumn("key", together).repartition("key").sortWithinPartitions("range").select("range", "gaps").mapInArrow(counted, "range long, map binary")
    found = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    width = max(1, (1 << range_bits) // 8)
    for row in maps.collect():
        found[row[0] * width : (row[0] + 1) * width] = np.frombuffer(row[1], np.uint8)
    return found


def _is_set(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0


def _classes(n: int) -> int:
    """Into how many classes the frequent shingles of sets of this size fall."""
    return 1 << max(0, (n // 32).bit_length() - 1)


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """What a set is found by. Even: a rare shingle. Odd: two frequent shingles of one class.

    A partner misses at most ``errors`` shingles of the set. In the order rare before frequent, then
    by hash, the prefix is extended until its rare shingles, plus for each class of frequent ones
    their number less one, are more than that. So a partner shares a rare shingle of the prefix, or
    two frequent ones of one class; and of two partners the one whose prefix ends first shares them
    within the other's prefix too. Both must use the same number of classes: a set uses its own, and
    also that of the largest partner it can have."""
    n = len(tokens)
    errors = n - -(-NUM * n // DEN)
    rare = tokens[~frequent][: errors + 1]
    found = [rare & ~np.uint64(1)]
    missing = errors + 1 - len(rare)
    if missing > 0:
        common = tokens[frequent]
        for classes in {_classes(n), _classes(DEN * n // NUM)}:
            of = (common & np.uint64(classes - 1)).astype(np.int64)
            first = np.zeros(len(common), np.int64)
            first[np.unique(of, return_index=True)[1]] = 1
            reached = np.searchsorted(np.cumsum(1 - first), missing) + 1
            part, of = common[:reached], of[:reached]
            order = np.argsort(of, kind="stable")
            part, of = part[order], of[order]
            for step in range(1, int(np.bincount(of).max()) if len(of) else 0):
                same = of[step:] == of[:-step]
                found.append(mixed(part[:-step][same] * np.uint64(0x9E3779B97F4A7C15) + part[step:][same]) | np.uint64(1))
    return np.unique(np.concatenate(found)).view(np.int64)


def parity_bits(tokens: np.ndarray) -> bytes:
    """One bit for each slot, four to eight slots a shingle: is the number of shingles that fall into
    it odd? Two sets differ in at least as many shingles as their bits differ."""
    slots = 4 << max(6, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (slots - 1), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(x: bytes, y: bytes, n_x: int, n_y: int) -> bool:
    """False only if the sets are surely too different. The longer bits are folded to the shorter:
    a slot of the half is the sum of two, so its parity is their exclusive or."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    differ = int(np.bitwise_count(a ^ b).sum())
    # DEN * shared >= NUM * union, where differ <= n_x + n_y - 2 * shared
    return (DEN + NUM) * differ <= (DEN - NUM) * (n_x + n_y)


def prefixes(docs: DataFrame, bitmap, bits: int, length: int = 5) -> DataFrame:
    shift = np.uint64(64 - bits)

    def sign(batches):
        frequent = bitmap.value
        for batch in batches:
            ids, sizes, lists, bits_of = [], [], [], []
            with np.errstate(over="ignore"):
                for doc_id, s in _sets(batch, length):
                    if doc_id is not None and len(s) > 1:
                        ids.append(doc_id)
                        sizes.append(len(s))
                        bits_of.append(parity_bits(s))
                        lists.append(signatures(s, _is_set(frequent, (s >> shift).astype(np.int64))))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(bits_of, pa.binary())], names=["doc_id", "n", "signatures", "parity"])
        at_rest()

    return _texts(docs).mapInArrow(sign, "doc_id long, n long, signatures array<long>, parity binary")


def id_map(spark: SparkSession, ids: DataFrame, bits: int):
    """A broadcast map of 2**bits bits that has each id's slot set: a filter of fixed size, only to
    spare a shuffle what a join would drop."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    low = min(15, bits)

    def done(key: int, slots: list[int]):
        flags = np.zeros(1 << low, bool)
        flags[slots] = True
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["range", "map"])

    def mapped(batches):
        at, slots = None, []
        for batch in batches:
            for key, s in zip(batch.column("range").to_pylist(), batch.column("slot").to_pylist()):
                if key != at:
                    if at is not None:
                        yield done(at, slots)
                    at, slots = key, []
                slots.append(s)
        if at is not None:
            yield done(at, slots)

    slots = ids.select(slot.alias("s")).select((F.col("s") / (1 << low)).cast("long").alias("range"), (F.col("s") % (1 << low)).alias("slot")).distinct()
    found = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    width = max(1, (1 << low) // 8)
    for row in slots.repartition("range").sortWithinPartitions("range").mapInArrow(mapped, "range long, map binary").collect():
        found[row[0] * width : (row[0] + 1) * width] = np.frombuffer(row[1], np.uint8)
    return spark.sparkContext.broadcast(found)


def not_ruled_out(pairs: DataFrame, prefix: DataFrame) -> DataFrame:
    """Pairs (a, b) without those whose parity bits rule a link out: about a tenth of the sets' bytes."""

    def keep(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("x", "y", "n_x", "n_y"))
            yield batch.select(["a", "b"]).filter(pa.array([may_link(*row) for row in zip(*columns)], pa.bool_()))

    x, y = (prefix.select(F.col("doc_id").alias(k), F.col("parity").alias(s), F.col("n").alias(f"n_{s}")).hint("merge") for k, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(keep, "a long, b long")


class _Parities:
    """Parity bits of many sets, folded once to every width at which they meet others: sets that can
    link differ less than twofold in size, so their own width and half of it."""

    def __init__(self, parities: list[np.ndarray]) -> None:
        self._width = np.array([len(p) for p in parities])
        self._at, self._folded = {}, {}
        for width in np.unique(self._width).tolist():
            rows = np.flatnonzero((self._width == width) | (self._width == 2 * width))
            self._at[width] = np.full(len(parities), -1)
            self._at[width][rows] = np.arange(len(rows))
            self._folded[width] = np.stack([np.bitwise_xor.reduce(parities[r].reshape(-1, width), axis=0) for r in rows]).view(np.uint64)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of bits in which the pairs differ."""
        narrow, found = np.minimum(self._width[i], self._width[j]), np.zeros(len(i), np.int64)
        for width in np.unique(narrow).tolist():
            pick = np.flatnonzero(narrow == width)
            place, folded = self._at[width], self._folded[width]
            found[pick] = np.bitwise_count(folded[place[i[pick]]] ^ folded[place[j[pick]]]).sum(axis=1, dtype=np.int64)
        return found


def likely_in_signature(members: DataFrame, prefix: DataFrame, block: int = 1024) -> DataFrame:
    """Pairs (a, b) that share a frequent signature, lie in different components, and are not ruled
    out by size or parity bits. Members (signature, id, n, label) of a signature are cut to blocks of
    ``block``, and each pair of blocks is a group; the pairs that are ruled out never become rows."""
    sizes = settle(members.groupBy("signature").agg(F.count("*").alias("members")), "jaccard-sizes")
    blocks = F.ceil(F.col("members") / block).cast("int")
    group = ["signature", "low", "high"]
    cut = (
        members.join(prefix.select(F.col("doc_id").alias("id"), "parity").hint("merge"), "id")
        .join(sizes.hint("merge"), "signature")
        .withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("signature", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "n", "label", "parity")
        .repartition(*group)
        .sortWithinPartitions(*group)
    )

    def pairs(table: pa.Table) -> pa.RecordBatch:
        key = np.cumsum(np.concatenate([[False], np.any([np.diff(table.column(g).to_numpy()) != 0 for g in group], axis=0)]))
        size = np.bincount(key)
        last = np.cumsum(size)[key] - 1
        low, high, own, ids, n, label = (table.column(c).to_numpy() for c in ("low", "high", "own", "id", "n", "label"))
        parities = _Parities([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("parity")])
        at, found = np.arange(len(table)), [np.zeros((0, 2), np.int64)]
        for step in range(1, int(size.max())):
            at = at[at + step <= last[at]]
            i, j = at, at + step
            may = (label[i] != label[j]) & ((low[i] == high[i]) | (own[i] != own[j])) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
            i, j = i[may], j[may]
            if len(i):
                may = (DEN + NUM) * parities.differ(i, j) <= (DEN - NUM) * (n[i] + n[j])
                i, j = ids[i[may]], ids[j[may]]
                found.append(np.stack([np.maximum(i, j), np.minimum(i, j)], axis=1))
        once = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["a", "b"])

    def compared(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            ends = np.flatnonzero(np.any([np.diff(held.column(g).to_numpy()) != 0 for g in group], axis=0))
            if len(ends):
                yield pairs(held.slice(0, int(ends[-1]) + 1))
                held = held.slice(int(ends[-1]) + 1)
        if held is not None and len(held):
            yield pairs(held)

    return cut.mapInArrow(compared, "a long, b long").distinct()


def linked(docs: DataFrame, pairs: DataFrame, n_docs: int, length: int = 5) -> DataFrame:
    """Of a written table of pairs (a, b), those whose sets are similar enough."""
    spark = docs.sparkSession
    bits = min(28, max(10, (8 * n_docs).bit_length()))
    wanted = id_map(spark, pairs.select(F.explode(F.array("a", "b")).alias("id")), bits)
    near = _texts(docs).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)))

    def sets(batches):
        bitmap = wanted.value
        for batch in batches:
            keep = pa.array(_is_set(bitmap, batch.column("slot").to_numpy()))
            ids, packed = [], []
            for doc_id, s in _sets(batch.filter(keep), length):
                ids.append(doc_id)
                packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["id", "tokens"])
        at_rest()

    of = near.where("doc_id is not null").mapInArrow(sets, "id long, tokens binary")
    first = pairs.join(of.select(F.col("id").alias("a"), F.col("tokens").alias("x")).hint("merge"), "a")
    both = first.join(of.select(F.col("id").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b")

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                together = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int(np.count_nonzero(together[1:] == together[:-1]))
                keep.append(DEN * shared >= NUM * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, length: int = 5, least_frequent: int = 64) -> DataFrame:
    """Link documents whose sets of ``length``-word shingles have a Jaccard similarity of 0.8 or
    more, and return for each row doc_id, n_shingles, and component_id, the smallest doc_id
    reachable by links.

    1. Equal sets become one class (by a 128-bit digest); the rest works on the class's smallest
       doc_id, so copies are never paired.
    2. All documents' shingles are counted by slot of their hash. Slots reached by at least
       ``least_frequent`` documents, or 8 times the mean, are frequent; others are rare. Any split
       gives the same links; it only sets how much is compared.
    3. Sets meet by signature (see ``signatures``). A rare signature is held by fewer sets than the
       count that makes a slot frequent. Frequent ones may be held by any number, so their smallest
       member is found by an aggregate and joined back, which adaptive execution can split.
    4. In each signature all members are verified against its smallest member only, and components
       are found. Then only members of one signature that are still in different components are
       compared pair by pair, those of frequent signatures within blocks. So a group of near copies costs one comparison for each, not all
       pairs, and no link between components is missed.
    5. Before sets are compared, parity bits, four to eight a shingle, rule most unlike pairs out, surely.

    Null and empty texts have no shingles and link with nothing. Rows with a null doc_id link with
    nothing and have a null component. Rows that share a doc_id are one document, linked with what
    either is. Other columns are ignored."""
    spark = docs.sparkSession
    seen = settle(sets_and_slots(docs, length), "jaccard-sets")
    info = seen.where("range is null").select("doc_id", "n_shingles", "digest")
    some = info.where("doc_id is not null and n_shingles > 0")
    total, n_docs = some.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    classes = settle(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    bits = min(_SLOT_BITS, max(16, (max(total, 1) // 2).bit_length()))
    least = max(least_frequent, 8 * total >> bits)
    frequent = spark.sparkContext.broadcast(frequent_slots(seen.where("range is not null"), bits, least))
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    prefix = settle(prefixes(docs, frequent, bits, length).join(reps.hint("merge"), "doc_id", "left_semi"), "jaccard-prefixes")
    held = prefix.select(F.explode("signatures").alias("signature"), F.col("doc_id").alias("id"), "n")
    in_one = Window.partitionBy("signature")
    rare = held.where("signature % 2 = 0").select("*", F.min(F.struct("id", "n")).over(in_one).alias("hub"), F.count("*").over(in_one).alias("members")).where("members > 1").drop("members")
    common = held.where("signature % 2 <> 0")
    hubs = settle(common.groupBy("signature").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members"), "jaccard-hubs")
    met = settle(rare.unionByName(common.join(hubs.hint("merge"), "signature").select(*rare.columns)), "jaccard-met")

    def fits(x: str, y: str):
        return f"{DEN} * least({x}, {y}) >= {NUM} * greatest({x}, {y})"

    stars = settle(met.where("id <> hub.id").where(fits("n", "hub.n")).select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct(), "jaccard-stars")
    links = settle(linked(docs, settle(not_ruled_out(stars, prefix), "jaccard-likely"), n_docs, length), "jaccard-links")
    labels = settle(components(links), "jaccard-labels")
    # What is left: members of one signature in different components, and not yet compared.
    own = met.select("signature", "id", "n").join(labels.select(F.col("node").alias("id"), "label").hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    own = settle(own, "jaccard-own")
    mixed_ones = settle(own.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("signature"), "jaccard-mixed")
    left = settle(own.join(mixed_ones.hint("merge"), "signature"), "jaccard-left")
    x, y = (left.where("signature % 2 = 0").select("signature", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "label"))) for s in "xy")
    of_rare = x.hint("merge").join(y, "signature").where("id_x > id_y and label_x <> label_y").where(fits("n_x", "n_y")).select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()
    of_common = settle(likely_in_signature(left.where("signature % 2 <> 0"), prefix), "jaccard-of-common")
    more = settle(not_ruled_out(of_rare, prefix), "jaccard-of-rare").unionByName(of_common).distinct().join(stars.hint("merge"), ["a", "b"], "left_anti")
    more = settle(more, "jaccard-rest")
    if not more.isEmpty():
        found = settle(linked(docs, more, n_docs, length), "jaccard-more")
        if not found.isEmpty():
            labels = settle(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found)), "jaccard-labels")
    named = settle(classes.join(labels.select(F.col("node").alias("rep"), "label").hint("merge"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label")), "jaccard-named")
    return info.join(named.hint("merge"), "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("label")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component; of rows that share it the one
    with the least text, a null text only where there is no other. Rows with a null doc_id link with
    nothing and stay. Of rows alike in doc_id and text one stays, whatever their other columns hold.
    Null and empty texts are groups of their own. An empty table gives an empty result."""
    names = docs.columns
    plain = docs.toDF(*(n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)))
    kept = settle(jaccard_components(plain, **options).where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("kept_rows")), "jaccard-kept")
    found = plain.join(kept.hint("merge"), F.col("doc_id").cast("long") == F.col("kept_id"))
    once = found.where("kept_rows = 1").select(*plain.columns)
    repeated = found.where("kept_rows > 1").groupBy("doc_id").agg(F.min_by(F.struct(*plain.columns), F.struct(F.col("text").isNull(), "text")).alias("first")).select("first.*")
    return once.unionByName(repeated).unionByName(plain.where("doc_id is null")).toDF(*names)
