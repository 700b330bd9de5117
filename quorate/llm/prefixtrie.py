"""The trie of conversations' opening turns: nodes, members, leaves, tokens that sharing saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import settle, word_count

#: The textless root's place in a path.
ROOT = bytes(16)
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]
_EMPTY_SHA = hashlib.sha256().hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text; null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)


def rebuilt_turns(conversations: DataFrame, every: int = 20, most_shared: int = 3) -> DataFrame:
    """(conv_id, turns): for each conversation c the first h turns of c - c % ``every``, then its own
    after its first h; h = crc32(decimal c) % (``most_shared`` + 1). A turn is (id, words)."""
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"), word_count(F.col("text")).alias("words"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id", "words")))  # a null turn comes first
    own = settle(said.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns")), "own-turns")
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_from"), F.slice("turns", 1, most_shared).alias("opening"))
    met = own.join(first.hint("merge"), F.col("conv_id") - F.col("conv_id") % every == F.col("_from"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most_shared + 1)).cast("int")
    opening = F.coalesce(F.slice("opening", F.lit(1), h), F.slice("turns", 1, 0))
    return met.select("conv_id", F.concat(opening, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's path: at each turn a hash of all turns so far."""
    for batch in batches:
        paths = []
        for ids in batch["ids"].to_pylist():
            path, at = [], ROOT
            for one in ids:
                at = xxhash.xxh3_128_digest(at + one)
                path.append(at)
            paths.append(path)
        yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(paths, pa.list_(pa.binary())), batch["words"]], ["conv_id", "path", "words"])


class _Open:
    """A node on the sweep's way from the container's top to the current suffix."""

    __slots__ = ("at", "children", "depth", "ends", "first", "leaves", "members", "saved", "up", "words")

    def __init__(self, at: bytes, depth: int, words: int, up: _Open | None) -> None:
        self.at, self.depth, self.words, self.up = at, depth, words, up
        self.first = self.members = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []

    def join(self, conv_id: int) -> None:
        self.first = conv_id if self.members == 0 else min(self.first, conv_id)
        self.members += 1

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.members - 1) * self.words
        if self.up is not None:
            self.up.children += 1
            self.up.leaves += self.leaves
            self.up.saved += self.saved


def ids_sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def sweep(container: list[tuple]) -> Iterator[tuple]:
    """Nodes of one container's (conv_id, head_depth, head_first, head, path, words), sorted by path:
    what is below the last shared node is closed, what is new is opened."""
    _, depth, head_first, head, *_ = container[0]
    way, closed = [], []

    def shut(to: int) -> None:
        while len(way) > to:
            node = way.pop()
            node.close()
            closed.append(node)

    for conv_id, _, _, _, path, words in container:
        shared = 0
        while shared < len(way) and shared < len(path) and way[shared].at == path[shared]:
            shared += 1
        shut(shared)
        for i in range(shared, len(path)):
            way.append(_Open(path[i], depth + 1 + i, words[i], way[-1] if way else None))
        for node in way:
            node.join(conv_id)
        way[-1].ends.append(conv_id)
    shut(0)
    for x in closed:
        yield (x.first, x.depth, head_first if x.up is None else x.up.first, x.members, x.children, x.leaves, x.saved, ids_sha(x.ends), head if x.up is None else None)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*((c, pa.string() if c == "ends_sha256" else pa.int64()) for c in _COLUMNS), ("head", pa.binary())])
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "head_depth", "head_first", "head", "path", "words"))))
    made: list[tuple] = []
    for _, container in groupby(rows, lambda row: row[4][0]):
        made += sweep(list(container))
        if len(made) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
            made = []
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of a node as texts of bounded length."""
    for batch in batches:
        nodes, ids = batch["node"].to_pylist(), batch["conv_id"].to_pylist()
        runs = [(node, [i for _, i in run]) for node, run in groupby(zip(nodes, ids), lambda x: x[0])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in runs], pa.binary()), pa.array([r[0] for _, r in runs], pa.int64()), pa.array([",".join(map(str, r)) for _, r in runs], pa.string())], ["node", "least", "ids"]
        )


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node, fed run by run."""
    rows = (row for batch in batches for row in zip(batch["node"].to_pylist(), batch["ids"].to_pylist()))
    for node, run in groupby(rows, lambda row: row[0]):
        digest = hashlib.sha256(next(run)[1].encode())
        for _, ids in run:
            digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])


def prefix_nodes(conversations: DataFrame, most_suffixes: int = 256) -> DataFrame:
    """One row for each distinct sequence of first d rebuilt turns (see ``rebuilt_turns``), d = 0 too:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the ids of members with just d turns).

    Turns are ordered by ``turn``, null first; equal ones by a hash of role and text. A null role or text
    is empty. Rows without conv_id belong to no conversation. An empty table has no nodes, not even a
    root. Other columns play no part.

    A burst trie: all suffixes of the root are one container; a container of more than
    ``most_suffixes`` suffixes bursts by their next turn id, and the node above becomes a trie head. As a
    path holds a hash at each turn, the sizes of all depths are counted at once, and each conversation
    goes at once to the container where bursting would leave it. Containers, so bounded, are dealt over
    the partitions, sorted there, and swept into nodes one at a time. Heads take sums of what hangs
    from them. Conversations that end at a head may be very many; their ids are joined in sorted runs
    by ranges, and one pass over a head's runs makes its digest. One conversation's turns, as ids of 16
    bytes without texts, are one row."""
    spark = conversations.sparkSession
    turns = rebuilt_turns(conversations).select("conv_id", "turns.id", "turns.words").withColumnRenamed("id", "ids")
    paths = settle(turns.mapInArrow(_chained, "conv_id long, path array<binary>, words array<long>"), "paths")
    n_convs, least = paths.agg(F.count("*"), F.min("conv_id")).first()

    # Heads: nodes with more than most_suffixes members, and the root.
    steps = paths.select("conv_id", F.posexplode("path").alias("at", "node"))
    sizes = steps.groupBy("node").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).where(F.col("n") > most_suffixes)
    sizes = settle(sizes, "head-sizes")
    within = steps.join(sizes.hint("merge"), "node").groupBy("conv_id").agg(F.max(F.col("at") + 1).alias("k"), F.max("first").alias("f"))  # both grow with depth
    k = F.coalesce("k", F.lit(0))
    head = F.when(k == 0, F.lit(ROOT)).otherwise(F.get("path", k - 1))
    placed = paths.join(within.hint("merge"), "conv_id", "left").select("conv_id", "path", "words", k.alias("head_depth"), F.coalesce("f", F.lit(least).cast("long")).alias("head_first"), head.alias("head"))
    placed = settle(placed, "placed")

    # Containers: dealt, sorted, swept.
    rest = lambda c: F.slice(c, F.col("head_depth") + 1, F.size("path")).alias(c)
    suffixes = placed.where(F.size("path") > F.col("head_depth")).select("conv_id", "head_depth", "head_first", "head", rest("path"), rest("words"))
    dealt = suffixes.repartition(F.get("path", F.lit(0))).sortWithinPartitions("path", "conv_id")
    nodes = settle(dealt.mapInArrow(_swept, f"{_NODE}, head binary"), "trie-nodes")

    # Heads: what hangs from each of them, then sums over the heads below.
    ended = placed.where(F.size("path") == F.col("head_depth")).select(F.col("head").alias("node"), "conv_id")
    runs = ended.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined_ids, "node binary, least long, ids string")
    ends = settle(runs.repartition("node").sortWithinPartitions("node", "least").mapInArrow(_hashed_ids, "node binary, ends_sha256 string"), "head-ends")
    found = sizes.join(placed.select(F.col("conv_id").alias("first"), "path", "words").hint("merge"), "first")
    depth = F.array_position("path", F.col("node")).cast("int")
    found = found.select("node", "n", "first", depth.cast("long").alias("depth"), F.when(depth == 1, F.lit(ROOT)).otherwise(F.get("path", depth - 2)).alias("up"), F.get("words", depth - 1).alias("words"))
    root = spark.range(1).where(F.lit(n_convs > 0)).select(F.lit(ROOT).alias("node"), F.lit(n_convs).cast("long").alias("n"), F.lit(least).cast("long").alias("first"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("words"))
    heads = settle(found.unionByName(root), "heads")
    hung = nodes.where("head is not null").groupBy(F.col("head").alias("node")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("top_leaves"), F.sum("saved_tokens").alias("top_saved"))
    below = heads.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("below"))
    above = heads.select(F.col("node").alias("up"), F.col("first").alias("parent_conv_id"))
    own = heads.join(hung.hint("merge"), "node", "left").join(below.hint("merge"), "node", "left").join(ends.hint("merge"), "node", "left").join(above.hint("merge"), "up", "left")
    children = F.coalesce("tops", F.lit(0)) + F.coalesce("below", F.lit(0))
    own = settle(
        own.select(
            "node", "n", "first", "depth", "parent_conv_id", children.alias("n_children"), F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
            (F.coalesce("top_leaves", F.lit(0)) + (children == 0).cast("long")).alias("leaves"), (F.coalesce("top_saved", F.lit(0)) + (F.col("n") - 1) * F.col("words")).alias("saved"),
        ),
        "head-sums",
    )
    # Heads of one smallest member are a run on its path: what a head has below it is the rest of its
    # run, and the whole of each run that branches off under it.
    of_run = own.groupBy("first").agg(F.min("depth").alias("from_depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where("from_depth > 0")
    over = F.concat(F.array(F.lit(ROOT)), F.slice("path", F.lit(1), (F.col("from_depth") - 1).cast("int")))
    branches = placed.select(F.col("conv_id").alias("first"), "path").join(of_run.hint("merge"), "first").select(F.explode(over).alias("node"), "leaves", "saved")
    branches = branches.groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    rest_of_run = Window.partitionBy("first").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = own.select("*", F.sum("leaves").over(rest_of_run).alias("run_leaves"), F.sum("saved").over(rest_of_run).alias("run_saved")).join(branches.hint("merge"), "node", "left")
    totals = summed.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("n_children").cast("long"),
        (F.col("run_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("run_saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), "ends_sha256",
    )
    return totals.unionByName(nodes.select(*_COLUMNS))


PREFIX_TRIE_SQL = r"""
WITH said AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS from_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM said)),
rebuilt AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS depth FROM (
  SELECT c.conv_id, 0 AS part, s.n, role, text FROM convs c JOIN said s ON s.conv_id = c.from_id AND s.n <= c.h UNION ALL SELECT c.conv_id, 1, s.n, role, text FROM convs c JOIN said s ON s.conv_id = c.conv_id AND s.n > c.h)),
ends AS (SELECT c.conv_id, count(r.depth) AS n FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
steps AS (SELECT conv_id, 0 AS depth, '' AS node, 0 AS words FROM convs UNION ALL
  SELECT conv_id, depth, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM rebuilt),
nodes AS (SELECT depth, node, min(s.conv_id) AS conv_id, count(*) AS n, max(words) AS words, sha256(coalesce(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) FILTER (e.n = s.depth), '')) AS ends_sha256
  FROM steps s JOIN ends e ON e.conv_id = s.conv_id GROUP BY depth, node),
parents AS (SELECT n.depth, n.node, p.depth AS up_depth, p.node AS up FROM nodes n JOIN steps p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT up_depth AS depth, up AS node, count(*) AS n_children FROM parents GROUP BY ALL),
each AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node),
under AS (SELECT DISTINCT a.depth, a.node, b.depth AS d, b.node AS b FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT u.depth, u.node, count(*) FILTER (e.n_children = 0) AS n_leaves, sum((e.n - 1) * e.words)::BIGINT AS saved_tokens FROM under u JOIN each e ON e.depth = u.d AND e.node = u.b GROUP BY u.depth, u.node)
SELECT e.conv_id, e.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, e.n AS n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256
FROM each e JOIN sums s ON s.depth = e.depth AND s.node = e.node LEFT JOIN parents p ON p.depth = e.depth AND p.node = e.node LEFT JOIN each o ON o.depth = p.up_depth AND o.node = p.up"""
