"""A trie of conversation prefixes, with subtree totals passed up by time-forward processing.

Every conversation is rebuilt from the opening of the conversation it starts from and its own turns. A node is a distinct
sequence of first turns; its name is the exclusive or, over its turns, of 120 bits of MD5 of (depth, role, text),
so equal prefixes get equal names from running values and no text is shuffled.

Totals of subtrees go from the deepest nodes to the root. A task reads its nodes in reverse level order (an external sort
of Spark), takes the messages of a node's children from a priority queue, adds them to the node's own values, and
sends the sum on to the parent through the queue. The queue holds ``QUEUE_ROWS`` messages in memory
and spills sorted runs beyond that to unnamed scratch files that end with the task.

Shards: a subtree that stands for at most ``shard_rows`` turns is whole in one shard, together with others; its root's sum is a message to
the node above. Nodes over larger subtrees are few; they are cut into bands of ``band`` levels, each piece is a shard, the
roots of the pieces pass their sums on among themselves in the same way, and a last pass within the pieces
adds what has come from below.

Defined cases: null roles and texts are empty; rows are ordered by turn (null first), then role, then MD5 of the text; all
repeated rows are turns; rows without ``conv_id`` belong to no conversation and are left out; remainders have the sign of the id, as in
SQL; a conversation without rebuilt turns ends at the root; an empty table gives no row; other columns
are ignored. A conversation of any length is split by blocks of turns, and a node's conversations by ranges of their ids.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.llm.tasks import tidy
from driftleaf.session import broadcast_if_small, materialise, ship_package

SHARED = 5  # conversations c - c % SHARED to c open alike
HEADS = 9
SHARD_ROWS = 1 << 16
BAND = 64
BLOCK_BITS = 12
QUEUE_ROWS = 1 << 18
CHUNK = 1 << 12
NO_BLOCK = -(1 << 60)
_MESSAGE = struct.Struct("<5q")


class SpillingQueue:
    """A priority queue of (level, x, y, leaves, saved); sorted runs beyond ``limit`` go to scratch files."""

    def __init__(self, limit: int = QUEUE_ROWS) -> None:
        self.limit = limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (next message, number, the rest)
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self.heap.sort()
            file = tempfile.TemporaryFile()
            for at in range(0, len(self.heap), 4096):
                file.write(b"".join(_MESSAGE.pack(*m) for m in self.heap[at : at + 4096]))
            self.heap = []
            self.spilled += 1
            file.seek(0)
            self._offer(self._read(file), self.spilled)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while block := file.read(_MESSAGE.size * 4096):
                yield from _MESSAGE.iter_unpack(block)

    def _offer(self, run: Iterator[tuple], number: int) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, number, run))

    def take(self, key: tuple) -> tuple[int, int]:
        """Sum of all messages for ``key``, which no waiting message comes before."""
        leaves = saved = 0
        while self.heap and self.heap[0][:3] == key:
            message = heapq.heappop(self.heap)
            leaves, saved = leaves + message[3], saved + message[4]
        while self.runs and self.runs[0][0][:3] == key:
            message, number, run = heapq.heappop(self.runs)
            leaves, saved = leaves + message[3], saved + message[4]
            self._offer(run, number)
        return leaves, saved

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


NODE = ["level", "x", "y", "px", "py", "is_top", "leaves", "saved"]
SUMS = "x long, y long, leaves long, saved long"


def pass_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of nodes that come in ascending (level, x, y), where level is minus the depth."""
    queue = SpillingQueue()
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in NODE]
        out_leaves, out_saved = [], []
        for level, x, y, px, py, is_top, leaves, saved in zip(*columns):
            more_leaves, more_saved = queue.take((level, x, y))
            leaves, saved = leaves + more_leaves, saved + more_saved
            out_leaves.append(leaves)
            out_saved.append(saved)
            if not is_top:
                queue.push((level + 1, px, py, leaves, saved))
        sums = [pa.array(v, pa.int64()) for v in (out_leaves, out_saved)]
        yield pa.record_batch([batch.column("x"), batch.column("y"), *sums], names=["x", "y", "leaves", "saved"])
    if len(queue):
        raise ValueError("messages for nodes that the shard lacks")


def _within_shards(nodes: DataFrame) -> DataFrame:
    """Sums within the shards named by (tx, ty), which are the shards' topmost nodes."""
    rows = nodes.select(
        (-F.col("depth")).cast("long").alias("level"), "x", "y", "px", "py",
        ((F.col("x") == F.col("tx")) & (F.col("y") == F.col("ty"))).alias("is_top"), "leaves", "saved", "tx", "ty",
    )
    return rows.repartition("tx", "ty").sortWithinPartitions("level", "x", "y").drop("tx", "ty").mapInArrow(tidy(pass_up), SUMS)


def _messages(tops: DataFrame) -> DataFrame:
    """What the topmost nodes of shards send to the nodes above."""
    return tops.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )


def _received(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    got = nodes.join(messages, ["x", "y"], "left")
    for name in ("leaves", "saved"):
        got = got.withColumn(name, F.col(name) + F.coalesce(F.col(f"more_{name}"), F.lit(0)))
    return got.drop("more_leaves", "more_saved")


def _bits(of: Column, begin: int) -> Column:
    return F.conv(F.substring(of, begin, 15), 16, 10).cast("long")


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, role, said, size) and conversations (conv_id, n, own, opened, base, reach): of
    ``n`` turns those from ``own`` stay, after ``opened`` turns of ``base``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.md5(text.cast("binary")).alias("said"),
        F.octet_length(text).cast("long").alias("size"),
        F.coalesce(F.shiftright(F.col("turn").cast("long"), BLOCK_BITS), F.lit(NO_BLOCK)).alias("block"),
    )
    count = turns.groupBy("conv_id", "block").agg(F.count("*").alias("rows"))
    block = Window.partitionBy("conv_id").orderBy("block")
    before = count.select("conv_id", "block", (F.sum("rows").over(block) - F.col("rows")).alias("before"))
    pos = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "said"))
    placed = turns.join(before, ["conv_id", "block"]).select(
        "conv_id", (F.col("before") + pos - 1).alias("pos"), "role", "said", "size"
    )
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = count.groupBy("conv_id").agg(F.sum("rows").alias("n")).withColumn("own", own)
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED)
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(of_base, "base", "left").withColumn("opened", F.least("own", F.coalesce("n_base", F.lit(0))))
    return placed, convs.withColumn("reach", F.col("opened") + F.greatest(F.lit(0), F.col("n") - F.col("own"))).drop("n_base")


def rebuilt_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, px, py, size, reach): each prefix of each rebuilt conversation, the empty one too."""
    turns, convs = (materialise(df, name) for df, name in zip(ordered_turns(conversations), ("turns", "convs")))
    # Blocks of turns keep a long conversation out of a single task.
    blocks = convs.select(
        "conv_id", "own", "opened", "reach",
        F.explode(F.sequence(F.lit(0), F.shiftright(F.col("n") - 1, BLOCK_BITS))).alias("block"),
    )
    kept = turns.withColumn("block", F.shiftright("pos", BLOCK_BITS)).join(blocks, ["conv_id", "block"]).where("pos >= own")
    kept = kept.select("conv_id", (F.col("opened") + F.col("pos") - F.col("own") + 1).alias("depth"), "role", "said", "size", "reach")
    heads = turns.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
    opened = convs.join(heads, "base").where("pos < opened")
    opened = opened.select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "said", "size", "reach")
    item = F.md5(F.concat_ws(":", "depth", F.octet_length("role"), "role", "said").cast("binary"))
    rows = kept.unionByName(opened).select(
        "conv_id", "depth", "size", "reach", _bits(item, 1).alias("a"), _bits(item, 16).alias("b"),
        F.shiftright(F.col("depth") - 1, BLOCK_BITS).alias("block"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "ab"]
    )
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.join(begins, ["conv_id", "block"])
    for name, part in (("x", "a"), ("y", "b")):
        named = named.withColumn(name, F.bit_xor(part).over(so_far).bitwiseXOR(F.col(f"{part}0")))
    named = named.select(
        "conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("px"), F.col("y").bitwiseXOR(F.col("b")).alias("py"),
        "size", "reach",
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select(
        "conv_id", zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("size"), "reach"
    )
    return named.unionByName(roots)


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """One row a node; ``below`` counts the turns that follow it in all its conversations."""
    return prefixes.groupBy("x", "y").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("px").alias("px"),
        F.max("py").alias("py"),
        F.count("*").alias("n_convs"),
        F.max("size").alias("size"),
        F.sum(F.col("reach") - F.col("depth")).alias("below"),
    )


def _outside(prefixes: DataFrame, heavy: DataFrame, salts: int = 32) -> DataFrame:
    """Prefixes that are no heavy node. A heavy node's rows are many, so beyond the budget they are salted."""
    few = broadcast_if_small(heavy.select("x", "y"), "heavy")
    if getattr(few, "_held", None) is not None:
        return prefixes.join(few, ["x", "y"], "left_anti")
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = prefixes.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int"))
    return rows.join(salted, ["x", "y", "_salt"], "left_anti").drop("_salt")


def subtree_sums(prefixes: DataFrame, nodes: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND) -> DataFrame:
    """(x, y, leaves, saved): childless nodes and saved bytes of each node's subtree."""
    ship_package(nodes.sparkSession)
    own = nodes.select(
        "x", "y", "px", "py", "conv_id", "depth", "below",
        (F.col("below") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    is_heavy = F.col("below") >= shard_rows
    heavy = own.where(is_heavy)
    # A conversation leaves the heavy nodes once; the first node after that is the top of its shard.
    top = _outside(prefixes, heavy).groupBy("conv_id").agg(F.min(F.struct("depth", "x", "y")).alias("top"))
    light = own.where(~is_heavy).join(top, "conv_id").withColumn("tx", F.col("top.x")).withColumn("ty", F.col("top.y"))
    light = materialise(light.drop("top"), "light-nodes")
    sums = materialise(_within_shards(light), "light-sums")
    tops = light.where("x = tx AND y = ty AND depth > 0").select("x", "y", "px", "py").join(sums, ["x", "y"])

    heavy = materialise(_received(heavy, _messages(tops)), "heavy-nodes")
    deepest = heavy.agg(F.max("depth")).first()[0]
    if deepest is None:
        return sums
    above = prefixes.where((F.col("depth") % band == 0) & (F.col("depth") > 0)).select(
        "conv_id", F.col("depth").alias("top_depth"), F.col("x").alias("bx"), F.col("y").alias("by")
    )
    if deepest < band:
        heavy = heavy.withColumn("tx", F.lit(0)).withColumn("ty", F.lit(0))
        return sums.unionByName(_within_shards(heavy))
    heavy = heavy.withColumn("top_depth", F.col("depth") - F.col("depth") % band).join(above, ["conv_id", "top_depth"], "left")
    heavy = heavy.withColumn("tx", F.coalesce("bx", F.lit(0))).withColumn("ty", F.coalesce("by", F.lit(0)))
    heavy = materialise(heavy.drop("bx", "by", "top_depth"), "heavy-shards")
    # Across shard roots: a shard's parent is the shard that holds the parent of its topmost node.
    roots = heavy.where("x = tx AND y = ty").select("x", "y", "px", "py", "depth").join(_within_shards(heavy), ["x", "y"])
    holds = heavy.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("tx").alias("qx"), F.col("ty").alias("qy"))
    roots = materialise(roots.join(holds, ["px", "py"], "left"), "shard-roots")
    tree = roots.select(
        F.floor(F.col("depth") / band).alias("depth"), "x", "y", F.col("qx").alias("px"), F.col("qy").alias("py"), "leaves", "saved",
        F.lit(0).alias("tx"), F.lit(0).alias("ty"),
    )
    whole = roots.select("x", "y", "px", "py").join(_within_shards(tree), ["x", "y"])
    complete = _received(heavy, _messages(whole.where("px IS NOT NULL")))
    return sums.unionByName(_within_shards(complete))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node, in order, joined in pieces of at most ``CHUNK`` ids."""
    for batch in batches:
        x, y, conv = (batch.column(c).to_numpy() for c in ("x", "y", "conv_id"))
        new = np.concatenate(([True], (np.diff(x) != 0) | (np.diff(y) != 0))) if len(x) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        within = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
        starts = np.flatnonzero(new | (within % CHUNK == 0))
        stops = np.append(starts[1:], len(x))
        ids = [str(c) for c in conv.tolist()]
        text = [",".join(ids[a:b]) for a, b in zip(starts, stops)]
        yield pa.record_batch(
            [pa.array(x[starts]), pa.array(y[starts]), pa.array(conv[starts]), pa.array(text, pa.string())],
            names=["x", "y", "first", "ids"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; only one digest is open at a time."""
    at, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ids"))):
            if (x, y) == at:
                state.update(b"," + ids.encode())
                continue
            if at is not None:
                done.append((*at, state.hexdigest()))
            at, state = (x, y), hashlib.sha256(ids.encode())
        yield _digest_rows(done)
    if at is not None:
        yield _digest_rows([(*at, state.hexdigest())])


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string())
    columns = [pa.array([row[i] for row in done], t) for i, t in enumerate(types)]
    return pa.record_batch(columns, names=["x", "y", "ends"])


def end_digests(prefixes: DataFrame) -> DataFrame:
    """(x, y, ends) of nodes where a conversation ends. A node's ids are dealt by range, joined in pieces, and only
    the pieces meet."""
    ship_package(prefixes.sparkSession)
    ends = prefixes.where("depth = reach").select("x", "y", "conv_id")
    pieces = ends.repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    pieces = pieces.mapInArrow(_pieces, "x long, y long, first long, ids string")
    return pieces.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(tidy(_digests), "x long, y long, ends string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND) -> DataFrame:
    """The nodes of the trie with their parents, counts, subtree totals and digests of the ids that end there."""
    prefixes = materialise(rebuilt_prefixes(conversations), "prefixes")
    nodes = materialise(trie_nodes(prefixes), "trie-nodes")
    sums = subtree_sums(prefixes, nodes, shard_rows, band)
    children = nodes.where("px IS NOT NULL").select(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(1).alias("child"))
    parts = nodes.unionByName(sums, allowMissingColumns=True).unionByName(end_digests(prefixes), allowMissingColumns=True)
    parts = parts.unionByName(children, allowMissingColumns=True)
    known = [F.max(c).alias(c) for c in ("conv_id", "depth", "px", "py", "n_convs", "leaves", "saved", "ends")]
    full = materialise(parts.groupBy("x", "y").agg(*known, F.count("child").alias("n_children")), "trie")
    # Parents of very many nodes are few; the others are met in an equi-join.
    parent = full.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"), "n_children")
    crowded = broadcast_if_small(
        parent.where(F.col("n_children") >= shard_rows).select("px", "py", F.col("parent").alias("crowded")), "crowded"
    )
    rest = parent.where(F.col("n_children").between(1, shard_rows - 1)).select(
        F.col("px").alias("rx"), F.col("py").alias("ry"), "parent"
    )
    met = full.join(crowded, ["px", "py"], "left")
    unmet = F.col("crowded").isNull()
    key = (F.when(unmet, F.col("px")).otherwise(-F.col("x") - 1) == F.col("rx")) & (F.col("py") == F.col("ry"))
    return met.join(rest, key, "left").select(
        "conv_id", "depth", F.coalesce("crowded", "parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(conversations)


SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), counted AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END), 4294967295) % 9 AS own
  FROM turns GROUP BY conv_id
), convs AS (
  SELECT c.*, least(c.own, coalesce(b.n, 0)) AS opened, least(c.own, coalesce(b.n, 0)) + greatest(0, c.n - c.own) AS reach
  FROM counted c LEFT JOIN counted b ON b.conv_id = c.base
), rebuilt AS (
  SELECT c.conv_id, reach, opened + pos - own + 1 AS depth, role, said FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= own
  UNION ALL
  SELECT c.conv_id, reach, pos + 1, role, said FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < opened
), paths AS (
  SELECT conv_id, reach, depth, strlen(said) AS size,
    string_agg(length(role) || ':' || role || length(said) || ':' || said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM rebuilt
  UNION ALL SELECT conv_id, reach, 0, 0, '' FROM convs
), linked AS (
  SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM paths
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(size) AS size,
    max(reach) = depth AS is_leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = reach), '')) AS ends_sha256
  FROM linked GROUP BY path, depth
), sums AS (
  SELECT p.path, sum(n.is_leaf::INT)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path
), children AS (
  SELECT parent AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN children c USING (path) LEFT JOIN nodes p ON p.path = n.parent
"""
