"""Prefix trie of conversations, with subtree totals by time-forward processing.

Turns are numbered per conversation from a range sort, so a conversation of any
length is dealt out. A turn's hashes with its position are summed along the
conversation: the running sums are the 128-bit key of the prefix, whatever partition
a turn is in. Nodes are an aggregate over prefixes with partial combine, taken over
one conversation of each group of equal ones.

Totals flow from children to parents in reverse level order: nodes are sorted deepest
first by Spark's external sort, every node takes the messages addressed to it from a
priority queue (which spills sorted runs to disk), and sends its own to its parent.
Shards are connected parts of the trie. A node's *weight*, the turns at and below it
counted per distinct conversation, bounds its subtree. Nodes with the same whole
quotient of weight and shard size hang together: with quotient 0 they are whole
subtrees, otherwise stretches of one path, as two children cannot both have it. So no
shard holds more nodes than the shard size, which is the root of the number of turns.
The order is: all light shards; then the tree of the heavy stretches, whose number is
of the same order, in one queue that spills; then the nodes of the heavy stretches.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import tempfile
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import small_batches
from chronoweave.operators.staging import stage

FAMILY, HEADS = 100, 6
BLOCK, LEAST_SHARD, QUEUE_ROWS, MOST_RUNS, RUN_IDS = 1024, 1000, 200_000, 32, 1 << 15
KEY = ["k1", "k2"]
_SUMS = ["s1", "s2", "s3", "s4"]


# ---- turns and prefixes ----

def numbered(turns: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Add ``at``, the rank of a row within its key from 1; a key of any size is dealt out over range partitions."""
    rows = turns.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    rows = stage(rows.withColumns({"part": F.spark_partition_id(), "here": F.monotonically_increasing_id()}), "sorted")
    parts = rows.groupBy(key, "part").agg(F.min("here").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(key, "part", (before - F.col("first") + 1).alias("shift"))
    return rows.join(parts, [key, "part"]).withColumn("at", F.col("here") + F.col("shift")).drop("part", "here", "shift")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, at, role, text``: the first h turns of the family's first conversation, then a conversation's own turns after its first h.

    Turns go by turn number, null first; equal ones by role, then text. A conversation without turns left has one row with a null ``at``.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("conv_id is not null")
    own = stage(numbered(t, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]).select("conv_id", "at", "role", "text"), "numbered")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = own.groupBy("conv_id").agg(F.max("at").alias("turns"))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = sizes.select("conv_id", heads.alias("h"), first.alias("base")).join(
        sizes.select(F.col("conv_id").alias("base"), F.least("turns", F.lit(HEADS - 1)).alias("lent")), "base", "left")
    convs = stage(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("lent")), "convs")
    lent = convs.where("lent > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), "lent")).alias("at"))
    start = own.where((F.col("at") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    lent = lent.join(start, ["base", "at"]).select("conv_id", "at", "role", "text")
    rest = own.join(convs.select("conv_id", "h", "lent"), "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "role", "text")
    both = lent.unionByName(rest)
    empty = convs.select("conv_id").join(both.select("conv_id").distinct(), "conv_id", "left_anti")
    return both.unionByName(empty.select("conv_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, points``: the key of every prefix and of the one before it, from the empty prefix on."""
    h = [F.xxhash64(F.lit(seed), "at", "role", "text") for seed in (1, 2)]
    low, high = (lambda c: c.bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftrightunsigned(c, 32))
    parts = dict(zip(_SUMS, (low(h[0]), high(h[0]), low(h[1]), high(h[1]))))  # halves: their sums stay within a long
    t = turns.where("at is not null").select("conv_id", "at", F.length("text").alias("points"), F.floor(F.col("at") / BLOCK).alias("block"), *[c.alias(n) for n, c in parts.items()])
    run = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    carry = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("conv_id", "block").agg(*[F.sum(s).alias(s) for s in _SUMS]).select("conv_id", "block", *[F.coalesce(F.sum(s).over(carry), F.lit(0)).alias(f"c_{s}") for s in _SUMS])
    local = t.select("conv_id", "block", "at", "points", *[F.sum(s).over(run).alias(f"r_{s}") for s in _SUMS], *parts).join(blocks, ["conv_id", "block"])
    now = [F.col(f"r_{s}") + F.col(f"c_{s}") for s in _SUMS]
    then = [F.col(f"r_{s}") + F.col(f"c_{s}") - F.col(s) for s in _SUMS]
    key = lambda at, sums: [F.xxhash64(F.lit(seed), at, *sums) for seed in (3, 4)]
    named = lambda at, sums, names: [c.alias(n) for c, n in zip(key(at, sums), names)]
    zero = [F.lit(0).cast("long")] * 4
    own = local.select("conv_id", F.col("at").alias("depth"), *named(F.col("at"), now, KEY), *named(F.col("at") - 1, then, ["p1", "p2"]), F.col("points").cast("long").alias("points"))
    none = F.lit(None).cast("long")
    top = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("depth"), *named(F.lit(0).cast("long"), zero, KEY), none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("points"))
    return own.unionByName(top)


# ---- hashes of the members that end at a node ----

def _chunks(batches):
    """Sorted ``k1, k2, conv_id`` rows to packed runs of ids of one node."""
    key, ids = None, []

    def run():
        return {"k1": key[0], "k2": key[1], "first": ids[0], "ids": zlib.compress(np.diff(np.array(ids, np.int64), prepend=np.int64(0)).tobytes())}

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
    for b in batches:
        out = []
        for k1, k2, conv in zip(*(c.to_pylist() for c in b.columns)):
            if (k1, k2) != key or len(ids) >= RUN_IDS:
                if ids:
                    out.append(run())
                key, ids = (k1, k2), []
            ids.append(conv)
        yield pa.RecordBatch.from_pylist(out, schema)
    if ids:
        yield pa.RecordBatch.from_pylist([run()], schema)


def _digests(batches):
    """Sorted packed runs to a digest per node; one state is held, whatever the number of ids."""
    key, state, out = None, None, []
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    for b in batches:
        for k1, k2, _, packed in zip(*(c.to_pylist() for c in b.columns)):
            ids = np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64)).tolist()
            if (k1, k2) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
        out = []
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest())))], schema)


def ends_digest(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of ``k1, k2, conv_id``: ids ascending, comma-joined.

    The hash of a node is one chain by definition; what reaches its task is packed runs of differences.
    """
    runs = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").select(*KEY, "conv_id").mapInArrow(_chunks, "k1 long, k2 long, first long, ids binary")
    return small_batches(runs).repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


# ---- time-forward processing ----

class SpillingQueue:
    """Priority queue of fixed-size messages; beyond ``rows`` the whole heap goes to disk as a sorted run, read back in blocks."""

    def __init__(self, rows: int = QUEUE_ROWS):
        self.rows, self.heap, self.runs, self.made, self.packer = rows, [], [], 0, struct.Struct("<5q")

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) >= self.rows:
            self._spill()

    def _spill(self) -> None:
        messages, self.heap = sorted(self.heap), []
        if len(self.runs) >= MOST_RUNS:  # few open files: all runs become one
            older, self.runs = [chain((head,), reader) for head, _, reader in self.runs], []
            messages = heapq.merge(messages, *older)
        run = tempfile.TemporaryFile()  # local to the task, gone with it
        for m in messages:
            run.write(self.packer.pack(*m))
        run.seek(0)
        reader = self._read(run)
        self.made += 1
        heapq.heappush(self.runs, (next(reader), self.made, reader))

    def _read(self, run):
        with run:
            while block := run.read(self.packer.size * 4096):
                yield from self.packer.iter_unpack(block)

    def peek(self) -> tuple[int, ...] | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            message, number, reader = self.runs[0]
            following = next(reader, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, reader))
            return message
        return heapq.heappop(self.heap)


def forward(nodes: DataFrame, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """``k1, k2, p1, p2, out, leaves, saved``: subtree totals within each shard.

    ``nodes`` has ``shard, depth, k1, k2``, its parent's ``up, p1, p2`` (depth and key), the
    node's own ``leaves, saved`` and ``out`` = whether its parent is in another shard.
    Shards are not cut by partitions; nodes come sorted by shard, deepest first, then key.
    """

    def run(batches):
        queue, shard = SpillingQueue(queue_rows), None
        for b in batches:
            done = []
            for s, depth, k1, k2, up, p1, p2, out, leaves, saved in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    queue, shard = SpillingQueue(queue_rows), s
                at = (-depth, k1, k2)
                while (m := queue.peek()) is not None and m[:3] == at:
                    _, _, _, more_leaves, more_saved = queue.pop()
                    leaves, saved = leaves + more_leaves, saved + more_saved
                if not out:
                    queue.push((-up, p1, p2, leaves, saved))
                done.append((leaves, saved))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "p1", "p2", "out")), *(pa.array([d[i] for d in done], pa.int64()) for i in (0, 1))],
                                             ["k1", "k2", "p1", "p2", "out", "leaves", "saved"])

    rows = nodes.select("shard", "depth", "k1", "k2", "up", "p1", "p2", "out", "leaves", "saved").repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "k1", "k2")
    return rows.mapInArrow(run, "k1 long, k2 long, p1 long, p2 long, out boolean, leaves long, saved long")


def _received(rows: DataFrame) -> DataFrame:
    """What shard roots send, added up per parent."""
    return rows.where("out and p1 is not null").groupBy("p1", "p2").agg(F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved")).withColumnsRenamed({"p1": "k1", "p2": "k2"})


def _with(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    more = lambda c: (F.col(c) + F.coalesce(F.col(f"m_{c}"), F.lit(0))).alias(c)
    return nodes.join(messages, KEY, "left").select(*[c for c in nodes.columns if c not in ("leaves", "saved")], more("leaves"), more("saved"))


def subtree_totals(nodes: DataFrame, paths: DataFrame, shard_rows: int, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """``k1, k2, n_leaves, saved_tokens``: sums of own ``leaves`` and ``saved`` over subtrees.

    ``nodes`` has ``k1, k2, p1, p2, depth, weight, leaves, saved``; ``paths`` (``conv_id, depth,
    k1, k2``) leads from the root through every node. A node's shard is named by the first
    node of its path that has the same quotient of weight and ``shard_rows``.
    """
    heavy = nodes.where(F.col("weight") >= shard_rows).select(*KEY, F.floor(F.col("weight") / shard_rows).alias("q"))  # few: each has a shard of turns below
    along = paths.select("conv_id", "depth", *KEY).join(heavy, KEY, "left").withColumn("q", F.coalesce("q", F.lit(0)))
    starts = along.groupBy("conv_id", "q").agg(F.min(F.struct("depth", "k1")).alias("s"))
    placed = along.join(starts, ["conv_id", "q"]).groupBy(*KEY).agg(F.min("q").alias("q"), F.min("s").alias("s"))
    placed = stage(nodes.join(placed, KEY).select("q", F.col("s.k1").alias("shard"), F.col("s.depth").alias("start"), (F.col("depth") == F.col("s.depth")).alias("out"), "depth", "k1", "k2", (F.col("depth") - 1).alias("up"), "p1", "p2", "leaves", "saved"), "placed")
    below = stage(forward(placed.where("q = 0"), queue_rows), "below")
    upper = stage(_with(placed.where("q > 0"), _received(below)), "upper")
    own = upper.groupBy("shard").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    roots = upper.where("out").select("shard", "depth", F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    roots = stage(roots.join(upper.select(*KEY, F.col("shard").alias("p1"), F.col("start").alias("up")), KEY, "left").join(own, "shard"), "stretches")
    none = F.lit(0).cast("long")
    across = forward(roots.select(none.alias("shard"), "depth", F.col("shard").alias("k1"), none.alias("k2"), "up", "p1", none.alias("p2"), F.col("p1").isNull().alias("out"), "leaves", "saved"), queue_rows)
    sent = roots.select("shard", *KEY).join(across.select(F.col("k1").alias("shard"), "leaves", "saved"), "shard").where("k1 is not null")
    sent = sent.groupBy(*KEY).agg(F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"))
    whole = below.unionByName(forward(_with(upper, sent), queue_rows))
    return whole.select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, shard_rows: int | None = None, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """A row per node of the prefix trie of rebuilt conversations; see ``rebuilt``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Null roles and texts are empty, null
    turns come first, equal turn numbers go by role and text, repeated rows are turns of
    their own. Rows without a conv_id belong to no conversation. An empty table has no
    node, not even a root. Extra columns are ignored.
    """
    turns = stage(rebuilt(conversations), "turns")
    every = stage(prefixes(turns), "prefixes")
    last = stage(every.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("e")).select("conv_id", "e.*"), "ends")
    alike = last.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.max("depth").alias("length")).drop(*KEY)
    paths = stage(every.join(alike, "conv_id"), "paths")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
                                    *[F.min(c).alias(c) for c in ("depth", "p1", "p2", "points")])
    nodes = stage(nodes, "nodes")
    children = nodes.where("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "k1", "p2": "k2"})
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stage(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("points")}), "nodes")
    if shard_rows is None:
        shard_rows = max(LEAST_SHARD, math.isqrt(nodes.agg(F.max("weight")).first()[0] or 0))  # the root's weight counts every path
    totals = subtree_totals(nodes, paths, shard_rows, queue_rows)
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, KEY).join(above, ["p1", "p2"], "left").join(ends_digest(last.select(*KEY, "conv_id")), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
