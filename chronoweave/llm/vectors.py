"""Near-duplicate vectors by a pivot-permutation index.

Pivots are spread reference points picked from a bounded sample. A vector is
described by its ``NEAREST`` pivots in order of similarity. Two vectors are
candidates if they share ``SHARED`` of them. A vector is posted to the inverted
lists of its ``NEAREST - SHARED + 1`` rarest pivots only: any two that share
``SHARED`` meet in one of those. Within a list shared pivots are counted, and
candidates are verified by cosine in double precision, in blocks; what leaves a
list is a number of links and a spanning edge per vector, never pairs. A list of
more than ``LIST_ROWS`` vectors is dealt out as pairs of slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import components, group_starts, small_batches, unite, whole_groups
from chronoweave.operators.staging import stage

PIVOTS, NEAREST, SHARED = 128, 8, 4
SAMPLE, SPREAD, LIST_ROWS = 4000, 0.8, 4096
COSINE = 0.98
BLOCK = 1 << 20


def _units(batches):
    """Rows with a 128-bit key of the vector and its unit form (null if it cannot be compared)."""
    for b in batches:
        ids, labels, vectors = (b.column(c) for c in ("vec_id", "label", "vector"))
        h1, h2, out = [], [], []
        for v in vectors.to_pylist():
            if v is None or any(x is None for x in v):
                h1.append(0), h2.append(0), out.append(None)
                continue
            x = np.array(v, np.float64)
            top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(top) or top == 0:
                h1.append(0), h2.append(0), out.append(None)
                continue
            d = xxhash.xxh3_128_digest(x.tobytes())
            h1.append(int.from_bytes(d[:8], "little", signed=True)), h2.append(int.from_bytes(d[8:], "little", signed=True))
            x = x / top
            out.append(x / np.sqrt(x @ x))
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(out, pa.list_(pa.float64()))],
                                         ["vec_id", "label", "h1", "h2", "unit"])


def spread_pivots(sample: np.ndarray, dim: int, number: int, seed: int = 5) -> np.ndarray:
    """Sample vectors taken in turn if less alike than ``SPREAD`` to those before, filled up with random directions."""
    picked = np.zeros((0, dim))
    for v in sample:
        if len(picked) == number:
            break
        if not len(picked) or (picked @ v).max() < SPREAD:
            picked = np.vstack([picked, v])
    extra = np.random.default_rng([seed, dim]).normal(size=(number - len(picked), dim))
    return np.vstack([picked, extra / np.linalg.norm(extra, axis=1, keepdims=True)])


class Pivots:
    """Pivots by vector length."""

    def __init__(self, sample: list[list[float]], number: int):
        self.number, self.sample, self.made = number, {}, {}
        for v in sample:
            self.sample.setdefault(len(v), []).append(v)

    def of(self, dim: int) -> np.ndarray:
        if dim not in self.made:
            self.made[dim] = spread_pivots(np.array(self.sample.get(dim, [])).reshape(-1, dim), dim, self.number)
        return self.made[dim]


def list_links(unit: np.ndarray, mask: np.ndarray, prefix: np.ndarray, copies: np.ndarray, pivot: int, shared: int, cosine: float, skip=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (copies counted) and smallest linked row of each vector of a list, for pairs whose first common prefix pivot is ``pivot``.

    ``skip(i, j)`` leaves out pairs that another slice pair has.
    """
    n = len(unit)
    links, labels = np.zeros(n, np.int64), np.arange(n)
    word, bit = divmod(pivot, 64)
    below = np.uint64((1 << bit) - 1)
    step = max(1, BLOCK // max(1, n))
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        common = sum(np.bitwise_count(mask[lo:hi, None, w] & mask[None, :, w]).astype(np.int8) for w in range(mask.shape[1]))
        ok = common >= shared
        for w in range(word):
            ok &= (prefix[lo:hi, None, w] & prefix[None, :, w]) == 0
        ok &= (prefix[lo:hi, None, word] & prefix[None, :, word] & below) == 0
        i, j = np.nonzero(ok)
        i += lo
        less = i < j
        i, j = i[less], j[less]
        if skip is not None:
            keep = ~skip(i, j)
            i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 17):
            a, b = i[k:k + (1 << 17)], j[k:k + (1 << 17)]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            a, b = a[near], b[near]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            labels = unite(labels, a, b)
    return links, labels


def vector_components(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
                      pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, list_rows: int = LIST_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row.

    Rows with equal, non-null labels link at ``cosine`` or more. Vectors that are
    null, zero or empty, or hold null or non-finite components, link with
    nothing, nor do those of different lengths with each other. Equal rows are
    copies of one vector and link; rows that share a vec_id are rows of their
    own; a null vec_id is never the smallest, and a component of null ids only
    has a null component_id. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = small_batches(vectors).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = stage(rows.mapInArrow(_units, "vec_id long, label string, h1 long, h2 long, unit array<double>"), "units")
    able = rows.where("unit is not null and label is not null")
    distinct = able.groupBy("label", "h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("unit").alias("unit"))
    distinct = stage(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    sample = distinct.orderBy(F.xxhash64("h1", "h2"), "h1", "h2", "label").limit(SAMPLE).select("unit").toPandas()["unit"]  # a bounded sample
    held = spark.sparkContext.broadcast(Pivots([np.asarray(v) for v in sample], pivots))

    def describe(batches):
        for b in batches:
            units = b.column("unit").to_pylist()
            near = [None] * len(units)
            for dim in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == dim]
                close = np.array([units[i] for i in at]) @ held.value.of(dim).T
                for i, order in zip(at, np.argsort(-close, axis=1, kind="stable")[:, :nearest]):
                    near[i] = order
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.int32()))], [*b.schema.names, "near"])

    described = stage(distinct.select("node", "label", "n", "unit").mapInArrow(describe, "node long, label string, n long, unit array<double>, near array<int>"), "described")
    used = {r["p"]: r["n"] for r in described.select(F.explode("near").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row per pivot
    rank = np.argsort(np.argsort([used.get(p, 0) for p in range(pivots)], kind="stable"))
    ranks = F.array(*[F.lit(int(r)) for r in rank])
    ranked = described.withColumn("ranks", F.array_sort(F.transform("near", lambda p: F.get(ranks, p))))
    posted = ranked.select("node", "label", "n", "unit", "ranks", F.explode(F.slice("ranks", 1, nearest - shared + 1)).alias("pivot"))
    posted = posted.withColumn("dim", F.size("unit"))
    hot = ranked.select("label", F.size("unit").alias("dim"), F.explode(F.slice("ranks", 1, nearest - shared + 1)).alias("pivot")).groupBy("label", "dim", "pivot").agg(
        F.count("*").alias("rows")).where(F.col("rows") > list_rows).select("label", "dim", "pivot", F.ceil(F.col("rows") * 2 / list_rows).alias("slices"))
    hot = stage(hot, "hot")
    k = F.coalesce(F.col("slices"), F.lit(1).cast("long"))
    dealt = posted.join(hot, ["label", "dim", "pivot"], "left").withColumn("own", F.pmod(F.xxhash64("node"), k)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
    task = F.xxhash64("label", "dim", "pivot", F.least("own", "other"), F.greatest("own", "other"))
    mixed = F.col("own") != F.col("other")
    dealt = dealt.select(task.alias("task"), "node", "n", "unit", "ranks", "pivot", "own", mixed.alias("mixed")).repartition("task").sortWithinPartitions("task")
    words, head = -(-pivots // 64), nearest - shared + 1

    def search(batches):
        for t in whole_groups(batches, ["task"], 2000):
            unit = t.column("unit").combine_chunks()
            task, node, n, pivot, own = (t.column(c).to_numpy() for c in ("task", "node", "n", "pivot", "own"))
            mix = t.column("mixed").to_numpy()
            order = np.array(t.column("ranks").to_pylist(), np.int64)
            cuts = group_starts(task)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2:
                    continue
                u = np.array(unit.slice(lo, hi - lo).to_pylist())
                mask, prefix = np.zeros((2, hi - lo, words), np.uint64)
                for c in range(order.shape[1]):
                    bit = np.uint64(1) << (order[lo:hi, c] % 64).astype(np.uint64)
                    mask[np.arange(hi - lo), order[lo:hi, c] // 64] |= bit
                    if c < head:
                        prefix[np.arange(hi - lo), order[lo:hi, c] // 64] |= bit
                slices = own[lo:hi]
                skip = (lambda i, j: slices[i] == slices[j]) if mix[lo:hi].any() else None  # noqa: B023
                links, labels = list_links(u, mask, prefix, n[lo:hi], int(pivot[lo]), shared, cosine, skip)
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][at]), pa.array(links[at]), pa.array(node[lo:hi][labels[at]])], ["node", "links", "root"])

    found = stage(dealt.mapInArrow(search, "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = distinct.select("label", "h1", "h2", "node", "n", "low").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = stage(placed.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    member = stage(placed.join(lows, "root").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "member")
    out = rows.select("vec_id", "label", "h1", "h2", F.col("unit").isNotNull().alias("able")).join(
        member.withColumn("able", F.lit(True)), ["label", "h1", "h2", "able"], "left")
    linked = F.col("n_links").isNotNull()
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
