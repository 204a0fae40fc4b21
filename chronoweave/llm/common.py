"""Helpers shared by the corpus operators: batches of whole groups, local union-find, components on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.staging import stage

BATCH_BYTES = "8m"
NULL_ID = -(2**63)


def small_batches(df: DataFrame) -> DataFrame:
    """Bound Arrow batches by bytes, so that a batch of very long texts stays small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def arrow_column(returns: str):
    """Decorator: a function of Arrow arrays becomes a function of columns; the UDF is made at the call, on the driver."""

    def wrap(f):
        def column(*cols: Column) -> Column:
            return F.arrow_udf(f, returns)(*cols)

        column.__doc__ = f.__doc__
        return column

    return wrap


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


class Remembered(dict):
    """Word to what ``make`` gives for it, in two generations of ``room`` words: a full young one becomes the old one.

    Words of more than ``longest`` characters are made anew each time.
    """

    def __init__(self, make, room: int, longest: int):
        super().__init__()
        self.make, self.room, self.longest, self.old = make, room, longest, {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
            if len(word) > self.longest:
                return ids
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def ragged(lists: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """Arrays as a list column without a Python object per value; None gives null."""
    sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate([x for x in lists if x is not None and len(x)]) if sizes.any() else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind), mask=pa.array([x is None for x in lists], pa.bool_()))


def fold_remainder(ident: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(ident.cast("string").cast("binary")) % modulus


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Regroup sorted batches into tables of about ``rows`` rows that never cut a group of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        change = np.zeros(n, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield t.slice(0, cuts[-1])
            t = t.slice(cuts[-1])
        held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held)


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Start offsets of runs of equal values, with the length appended."""
    n = len(columns[0])
    change = np.ones(n, bool)
    if n:
        change[1:] = False
    for v in columns:
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), n)


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i]; a class's label is its smallest index."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: the smallest node reachable, for every node with an edge.

    Alternates large-star and small-star rounds. Minima are aggregates with
    partial combine and are written before they are joined back, so a hub of any
    degree is never gathered and adaptive execution can split its join rows.
    Every round is cut off by written tables.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:  # ends: every round lowers a label or changes nothing
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or now[0] == 0:
            break
        mark = tuple(now)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        star = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        star = stage(star, "star")
        low = stage(star.groupBy("a").agg(F.min("b").alias("m")), "low")
        e = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).distinct()
        e = stage(e, "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
