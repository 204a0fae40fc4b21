"""Near-duplicate documents by 64-bit SimHash and a binary trie self-join.

Distinct fingerprints are laid out in ``C(blocks, blocks - budget)`` bit orders.
Two fingerprints at most ``budget`` bits apart differ in at most ``budget`` of
the blocks, so in at least one order they share the leading blocks, that is, the
same trie node at that depth. Spark deals those nodes out; inside a node a trie
is walked by pairs of nodes, adding up differing bits, and a pair of subtrees is
given up as soon as the sum exceeds the budget. Links leave a task only as a
spanning forest, never as all pairs. A node with more than ``node_rows``
fingerprints is dealt out as pairs of slices.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import arrow_column, components, free_names, group_starts, small_batches, text_bytes, unite, whole_groups
from chronoweave.operators.staging import stage

BUDGET, BLOCKS, NODE_ROWS = 4, 6, 8192
LEAF_PAIRS, FRONTIER = 64, 1 << 18


def fingerprint_of(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint; a text with no word has fingerprint 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat, at, ends, starts = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    if len(words) <= width:
        spans = ((0, len(flat)),)
    else:
        spans = zip(starts, ends[width - 1:])
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(flat[s:e], seed) for s, e in spans], np.uint64))


def majority(h: np.ndarray) -> int:
    """Unsigned fingerprint of shingle hashes: the bits that are set in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k:k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


@arrow_column("long")
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint_of(t) for t in text_bytes(text)], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the signed 64-bit fingerprint; a null text counts as empty."""
    return small_batches(docs).withColumn(out, _fingerprints(F.col(text)))


def trie_links(group: np.ndarray, codes: np.ndarray, budget: int) -> np.ndarray:
    """Class labels of rows sorted by (group, code): rows of a group are linked at ``budget`` or fewer differing bits."""
    labels = np.arange(len(codes))
    cuts = group_starts(group)
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    zeros: dict[int, np.ndarray] = {}

    def split(at: np.ndarray, to: np.ndarray, bit: int) -> np.ndarray:
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1) == 0)))
        return at + zeros[bit][to] - zeros[bit][at]

    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        bit, al, ah, bl, bh, diff = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(bit, *(x[half:] for x in (al, ah, bl, bh, diff))), (bit, *(x[:half] for x in (al, ah, bl, bh, diff)))]
            continue
        size = (ah - al) * (bh - bl)
        leaf = (size <= LEAF_PAIRS) | (bit < 0)
        if leaf.any():
            for part in np.array_split(np.flatnonzero(leaf), 1 + int(size[leaf].sum()) // (1 << 21)):
                n = size[part]
                k = np.repeat(np.arange(len(part)), n)
                o = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                wide = (bh - bl)[part][k]
                i, j = al[part][k] + o // wide, bl[part][k] + o % wide
                near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
                labels = unite(labels, i[near], j[near])
        go = ~leaf
        al, ah, bl, bh, diff = al[go], ah[go], bl[go], bh[go], diff[go]
        if not len(al):
            continue
        am, bm = split(al, ah, bit), split(bl, bh, bit)
        own = al == bl
        kids = [(al, am, bl, bm, diff, None), (am, ah, bm, bh, diff, None), (al, am, bm, bh, diff + 1, None), (am, ah, bl, bm, diff + 1, ~own)]
        out = [[], [], [], [], []]
        for a0, a1, b0, b1, d, only in kids:
            keep = (a1 > a0) & (b1 > b0) & (d <= budget)
            keep &= ~((a1 - a0 == 1) & (a0 == b0))
            if only is not None:
                keep &= only
            for x, v in zip(out, (a0, a1, b0, b1, d)):
                x.append(v[keep])
        nxt = [np.concatenate(x) for x in out]
        if len(nxt[0]):
            stack.append((bit - 1, *nxt))
    return labels


def orders(blocks: int, budget: int) -> list[int]:
    """Masks of the leading blocks of each bit order, as unsigned integers."""
    edge = np.linspace(0, 64, blocks + 1).astype(int)
    one = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edge[:-1], edge[1:])]
    return [sum(one[i] for i in pick) for pick in combinations(range(blocks), blocks - budget)]


def fingerprint_links(codes: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Distinct ``code`` values to ``(a, b)`` edges that connect all codes within ``budget`` bits."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in orders(blocks, budget)]
    keyed = codes.select("code", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in signed])).alias("ord", "key"))
    hot = keyed.groupBy("ord", "key").agg(F.count("*").alias("n")).where(F.col("n") > node_rows).select(
        "ord", "key", F.ceil(F.col("n") * 2 / node_rows).alias("slices"))
    hot = stage(hot, "hot")
    k = F.col("slices")
    own = F.pmod(F.xxhash64("code"), k)
    tasks = F.when(k.isNull(), F.array(F.lit("0"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), k - 1), lambda o: F.concat_ws("-", F.least(o, own), F.greatest(o, own))))
    dealt = keyed.join(hot, ["ord", "key"], "left").select("ord", "key", "code", F.explode(tasks).alias("task"))
    dealt = dealt.select(F.xxhash64("ord", "key", "task").alias("node"), "code")
    dealt = dealt.repartition("node").sortWithinPartitions("node", "code")

    def walk(batches):
        for t in whole_groups(batches, ["node"], 200_000):
            g, c = t.column("node").to_numpy(), t.column("code").to_numpy().view(np.uint64)
            o = np.lexsort((c, g))
            g, c = g[o], c[o]
            lab = trie_links(g, c, budget)
            at = np.flatnonzero(lab != np.arange(len(lab)))
            yield pa.RecordBatch.from_arrays([pa.array(c[at].view(np.int64)), pa.array(c[lab[at]].view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(walk, "a long, b long").distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET,
                       blocks: int = BLOCKS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``doc_id, code, component_id`` per row: the smallest doc_id linked to it, itself included.

    Null and empty texts have fingerprint 0 and link like any other. Rows that
    share a doc_id are separate rows; a null doc_id never is the smallest, and a
    component of null ids only has a null component_id. Extra columns are ignored.
    """
    prints = stage(with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "code")
                   .select("doc_id", "code"), "prints")
    codes = stage(prints.groupBy("code").agg(F.min("doc_id").alias("low")), "codes")
    edges = fingerprint_links(codes.select("code"), budget, blocks, node_rows)
    roots = components(edges).withColumnRenamed("node", "code")
    placed = codes.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))
    low = stage(placed.groupBy("root").agg(F.min("low").alias("component_id")), "low")
    member = stage(placed.join(low, "root").select("code", "component_id"), "member")
    return prints.join(member, "code").select("doc_id", "code", "component_id")


def near_duplicates_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups=simhash_components) -> DataFrame:
    """``docs``, all columns, with one document of each group of near duplicates that ``groups`` finds: the smallest doc_id's.

    Of rows equal in doc_id and text one stays; rows that share a doc_id but not the text are kept or
    dropped together. Rows with a null doc_id cannot be told apart and stay.
    """
    ident, body, row, held = free_names(docs, "ident", "body", "row", "held")
    keep = groups(docs, doc_id, text).where("doc_id = component_id").select(F.col("doc_id").alias(held)).distinct()
    rows = docs.withColumn(ident, F.col(doc_id).cast("long")).withColumn(body, F.xxhash64(text)).join(keep, F.col(ident) == F.col(held), "left")
    rows = rows.withColumn(row, F.row_number().over(Window.partitionBy(ident, body).orderBy(ident)))
    return rows.where(F.col(ident).isNull() | (F.col(held).isNotNull() & (F.col(row) == 1))).select(*docs.columns)
