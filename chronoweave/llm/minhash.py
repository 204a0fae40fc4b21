"""Near-duplicate documents by the true Jaccard similarity of their five-word shingles.

Candidates have SimHash fingerprints of those shingles at most 4 bits apart, found
by the trie self-join of ``simhash``. Texts alike at 0.8 differ in about ten bits,
more than any trie over 64 bits affords, so those that share one of ``BANDS``
MinHash bands of ``ROWS`` values are candidates too: a pair of similarity s meets
there with probability ``1 - (1 - s^ROWS)^BANDS``, 0.9996 at 0.8.
Distinct texts that candidates connect form a group; inside a group every
pair that is not linked yet is compared by its whole shingle sets, so no link is
estimated. Links leave a task only as a spanning forest. A large group is dealt
out as pairs of slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import simhash
from chronoweave.llm.common import components, group_starts, small_batches, text_bytes, whole_groups
from chronoweave.operators.staging import stage

WIDTH, ALIKE, OF = 5, 4, 5  # similarity of at least ALIKE / OF
BANDS, ROWS = 20, 5
NODE_ROWS, NODE_SHINGLES = 2048, 1 << 22
_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` lower-case words; a text of fewer words is one shingle."""
    words = (text or b"").decode("utf-8", "replace").lower().encode().split()
    digest = xxhash.xxh64_intdigest
    spans = (b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))
    return np.unique(np.fromiter((digest(s) for s in spans), np.uint64))


def bands(sh: np.ndarray) -> np.ndarray:
    """A hash for each band of MinHash values."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(sh), 1024):
        low = np.minimum(low, (sh[k:k + 1024, None] * _MUL + _ADD).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def alike_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets of similarity ``ALIKE / OF`` or more, found by true intersections."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    start = np.append(0, np.cumsum(size))
    names, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark = np.zeros(len(names), bool)
    fresh = np.ones(len(sets), bool)
    out = []
    for first in range(len(sets)):
        if not fresh[first]:
            continue
        fresh[first] = False
        queue = [first]
        while queue:
            v = queue.pop()
            lo, hi = np.searchsorted(size * OF, size[v] * ALIKE), np.searchsorted(size * ALIKE, size[v] * OF, "right")
            todo = lo + np.flatnonzero(fresh[lo:hi])
            if not len(todo):
                continue
            own = flat[start[v]:start[v + 1]]
            mark[own] = True
            if len(todo) * 8 < hi - lo:
                common = np.array([np.count_nonzero(mark[flat[start[j]:start[j + 1]]]) for j in todo])
            else:
                common = np.add.reduceat(mark[flat[start[lo]:start[hi]]], start[lo:hi] - start[lo], dtype=np.int64)[todo - lo]
            mark[own] = False
            near = todo[common * (ALIKE + OF) >= ALIKE * (size[todo] + size[v])]
            fresh[near] = False
            queue += near.tolist()
            out += [(int(order[v]), int(order[j])) for j in near]
    return out


def simhash_candidates(prints: DataFrame) -> DataFrame:
    """``(a, b)`` edges that connect all codes whose fingerprints (``print``) the trie links."""
    first = stage(prints.groupBy("print").agg(F.min("code").alias("a")), "fingerprints")
    same = prints.join(first, "print").where("code <> a").select("a", F.col("code").alias("b"))
    links = simhash.fingerprint_links(first.select(F.col("print").alias("code")))
    a, b = (first.select(F.col("print").alias(f"print_{c}"), F.col("a").alias(f"code_{c}")) for c in "ab")
    near = links.join(a, F.col("a") == F.col("print_a")).join(b, F.col("b") == F.col("print_b"))
    return same.unionByName(near.select(F.col("code_a").alias("a"), F.col("code_b").alias("b")))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """``doc_id, code, component_id`` per row: the smallest doc_id linked to it, itself included; ``code`` stands for the text.

    Null and empty texts are one text and link to texts without a word. Rows that
    share a doc_id are separate rows; a null doc_id never is the smallest, and a
    component of null ids only has a null component_id. Extra columns are ignored.
    """
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("code", F.xxhash64("text"))

    def sign(batches):
        for b in batches:
            got = [shingles(t) for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("code"), pa.array([len(s) for s in got], pa.int64()),
                                              pa.array([bands(s) for s in got], pa.list_(pa.int64())),
                                              pa.array(np.array([simhash.majority(s) for s in got], np.uint64).view(np.int64))], ["doc_id", "code", "n", "bands", "print"])

    prints = stage(rows.mapInArrow(sign, "doc_id long, code long, n long, bands array<long>, print long"), "prints")
    codes = stage(prints.groupBy("code").agg(F.min("doc_id").alias("low"), F.max("n").alias("n")), "codes")
    posts = prints.select("code", F.explode("bands").alias("band"))
    first = stage(posts.groupBy("band").agg(F.min("code").alias("a"), F.max("code").alias("top")).where("a < top").select("band", "a"), "first")
    banded = posts.join(first, "band").where("code <> a").select("a", F.col("code").alias("b"))
    group = stage(components(banded.unionByName(simhash_candidates(prints.select("code", "print"))).distinct()), "group")
    held = group.withColumnRenamed("node", "code").join(codes, "code")
    hot = stage(held.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where(
        (F.col("rows") > node_rows) | (F.col("shingles") > NODE_SHINGLES)).select(
        "root", F.ceil(F.greatest(F.col("rows") * 2 / node_rows, F.col("shingles") * 2 / NODE_SHINGLES)).alias("slices")), "hot")
    k = F.col("slices")
    own = F.pmod(F.xxhash64("code", F.lit(1)), k)
    tasks = F.when(k.isNull(), F.array(F.lit("0"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), k - 1), lambda o: F.concat_ws("-", F.least(o, own), F.greatest(o, own))))
    # one row a text: its smallest doc_id's
    member = rows.join(held.select("code", "root", "low"), "code").where("doc_id <=> low").join(hot, "root", "left")
    dealt = member.select(F.explode(tasks).alias("task"), "root", "code", "text").select(F.xxhash64("root", "task").alias("node"), "code", "text")
    dealt = small_batches(dealt.repartition("node").sortWithinPartitions("node", "code"))

    def verify(batches):
        for t in whole_groups(batches, ["node"], 256):
            node, code = t.column("node").to_numpy(), t.column("code").to_numpy()
            cuts = group_starts(node)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                at = lo + group_starts(code[lo:hi])[:-1]
                if len(at) < 2:
                    continue
                got = [shingles(x) for x in text_bytes(t.column("text").take(pa.array(at)))]
                link = np.array(alike_links(got), int).reshape(-1, 2)
                if len(link):
                    yield pa.RecordBatch.from_arrays([pa.array(code[at[link[:, 0]]]), pa.array(code[at[link[:, 1]]])], ["a", "b"])

    roots = components(dealt.mapInArrow(verify, "a long, b long")).withColumnRenamed("node", "code")
    placed = codes.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))
    low = stage(placed.groupBy("root").agg(F.min("low").alias("component_id")), "low")
    found = stage(placed.join(low, "root").select("code", "component_id"), "member")
    return prints.join(found, "code").select("doc_id", "code", "component_id")
