"""Line de-duplication through sharded minimal perfect hashes.

Distinct keys of repeated lines are split over shards by hash. A shard holds a
minimal perfect hash (levels of bit arrays with ranks) and, at its positions, an
array of fingerprints, one of counts and one of the largest holder. Occurrences
are streamed past the arrays of their shard; texts are never joined by line.
A shard with many occurrences is copied to several tasks, so a line that every
document has is no hot spot, and a task holds one shard and one batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import NULL_ID, arrow_column, free_names, small_batches, text_bytes
from chronoweave.operators.staging import stage

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS, SHARD_ROWS = 100_000, 150_000
SPACES = b" \t\n\x0b\x0c\r"
_MIX = 0x9E3779B97F4A7C15


# ---- minimal perfect hash ----

def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h + np.uint64((level + 1) * _MIX % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own number below n; other keys map anywhere or to -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, seen = [], 0
        for bits in levels:
            self.ranks.append(seen + np.cumsum(bits) - bits)
            seen += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = 2 * len(rest) + 1
            at = _slot(rest, len(levels), size)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            rest = rest[hits[at] > 1]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = _slot(keys[todo], k, len(bits))
            hit = bits[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out

    def pack(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(p, np.uint8, offset=8), count=int.from_bytes(p[:8], "little")).astype(bool) for p in parts])


# ---- lines ----

def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(SPACES).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _row_key(ident: int, body: bytes | None) -> int:
    return xxhash.xxh3_128_intdigest(ident.to_bytes(8, "little", signed=True) + (body or b""))


def _halves(wide: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(x.to_bytes(16, "little") for x in wide)
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _occurrences(min_chars: int):
    def emit(batches):
        for b in batches:
            rows, ids, nos, firsts, keys = [], [], [], [], []
            for ident, body in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                row, seen = _row_key(ident, body), set()
                for no, line in enumerate((body or b"").split(b"\n")):
                    key = line_key(line, min_chars)
                    if key is not None:
                        h = xxhash.xxh3_128_intdigest(key)
                        rows.append(row)
                        ids.append(ident)
                        nos.append(no)
                        firsts.append(h not in seen)
                        keys.append(h)
                        seen.add(h)
            for k in range(0, len(keys), 20_000):
                to = slice(k, k + 20_000)
                (r1, r2), (h1, h2) = _halves(rows[to]), _halves(keys[to])
                yield pa.RecordBatch.from_arrays([pa.array(r1), pa.array(r2), pa.array(ids[to], pa.int64()), pa.array(nos[to], pa.int32()),
                                                  pa.array(firsts[to], pa.bool_()), pa.array(h1), pa.array(h2)],
                                                 ["r1", "r2", "id", "no", "first", "h1", "h2"])
    return emit


def _mixed(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
    """The 64 bits that are hashed perfectly: the first half of a key, with the second multiplied in if ``salt`` is above 0."""
    key = h1.view(np.uint64)
    return key if salt == 0 else key ^ (h2.view(np.uint64) * np.uint64(2 * salt * 0x9E3779B97F4A7C15 + 1 & 2**64 - 1))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2, salt = pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), 0
    key = _mixed(h1, h2, salt)
    while len(np.unique(key)) < len(key):  # two keys of one shard agree in 64 bits: mix in the rest
        salt += 1
        key = _mixed(h1, h2, salt)
    ph = PerfectHash.build(key)
    at = ph.find(key)
    prints, counts, tops = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    prints[at], counts[at], tops[at] = pdf["h2"], pdf["n"], pdf["top"]
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "salt": [salt], "levels": [ph.pack()], "prints": [prints.tobytes()],
                         "counts": [counts.tobytes()], "tops": [tops.tobytes()]})


def line_index(occurrences: DataFrame, min_docs: int, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """One row per shard: hash levels, fingerprints, counts and largest holders of lines in ``min_docs`` documents or more."""
    found = occurrences.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("top")).where(F.col("n") >= min_docs)
    found = stage(found, "repeated")
    shards = max(1, -(-found.count() // shard_keys))
    index = found.withColumn("shard", F.pmod("h2", F.lit(shards))).groupBy("shard").applyInPandas(
        _build, "shard long, salt long, levels array<binary>, prints binary, counts binary, tops binary")
    return stage(index, "lineindex"), shards


def _probe(batches):
    """Stream occurrences past the shard arrays that precede them; yields those to drop."""
    at, ph = None, None
    for b in batches:
        place, kind = b.column("place").to_numpy(zero_copy_only=False), b.column("kind").to_numpy()
        cuts = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (kind[1:] == 0) | (kind[:-1] == 0)))
        for lo, hi in zip(cuts, [*cuts[1:], len(place)]):
            part = b.slice(lo, hi - lo)
            if kind[lo] == 0:
                at, ph = place[lo], PerfectHash.unpack(part.column("levels")[0].as_py())
                salt = part.column("salt")[0].as_py()
                prints, counts, tops = (np.frombuffer(part.column(c)[0].as_py(), np.int64) for c in ("prints", "counts", "tops"))
                continue
            if at != place[lo]:
                continue
            h1, h2, ident = (part.column(c).to_numpy() for c in ("h1", "h2", "id"))
            k = ph.find(_mixed(h1, h2, salt))
            drop = (k >= 0) & (prints[k] == h2) & (counts[k] > 0) & (tops[k] != ident)
            if drop.any():
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(drop)) for c in ("r1", "r2", "no")], ["r1", "r2", "no"])


def dropped_lines(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """``r1, r2, no``: lines to drop by row key and line number."""
    index, shards = line_index(occurrences, min_docs)
    probes = occurrences.withColumn("shard", F.pmod("h2", F.lit(shards)))
    copies = probes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("copies"))  # one row per shard
    copies = F.broadcast(stage(copies, "copies"))
    place = F.concat_ws("-", "shard", "copy")
    probes = probes.join(copies, "shard").select(
        place_of(F.pmod(F.xxhash64("r1", "no"), F.col("copies"))).alias("place"), F.lit(1).alias("kind"), "r1", "r2", "id", "no", "h1", "h2")
    arrays = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(
        place.alias("place"), F.lit(0).alias("kind"), "salt", "levels", "prints", "counts", "tops")
    dealt = probes.unionByName(arrays, allowMissingColumns=True).repartition("place").sortWithinPartitions("place", "kind")
    return dealt.mapInArrow(_probe, "r1 long, r2 long, no int")


def place_of(copy):
    return F.concat_ws("-", "shard", copy)


@arrow_column("struct<r1: bigint, r2: bigint>")
def _row_keys(ident: pa.Array, text: pa.Array) -> pa.Array:
    r1, r2 = _halves([_row_key(i, t) for i, t in zip(ident.to_pylist(), text_bytes(text))])
    return pa.StructArray.from_arrays([pa.array(r1), pa.array(r2)], ["r1", "r2"])


@arrow_column("struct<text: string, n_lines: bigint, n_dropped: bigint, sha: string>")
def _rebuild(text: pa.Array, drop: pa.Array) -> pa.Array:
    kept, lines, gone, shas = [], [], [], []
    for body, no in zip(text_bytes(text), drop.to_pylist()):
        rows = (body or b"").split(b"\n")
        if no:
            off = set(no)
            out = b"\n".join(x for k, x in enumerate(rows) if k not in off)
            body = out
        kept.append(body)
        lines.append(len(rows))
        gone.append(len(no or ()))
        shas.append(hashlib.sha256(body or b"").hexdigest())
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()),
                                       pa.array(shas)], ["text", "n_lines", "n_dropped", "sha"])


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                      min_docs: int = MIN_DOCS, stats: bool = False) -> DataFrame:
    """Drop repeated lines, keeping them in the largest doc_id that holds them; all columns of ``docs`` stay.

    With ``stats`` the columns n_lines, n_dropped and kept_sha256 are added,
    replacing columns of those names. A null text is one empty line and stays
    null. Each row is a document of its own when holders are counted; rows that
    share the largest doc_id all keep the line. A null doc_id counts as smaller
    than any other.
    """
    ident = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    body = small_batches(docs).select(ident.alias("id"), F.col(text).alias("text"))
    occ = stage(body.mapInArrow(_occurrences(min_chars), "r1 long, r2 long, id long, no int, first boolean, h1 long, h2 long"), "lines")
    row, new, gone, r1, r2 = free_names(docs, "row", "new", "drop", "r1", "r2")
    drop = dropped_lines(occ, min_docs).groupBy("r1", "r2").agg(F.collect_set("no").alias(gone))
    drop = drop.select(F.col("r1").alias(r1), F.col("r2").alias(r2), gone)
    rows = docs.withColumn(row, _row_keys(ident, F.col(text)))
    rows = rows.join(drop, (F.col(row)["r1"] == F.col(r1)) & (F.col(row)["r2"] == F.col(r2)), "left").drop(r1, r2, row)
    out = rows.withColumn(new, _rebuild(F.col(text), F.col(gone))).withColumn(text, F.col(new)["text"])
    if stats:
        out = out.withColumns({"n_lines": F.col(new)["n_lines"], "n_dropped": F.col(new)["n_dropped"], "kept_sha256": F.col(new)["sha"]})
    return out.drop(gone, new)
