"""Removal of every byte covered by a string of ``length`` bytes that starts anywhere else in the corpus.

1. Anchors. In every window of ``length`` bytes the ``ANCHOR``-byte string with the
   smallest hash is selected (leftmost on ties). The choice depends on the window's
   bytes alone, so equal windows have equal anchors at equal offsets: comparing windows
   of the same anchor loses no match. An anchor owns the windows that select it.
2. The context of an anchor is every byte of the windows it owns. Contexts equal in all
   bytes form a class; a class of two or more is repeated as a whole.
3. Anchors with several classes send one context of each to shards of bounded size.
   A shard sorts the suffixes of its contexts (Larsson-Sadakane doubling: only groups
   that still tie are sorted again), takes common prefixes of neighbours (Kasai, all
   contexts in step) and so groups equal windows.
4. An anchor with more classes than a shard takes is cut into slices. Each slice hands
   on runs of fingerprints of its distinct windows, cut at fixed ranges; the runs of a
   range are merged and windows found in others by binary search.
5. What a class has repeated is handed to all its members and cut from their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import NULL_ID, arrow_column, group_starts, small_batches, text_bytes, whole_groups
from chronoweave.operators.staging import stage

LENGTH, ANCHOR = 400, 100
PIECE = 1 << 19
SHARD_CONTEXTS, HOT_CONTEXTS = 1500, 3000
RUN_WINDOWS = 1_000_000
_POSITION = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Hashes of all strings of a given length of a byte array."""

    def __init__(self, n: int, seed: int = 11):
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        self.byte = np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, b: np.ndarray, k: int) -> np.ndarray:
        n = len(b)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[b] * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:n + 1 - k]) * self.down[:n + 1 - k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    grid = pad.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def anchors(texts: list[bytes], roller: Roller, length: int, k: int):
    """``(text number, position, hash, first, last)`` of the anchors of all windows of several short texts, or of one text
    in pieces; ``first`` and ``last`` are the starts of the windows an anchor owns."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        step = PIECE - length + 1
        parts = [anchors([texts[0][at:at + PIECE]], roller, length, k) for at in range(0, len(texts[0]) - length + 1, step)]
        pos, first, last = (np.concatenate([p[c] + i * step for i, p in enumerate(parts)]) for c in (1, 3, 4))
        cut = group_starts(pos)[:-1]  # an anchor whose windows lie in two pieces
        h = np.concatenate([p[2] for p in parts])
        return np.zeros(len(cut), np.int64), pos[cut], h[cut], first[cut], last[np.append(cut[1:], len(pos)) - 1]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], int)
    ends = np.cumsum(size)
    if len(flat) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = roller.hashes(flat, k)
    low = sliding_min((h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), length - k + 1)
    start = np.flatnonzero(np.repeat(ends, size)[:len(low)] - np.arange(len(low)) >= length)
    pick = (low[start] & _POSITION).astype(np.int64)
    cut = group_starts(pick)
    at, first, last = pick[cut[:-1]], start[cut[:-1]], start[cut[1:] - 1]
    owner = np.searchsorted(ends, at, side="right")
    base = (ends - size)[owner]
    return owner, at - base, h[at], first - base, last - base


def suffix_array(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of texts laid end to end with a zero byte after each; ``bounds`` are their starts and the end.

    Suffixes stop at the end of their text; equal ones are told apart by place.
    Larsson-Sadakane: ranks double their depth, and only suffixes in groups that
    still tie are sorted again.
    """
    n = len(text)
    stop = np.repeat(bounds[1:] - 1, np.diff(bounds))  # place of each suffix's end mark
    left = np.minimum(stop - np.arange(n), 7)
    # the first seven bytes, then how many of them there are: a suffix sorts before what it begins
    word = _words(text, ">u8").astype(np.uint64) >> np.uint64(8)
    word &= ~((np.uint64(1) << (56 - 8 * left).astype(np.uint64)) - np.uint64(1))
    word = (word << np.uint64(8)) | left.astype(np.uint64)
    sa = np.argsort(word)
    word = word[sa]
    ends = np.flatnonzero(word & np.uint64(255) < 7)
    sa[ends] = sa[ends][np.lexsort((sa[ends], word[ends]))]
    new = np.append(True, (word[1:] != word[:-1]) | (word[1:] & np.uint64(255) < 7))
    depth = 7
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    rank[sa] = np.repeat(start, np.diff(np.append(start, n)))
    at = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(at):
        who = sa[at]
        key = rank[who] * n + rank[who + depth]
        order = np.argsort(key)
        who, key = who[order], key[order]
        sa[at] = who
        fresh = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(fresh)
        rank[who] = np.repeat(at[start], np.diff(np.append(start, len(at))))
        at = at[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return sa, rank


def _words(text: np.ndarray, kind: str) -> np.ndarray:
    """Eight bytes from every place on, zeros past the end."""
    padded = np.append(text, np.zeros(8, np.uint8))
    return np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1)).copy().view(kind).ravel()


def common_prefixes(text: np.ndarray, bounds: np.ndarray, sa: np.ndarray, rank: np.ndarray, least: int = 0) -> np.ndarray:
    """Kasai: bytes each suffix shares with its predecessor in the suffix array, all texts walked in step, eight bytes a comparison.

    Suffixes of under ``least`` bytes, the last of each text, are not walked and have 0.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    stop = np.repeat(bounds[1:] - 1, np.diff(bounds))
    word = _words(text, "u8")
    base, size = bounds[:-1], np.diff(bounds) - least
    h = np.zeros(len(base), np.int64)
    for o in range(max(0, int(size.max()))):
        live = np.flatnonzero(o < size)
        i = base[live] + o
        here = rank[i]
        has = here > 0
        live, i, here = live[has], i[has], here[has]
        j = sa[here - 1]
        got = np.maximum(h[live] - 1, 0)
        most = np.minimum(stop[i] - i, stop[j] - j)
        got = np.minimum(got, most)
        go = np.arange(len(i))
        while len(go):
            x = word[np.minimum(i[go] + got[go], n - 1)] ^ word[np.minimum(j[go] + got[go], n - 1)]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            got[go] = np.minimum(got[go] + same, most[go])
            go = go[(same == 8) & (got[go] < most[go])]
        h[:] = 0
        h[live] = got
        lcp[here] = got
    return lcp


def window_groups(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(context, start, group)`` of all windows of ``length`` bytes; windows of one group are equal."""
    size = np.array([len(c) + 1 for c in contexts], int)
    bounds = np.append(0, np.cumsum(size))
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    sa, rank = suffix_array(text, bounds)
    lcp = common_prefixes(text, bounds, sa, rank, length)
    group = np.empty(len(text), np.int64)
    group[sa] = np.cumsum(lcp < length)
    owner = np.repeat(np.arange(len(contexts)), size)
    at = np.flatnonzero(bounds[1:][owner] - 1 - np.arange(len(text)) >= length)
    return owner[at], at - bounds[owner[at]], group[at]


def _groups(texts: list[bytes]):
    """Runs of texts of about PIECE bytes; a longer text stands alone."""
    run, n = [], 0
    for i, t in enumerate(texts):
        if run and n + len(t) > PIECE:
            yield run
            run, n = [], 0
        run.append(i)
        n += len(t)
    if run:
        yield run


def _key(body: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(body)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _anchor_rows(length: int, k: int):
    def emit(batches):
        roller = Roller(PIECE)
        for b in batches:
            ids, texts = b.column("id").to_pylist(), text_bytes(b.column("text"))
            for run in _groups(texts):
                owner, pos, h, first, last = anchors([texts[i] for i in run], roller, length, k)
                keys = [_key(texts[i]) for i in run]
                own = [run[o] for o in owner]
                c = [xxhash.xxh3_64_intdigest(texts[i][s:e + length], p - s) for i, p, s, e in zip(own, pos.tolist(), first.tolist(), last.tolist())]
                t = np.array(keys, np.int64).reshape(-1, 2)[owner]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in own], pa.int64()), pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array(first.astype(np.int32)), pa.array((pos - first).astype(np.int32)),
                    pa.array(h.view(np.int64)), pa.array(np.array(c, np.uint64).view(np.int64)), pa.array((last - first + length).astype(np.int32))],
                    ["id", "t1", "t2", "first", "left", "a", "c", "span"])

    return emit


_ANCHORS = "id long, t1 long, t2 long, first int, left int, a long, c long, span int"


def _merge(starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of spans."""
    o = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[o], np.maximum.accumulate(np.asarray(ends)[o])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def _shards(length: int, k: int, run_windows: int):
    def search(batches):
        roller = Roller(PIECE, 21)
        for t in whole_groups(batches, ["shard"], 2 * SHARD_CONTEXTS):
            shard, a, c, n, left, parts = (t.column(x).to_numpy() for x in ("shard", "a", "c", "n", "left", "parts"))
            cuts = group_starts(shard)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                one = lo + group_starts(a[lo:hi], c[lo:hi])[:-1]  # equal rows bring a context twice
                body = t.column("body").take(pa.array(one)).to_pylist()
                owner, start, group = window_groups(body, length)
                size = np.bincount(group, minlength=1)
                copied = np.zeros(len(size), bool)
                copied[group[n[one][owner] > 1]] = True
                hit = (size[group] > 1) | copied[group]
                yield from _class_rows(a[one], c[one], owner[hit], start[hit], length)
                if parts[lo]:
                    yield from _runs(a[one], c[one], left[one], int(parts[lo]), body, owner, start, group, hit, roller, length)

    return search


_FOUND = "a long, c long, s int, e int, part int, cs binary, i binary, at binary, f binary, many binary"


def _class_rows(a, c, owner, start, length):
    """Merged repeated spans of each context."""
    if not len(owner):
        return
    wide = np.int64(1 << 32)
    s, e = _merge(owner * wide + start, owner * wide + start + length)
    yield _spans(a[s // wide], c[s // wide], s % wide, e % wide)


def _spans(a, c, s, e) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)),
                                       pa.nulls(len(a), pa.int32()), none, none, none, none, none], [x.split()[0] for x in _FOUND.split(", ")])


def _runs(a, c, left, parts, body, owner, start, group, hit, roller, length):
    """A slice's fingerprints in sorted runs, one per range; of equal windows inside the slice one stands for all."""
    _, stands = np.unique(np.where(hit, group, -1 - np.arange(len(group))), return_index=True)
    stands.sort()
    owner, start, hit = owner[stands], start[stands], hit[stands]
    f = np.empty(len(owner), np.uint64)
    cut = group_starts(owner)
    for x, y in zip(cut[:-1], cut[1:]):
        f[x:y] = roller.hashes(np.frombuffer(body[owner[x]], np.uint8), length)[start[x:y]]
    f ^= (left[owner] - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # equal windows have their anchor at equal offsets
    part = ((f >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    for p in np.unique(part):
        k = np.flatnonzero(part == p)
        k = k[np.argsort(f[k])]
        yield pa.RecordBatch.from_pydict({
            "a": [int(a[0])], "c": pa.nulls(1, pa.int64()), "s": pa.nulls(1, pa.int32()), "e": pa.nulls(1, pa.int32()), "part": pa.array([int(p)], pa.int32()), "cs": [c.tobytes()],
            "i": [owner[k].astype(np.int32).tobytes()], "at": [start[k].astype(np.int32).tobytes()], "f": [f[k].tobytes()], "many": [hit[k].tobytes()]})


def _merge_runs(length: int):
    """Of the runs of each range: windows that another run has, too, by binary search of the merged run."""

    def merge(batches):
        for t in whole_groups(batches, ["key"], 1):
            key, a = t.column("key").to_numpy(), t.column("a").to_numpy()
            cuts = group_starts(key)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                one = {(bytes(r["cs"]), bytes(r["f"])): r for r in t.slice(lo, hi - lo).to_pylist()}.values()
                f = [np.frombuffer(r["f"], np.uint64) for r in one]
                merged = np.sort(np.concatenate(f))
                for r, run in zip(one, f):
                    hit = np.searchsorted(merged, run, side="right") - np.searchsorted(merged, run, side="left") > 1
                    hit &= ~np.frombuffer(r["many"], bool)
                    c, owner, start = np.frombuffer(r["cs"], np.int64), np.frombuffer(r["i"], np.int32)[hit].astype(np.int64), np.frombuffer(r["at"], np.int32)[hit].astype(np.int64)
                    yield from _class_rows(np.full(len(c), a[lo]), c, owner, start, length)

    return merge


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_contexts: int = SHARD_CONTEXTS, hot_contexts: int = HOT_CONTEXTS, run_windows: int = RUN_WINDOWS) -> DataFrame:
    """``id, t1, t2, spans`` of ``docs(id, text)``: covered byte spans by id and text key, not yet merged."""
    occ = stage(docs.mapInArrow(_anchor_rows(length, anchor), _ANCHORS), "anchors")
    classes = stage(occ.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "t1", "t2", "first", "left")).alias("rep"), F.max("span").alias("span")), "classes")
    several = classes.groupBy("a").agg(F.count("*").alias("m")).where("m > 1")
    reps = stage(classes.join(several, "a").select("rep.*", "span", "a", "c", "n", "m"), "contexts")
    shards = max(1, -(-reps.count() // shard_contexts))
    wanted = reps.groupBy("id", "t1", "t2").agg(F.collect_list(F.struct("first", "span", "left", "a", "c", "n", "m")).alias("want"))
    keyed = docs.withColumn("k", _text_keys("text"))
    same = (F.col("id") == F.col("wid")) & (F.col("k.t1") == F.col("w1")) & (F.col("k.t2") == F.col("w2"))
    bodies = keyed.join(wanted.withColumnsRenamed({"t1": "w1", "t2": "w2", "id": "wid"}), same)
    bodies = bodies.select(F.explode(_contexts("text", "want")).alias("x")).select("x.*")
    hot = F.col("m") > hot_contexts
    shard = F.when(hot, F.xxhash64("a", F.pmod("c", F.ceil(F.col("m") / shard_contexts)))).otherwise(F.pmod(F.xxhash64("a"), F.lit(shards)))
    parts = F.when(hot, F.ceil(F.col("m") * (length - anchor) / (2 * run_windows)).cast("int")).otherwise(0)
    dealt = bodies.select(shard.alias("shard"), parts.alias("parts"), "a", "c", "n", "left", "body").repartition("shard").sortWithinPartitions("shard", "a", "c")
    found = stage(dealt.mapInArrow(_shards(length, anchor, run_windows), _FOUND), "found")
    single = found.where("part is null").select("a", "c", "s", "e")
    runs = found.where("part is not null").withColumn("key", F.xxhash64("a", "part")).repartition("key").sortWithinPartitions("key")
    across = runs.mapInArrow(_merge_runs(length), _FOUND).select("a", "c", "s", "e")
    whole = classes.where("n > 1").select("a", "c", F.lit(0).alias("s"), F.col("span").alias("e"))
    covered = single.unionByName(across).unionByName(whole).groupBy("a", "c").agg(F.collect_set(F.struct("s", "e")).alias("covered"))
    covered = stage(covered, "covered")  # a table of its own, so that the join can split a class with very many members
    at = occ.join(covered, ["a", "c"]).select("id", "t1", "t2", F.col("first").alias("from"), "covered")
    return at.groupBy("id", "t1", "t2").agg(F.collect_list(F.struct("from", "covered")).alias("spans"))


@arrow_column("array<struct<a: bigint, c: bigint, n: bigint, m: bigint, left: int, body: binary>>")
def _contexts(text: pa.Array, want: pa.Array) -> pa.Array:
    out = []
    for t, ws in zip(text_bytes(text), want.to_pylist()):
        out.append([{**w, "body": t[w["first"]:w["first"] + w["span"]]} for w in ws])
    return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("left", pa.int32()), ("body", pa.binary())])))


def _text_keys(text: str):
    @F.arrow_udf("struct<t1: bigint, t2: bigint>")
    def keys(column: pa.Array) -> pa.Array:
        k = np.array([_key(t) for t in text_bytes(column)], np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1])], ["t1", "t2"])

    return keys(text)


@arrow_column("struct<kept: binary, n_bytes: bigint, n_removed: bigint, n_spans: bigint, sha: string>")
def _cut_out(text: pa.Array, spans: pa.Array) -> pa.Array:
    kept, size, gone, runs, shas = [], [], [], [], []
    for body, each in zip(text_bytes(text), spans.to_pylist()):
        out, removed, n = body, 0, 0
        if each:
            flat = np.array([(x["from"] + y["s"], x["from"] + y["e"]) for x in each for y in x["covered"]], np.int64)
            s, e = _merge(flat[:, 0], flat[:, 1])
            removed, n = int((e - s).sum()), len(s)
            out = b"".join(body[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(body)]))
        kept.append(out)
        size.append(len(body))
        gone.append(removed)
        runs.append(n)
        shas.append(hashlib.sha256(out).hexdigest())
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas)],
                                      ["kept", "n_bytes", "n_removed", "n_spans", "sha"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
                   shard_contexts: int = SHARD_CONTEXTS, hot_contexts: int = HOT_CONTEXTS, run_windows: int = RUN_WINDOWS) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256`` per row.

    Every byte covered by a string of ``length`` bytes that also starts anywhere
    else, in the same text or another, is removed; ``kept`` (binary: a cut may
    split a character) is the rest. A null text is empty; texts shorter than
    ``length`` stay; copies lose all bytes. Each row is a text of its own,
    whatever its doc_id. Extra columns are ignored.
    """
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
                                      F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeated_spans(rows.select("id", "text"), length, anchor, shard_contexts, hot_contexts, run_windows)
    out = rows.withColumn("k", _text_keys("text")).join(spans.withColumnsRenamed({"t1": "w1", "t2": "w2", "id": "wid"}),
                                                        (F.col("id") == F.col("wid")) & (F.col("k.t1") == F.col("w1")) & (F.col("k.t2") == F.col("w2")), "left")
    out = out.withColumn("x", _cut_out(F.col("text"), F.col("spans")))
    return out.select("doc_id", F.col("x.kept").alias("kept"), F.col("x.n_bytes").alias("n_bytes"), F.col("x.n_removed").alias("n_removed"),
                      F.col("x.n_spans").alias("n_spans"), F.col("x.sha").alias("kept_sha256"))
