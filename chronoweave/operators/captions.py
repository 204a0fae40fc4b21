"""Caption grouping and word edits.

A clip is bounded by its maximal length, so per-clip arrays are bounded. Where words
leave their transcripts anyway, clips and scenes meet them in time bins. Where they do
not, clips, scenes and edits come to the transcript as one list per key (``beside``),
the transcript's compact row is exchanged once, and its words are made after that: no
word is ever exchanged, sorted or written.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.binding import let, part, same_words
from chronoweave.functions.text import WHITESPACE, norm_word, squeeze, strip_fillers, tokens
from chronoweave.operators import joins
from chronoweave.operators.mining import leading

# Fixed values (milliseconds).
DEFAULT_GROUP = 3
OUT_PAD_MS = 40
MIN_HOLD_MS, MAX_HOLD_MS = 360, 1150
EDGE_MS = 50
PEAK_TAIL_MS = 2500
MIN_KARAOKE_MS = 20
SNAP_MS = 120
CUSTOM_MS = 1500
BIN_MS = 30_000.0
WORD = ("t_ms", "word_no", "word", "next_ms")


def beside(docs: DataFrame, items: DataFrame, key: str, name: str, fields: list[str], how: str = "inner") -> DataFrame:
    """``docs``, one row a key, with the ``items`` of each key beside them: an array of ``fields``, sorted by them in turn."""
    lists = items.repartition(key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return docs.join(lists, key, how)


def row_words(items: Column) -> Column:
    """Words (t_ms, word_no, word, next_ms), in order of time, as one array a field: what the operators in a row read."""
    return F.struct(*[F.transform(items, lambda w: w[c]).alias(c) for c in WORD])  # noqa: B023


def words_in_window(clips: DataFrame, words: DataFrame, key: str, lo: int = EDGE_MS, keep_bin: bool = False) -> DataFrame:
    """Words with ``start - 50 ms <= t <= end`` of each clip."""
    return joins.points_in_spans(words, clips, [key], "t_ms", F.col("c_start") - lo, F.col("c_end"), BIN_MS, keep_bin=keep_bin)


def windows_beside(docs: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """``docs``, one row a key, with an array ``clips`` for ``windows_in_row``; clips alike in every column are one with ``copies``."""
    cols = ["clip_id", "c_start", "c_end", "duration"]
    c = clips.filter("c_start IS NOT NULL AND c_end IS NOT NULL").repartition(key).groupBy(key, *cols).agg(F.count("*").cast("int").alias("copies"))
    return beside(docs, c, key, "clips", [*cols, "copies"])


def windows_in_row(words: Column, clips: Column, stretches: Column | None = None, fields: tuple[str, ...] = WORD) -> Column:
    """``words_in_window`` in a row: per clip that has words (clip_id, c_start, duration), arrays of its words' ``fields``, and of its groups.

    A clip that comes several times has each of its words as often. With ``stretches``
    (``scenes_in_row``) come the groups of ``group_captions``: places where they start, and scenes.
    """
    def seen(c):
        return F.struct(leading(words["t_ms"], lambda t: t < c["c_start"] - EDGE_MS).alias("a"), leading(words["t_ms"], lambda t: t <= c["c_end"]).alias("b"))

    def one(c):
        def caught(v):
            places = F.sequence(v["a"], v["b"] - 1)
            repeated = F.flatten(F.transform(places, lambda i: F.array_repeat(i, c["copies"])))
            cut = {} if stretches is None else _group_starts(stretches, v["a"], v["b"], c["copies"])
            def parts(ps):
                return F.struct(c["clip_id"], c["c_start"], c["duration"], *[F.transform(ps, lambda i: F.get(words[f], i)).alias(f) for f in fields], *[x.alias(n) for n, x in cut.items()])  # noqa: B023
            return F.when(v["b"] > v["a"], let(F.when(c["copies"] == 1, places).otherwise(repeated), parts))
        return let(seen(c), caught)

    return F.filter(F.transform(clips, one), lambda x: x.isNotNull())


def lines_in_window(clips: DataFrame, cues: DataFrame, key: str) -> DataFrame:
    """Cues that overlap a clip, in clip time floored at zero."""
    hit = joins.overlaps(clips, cues, [key], "c_start", "c_end", "start_ms", "end_ms", BIN_MS)
    return hit.withColumn("t_ms", F.greatest(F.lit(0), F.col("start_ms") - F.col("c_start")))


def scene_at(words: DataFrame, scenes: DataFrame, key: str, word_id: list[str], t: str = "t_ms") -> DataFrame:
    """First scene (by ``scene_no``) that contains each word's onset."""
    hit = joins.points_in_spans(words.select(key, *word_id, t), scenes, [key], t, F.col("s_start"), F.col("s_end") - 1, BIN_MS)
    first = hit.groupBy(key, *word_id).agg(F.min_by(F.struct("scene_no", "size"), "scene_no").alias("scene"))
    return words.join(first, [key, *word_id], "left")


def scene_in_bin(words: DataFrame, scenes: DataFrame, key: str, t: str = "t_ms") -> DataFrame:
    """As ``scene_at``, for words that still carry their bin (``words_in_window`` with ``keep_bin``).

    A bin's scenes come as one list, so every word stays one row, where it is: the words
    are neither grouped nor joined to themselves, and only the scenes are shuffled.
    """
    s = scenes.select(F.col(key).alias("__key"), "scene_no", "size", "s_start", (F.col("s_end") - 1).alias("s_last"))
    s = s.withColumn("__sbin", F.explode(joins.bins(F.col("s_start"), F.col("s_last"), BIN_MS)))
    s = s.groupBy("__sbin", "__key").agg(F.collect_set(F.struct("scene_no", "size", "s_start", "s_last")).alias("__scenes"))
    inside = F.filter("__scenes", lambda v: (F.col(t) >= v["s_start"]) & (F.col(t) <= v["s_last"]))
    x = words.join(s, (F.col(joins.BIN) == F.col("__sbin")) & (F.col(key) == F.col("__key")), "left")
    x = x.withColumn("scene", F.array_min(F.transform(inside, lambda v: F.struct(v["scene_no"], v["size"]))))
    return x.drop(joins.BIN, "__sbin", "__key", "__scenes")


def scenes_beside(docs: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """``docs``, one row a key, with an array ``scenes`` for ``scenes_in_row``, in order of start; ``reach`` is the latest end so far."""
    s = scenes.select(key, "scene_no", "size", "s_start", (F.col("s_end") - 1).alias("s_last")).filter("s_start <= s_last").repartition(key)
    so_far = Window.partitionBy(key).orderBy("s_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one transcript
    s = s.withColumn("reach", F.max("s_last").over(so_far))
    return beside(docs, s, key, "scenes", ["s_start", "reach", "s_last", "scene_no", "size"], "left")


def scenes_in_row(words: Column, scenes: Column) -> Column:
    """``scene_at`` in a row (``row_words``): stretches (ix, scene_no, size) of words in one scene or in none.

    The first scene (by ``scene_no``) changes only where a scene starts or has ended, so it
    is looked for there and not at each word: among the scenes that may still run, if any
    two overlap.
    """
    kind = "array<struct<ix:int,scene_no:bigint,size:int>>"
    place = lambda c: leading(words["t_ms"], lambda t: t < c)
    stretch = lambda ix, no, size: F.struct(ix.alias("ix"), no.cast("long").alias("scene_no"), size.cast("int").alias("size"))
    none = lambda ix: stretch(ix, F.lit(None), F.lit(None))

    def apart(v):
        return F.flatten(F.transform(v, lambda x: F.array(stretch(place(x["s_start"]), x["scene_no"], x["size"]), none(place(x["s_last"] + 1)))))

    def overlapping(v):
        def first(c):
            """Of the scenes that start by ``c``, those before the first whose reach gets there have ended."""
            def among(h):
                run = F.filter(part(v, h["j"], h["k"] - h["j"], lambda x: x), lambda x: x["s_last"] >= c)
                return F.when(h["k"] > h["j"], F.array_min(F.transform(run, lambda x: F.struct(x["scene_no"], x["size"]))))
            held = F.struct(leading(v, lambda x: x["reach"] < c).alias("j"), leading(v, lambda x: x["s_start"] <= c).alias("k"))
            return let(let(held, among), lambda s: stretch(place(c), s["scene_no"], s["size"]))
        cuts = F.sort_array(F.concat(F.transform(v, lambda x: x["s_start"]), F.transform(v, lambda x: x["s_last"] + 1)))
        return F.transform(F.array_distinct(cuts), first)

    def found(v):
        clash = F.exists(F.transform(v, lambda x, i: x["s_start"] <= F.get(v, i - 1)["reach"]), lambda x: x)
        return F.concat(F.array(none(F.lit(0))), F.coalesce(F.when(clash, overlapping(v)).otherwise(apart(v)), F.array().cast(kind)))

    held = let(let(scenes, found), lambda st: F.filter(st, lambda s, i: s["ix"] < F.coalesce(F.get(st, i + 1)["ix"], F.size(words["t_ms"]))))
    return let(held, lambda st: F.filter(st, lambda s, i: (i == 0) | ~s["scene_no"].eqNullSafe(F.get(st, i - 1)["scene_no"])))


def scenes_of_words(words: Column, stretches: Column, repeated: Column) -> Column:
    """Scene number of each word of a row, null outside scenes.

    Where a key is ``repeated``, words of one number share the first scene any of them lies in.
    """
    end = lambda i: F.coalesce(F.get(stretches, i + 1)["ix"], F.size(words["word_no"]))
    each = F.flatten(F.transform(stretches, lambda s, i: F.array_repeat(s["scene_no"], end(i) - s["ix"])))

    def shared(found):
        hits = F.filter(F.transform(found, lambda s, i: F.struct(F.get(words["word_no"], i).alias("word_no"), s.alias("scene_no"))), lambda h: h["scene_no"].isNotNull())
        at = lambda hs, no: F.get(hs, leading(hs, lambda h: h["word_no"] < no))
        return let(F.sort_array(hits), lambda hs: F.transform(words["word_no"], lambda no: let(at(hs, no), lambda h: F.when(h["word_no"] == no, h["scene_no"]))))

    return F.when(repeated, let(each, shared)).otherwise(each)


def caption_end(start: Column, nxt: Column, duration: Column) -> Column:
    cap = F.greatest(start + 40, duration - OUT_PAD_MS)
    natural = F.when(nxt.isNotNull(), F.least(nxt, start + MAX_HOLD_MS)).otherwise(start + MIN_HOLD_MS)
    return F.least(cap, natural)


def _group_starts(stretches: Column, a: Column, b: Column, copies: Column, size: int = DEFAULT_GROUP) -> dict[str, Column]:
    """Groups of fixed size that never cross a scene change, for words ``a`` to ``b`` of a row that come ``copies`` times each."""
    span = F.struct((leading(stretches, lambda s: s["ix"] <= a) - 1).alias("i"), leading(stretches, lambda s: s["ix"] < b).alias("j"))

    def run(s, nxt):
        lo, hi = F.when(s["ix"] > a, s["ix"] - a).otherwise(0), F.when(nxt["ix"] < b, nxt["ix"]).otherwise(b) - a
        return F.sequence(lo * copies, hi * copies - 1, F.coalesce(s["size"], F.lit(size)))

    def runs(v):
        starts = F.transform(F.sequence(v["i"], v["j"] - 1), lambda k: run(F.get(stretches, k), F.get(stretches, k + 1)))
        scene = lambda x, r: F.array_repeat(F.coalesce(F.get(stretches, v["i"] + r)["scene_no"], F.lit(-1)), F.size(x))
        return let(starts, lambda xs: F.struct(F.flatten(xs).alias("starts"), F.flatten(F.transform(xs, scene)).alias("scene_nos")))

    return {"groups": let(span, runs)}


def group_captions(windows: DataFrame, keep: list[str]) -> DataFrame:
    """Fixed-size word groups that never cross a scene change, with their hold time; one row a group, ``keep`` of the clip's columns.

    ``windows`` has a row a clip as ``windows_in_row`` gives it with scenes. ``a`` to ``b``
    are the places of the group's words in the clip, the last included; ``scene_no`` is -1
    outside scenes.
    """
    own = ["c_start", "duration", "t_ms", "next_ms", "word_no", "groups"]
    g = windows.select(*dict.fromkeys([*keep, *own]), F.posexplode("groups.starts").alias("__pos", "a"))
    g = g.withColumn("b", F.coalesce(F.get("groups.starts", F.col("__pos") + 1), F.size("t_ms")) - 1)
    start = F.greatest(F.lit(0), F.get("t_ms", F.col("a")) - F.col("c_start"))
    g = g.withColumn("start_ms", start).withColumn("end_ms", caption_end(start, F.get("next_ms", F.col("b")) - F.col("c_start"), F.col("duration")))
    g = g.filter("end_ms > start_ms")
    return g.select(*keep, "a", "b", "start_ms", "end_ms", F.get("word_no", F.col("a")).alias("word_no"), F.get("groups.scene_nos", F.col("__pos")).alias("scene_no"))


def peak_window(times: Column, words: Column, start: Column, duration: Column, peak_ms: Column, phrase: Column) -> Column:
    """Window of the peak in the words of a clip that begins at ``start``: by time, else by its first four words."""
    n = F.size(times)

    def by_time(t):
        return let(leading(times, lambda x: x < t), lambda i: F.when(i < n, i))

    def by_text(probe):
        spots = F.sequence(F.lit(0), F.greatest(n - F.size(probe), F.lit(0)))
        first = lambda ns: F.array_min(F.filter(spots, lambda i: same_words(ns, i, probe)))
        return F.when(F.size(probe) > 0, let(F.transform(words, norm_word), first))

    at = F.coalesce(F.when(peak_ms.isNotNull(), let(start + peak_ms - EDGE_MS, by_time)), let(F.slice(phrase, 1, 4), by_text))

    def window(i):
        rel = lambda k: F.get(times, k) - start
        return F.when(i.isNotNull(), let(F.greatest(F.lit(0), rel(i)), lambda s: F.struct(
            s.alias("start_ms"), F.least(duration, F.coalesce(rel(i + F.greatest(F.lit(1), F.size(phrase))), s + PEAK_TAIL_MS)).alias("end_ms"))))

    return let(let(at, window), lambda w: F.when(w["end_ms"] > w["start_ms"], w))


def karaoke_spans(groups: DataFrame) -> DataFrame:
    """One span per word of a group of two or more, at least 20 ms long; ``groups`` as of ``group_captions``, with the clip's ``c_start, t_ms, word``."""
    x = groups.filter("b > a").withColumn("__i", F.explode(F.sequence("a", "b")))
    rel = lambda i: F.get("t_ms", i) - F.col("c_start")
    begin = F.greatest("start_ms", rel(F.col("__i")))
    x = x.select(*[c for c in groups.columns if c not in ("start_ms", "end_ms", "word")], (F.col("__i") - F.col("a")).cast("long").alias("pos"), F.get("word", F.col("__i")).alias("word"),
                 begin.alias("start_ms"), F.when(F.col("__i") < F.col("b"), F.greatest(begin, rel(F.col("__i") + 1))).otherwise(F.col("end_ms")).alias("end_ms"))
    return x.filter(F.col("end_ms") - F.col("start_ms") >= MIN_KARAOKE_MS)


def edits_beside(docs: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``docs``, one row a key, with an array ``edits`` for ``apply_overrides``, in order of time."""
    return beside(docs, edits.filter("t_ms IS NOT NULL"), key, "edits", ["t_ms", "word", "hidden"], "left")


def _live(words: Column, edits: Column) -> Column:
    """Words that stay, as arrays (t_ms, nx, word, e_word); words and edits are met once per edited onset."""
    ts, n = words["t_ms"], F.size(words["t_ms"])
    ints = F.array().cast("array<int>")
    upto = lambda lo, hi: F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(ints)

    def met(i, j):
        """Edits ``i`` to ``j`` of one onset: the places ``a`` to ``b`` of its words, and which edits do not hide them."""
        t = F.get(edits, i)["t_ms"]
        to = lambda a: F.when(F.get(ts, a) == t, F.when(F.get(ts, a + 1) == t, leading(ts, lambda x: x <= t)).otherwise(a + 1)).otherwise(a)
        kept = F.filter(F.sequence(i, j - 1), lambda k: ~F.coalesce(F.get(edits, k)["hidden"], F.lit(False)))
        return let(leading(ts, lambda x: x < t), lambda a: F.struct(a.alias("a"), to(a).alias("b"), kept.alias("kept")))

    def merged(ms):
        after = lambda m, r: upto(m["b"], F.coalesce(F.get(ms, r + 1)["a"], n))
        edited = lambda m: F.flatten(F.transform(upto(m["a"], m["b"]), lambda k: F.array_repeat(k, F.size(m["kept"]))))
        head = upto(F.lit(0), F.get(ms, F.lit(0))["a"])
        places = F.flatten(F.transform(ms, lambda m, r: F.flatten(F.array(edited(m), after(m, r)))))
        refs = F.flatten(F.transform(ms, lambda m, r: F.flatten(F.array(F.flatten(F.array_repeat(m["kept"], m["b"] - m["a"])), F.array_repeat(F.lit(-1), F.coalesce(F.get(ms, r + 1)["a"], n) - m["b"])))))
        return F.struct(F.concat(head, places).alias("at"), F.concat(F.array_repeat(F.lit(-1), F.size(head)), refs).alias("ref"))

    def said(v):
        t = F.transform(v["at"], lambda i: F.get(ts, i))
        texts = F.transform(v["ref"], lambda r: F.when(r >= 0, F.get(edits, r)["word"]))
        return let(t, lambda x: F.struct(x.alias("t_ms"), F.slice(x, 2, F.greatest(F.size(x), F.lit(1))).alias("nx"), F.transform(v["at"], lambda i: F.get(words["word"], i)).alias("word"), texts.alias("e_word")))

    firsts = F.filter(F.sequence(F.lit(0), F.size(edits) - 1), lambda i: (i == 0) | (F.get(edits, i)["t_ms"] != F.get(edits, i - 1)["t_ms"]))
    each = lambda fs: F.transform(fs, lambda i, r: met(i, F.coalesce(F.get(fs, r + 1), F.size(edits))))
    all_of_them = F.struct(upto(F.lit(0), n).alias("at"), F.array_repeat(F.lit(-1), n).alias("ref"))
    return let(F.when(F.size(edits) > 0, let(let(firsts, each), merged)).otherwise(all_of_them), said)


def apply_overrides(words: DataFrame, key: str) -> DataFrame:
    """Word edits on the millisecond key: hidden words go, text replaces, phrases expand again.

    ``words`` has a row a key: ``words`` (``row_words``) and the array ``edits``, both in order of time, ``edits`` null if there are none.
    """
    x = words.select(key, let(F.col("words"), lambda ws: let(F.col("edits"), lambda es: _live(ws, es))).alias("x")).select(key, "x.*")
    x = x.select(key, F.explode(F.arrays_zip("t_ms", "nx", "word", "e_word")).alias("w")).select(key, "w.*")
    word = F.coalesce(F.nullif(F.trim("e_word"), F.lit("")), F.col("word"))
    x = x.select(key, "t_ms", "nx", word.alias("word"))
    spaced = F.col("word").rlike(WHITESPACE) | (F.col("word") == "")
    x = x.withColumn("toks", F.when(spaced, tokens(F.col("word"))).otherwise(F.array("word")))
    n = F.size("toks")
    span = F.when(F.col("nx") > F.col("t_ms") + 40, (F.col("nx") - F.col("t_ms")).cast("double")).otherwise(F.greatest(n * 140.0, F.lit(280.0)))
    x = x.withColumn("step", span / F.nullif(n, F.lit(0))).select(key, "t_ms", "step", F.posexplode("toks").alias("k", "word"))
    return x.select(key, F.floor(F.col("t_ms") + F.col("step") * F.col("k") + 0.5).alias("t_ms"), "word")


def merge_patches(patches: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Later patch wins per field; a field a patch does not carry keeps its earlier value."""
    return patches.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def assign_tokens(targets: Column, toks: Column) -> Column:
    """Edited tokens onto onsets: spare onsets are hidden, spare tokens ride on the last onset."""
    def one(t, i):
        rest = F.array_join(F.slice(toks, i + 1, F.greatest(F.size(toks) - i, F.lit(1))), " ")
        word = F.when(i >= F.size(toks), None).when((i == F.size(targets) - 1) & (F.size(toks) > F.size(targets)), rest).otherwise(F.get(toks, i))
        return F.struct(t["t_ms"].alias("t_ms"), word.alias("word"), (i >= F.size(toks)).alias("hidden"))
    return F.transform(targets, one)


def edit_targets(words: Column, start: Column, end: Column, n: Column) -> Column:
    """Onsets a group edit covers: those in its range, else as many as it has tokens from its start."""
    spanned = F.filter(words, lambda w: (w["t_ms"] >= start - 20) & (w["t_ms"] < end - 1))
    at = F.array_position(F.transform(words, lambda w: w["t_ms"] >= start - EDGE_MS), True).cast("int")
    from_start = F.when(at > 0, F.slice(words, F.greatest(at, F.lit(1)), n))
    return F.when(at <= 0, None).when(end.isNotNull() & (F.size(spanned) > 0), spanned).otherwise(from_start)


_KEY = re.compile(r"[^a-z0-9']")


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.where(b == x, row[:-1] + 1, row[1:]))
    return row


def _gap(a: np.ndarray, i: int, i_end: int, b: np.ndarray, j: int, j_end: int, out: list[tuple[int, int]]) -> None:
    """Appends the pairs of a longest common subsequence of two stretches, halving the first: memory is linear."""
    while i < i_end and j < j_end and a[i] == b[j]:
        out.append((i, j))
        i, j = i + 1, j + 1
    tail = 0
    while i < i_end - tail and j < j_end - tail and a[i_end - tail - 1] == b[j_end - tail - 1]:
        tail += 1
    i_to, j_to = i_end - tail, j_end - tail
    if i_to - i == 1:
        at = np.flatnonzero(b[j:j_to] == a[i])
        out += [(i, j + int(at[0]))] if len(at) else []
    elif i < i_to and j < j_to:
        mid = (i + i_to) // 2
        cut = j + int(np.argmax(_lengths(a[i:mid], b[j:j_to]) + _lengths(a[mid:i_to][::-1], b[j:j_to][::-1])[::-1]))
        _gap(a, i, mid, b, j, cut, out)
        _gap(a, mid, i_to, b, cut, j_to, out)
    out += [(i_to + k, j_to + k) for k in range(tail)]


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Rising pairs of equal words: first the words that each side has once, in their longest rising run, then the gaps between them."""
    once_a, once_b = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if once_b[w] == 1}
    single = [(i, place[w]) for i, w in enumerate(a) if once_a[w] == 1 and w in place]
    tails, ends, before = [], [], []
    for n, (_, j) in enumerate(single):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at:at + 1], ends[at:at + 1] = [j], [n]
    rising, n = [], ends[-1] if ends else -1
    while n >= 0:
        rising.append(single[n])
        n = before[n]
    code = {w: k for k, w in enumerate({*a, *b})}
    a, b = (np.array([code[w] for w in x], np.int32) for x in (a, b))
    out, i0, j0 = [], 0, 0
    for i, j in [*reversed(rising), (len(a), len(b))]:
        _gap(a, i0, i, b, j0, j, out)
        out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out[:-1]


def _align(old: list[str], new: list[str]) -> list[tuple[int, str | None, bool]]:
    """Edits (old index, replacement, hidden): a word without a match is hidden, new words ride on the match before them or on the first word."""
    fold = lambda w: _KEY.sub("", w.lower()) or w.lower()
    pairs = _matched([fold(w) for w in old], [fold(w) for w in new])
    carried: dict[int, list[str]] = {0: new[:pairs[0][1] if pairs else len(new)]}
    for (i, j), (_, nxt) in zip(pairs, [*pairs[1:], (0, len(new))]):
        carried[i] = carried.get(i, []) + new[j:nxt]
    edits = ((i, carried.get(i, [])) for i in range(len(old)))
    return [(i, " ".join(v) or None, not v) for i, v in edits if v != [old[i]]]


def align_transcripts(pairs: DataFrame, key: str) -> DataFrame:
    """Edited text aligned to timed words, one pair per row; Arrow batches, pairs spread over partitions.

    ``pairs`` has the key, ``old`` (array of words), ``t_ms`` (array) and ``new`` (array of words).
    """
    def run(batches):
        for pdf in batches:
            out = [(r[key], int(r["t_ms"][k]), w, h) for r in pdf.to_dict("records") if len(r["old"])
                   for k, w, h in _align(list(r["old"]), list(r["new"]))]
            yield pd.DataFrame(out, columns=[key, "t_ms", "word", "hidden"])
    return pairs.mapInPandas(run, f"{key} long, t_ms long, word string, hidden boolean")


def snap_cues(items: DataFrame, cues: DataFrame, key: str, item_id: str) -> DataFrame:
    """Cleaned cue edits snapped to the nearest cue under 120 ms away; unchanged rows are not written."""
    grid = cues.select(key, F.col("start_ms").alias("g"), "end_ms", "text")
    hit = joins.asof(items, grid, [key], "at_ms", "g", ["end_ms", "text"], 3_600_000, before="b", after="a", left_id=item_id)
    db, da = F.col("at_ms") - F.col("b.t"), F.col("a.t") - F.col("at_ms")
    cue = F.when(db <= F.coalesce(da, F.lit(1 << 40)), F.col("b")).otherwise(F.col("a"))
    x = hit.withColumn("cue", cue).filter(F.least(db, da) < SNAP_MS)
    cleaned = F.coalesce(F.nullif(strip_fillers(F.substring(squeeze(F.col("new_text")), 1, 160)), F.lit("")), strip_fillers(F.col("cue.text")))
    cleaned = F.when(F.col("hide"), "").otherwise(cleaned)
    x = x.select(key, F.col("cue.t").alias("start_ms"), cleaned.alias("text"), F.col("cue.text").alias("__old"))
    return x.withColumn("hidden", F.col("text") == "").filter(F.col("hidden") | (F.col("text") != F.col("__old"))).drop("__old")


def window_patch_merge(stored: DataFrame, fresh: DataFrame, keys: list[str], t: str, lo: int, hi: int, fields: list[str]) -> DataFrame:
    """Stored patches inside the window are replaced by the fresh ones; the later one wins per millisecond."""
    kept = stored.filter((F.col(t) < lo - EDGE_MS) | (F.col(t) > hi + EDGE_MS)).withColumn("__src", F.lit(0))
    both = kept.unionByName(fresh.withColumn("__src", F.lit(1)))
    return both.groupBy(*keys, t).agg(F.max_by(F.struct(*fields), F.struct("__src", *fields)).alias("__p")).select(*keys, t, "__p.*")


def custom_cues(cues: DataFrame, start: Column, end: Column, lo: int, duration: int) -> DataFrame:
    """User cues clipped to the clip window."""
    stop = F.coalesce(end, start + CUSTOM_MS)
    x = cues.filter((stop > lo) & (start < lo + duration))
    x = x.withColumn("local_start", F.greatest(F.lit(0), start - lo)).withColumn("local_end", F.least(F.lit(duration - OUT_PAD_MS), stop - lo))
    return x.filter("local_end > local_start")


def validate_overrides(edits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last edit per identity (id for custom ones, millisecond otherwise) with its rejection reason."""
    ident = F.when(F.col("custom"), F.concat(F.lit("custom:"), F.coalesce("id", F.lit("?")))).otherwise(F.concat(F.lit("generated:"), F.col("start_ms").cast("string")))
    last = edits.withColumn("ident", ident).groupBy(*keys, "ident").agg(F.max_by(F.struct("start_ms", "end_ms", "custom", "id", order), order).alias("e"))
    why = (F.when(F.col("e.custom") & F.col("e.id").isNull(), "needs_id")
           .when(F.col("e.end_ms").isNotNull() & (F.col("e.end_ms") <= F.col("e.start_ms")), "ends_before_start")
           .when((F.col("e.start_ms") < 0) | (F.col("e.start_ms") > 24 * 3600 * 1000), "out_of_range"))
    return last.select(*keys, "ident", "e.start_ms", "e.end_ms", why.alias("rejected"))
