"""Word timelines inside one transcript row: array expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions.binding import let, part
from chronoweave.functions.text import norm_words, tokens

# Fixed values.
MAX_OVERLAP = 40
MIN_CUE_MS = 50
PHRASE_GAP_MS = 40
PHRASE_WORD_MS, PHRASE_MIN_MS = 140, 280
PAUSE_MS = 750
MAX_WORDS, MIN_WORDS = 34, 4
TERMINAL = r"[.!?][\"')\]]?$"


def dedupe_consecutive(lines: Column) -> Column:
    """Drop empties, then every line equal to the one kept before it (equal runs collapse)."""
    full = F.filter(lines, lambda x: F.trim(x) != "")
    return let(full, lambda f: F.filter(f, lambda x, i: (i == 0) | (x != F.get(f, i - 1))))


def rolling_overlap(cues: Column, clean) -> Column:
    """Per cue: how many leading words were already emitted, and the fresh words.

    State is the last 40 emitted normalised words; the longest prefix that is a
    suffix of it is dropped.
    """
    def prep(c):
        return let(tokens(clean(c["text"])), lambda raw: F.struct(c["cue_no"].alias("cue_no"), c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"),
                        raw.alias("raw"), norm_words(F.array_join(raw, " ")).alias("cand")))

    ready = F.filter(F.transform(cues, prep), lambda c: F.size(c["raw"]) > 0)

    def step(acc, c):
        tail, cand = acc["tail"], c["cand"]
        most = F.least(F.size(tail), F.size(cand), F.lit(MAX_OVERLAP))
        ks = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        head = F.get(cand, F.lit(0))
        fits = F.filter(ks, lambda k: (F.get(tail, F.size(tail) - k) == head) & (F.slice(tail, F.size(tail) - k + 1, k) == F.slice(cand, F.lit(1), k)))
        n = F.coalesce(F.array_max(fits), F.lit(0))
        fresh = F.slice(c["raw"], n + 1, F.greatest(F.size(c["raw"]) - n, F.lit(0)))
        row = F.struct(c["cue_no"].alias("cue_no"), c["start_ms"].alias("start_ms"),
                       F.greatest(c["end_ms"], c["start_ms"] + MIN_CUE_MS).alias("end_ms"), n.alias("overlap"), fresh.alias("fresh"))
        both = F.concat(tail, F.slice(cand, n + 1, F.greatest(F.size(cand) - n, F.lit(0))))
        kept = F.slice(both, F.greatest(F.size(both) - MAX_OVERLAP + 1, F.lit(1)), F.lit(MAX_OVERLAP))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), kept.alias("tail"))

    kind = "array<struct<cue_no:bigint,start_ms:bigint,end_ms:bigint,overlap:int,fresh:array<string>>>"
    init = F.struct(F.array().cast(kind).alias("out"), F.array().cast("array<string>").alias("tail"))
    return F.aggregate(ready, init, step, lambda a: F.filter(a["out"], lambda r: F.size(r["fresh"]) > 0))


def spread(cue: Column) -> Column:
    """Fresh words of a cue at even steps: (t, end_t, word) in milliseconds as double."""
    n = F.size(cue["fresh"])
    stepw = (cue["end_ms"] - cue["start_ms"]) / n
    return F.transform(cue["fresh"], lambda w, i: F.struct((cue["start_ms"] + stepw * i).alias("t_ms"),
                                                          (cue["start_ms"] + stepw * i + stepw).alias("end_ms"), w.alias("word")))


def expand_phrases(items: Column) -> Column:
    """Onset items (t_ms, word) whose text holds several tokens become one item per token."""
    return let(items, _expand)


def _expand(items: Column) -> Column:
    def one(it, i):
        return let(tokens(it["word"]), lambda toks: placed(it, i, toks))

    def placed(it, i, toks):
        n = F.size(toks)
        nxt = F.get(items, i + 1)["t_ms"]
        span = F.when(nxt > it["t_ms"] + PHRASE_GAP_MS, (nxt - it["t_ms"]).cast("double")).otherwise(
            F.greatest(n * F.lit(float(PHRASE_WORD_MS)), F.lit(float(PHRASE_MIN_MS))))
        return F.transform(toks, lambda w, k: F.struct(F.floor(it["t_ms"] + span / n * k + 0.5).alias("t_ms"), w.alias("word")))
    return F.flatten(F.transform(items, one))


def segment_sentences(words: Column) -> Column:
    """Sentence units over words (word_no, t_ms, end_ms, word).

    Flush on terminal punctuation, on a long pause, or at the word cap; a runt of
    fewer than four words joins the unit before it. The fold steps over the words that
    may close a unit, not over all, and carries the start of the open buffer and the
    stops so far.
    """
    return let(words, _segment)


def _segment(words: Column) -> Column:
    n = F.size(words)

    def closing(w, i):
        pause = F.get(words, i + 1)["t_ms"] - w["end_ms"] >= PAUSE_MS
        return F.when(w["word"].rlike(TERMINAL) | pause, i)

    none = F.array().cast("array<int>")

    def capped(acc, stop):
        """Cut full buffers off ``[start, stop)``; fewer words than the cap stay open."""
        k = F.floor((stop - acc["start"]) / MAX_WORDS).cast("int")
        cuts = F.transform(F.sequence(F.lit(1), k), lambda j: acc["start"] + j * MAX_WORDS)
        cut = F.struct(F.concat(acc["stops"], cuts).alias("stops"), (acc["start"] + k * MAX_WORDS).alias("start"))
        return F.when(stop - acc["start"] >= MAX_WORDS, cut).otherwise(acc)

    def step(acc, i):
        def close(open_):
            closed = F.struct(F.concat(open_["stops"], F.array(i + 1)).alias("stops"), (i + 1).alias("start"))
            return F.when(i + 1 - open_["start"] >= MIN_WORDS, closed).otherwise(open_)
        return F.when(i + 1 - acc["start"] >= MIN_WORDS, let(capped(acc, i + 1), close)).otherwise(acc)

    def rest(acc):
        """Close what is open at the end: a new unit, or an extension of the last one."""
        def close(open_):
            stops, size = open_["stops"], n - open_["start"]
            runt = (size < MIN_WORDS) & (F.size(stops) > 0)
            joined = F.concat(F.slice(stops, F.lit(1), F.greatest(F.size(stops) - 1, F.lit(0))), F.array(n))
            return F.when(size <= 0, stops).when(runt, joined).otherwise(F.concat(stops, F.array(n)))
        return let(capped(acc, n), close)

    init = F.struct(none.alias("stops"), F.lit(0).alias("start"))
    stops = F.aggregate(F.array_compact(F.transform(words, closing)), init, step, rest)
    units = let(stops, lambda ss: F.transform(ss, lambda b, i: F.struct(F.coalesce(F.get(ss, i - 1), F.lit(0)).alias("a"), b.alias("b"))))
    return F.transform(units, lambda u, i: F.struct(
        i.cast("int").alias("sent_no"), F.get(words, u["a"])["t_ms"].alias("start_ms"), F.get(words, u["b"] - 1)["end_ms"].alias("end_ms"),
        u["a"].alias("word_start"), u["b"].alias("word_end"),
        F.array_join(part(words, u["a"], u["b"] - u["a"], lambda w: w["word"]), " ").alias("text")))
