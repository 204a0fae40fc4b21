"""Chunking, candidate resolution and ranking over one transcript row.

The whole path from cues to ranked candidates stays inside the row, so a corpus
run is one map-only stage: nothing is shuffled and a transcript cannot be split
over tasks or collected anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.binding import let, part, rows, same_words
from chronoweave.functions.numeric import clamp, finite_or, half_up
from chronoweave.functions.profiles import DEFAULT_PROFILE, PROFILES
from chronoweave.functions.text import fluency_factor, norm_tokens

# Fixed values (times in milliseconds).
CHUNK_MS, OVERLAP_MS = 720_000, 120_000
STRIDE_MS = CHUNK_MS - OVERLAP_MS
MIN_CHUNK_SENTENCES = 8
LEAD_IN_MS = 250
DEDUPE_OVERLAP = 0.45
MIN_PEAK_POSITION = 0.2
MIN_TOTAL_SCORE = 3.5
BOARD_SIZE = 12
FUZZY_SHARE = 0.75
SEED_SLOTS = 65_536


def overlap_chunks(sents: Column) -> Column:
    """Overlapping windows of sentences: array of (chunk_no, sents), windows with too few sentences dropped."""
    def build(s):
        total = F.element_at(s, -1)["end_ms"]
        ks = F.filter(F.sequence(F.lit(0), F.floor(F.greatest(total - 1, F.lit(0)) / STRIDE_MS).cast("int")),
                      lambda k: (k == 0) | (k * STRIDE_MS + OVERLAP_MS < total))
        chunk = lambda k: F.struct(k.alias("chunk_no"), F.filter(s, lambda x: (x["start_ms"] >= k * STRIDE_MS) & (x["start_ms"] < k * STRIDE_MS + CHUNK_MS)).alias("sents"))
        return F.filter(F.transform(ks, chunk), lambda c: F.size(c["sents"]) >= MIN_CHUNK_SENTENCES)
    return let(F.filter(sents, lambda x: x["sent_no"].isNotNull()), lambda s: F.when(F.size(s) > 0, build(s)))


def chunk_lines(sents: Column) -> Column:
    """One line per sentence: ``#id [start] text``."""
    return F.array_join(F.transform(sents, lambda s: F.concat(F.lit("#"), s["sent_no"].cast("string"), F.lit(" ["),
                                                             F.format_string("%.1f", s["start_ms"] / 1000.0), F.lit("] "), s["text"])), "\n")


def leading(items: Column, test: Callable[[Column], Column]) -> Column:
    """How many of the first items pass a test that no item passes after the first that fails; reads the logarithm of their number.

    The test is not true of null, which stands beyond the last item.
    """
    bits = F.length(F.bin(F.size(items)))
    powers = F.slice(F.lit([1 << b for b in range(30, -1, -1)]), 32 - bits, bits)
    return F.aggregate(powers, F.lit(0), lambda k, b: F.when(test(F.get(items, k + b - 1)), k + b).otherwise(k))


def snap_start(t: Column, starts: Column) -> Column:
    """Last of the ascending boundaries at or before ``t`` (else the first one), a little earlier, never below zero."""
    best = F.coalesce(F.get(starts, leading(starts, lambda s: s <= t + 1) - 1), F.get(starts, F.lit(0)), t)
    return F.greatest(F.lit(0), best - LEAD_IN_MS)


def snap_end(t: Column, ends: Column) -> Column:
    """First of the ascending boundaries at or after ``t``, else the last one."""
    return F.coalesce(F.get(ends, leading(ends, lambda e: e < t - 1)), F.get(ends, F.size(ends) - 1), t)


def _steps(n: Column) -> Column:
    """Loop counter of ``n`` steps, at least one (a step that has nothing to do changes nothing)."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), n))


def fit_span(sents: Column, start_id: Column, end_id: Column, peak_id: Column, lo_ms: int, hi_ms: int) -> Column:
    """Grow (forward first) to the band's minimum, then trim (front first, around the peak) to its maximum.

    Sentences are in order of time, starts and ends alike.
    """
    at = lambda i: F.get(sents, i)
    n = F.size(sents)
    init = F.struct(F.least(start_id, end_id).alias("lo"), F.greatest(start_id, end_id).alias("hi"))

    def grow(a, _):
        length = at(a["hi"])["end_ms"] - at(a["lo"])["start_ms"]
        fwd = (a["hi"] + 1 < n) & (at(a["hi"] + 1)["end_ms"] - at(a["lo"])["start_ms"] <= hi_ms)
        back = (a["lo"] > 0) & (at(a["hi"])["end_ms"] - at(a["lo"] - 1)["start_ms"] <= hi_ms)
        short = length < lo_ms
        return F.struct(F.when(short & ~F.coalesce(fwd, F.lit(False)) & back, a["lo"] - 1).otherwise(a["lo"]).alias("lo"),
                        F.when(short & F.coalesce(fwd, F.lit(False)), a["hi"] + 1).otherwise(a["hi"]).alias("hi"))

    def trim(a, _):
        long = at(a["hi"])["end_ms"] - at(a["lo"])["start_ms"] > hi_ms
        peak = F.coalesce(peak_id, a["lo"])
        front = (a["lo"] < peak) & (a["lo"] < a["hi"])
        rear = (a["hi"] > peak) & (a["hi"] > a["lo"])
        return F.struct(F.when(long & front, a["lo"] + 1).otherwise(a["lo"]).alias("lo"),
                        F.when(long & ~front & rear, a["hi"] - 1).otherwise(a["hi"]).alias("hi"))

    def reach(a):
        # sentences that still fit the band on either side: no more steps than these can be taken
        after = leading(sents, lambda x: x["end_ms"] - at(a["lo"])["start_ms"] <= hi_ms) - a["hi"] - 1
        before = a["lo"] - leading(sents, lambda x: at(a["hi"])["end_ms"] - x["start_ms"] > hi_ms)
        return F.greatest(after, F.lit(0)) + F.greatest(before, F.lit(0))

    length = lambda a: at(a["hi"])["end_ms"] - at(a["lo"])["start_ms"]
    # one step is taken before the reach is looked for: it is enough for most spans
    more = lambda a: F.when(length(a) >= lo_ms, a).otherwise(F.aggregate(_steps(reach(a)), a, grow))
    grown = let(init, lambda a: F.when(length(a) >= lo_ms, a).otherwise(let(grow(a, None), more)))
    return let(grown, lambda a: F.when(length(a) <= hi_ms, a).otherwise(F.aggregate(_steps(a["hi"] - a["lo"]), a, trim)))


def lead_up(sents: Column, span: Column, peak_ms: Column, hi_ms: int) -> Column:
    """Extend a span backwards until the peak sits at least a fifth into it; array index of the new start."""
    at = lambda i: F.get(sents, i)
    end = at(span["hi"])["end_ms"]

    def early(lo):
        start = at(lo)["start_ms"]
        return (peak_ms - start) / (end - start) < MIN_PEAK_POSITION

    def back(lo, _):
        room = (lo > 0) & (end - at(lo - 1)["start_ms"] <= hi_ms)
        return F.when(early(lo) & room, lo - 1).otherwise(lo)

    room = span["lo"] - leading(sents, lambda x: end - x["start_ms"] > hi_ms)
    return F.when(early(span["lo"]), F.aggregate(_steps(room), span["lo"], back)).otherwise(span["lo"])


def phrase_words(quote: Column) -> Column:
    return norm_tokens(quote)


def sentence_norms(sents: Column, norms: Column) -> Column:
    """Per sentence its normalised words as one text, a space between; words may be empty."""
    return F.transform(sents, lambda s: F.array_join(part(norms, s["word_start"], s["word_end"] - s["word_start"], lambda w: w), " "))


def locate_exact(said: Column, q: Column, lo: Column, hi: Column, start: Column) -> Column:
    """Zero-based word position of the first exact word-sequence match inside sentences ``lo`` to ``hi``, else null.

    ``said`` is of ``sentence_norms``; ``start`` is the position of the first word of ``lo``.
    Normalised words hold no space, so a match of words is a match of text between two spaces.
    """
    text = F.concat(F.lit(" "), F.array_join(part(said, lo, hi - lo + 1, lambda x: x), " "), F.lit(" "))
    probe = F.concat(F.lit(" "), F.array_join(q, " "), F.lit(" "))

    def words_before(x, pos):
        head = F.substring(x, F.lit(1), pos - 1)
        return F.when(pos > 0, start + F.length(head) - F.length(F.replace(head, F.lit(" "))))

    return F.when((F.size(q) >= 3) & (hi >= lo), let(text, lambda x: let(F.instr(x, probe), lambda pos: words_before(x, pos))))


def _in_row_lengths(phrases: DataFrame, q: str, head: int, longest: int) -> Callable[[Column], Column]:
    """Places in an array that may be where a phrase begins, by its first one or two words (``head``), as structs ``pos, n``: words of the longest such phrase.

    Lengths are kept by a hash of those words in ``SEED_SLOTS`` bytes, a literal of fixed size, however many phrases.
    """
    slot = F.pmod(F.xxhash64(*[F.get(q, F.lit(k)) for k in range(head)]), F.lit(SEED_SLOTS))
    n = F.size(q)
    used = phrases.groupBy(slot.alias("b")).agg(F.max(n).alias("n")).collect()  # at most SEED_SLOTS rows
    table = bytearray(SEED_SLOTS)
    for r in used:
        table[r["b"]] = min(r["n"], 127)  # 127: as long as the longest
    lengths = F.lit(bytes(table))  # one literal; an array of numbers takes the planner seconds

    def places(items: Column) -> Column:
        """A word is hashed once; its byte of the table is read as an ASCII character."""
        hashed = F.transform(items, lambda w, i: F.xxhash64(w, *[F.get(items, i + k) for k in range(1, head)]).bitwiseAND(F.lit(SEED_SLOTS - 1)).cast("int"))
        held = F.transform(hashed, lambda h, i: F.struct(i.alias("pos"), F.ascii(F.substring(lengths, h + 1, F.lit(1)).cast("string")).alias("n")))
        return F.transform(F.filter(held, lambda v: v["n"] > 0), lambda v: F.struct(v["pos"].alias("pos"), F.when(v["n"] < 127, v["n"]).otherwise(F.lit(longest)).alias("n")))

    return places


def phrase_spots(docs: DataFrame, phrases: DataFrame, key: str, phrase_id: str, share: float = 0.0) -> DataFrame:
    """``key, phrase_id, pos, hits, n``: every place whose word is a phrase's first, with the words of the phrase that match there in place.

    With ``share`` only places where at least that share of the phrase matches: of ``n`` words ``m`` may differ, so one
    of the ``m + 1`` after the first has to match, and most places are given up there, before all words are compared.
    ``docs``: key, norms (array of words). ``phrases``: phrase_id, q (array of three words or
    more). The phrases alone are indexed: a bitmap of their first words is tested inside the
    transcript's row, so of a transcript only short windows at such words leave it (as long as
    the longest phrase), never its word array; a window meets the phrases on the first word.
    """
    q = phrases.filter(F.size("q") >= 3).select(phrase_id, "q", F.get("q", F.lit(0)).alias("__first"))
    longest = q.agg(F.max(F.size("q"))).first()[0]
    if longest is None:
        q, longest = q.limit(0), 3
    seeds = _in_row_lengths(q, "q", 2 if share >= 1 else 1, longest)

    def windows(ws):
        n = F.size(ws)
        none = F.array().cast("array<struct<pos:int,n:int>>")
        return F.transform(F.when(n >= 3, seeds(ws)).otherwise(none), lambda v: F.struct(v["pos"].alias("pos"), part(ws, v["pos"], F.least(v["n"], n - v["pos"]), lambda w: w).alias("win")))

    w = rows(docs, [key], let(F.col("norms"), windows), "w").select(key, "w.pos", "w.win", F.get("w.win", F.lit(0)).alias("__first"))
    n = F.size("q")
    met = w.join(q, "__first").filter(F.size("win") >= n)
    if share >= 1:
        met = met.filter(same_words(F.col("win"), F.lit(0), F.col("q")))
    elif share > 0:
        spare = (n - F.ceil(n * share - 1e-6)).cast("int")
        met = met.filter((spare + 1 >= n) | F.exists(F.sequence(F.lit(1), spare + 1), lambda j: F.get("win", j) == F.get("q", j)))
    hits = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.get("win", j) == F.get("q", j)))
    out = met.select(key, phrase_id, "pos", hits.alias("hits"), n.alias("n"))
    return out.filter(F.col("hits") / F.col("n") >= share) if share > 0 else out


def clamp_score(x: Column) -> Column:
    return clamp(half_up(finite_or(x, 0.0), 1), 0.0, 10.0)


def keep_axes(scores: Column, profile: str) -> Column:
    """Only the profile's axes, each clamped; a missing axis scores 0."""
    return F.map_from_arrays(F.array(*[F.lit(a) for a in PROFILES[profile]["axes"]]),
                             F.array(*[clamp_score(F.coalesce(scores[a], F.lit(0.0))) for a in PROFILES[profile]["axes"]]))


def profile_score(scores: Column, profile: str, peak_line: Column | None = None) -> Column:
    """Weighted craft mean × gates × fluency on a 0-10 scale, two decimals. Plain arithmetic per row."""
    p = PROFILES[profile]
    craft, gate, total = F.lit(0.0), F.lit(1.0), 0.0
    for axis, (weight, exponent) in p["axes"].items():
        value = clamp(finite_or(F.coalesce(scores[axis], F.lit(0.0)), 0.0), 0.0, 10.0)
        if exponent is None:
            craft, total = craft + weight * value, total + weight
        else:
            gate = gate * F.pow(value / 10.0, F.lit(exponent))
    fluency = F.lit(1.0)
    if p["peak_kind"] == "line" and peak_line is not None:
        fluency = F.when(F.coalesce(peak_line, F.lit("")) != "", fluency_factor(peak_line)).otherwise(1.0)
    return half_up(craft / total * gate * fluency, 2)


def theme_filter(raw: Column, allowed: list[str], cap: int = 3) -> Column:
    keys = F.transform(raw, lambda x: F.regexp_replace(F.trim(F.lower(x)), r"[\s-]+", "_"))
    kept = F.slice(F.array_intersect(keys, F.array(*[F.lit(a) for a in allowed])), 1, cap)
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.lit(allowed[0]))))


def raw_moments(sents: Column) -> Column:
    """Deterministic stand-in for a scoring model: token statistics of a chunk's sentences.

    Every sentence is a peak, the strongest first, and its own peak line; its moment
    runs from two sentences before it to one after, inside the chunk.
    """
    def score(s):
        n = F.size(F.split(s["text"], " "))
        return F.struct((-F.least(F.lit(10.0), F.length(s["text"]) / 20.0)).alias("neg_payoff"), s["sent_no"].alias("sent_no"), n.alias("n"), s["text"].alias("text"))

    def build(ss):
        first, last = F.get(ss, F.lit(0))["sent_no"], F.element_at(ss, -1)["sent_no"]

        def moment(x):
            dangling = F.lower(F.split(x["text"], " ")[0]).isin("that", "this", "he", "she", "they", "it", "and", "so")
            scores = F.map_from_arrays(F.array(*[F.lit(a) for a in ("hook", "payoff", "quotability", "standalone")]), F.array(
                F.least(F.lit(10.0), x["n"] / 3.0), -x["neg_payoff"], fluency_factor(x["text"]) * 10.0, F.when(dangling, 4.0).otherwise(9.0)))
            return F.struct(F.greatest(first, x["sent_no"] - 2).alias("start_id"), F.least(last, x["sent_no"] + 1).alias("end_id"), x["sent_no"].alias("peak_id"),
                            x["text"].alias("peak_line"), scores.alias("scores"))

        return F.transform(F.sort_array(F.transform(ss, score)), moment)

    return let(sents, build)


def resolve_candidate(m: Column, words: Column, said: Column, sents: Column, starts: Column, ends: Column, profile: str = DEFAULT_PROFILE) -> Column:
    """Turn sentence ids into times, verbatim text and an exact peak; null when a rule rejects the moment.

    ``sents`` cut ``words`` one after the other, so a span's text is its sentences' text; ``said`` is of ``sentence_norms``.
    """
    lo_s, _, hi_s = PROFILES[profile]["duration"]
    lo_ms, hi_ms = lo_s * 1000, hi_s * 1000
    is_line = PROFILES[profile]["peak_kind"] == "line"
    at = lambda i: F.get(sents, i)
    text = lambda a, n: F.array_join(part(words, a, n, lambda w: w["word"]), " ")
    find = lambda q, lo, hi: locate_exact(said, q, lo, hi, at(lo)["word_start"])

    def placed(v):
        span, q = v["span"], v["q"]
        length = at(span["hi"])["end_ms"] - at(span["lo"])["start_ms"]
        ok = (length >= lo_ms * 0.6) & (length <= hi_ms + 5000)
        found = F.struct(span.alias("span"), find(q, span["lo"], span["hi"]).alias("pre"), q.alias("q"))
        return F.when(ok, let(found, timed))

    def timed(v):
        span, pre, q = v["span"], v["pre"], v["q"]
        peak_ms = F.coalesce(F.get(words, pre)["t_ms"], at(m["peak_id"])["start_ms"])
        return let(F.struct(span.alias("span"), pre.alias("pre"), peak_ms.alias("peak_ms"), q.alias("q")), led)

    def led(v):
        lo = lead_up(sents, v["span"], v["peak_ms"], hi_ms)
        return let(F.struct(lo.alias("lo"), v["span"]["lo"].alias("lo0"), v["span"]["hi"].alias("hi"), v["pre"].alias("pre"), v["peak_ms"].alias("peak_ms"), v["q"].alias("q")), finish)

    def finish(v):
        a, b = at(v["lo"]), at(v["hi"])
        position = (v["peak_ms"] - a["start_ms"]) / (b["end_ms"] - a["start_ms"])
        hit = F.when(v["lo"] == v["lo0"], v["pre"]).otherwise(find(v["q"], v["lo"], v["hi"]))  # searched before, unless the span grew
        return F.when(position >= MIN_PEAK_POSITION * 0.5, let(F.struct(v["q"].alias("q"), v["lo"].alias("lo"), v["hi"].alias("hi"), snap_start(a["start_ms"], starts).alias("start_ms"),
                                                                       snap_end(b["end_ms"], ends).alias("end_ms"), hit.alias("hit")), lined))

    def lined(v):
        pointed = at(F.least(F.greatest(m["peak_id"], v["lo"]), v["hi"]))
        line = F.when(v["hit"].isNotNull(), text(v["hit"], F.size(v["q"])))
        if is_line:
            line = F.coalesce(line, pointed["text"])
        sec = F.coalesce(F.get(words, v["hit"])["t_ms"], pointed["start_ms"])
        return let(F.struct(v["lo"].alias("lo_id"), v["hi"].alias("hi_id"), v["start_ms"].alias("start_ms"), v["end_ms"].alias("end_ms"), sec.alias("peak_ms"), line.alias("line")), joined)

    def joined(v):
        in_time = (v["end_ms"] > v["start_ms"]) & v["peak_ms"].between(v["start_ms"], v["end_ms"])
        whole = F.array_join(part(sents, v["lo_id"], v["hi_id"] - v["lo_id"] + 1, lambda x: x["text"]), " ")
        return F.when(in_time, let(whole, lambda t: let(F.contains(t, v["line"]), lambda verbatim: check(v, t, verbatim))))

    def check(v, transcript, verbatim):
        min_words = max(8, int(lo_s * 0.5 + 0.5))
        ok = (at(v["hi_id"])["word_end"] - at(v["lo_id"])["word_start"] >= min_words) | (F.size(F.split(transcript, " ")) >= min_words)  # a word is one or more of its text's
        if is_line:
            ok = ok & F.coalesce(verbatim, F.lit(True))
        fixed = F.struct(keep_axes(m["scores"], profile).alias("scores"), F.when(verbatim, v["line"]).alias("line"))
        return F.when(ok, let(fixed, lambda f: done(v, transcript, f["scores"], f["line"])))

    def done(v, transcript, scores, line):
        return F.struct(
            F.concat(F.lit("mm-"), v["start_ms"].cast("string"), F.lit("-"), v["end_ms"].cast("string")).alias("candidate_id"),
            v["lo_id"], v["hi_id"], v["start_ms"], v["end_ms"], v["peak_ms"], transcript.alias("transcript"), line.alias("peak_line"), scores.alias("scores"),
            profile_score(scores, profile, line).alias("total"))

    valid = at(m["start_id"]).isNotNull() & at(m["end_id"]).isNotNull()
    span = fit_span(sents, m["start_id"], m["end_id"], m["peak_id"], lo_ms, hi_ms)
    return F.when(valid, let(F.struct(span.alias("span"), phrase_words(m["peak_line"]).alias("q")), placed))


def interval_nms(items: Column, start: str, end: str, score: str, share: float = DEDUPE_OVERLAP) -> Column:
    """Greedy de-duplication over an array sorted best first: drop what overlaps a kept item too much."""
    def step(acc, x):
        def clash(k):
            apart = (k[start] >= x[end]) | (k[end] <= x[start])  # most are; the least and greatest are dear
            inter = F.least(k[end], x[end]) - F.greatest(k[start], x[start])
            return ~F.coalesce(apart, F.lit(False)) & (inter > 0) & (inter / F.least(k[end] - k[start], x[end] - x[start]) > share)
        return F.when(F.exists(acc, clash), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(items, F.filter(items, lambda x: F.lit(False)), step)


def best_first(items: Column, score: str) -> Column:
    """Stable descending order by score."""
    keys = lambda xs: F.sort_array(F.transform(xs, lambda x, i: F.struct((-x[score]).alias("k"), i.alias("i"))))
    return let(items, lambda xs: F.transform(keys(xs), lambda k: F.get(xs, k["i"])))


def classify_votes(words: Column, lexicon: dict[str, dict[str, float]], default: str) -> Column:
    """Weighted lexicon vote over sample words; the default wins when nothing matches, first name on ties."""
    def votes(ws):
        rows = []
        for genre in sorted(lexicon):
            total = F.lit(0.0)
            for word, weight in lexicon[genre].items():
                total = total + (F.size(ws) - F.size(F.array_remove(ws, word))) * weight
            rows.append(F.struct((-total).alias("neg"), F.lit(genre).alias("genre")))
        return let(F.array_min(F.array(*rows)), lambda b: F.when(b["neg"] < 0, b["genre"]).otherwise(F.lit(default)))
    return let(words, votes)


def genre_precedence(explicit: Column, stored: Column, stored_auto: Column, detected: Column) -> Column:
    """Explicit beats a previously explicit choice, which beats detection."""
    return F.coalesce(explicit, F.when(~stored_auto, stored), detected)
