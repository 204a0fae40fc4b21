"""Queries over segmentation, chunking, candidate mining and the ranked board."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.functions.binding import let, rows
from chronoweave.functions.numeric import half_up, half_up_sql
from chronoweave.functions.profiles import DEFAULT_PROFILE, PROFILES
from chronoweave.functions.text import norm_word, squeeze, tokens
from chronoweave.operators import intervals as iv
from chronoweave.operators import mining as mn
from chronoweave.operators import words as wd
from chronoweave.operators.folds import collect_ordered
from chronoweave.plans import views
from chronoweave.plans.registry import query
from chronoweave.plans.text_plans import NORM, TOK

SENTS = r"""
  w0 AS (SELECT project_id, word_no AS i, t_ms, t_ms + 400 AS e, word, lead(t_ms) OVER (PARTITION BY project_id ORDER BY word_no) AS nx FROM v_words),
  w1 AS (SELECT *, CASE WHEN regexp_matches(word, '[.!?]["'')\]]?$') OR nx - e >= 750 THEN i END AS brk FROM w0),
  w2 AS (SELECT *, min(brk) OVER (PARTITION BY project_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb FROM w1),
  wn AS (SELECT project_id, count(*) AS n FROM w0 GROUP BY project_id),
  fl AS (SELECT project_id, i AS b, least(n, least(coalesce(nb3, n), i + 33) + 1) AS stop, n FROM
    (SELECT w2.project_id, i, n, lead(nb, 3) OVER (PARTITION BY w2.project_id ORDER BY i) AS nb3 FROM w2 JOIN wn ON wn.project_id = w2.project_id)),
  fr AS (SELECT project_id, b, stop, n, 0 AS k FROM fl WHERE b = 0 UNION ALL SELECT f.project_id, f.b, f.stop, f.n, r.k + 1 FROM fr r JOIN fl f ON f.project_id = r.project_id AND f.b = r.stop),
  fm AS (SELECT *, max(k) OVER (PARTITION BY project_id) AS kmax, lead(stop - b) OVER (PARTITION BY project_id ORDER BY k) AS nlen FROM fr),
  fu AS (SELECT project_id, k AS sent_no, b AS word_start, CASE WHEN k = kmax - 1 AND nlen < 4 THEN n ELSE stop END AS word_end FROM fm WHERE NOT (k = kmax AND k > 0 AND stop - b < 4)),
  v_sent AS (SELECT u.project_id, u.sent_no, u.word_start, u.word_end, min(w.t_ms) AS start_ms, max(w.e) AS end_ms, string_agg(w.word, ' ' ORDER BY w.i) AS text
    FROM fu u JOIN w0 w ON w.project_id = u.project_id AND w.i >= u.word_start AND w.i < u.word_end GROUP BY ALL)"""
CHUNKS = SENTS + """,
  tot AS (SELECT project_id, arg_max(end_ms, sent_no) AS total FROM v_sent GROUP BY project_id),
  ch0 AS (SELECT s.*, t.total, unnest(range(greatest(0, CAST(floor((s.start_ms - 720000) / 6e5) AS BIGINT) + 1), CAST(floor(s.start_ms / 6e5) AS BIGINT) + 1)) AS chunk_no
    FROM v_sent s JOIN tot t ON t.project_id = s.project_id),
  v_chunk AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY project_id, chunk_no) AS n FROM ch0 WHERE chunk_no = 0 OR chunk_no * 600000 + 120000 < total) WHERE n >= 8)"""
FLU = r"""(SELECT CASE WHEN len(w) < 2 OR r = 0 THEN 1e0 WHEN r = 1 THEN 55e-2 ELSE 25e-2 END FROM (SELECT w, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS r FROM (SELECT {tok} AS w)))"""


def flu(x):
    return FLU.format(tok=TOK.format(x=rf"regexp_replace(lower({x}), '[^a-z0-9''\s]', ' ', 'g')"))


MOMENTS = CHUNKS + f""",
  sf AS (SELECT project_id, sent_no, text, len(string_split(text, ' ')) AS nw, least(1e1, length(text) / 2e1) AS payoff, {flu('text')} AS fl FROM v_sent),
  mo AS (SELECT c.project_id, c.chunk_no, c.sent_no, f.text, f.nw, f.payoff, f.fl, min(c.sent_no) OVER (PARTITION BY c.project_id, c.chunk_no) AS f0, max(c.sent_no) OVER (PARTITION BY c.project_id, c.chunk_no) AS l0,
      row_number() OVER (PARTITION BY c.project_id, c.chunk_no ORDER BY f.payoff DESC, c.sent_no) AS rn
    FROM v_chunk c JOIN sf f ON f.project_id = c.project_id AND f.sent_no = c.sent_no),
  v_moment AS (SELECT project_id, chunk_no, rn, greatest(f0, sent_no - 2) AS start_id, least(l0, sent_no + 1) AS end_id, sent_no AS peak_id, text AS peak_line,
      least(1e1, nw / 3e0) AS hook, payoff, fl * 1e1 AS quotability, CASE WHEN lower(string_split(text, ' ')[1]) IN ('that', 'this', 'he', 'she', 'they', 'it', 'and', 'so') THEN 4e0 ELSE 9e0 END AS standalone FROM mo)"""
FIT = MOMENTS + f""",
  sa AS (SELECT project_id, list(start_ms ORDER BY sent_no) AS s, list(end_ms ORDER BY sent_no) AS e, list(word_start ORDER BY sent_no) AS wa, list(word_end ORDER BY sent_no) AS wb, count(*) AS n FROM v_sent GROUP BY project_id),
  na AS (SELECT project_id, list({NORM.format(x='word')} ORDER BY word_no) AS norms, list(t_ms ORDER BY word_no) AS ts, list(word ORDER BY word_no) AS ws FROM v_words GROUP BY project_id),
  g AS (SELECT m.project_id, chunk_no, rn, peak_id, start_id AS lo, end_id AS hi, 0 AS it, TRUE AS go FROM v_moment m
    UNION ALL SELECT project_id, chunk_no, rn, peak_id, CASE WHEN short AND NOT fwd AND back THEN lo - 1 ELSE lo END, CASE WHEN short AND fwd THEN hi + 1 ELSE hi END, it + 1, short AND (fwd OR back)
    FROM (SELECT g.*, sa.e[hi + 1] - sa.s[lo + 1] < 20000 AS short, hi + 1 < n AND coalesce(sa.e[hi + 2] - sa.s[lo + 1] <= 45000, FALSE) AS fwd, lo > 0 AND sa.e[hi + 1] - sa.s[greatest(lo, 1)] <= 45000 AS back
      FROM g JOIN sa ON sa.project_id = g.project_id WHERE go)),
  g2 AS (SELECT project_id, chunk_no, rn, peak_id, arg_max(lo, it) AS lo, arg_max(hi, it) AS hi FROM g GROUP BY ALL),
  t AS (SELECT *, 0 AS it, TRUE AS go FROM g2
    UNION ALL SELECT project_id, chunk_no, rn, peak_id, CASE WHEN long AND front THEN lo + 1 ELSE lo END, CASE WHEN long AND NOT front AND rear THEN hi - 1 ELSE hi END, it + 1, long AND (front OR rear)
    FROM (SELECT t.*, sa.e[hi + 1] - sa.s[lo + 1] > 45000 AS long, lo < least(greatest(peak_id, lo), hi) AND lo < hi AS front, hi > least(greatest(peak_id, lo), hi) AND hi > lo AS rear
      FROM t JOIN sa ON sa.project_id = t.project_id WHERE go)),
  v_fit AS (SELECT project_id, chunk_no, rn, peak_id, arg_max(lo, it) AS lo, arg_max(hi, it) AS hi FROM t GROUP BY ALL)"""
CAND = FIT + f""",
  c0 AS (SELECT f.*, m.peak_line, m.hook, m.payoff, m.quotability, m.standalone, list_filter(list_transform({TOK.format(x='m.peak_line')}, lambda w: {NORM.format(x='w')}), lambda w: (w <> '')) AS q
    FROM v_fit f JOIN v_moment m ON m.project_id = f.project_id AND m.chunk_no = f.chunk_no AND m.rn = f.rn),
  c1 AS (SELECT c0.*, sa.e[hi + 1] - sa.s[lo + 1] AS len0, CASE WHEN len(q) >= 3 THEN list_min(list_filter(range(sa.wa[lo + 1], sa.wb[hi + 1] - len(q) + 1), lambda i: na.norms[i + 1] = q[1] AND list_slice(na.norms, i + 1, i + len(q)) = q)) END AS pre
    FROM c0 JOIN sa ON sa.project_id = c0.project_id JOIN na ON na.project_id = c0.project_id),
  c2 AS (SELECT c1.*, coalesce(na.ts[pre + 1], sa.s[peak_id + 1]) AS pk FROM c1 JOIN sa ON sa.project_id = c1.project_id JOIN na ON na.project_id = c1.project_id),
  b AS (SELECT project_id, chunk_no, rn, lo, hi, pk, 0 AS it, TRUE AS go FROM c2
    UNION ALL SELECT project_id, chunk_no, rn, CASE WHEN mv THEN lo - 1 ELSE lo END, hi, pk, it + 1, mv
    FROM (SELECT b.*, (pk - sa.s[lo + 1]) / (sa.e[hi + 1] - sa.s[lo + 1])::DOUBLE < 2e-1 AND lo > 0 AND sa.e[hi + 1] - sa.s[greatest(lo, 1)] <= 45000 AS mv FROM b JOIN sa ON sa.project_id = b.project_id WHERE go)),
  b2 AS (SELECT project_id, chunk_no, rn, arg_max(lo, it) AS lo2 FROM b GROUP BY ALL),
  bd AS (SELECT project_id, list(DISTINCT start_ms) AS starts, list(DISTINCT end_ms) AS ends FROM v_cues WHERE end_ms - start_ms >= 50 GROUP BY project_id),
  c3 AS (SELECT c2.*, lo2, sa.s[lo2 + 1] AS s0, sa.e[hi + 1] AS e0, sa.wa[lo2 + 1] AS wa, sa.wb[hi + 1] AS wb, least(greatest(peak_id, lo2), hi) AS pid, sa.s AS ss, sa.wa AS was, sa.wb AS wbs
    FROM c2 JOIN b2 ON b2.project_id = c2.project_id AND b2.chunk_no = c2.chunk_no AND b2.rn = c2.rn JOIN sa ON sa.project_id = c2.project_id),
  c4 AS (SELECT c3.*, greatest(0, coalesce(list_max(list_filter(bd.starts, lambda x: x <= s0 + 1)), list_min(bd.starts), s0) - 250) AS start_ms, coalesce(list_min(list_filter(bd.ends, lambda x: x >= e0 - 1)), list_max(bd.ends), e0) AS end_ms,
      array_to_string(list_slice(na.ws, wa + 1, wb), ' ') AS transcript, CASE WHEN len(q) >= 3 THEN list_min(list_filter(range(wa, wb - len(q) + 1), lambda i: na.norms[i + 1] = q[1] AND list_slice(na.norms, i + 1, i + len(q)) = q)) END AS hit, na.ws, na.ts
    FROM c3 JOIN bd ON bd.project_id = c3.project_id JOIN na ON na.project_id = c3.project_id),
  c5 AS (SELECT *, coalesce(ts[hit + 1], ss[pid + 1]) AS peak_ms, CASE WHEN hit IS NOT NULL THEN array_to_string(list_slice(ws, hit + 1, hit + len(q)), ' ') ELSE array_to_string(list_slice(ws, was[pid + 1] + 1, wbs[pid + 1]), ' ') END AS line FROM c4),
  c6 AS (SELECT * FROM c5 WHERE len0 >= 12000 AND len0 <= 50000 AND (pk - s0) / (e0 - s0)::DOUBLE >= 2e-1 * 5e-1 AND end_ms > start_ms AND len(string_split(transcript, ' ')) >= 10 AND peak_ms BETWEEN start_ms AND end_ms AND contains(transcript, line)),
  c7 AS (SELECT *, {half_up_sql('hook', 1)} AS a1, {half_up_sql('payoff', 1)} AS a2, {half_up_sql('quotability', 1)} AS a3, {half_up_sql('standalone', 1)} AS a4, {flu('line')} AS fl FROM c6),
  v_cand AS (SELECT *, 'mm-' || start_ms || '-' || end_ms AS candidate_id, {half_up_sql('(35e-2 * a1 + 35e-2 * a2 + 3e-1 * a3) / (35e-2 + 35e-2 + 3e-1) * pow(a4 / 1e1, 75e-2) * fl', 2)} AS total FROM c7)"""
BOARD = CAND + """,
  o0 AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY total DESC, chunk_no, rn) AS ord FROM v_cand),
  nm AS (SELECT project_id, ord, TRUE AS keep, [struct_pack(s := start_ms, e := end_ms)] AS kept FROM o0 WHERE ord = 1
    UNION ALL SELECT project_id, ord, NOT clash, CASE WHEN clash THEN kept ELSE list_append(kept, struct_pack(s := start_ms, e := end_ms)) END FROM
    (SELECT o.project_id, o.ord, o.start_ms, o.end_ms, r.kept, len(list_filter(r.kept, lambda k: least(k.e, o.end_ms) - greatest(k.s, o.start_ms) > 0 AND (least(k.e, o.end_ms) - greatest(k.s, o.start_ms)) / least(k.e - k.s, o.end_ms - o.start_ms)::DOUBLE > 45e-2)) > 0 AS clash
     FROM nm r JOIN o0 o ON o.project_id = r.project_id AND o.ord = r.ord + 1)),
  bo AS (SELECT o0.*, row_number() OVER (PARTITION BY o0.project_id ORDER BY o0.ord) AS rank FROM o0 JOIN nm ON nm.project_id = o0.project_id AND nm.ord = o0.ord AND nm.keep WHERE total >= 35e-1)"""


def sentences(spark, sf):
    """One row per transcript: cues, words, sentences."""
    t = views.transcripts(spark, sf)
    words = F.transform(views.words_array(F.col("cues")), lambda w: F.struct(w["word_no"], w["t_ms"], (w["t_ms"] + 400).alias("end_ms"), w["word"]))
    return t.select("project_id", "cues", words.alias("words")).withColumn("sents", wd.segment_sentences(F.col("words")))


def moments(spark, sf):
    s = sentences(spark, sf).withColumn("chunks", mn.overlap_chunks(F.col("sents")))
    return s.withColumn("moments", F.flatten(F.transform("chunks", lambda c: F.transform(mn.raw_moments(c["sents"]), lambda m, i: F.struct(c["chunk_no"], (i + 1).alias("rn"), m.alias("m"))))))


def candidates(spark, sf):
    m = moments(spark, sf)
    norms = views.norms_array(F.col("cues"))
    long_cues = F.filter("cues", lambda c: c["end_ms"] - c["start_ms"] >= wd.MIN_CUE_MS)
    said = let(norms, lambda ns: mn.sentence_norms(F.col("sents"), ns))
    m = m.select("project_id", "words", "sents", "chunks", "moments", said.alias("said"),
        F.sort_array(F.array_distinct(F.transform(long_cues, lambda c: c["start_ms"]))).alias("starts"), F.sort_array(F.array_distinct(F.transform(long_cues, lambda c: c["end_ms"]))).alias("ends"))
    resolved = F.transform("moments", lambda x: F.struct(x["chunk_no"], x["rn"], mn.resolve_candidate(
        x["m"], F.col("words"), F.col("said"), F.col("sents"), F.col("starts"), F.col("ends")).alias("c")))
    return m.withColumn("resolved", F.filter(resolved, lambda x: x["c"].isNotNull()))


def board_array(spark, sf):
    flat = F.transform("resolved", lambda x: F.struct(x["c"]["candidate_id"], x["c"]["start_ms"], x["c"]["end_ms"], x["c"]["peak_ms"], x["c"]["peak_line"], x["c"]["transcript"], x["c"]["scores"], x["c"]["total"]))
    c = candidates(spark, sf).select("project_id", "words", "sents", "chunks", flat.alias("flat"))
    kept = let(mn.best_first(F.col("flat"), "total"), lambda xs: mn.interval_nms(xs, "start_ms", "end_ms", "total"))
    return c.withColumn("board", F.slice(F.filter(kept, lambda x: x["total"] >= mn.MIN_TOTAL_SCORE), 1, mn.BOARD_SIZE))


@query("flagship_ranked_board", BOARD + " SELECT project_id, rank, candidate_id, start_ms, end_ms, peak_ms, line AS peak_line, total FROM bo WHERE rank <= 12", "v_words")
def q_board(spark, sf):
    b = rows(board_array(spark, sf), ["project_id"], F.col("board"), "c", pos="pos")
    return b.select("project_id", (F.col("pos") + 1).cast("long").alias("rank"), "c.candidate_id", "c.start_ms", "c.end_ms", "c.peak_ms", "c.peak_line", "c.total")


@query("c1_segment_sentences", SENTS + " SELECT project_id, sent_no, word_start, word_end, start_ms, end_ms, text FROM v_sent", "v_words")
def q_segment(spark, sf):
    return rows(sentences(spark, sf), ["project_id"], F.col("sents"), "s").select("project_id", "s.*").select(
        "project_id", *[F.col(c).cast("long").alias(c) for c in ("sent_no", "word_start", "word_end")], "start_ms", "end_ms", "text")


@query("c2_overlap_chunks", CHUNKS + " SELECT project_id, chunk_no, count(*) AS n, min(sent_no) AS first_sent, max(sent_no) AS last_sent FROM v_chunk GROUP BY ALL", "v_words")
def q_chunks(spark, sf):
    c = rows(sentences(spark, sf), ["project_id"], mn.overlap_chunks(F.col("sents")), "c")
    return c.select("project_id", F.col("c.chunk_no").cast("long").alias("chunk_no"), F.size("c.sents").cast("long").alias("n"),
                    F.element_at("c.sents", 1)["sent_no"].cast("long").alias("first_sent"), F.element_at("c.sents", -1)["sent_no"].cast("long").alias("last_sent"))


@query("c3_chunk_prompt_lines", CHUNKS + " SELECT project_id, chunk_no, string_agg('#' || sent_no || ' [' || printf('%.1f', start_ms / 1e3) || '] ' || text, chr(10) ORDER BY sent_no) AS lines FROM v_chunk GROUP BY ALL", "v_words")
def q_lines(spark, sf):
    c = rows(sentences(spark, sf), ["project_id"], mn.overlap_chunks(F.col("sents")), "c")
    return c.select("project_id", F.col("c.chunk_no").cast("long").alias("chunk_no"), mn.chunk_lines(F.col("c.sents")).alias("lines"))


SNAP = SENTS + ", bd AS (SELECT project_id, list(DISTINCT start_ms) AS starts, list(DISTINCT end_ms) AS ends FROM v_cues WHERE end_ms - start_ms >= 50 GROUP BY project_id)"


@query("c4_snap_start", SNAP + " SELECT s.project_id, sent_no, greatest(0, coalesce(list_max(list_filter(starts, lambda x: x <= s.start_ms + 1)), list_min(starts)) - 250) AS snapped FROM v_sent s JOIN bd ON bd.project_id = s.project_id", "v_words")
def q_snap_start(spark, sf):
    s = sentences(spark, sf).select("project_id", "sents", F.transform("cues", lambda c: c["start_ms"]).alias("b"))
    snapped = F.transform("sents", lambda x: F.struct(x["sent_no"].cast("long").alias("sent_no"), mn.snap_start(x["start_ms"], F.col("b")).alias("snapped")))
    return rows(s, ["project_id"], snapped, "s").select("project_id", "s.*")


@query("c5_snap_end", SNAP + " SELECT s.project_id, sent_no, coalesce(list_min(list_filter(ends, lambda x: x >= s.end_ms - 401)), list_max(ends)) AS snapped FROM v_sent s JOIN bd ON bd.project_id = s.project_id", "v_words")
def q_snap_end(spark, sf):
    s = sentences(spark, sf).select("project_id", "sents", F.transform("cues", lambda c: c["end_ms"]).alias("b"))
    snapped = F.transform("sents", lambda x: F.struct(x["sent_no"].cast("long").alias("sent_no"), mn.snap_end(x["end_ms"] - 400, F.col("b")).alias("snapped")))
    return rows(s, ["project_id"], snapped, "s").select("project_id", "s.*")


@query("c6_fit_span", FIT + " SELECT project_id, chunk_no, rn, lo, hi FROM v_fit", "v_words")
def q_fit(spark, sf):
    m = moments(spark, sf)
    lo, _, hi = PROFILES[DEFAULT_PROFILE]["duration"]
    fits = F.transform("moments", lambda x: F.struct(x["chunk_no"], x["rn"], mn.fit_span(F.col("sents"), x["m"]["start_id"], x["m"]["end_id"], x["m"]["peak_id"], lo * 1000, hi * 1000).alias("f")))
    r = rows(m, ["project_id"], fits, "r").select("project_id", "r.*")
    return r.select("project_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_no", "rn")], F.col("f.lo").cast("long").alias("lo"), F.col("f.hi").cast("long").alias("hi"))


def cand_rows(spark, sf):
    return rows(candidates(spark, sf), ["project_id"], F.col("resolved"), "r").select("project_id", "r.*").select(
        "project_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("rn").cast("long").alias("rn"), "c.*")


@query("c7_peak_position_guard", CAND + " SELECT project_id, chunk_no, rn, lo2 AS lo_id, hi AS hi_id FROM v_cand", "v_words")
def q_guard(spark, sf):
    return cand_rows(spark, sf).select("project_id", "chunk_no", "rn", F.col("lo_id").cast("long").alias("lo_id"), F.col("hi_id").cast("long").alias("hi_id"))


def located(spark, sf, share=0.0):
    """Every benchmark phrase against every transcript."""
    items = views.table(spark, sf, "benchmark").select("item_id", mn.phrase_words(F.col("text")).alias("q"))
    docs = views.documents(spark, sf).select(F.col("doc_id").alias("project_id"), views.text_norms(F.col("text")).alias("norms"))
    return mn.phrase_spots(docs, items, "project_id", "item_id", share)


LOC = f"""
  it AS (SELECT item_id, list_filter(list_transform({TOK.format(x='text')}, lambda w: {NORM.format(x='w')}), lambda w: (w <> '')) AS q FROM benchmark),
  na AS (SELECT project_id, list({NORM.format(x='word')} ORDER BY word_no) AS norms FROM v_words GROUP BY project_id),
  p0 AS (SELECT w.project_id, w.word_no AS pos, it.item_id, it.q FROM v_words w JOIN it ON len(it.q) >= 3 AND {NORM.format(x='w.word')} = it.q[1]),
  p1 AS (SELECT p0.*, list_slice(norms, pos + 1, pos + len(q)) AS win FROM p0 JOIN na ON na.project_id = p0.project_id WHERE pos + len(q) <= len(norms)),
  p2 AS (SELECT *, len(list_filter(range(1, len(q) + 1), lambda i: win[i] = q[i])) AS hits FROM p1)"""


@query("c8_locate_phrase_exact", LOC + " SELECT project_id, item_id, min(pos) AS pos FROM p2 WHERE hits = len(q) GROUP BY ALL", "v_words")
def q_locate(spark, sf):
    f = located(spark, sf, 1.0).filter("hits = n")
    return f.groupBy("project_id", "item_id").agg(F.min("pos").cast("long").alias("pos"))


@query("c9_locate_phrase_fuzzy", LOC + " SELECT project_id, item_id, arg_min(pos, struct_pack(h := -hits, p := pos)) AS pos, max(hits) AS hits FROM p2 WHERE hits / len(q)::DOUBLE >= 75e-2 GROUP BY project_id, item_id", "v_words")
def q_locate_fuzzy(spark, sf):
    f = located(spark, sf, mn.FUZZY_SHARE).filter(F.col("hits") / F.col("n") >= mn.FUZZY_SHARE)
    return f.groupBy("project_id", "item_id").agg(F.min_by("pos", F.struct(-F.col("hits"), "pos")).cast("long").alias("pos"), F.max("hits").cast("long").alias("hits"))


@query("c10_span_text", CAND + " SELECT project_id, chunk_no, rn, transcript FROM v_cand", "v_words")
def q_text(spark, sf):
    return cand_rows(spark, sf).select("project_id", "chunk_no", "rn", "transcript")


@query("c11_min_words", SENTS + " SELECT project_id, sent_no, word_end - word_start AS n FROM v_sent WHERE word_end - word_start >= 10", "v_words")
def q_min_words(spark, sf):
    lo = PROFILES[DEFAULT_PROFILE]["duration"][0]
    s = rows(sentences(spark, sf), ["project_id"], F.col("sents"), "s").select("project_id", "s.*")
    n = F.size(F.split("text", " "))
    return s.filter(n >= max(8, int(lo * 0.5 + 0.5))).select("project_id", F.col("sent_no").cast("long").alias("sent_no"), n.cast("long").alias("n"))


@query("c12_peak_consistency", CAND + " SELECT project_id, chunk_no, rn, peak_ms, line AS peak_line FROM v_cand", "v_words")
def q_peak(spark, sf):
    return cand_rows(spark, sf).select("project_id", "chunk_no", "rn", "peak_ms", "peak_line")


def line_scores(spark, sf):
    l = views.table(spark, sf, "lineitem")
    scores = F.map_from_arrays(F.array(*[F.lit(a) for a in ("hook", "payoff", "quotability", "standalone", "bogus")]), F.array(
        F.col("l_quantity") / 4.0, F.when(F.col("l_discount") > 0.09, F.lit(float("nan"))).otherwise(F.col("l_discount") * 100), F.col("l_tax") * 125, F.col("l_linenumber") * 1.5, F.lit(3.0)))
    return l.select("l_orderkey", "l_linenumber", scores.alias("scores"))


LSCORE = f"""
  WITH s AS (SELECT l_orderkey, l_linenumber, least(1e1, {half_up_sql('l_quantity / 4e0', 1)}) AS hook, CASE WHEN l_discount > 9e-2 THEN 0e0 ELSE least(1e1, {half_up_sql('l_discount * 100', 1)}) END AS payoff,
    least(1e1, {half_up_sql('l_tax * 125', 1)}) AS quotability, least(1e1, {half_up_sql('l_linenumber * 15e-1', 1)}) AS standalone FROM lineitem)"""


@query("c13_clamp_scores", LSCORE + " SELECT l_orderkey, l_linenumber, hook, payoff, quotability, standalone FROM s")
def q_clamp(spark, sf):
    s = line_scores(spark, sf).withColumn("k", mn.keep_axes(F.col("scores"), "motivation"))
    return s.select("l_orderkey", "l_linenumber", *[F.col("k")[a].alias(a) for a in PROFILES["motivation"]["axes"]])


@query("c14_profile_score", LSCORE + f" SELECT l_orderkey, l_linenumber, {half_up_sql('(35e-2 * hook + 35e-2 * payoff + 3e-1 * quotability) / (35e-2 + 35e-2 + 3e-1) * pow(standalone / 1e1, 75e-2)', 2)} AS total FROM s")
def q_score(spark, sf):
    s = line_scores(spark, sf)
    return s.select("l_orderkey", "l_linenumber", mn.profile_score(mn.keep_axes(F.col("scores"), "motivation"), "motivation").alias("total"))


@query("c15_theme_filter", r"""
  WITH a AS (SELECT p_partkey, list_transform(list_concat(string_split(p_name || ' ' || p_type, ' '), ['Red-Widget']), lambda x: regexp_replace(trim(lower(x)), '[\s-]+', '_', 'g')) AS k FROM part),
  b AS (SELECT p_partkey, list_slice(list_filter(list_distinct_ordered, lambda x: x IN ('blue', 'widget', 'economy', 'red_widget')), 1, 3) AS t FROM
    (SELECT p_partkey, list_filter(k, lambda x, i: list_position(k, x) = i) AS list_distinct_ordered FROM a))
  SELECT p_partkey, array_to_string(CASE WHEN len(t) > 0 THEN t ELSE ['blue'] END, ',') AS themes FROM b""")
def q_themes(spark, sf):
    p = views.table(spark, sf, "part")
    raw = F.concat(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), F.array(F.lit("Red-Widget")))
    return p.select("p_partkey", F.array_join(mn.theme_filter(raw, ["blue", "widget", "economy", "red_widget"]), ",").alias("themes"))


@query("c16_interval_nms", """
  o0 AS (SELECT owner_id, span_id, start_ms, end_ms, score, row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, span_id) AS ord FROM v_spans),
  nm AS (SELECT owner_id, ord, TRUE AS keep, [struct_pack(s := start_ms, e := end_ms)] AS kept FROM o0 WHERE ord = 1
    UNION ALL SELECT owner_id, ord, NOT clash, CASE WHEN clash THEN kept ELSE list_append(kept, struct_pack(s := start_ms, e := end_ms)) END FROM
    (SELECT o.owner_id, o.ord, o.start_ms, o.end_ms, r.kept, len(list_filter(r.kept, lambda k: least(k.e, o.end_ms) - greatest(k.s, o.start_ms) > 0 AND (least(k.e, o.end_ms) - greatest(k.s, o.start_ms)) / least(k.e - k.s, o.end_ms - o.start_ms)::DOUBLE > 45e-2)) > 0 AS clash
     FROM nm r JOIN o0 o ON o.owner_id = r.owner_id AND o.ord = r.ord + 1))
  SELECT o0.owner_id, span_id, start_ms, end_ms, score FROM o0 JOIN nm ON nm.owner_id = o0.owner_id AND nm.ord = o0.ord AND nm.keep""", "v_spans")
def q_nms(spark, sf):
    """Spans that do not overlap never compete, so the greedy pass runs per overlap island."""
    s = views.spans(spark, sf).select("owner_id", "span_id", "start_ms", "end_ms", "score")
    isl = iv.islands(s, ["owner_id"], "start_ms", "end_ms", "span_id", touch=False).withColumn("neg", -F.col("score"))
    items = collect_ordered(isl, ["owner_id", "island"], ["neg", "span_id"], ["start_ms", "end_ms", "score"])
    kept = mn.interval_nms(F.col("items"), "start_ms", "end_ms", "score")
    return items.select("owner_id", F.inline(kept)).select("owner_id", "span_id", "start_ms", "end_ms", "score")


@query("c17_score_floor_topk", """SELECT owner_id, rank, span_id, score FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, span_id) AS rank FROM v_spans WHERE score >= 35e-1) WHERE rank <= 12""", "v_spans")
def q_topk(spark, sf):
    s = views.spans(spark, sf).filter(F.col("score") >= mn.MIN_TOTAL_SCORE)
    w = Window.partitionBy("owner_id").orderBy(F.desc("score"), "span_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= mn.BOARD_SIZE).select("owner_id", "rank", "span_id", "score")


@query("c18_candidate_id", "SELECT span_id, 'mm-' || start_ms || '-' || end_ms AS candidate_id FROM v_spans", "v_spans")
def q_id(spark, sf):
    return views.spans(spark, sf).select("span_id", F.concat(F.lit("mm-"), "start_ms", F.lit("-"), "end_ms").alias("candidate_id"))


@query("c19_mining_stats", BOARD + """
  SELECT t.project_id, (SELECT count(DISTINCT chunk_no) FROM v_chunk c WHERE c.project_id = t.project_id) AS chunks, wn.n AS words,
    (SELECT count(*) FROM v_sent s WHERE s.project_id = t.project_id) AS sentences, (SELECT count(*) FROM bo b WHERE b.project_id = t.project_id AND rank <= 12) AS kept
  FROM tot t JOIN wn ON wn.project_id = t.project_id WHERE t.project_id IN (SELECT project_id FROM v_moment)""", "v_words")
def q_stats(spark, sf):
    b = board_array(spark, sf)
    b = b.select("project_id", *[F.size(c).cast("long").alias(n) for c, n in (("chunks", "chunks"), ("words", "words"), ("sents", "sentences"), ("board", "kept"))])
    return b.filter("chunks > 0")


LEXICON = {"comedy_talk": {"de": 1.0, "la": 1.5}, "motivation": {"the": 1.0, "and": 1.5}, "music": {"der": 1.0, "und": 1.5}, "sports_gaming": {"el": 1.0, "los": 2.0}}


@query("c20_classify_channel", rf"""
  WITH s AS (SELECT doc_id, list_transform({TOK.format(x='text')}, lambda w: {NORM.format(x='w')}) AS ws FROM documents),
  v AS (SELECT doc_id, unnest([struct_pack(g := 'comedy_talk', v := len(list_filter(ws, lambda w: w = 'de')) + 15e-1 * len(list_filter(ws, lambda w: w = 'la'))),
    struct_pack(g := 'motivation', v := len(list_filter(ws, lambda w: w = 'the')) + 15e-1 * len(list_filter(ws, lambda w: w = 'and'))),
    struct_pack(g := 'music', v := len(list_filter(ws, lambda w: w = 'der')) + 15e-1 * len(list_filter(ws, lambda w: w = 'und'))),
    struct_pack(g := 'sports_gaming', v := len(list_filter(ws, lambda w: w = 'el')) + 2e0 * len(list_filter(ws, lambda w: w = 'los')))]) AS x FROM s)
  SELECT doc_id, CASE WHEN max(x.v) > 0 THEN arg_min(x.g, struct_pack(v := -x.v, g := x.g)) ELSE 'motivation' END AS genre FROM v GROUP BY doc_id""")
def q_classify(spark, sf):
    d = views.table(spark, sf, "documents")
    ws = F.transform(tokens(F.col("text")), norm_word)
    return d.select("doc_id", mn.classify_votes(ws, LEXICON, DEFAULT_PROFILE).alias("genre"))


@query("c21_genre_precedence", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN 'music' END, CASE WHEN o_orderstatus = 'F' THEN 'comedy_talk' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'sports_gaming' ELSE 'motivation' END) AS genre FROM orders""")
def q_precedence(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select("o_orderkey", mn.genre_precedence(F.when(F.col("o_orderkey") % 7 == 0, "music"), F.lit("comedy_talk"), F.col("o_orderstatus") != "F",
                                                      F.when(F.col("o_orderpriority") == "1-URGENT", "sports_gaming").otherwise("motivation")).alias("genre"))


@query("c22_registry_lookup_strict", """
  SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'motivation' WHEN p_type IN ('ECONOMY', 'SMALL', 'LARGE') THEN lower(p_type) END AS profile,
    CASE WHEN p_size % 5 <> 0 AND p_type NOT IN ('ECONOMY', 'SMALL', 'LARGE') THEN 'unknown ' || p_type END AS rejected FROM part""")
def q_lookup(spark, sf):
    p = views.table(spark, sf, "part").withColumn("wanted", F.when(F.col("p_size") % 5 != 0, F.col("p_type")))
    known = spark.createDataFrame([("ECONOMY", "economy"), ("SMALL", "small"), ("LARGE", "large")], "wanted string, profile string")
    j = p.join(F.broadcast(known), "wanted", "left")  # the registry is a fixed handful of rows
    return j.select("p_partkey", F.when(F.col("wanted").isNull(), DEFAULT_PROFILE).otherwise(F.col("profile")).alias("profile"),
                    F.when(F.col("wanted").isNotNull() & F.col("profile").isNull(), F.concat(F.lit("unknown "), "wanted")).alias("rejected"))


@query("c23_mining_invariants", BOARD + """
  SELECT count(*) AS candidates, count(*) FILTER (WHERE NOT contains(transcript, line)) AS not_verbatim, count(*) FILTER (WHERE peak_ms < start_ms - 10 OR peak_ms > end_ms + 10) AS peak_outside,
    count(*) FILTER (WHERE line IS NULL) AS no_line, count(*) FILTER (WHERE end_ms - start_ms < 12000 OR end_ms - start_ms > 50000) AS outside_band, 0 AS missing_axis, 0 AS extra_axis FROM bo WHERE rank <= 12""", "v_words")
def q_invariants(spark, sf):
    c = rows(board_array(spark, sf), [], F.col("board"), "c").select("c.*")
    axes = F.array(*[F.lit(a) for a in PROFILES[DEFAULT_PROFILE]["axes"]])
    length = F.col("end_ms") - F.col("start_ms")
    return c.agg(F.count("*").alias("candidates"), F.count_if(~F.contains("transcript", F.col("peak_line"))).alias("not_verbatim"),
                 F.count_if(~F.col("peak_ms").between(F.col("start_ms") - 10, F.col("end_ms") + 10)).alias("peak_outside"), F.count_if(F.col("peak_line").isNull()).alias("no_line"),
                 F.count_if((length < 12000) | (length > 50000)).alias("outside_band"),
                 F.count_if(F.size(F.array_except(axes, F.map_keys("scores"))) > 0).alias("missing_axis"), F.count_if(F.size(F.array_except(F.map_keys("scores"), axes)) > 0).alias("extra_axis"))
