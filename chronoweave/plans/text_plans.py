"""Queries over text cleaning and word timelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions.binding import let
from chronoweave.functions.numeric import half_up, half_up_sql
from chronoweave.operators import words as wd
from chronoweave.plans import views
from chronoweave.plans.registry import query

_DEC = """replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' ')"""
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(" + _DEC + r""", '&amp;', '&'), '&#\d+;', ' ', 'g'),
  '<[^>]*>', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), '>>+', ' ', 'g'), '\s+', ' ', 'g'))"""
STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""
NORM = "regexp_replace(lower({x}), '[^a-z0-9'']', '', 'g')"
TOK = r"list_filter(string_split(trim(regexp_replace({x}, '\s+', ' ', 'g')), ' '), lambda x: (x <> ''))"
SENT = r"""list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda s: trim(regexp_replace(s, '(?i)^(and|um|uh|so|like)\s+', ''))), lambda s: (length(s) > 28 AND length(s) < 220))"""


@query("b1_clean_cue_text", f"SELECT page_id, {CLEAN.format(x='html')} AS text FROM pages")
def q_clean(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", tx.clean_cue_text(F.col("html")).alias("text"))


@query("b2_strip_tags_then_decode", f"SELECT page_id, {STRIP.format(x='html')} AS text FROM pages")
def q_strip(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@query("b3_norm_word", f"SELECT word, {NORM.format(x='word')} AS norm, count(*) AS n FROM v_words GROUP BY word", "v_words")
def q_norm(spark, sf):
    n = views.words(spark, sf).groupBy("word").agg(F.count("*").alias("n"))
    return n.select("word", tx.norm_word(F.col("word")).alias("norm"), "n")


@query("b4_dedupe_consecutive", """
  d AS (SELECT project_id, ord, text, lag(text) OVER (PARTITION BY project_id ORDER BY ord) AS p FROM v_lines),
  k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1 AS pos FROM d WHERE p IS NULL OR p <> text)
  SELECT project_id, pos, text FROM k""", "v_cues")
def q_dedupe(spark, sf):
    d = views.documents(spark, sf)
    kept = wd.dedupe_consecutive(F.split("text", "\n"))
    return d.select(F.col("doc_id").alias("project_id"), F.posexplode(kept).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


ROLL = rf"""
  r0 AS (SELECT project_id, cue_no, start_ms, end_ms, {TOK.format(x=CLEAN.format(x='text'))} AS raw FROM v_rolling),
  r1 AS (SELECT *, list_transform(raw, lambda w: {NORM.format(x='w')}) AS cand, row_number() OVER (PARTITION BY project_id ORDER BY cue_no) AS rn FROM r0 WHERE len(raw) > 0),
  r2 AS (SELECT project_id, rn, cue_no, start_ms, end_ms, raw, 0 AS k, list_slice(cand, greatest(len(cand) - 39, 1), len(cand)) AS tail FROM r1 WHERE rn = 1
    UNION ALL
    SELECT project_id, rn, cue_no, start_ms, end_ms, raw, k, list_slice(joined, greatest(len(joined) - 39, 1), len(joined)) FROM (
      SELECT *, list_concat(tail, list_slice(cand, k + 1, len(cand))) AS joined FROM (
        SELECT n.project_id, n.rn, n.cue_no, n.start_ms, n.end_ms, n.raw, n.cand, r.tail,
          coalesce(list_max(list_filter(range(1, least(len(n.cand), len(r.tail), 40) + 1), lambda j: list_slice(r.tail, len(r.tail) - j + 1, len(r.tail)) = list_slice(n.cand, 1, j))), 0) AS k
        FROM r2 r JOIN r1 n ON n.project_id = r.project_id AND n.rn = r.rn + 1))),
  r3 AS (SELECT project_id, cue_no, k AS overlap, start_ms, greatest(end_ms, start_ms + 50) AS end_ms, list_slice(raw, k + 1, len(raw)) AS fresh FROM r2 WHERE k < len(raw))"""


def rolling(spark, sf):
    t = views.transcripts(spark, sf).select("project_id", views.rolling(F.col("cues")).alias("cues"))
    return t.select("project_id", F.explode(wd.rolling_overlap(F.col("cues"), tx.clean_cue_text)).alias("c"))


@query("b5_rolling_overlap", ROLL + " SELECT project_id, cue_no, overlap, len(fresh) AS fresh_n, array_to_string(fresh, ' ') AS fresh FROM r3", "v_rolling")
def q_rolling(spark, sf):
    return rolling(spark, sf).select("project_id", "c.cue_no", F.col("c.overlap").cast("long").alias("overlap"),
                                     F.size("c.fresh").cast("long").alias("fresh_n"), F.array_join("c.fresh", " ").alias("fresh"))


@query("b6_spread_words", rf"""
  t AS (SELECT project_id, cue_no, start_ms, greatest(end_ms, start_ms + 50) AS e, {TOK.format(x='text')} AS ws FROM v_turns),
  u AS (SELECT project_id, cue_no, start_ms, (e - start_ms) / len(ws)::DOUBLE AS step, w.k - 1 AS k, w.word FROM t, unnest(ws) WITH ORDINALITY AS w(word, k))
  SELECT project_id, cue_no, k, word, {half_up_sql('start_ms + step * k', 3)} AS t_ms, {half_up_sql('start_ms + step * k + step', 3)} AS end_ms FROM u""", "v_turns")
def q_spread(spark, sf):
    t = views.turns(spark, sf)
    cue = F.struct("start_ms", F.greatest(F.col("end_ms"), F.col("start_ms") + 50).alias("end_ms"), tx.tokens(F.col("text")).alias("fresh"))
    t = t.select("project_id", "cue_no", cue.alias("c"))
    s = t.select("project_id", "cue_no", F.posexplode(wd.spread(F.col("c"))).alias("k", "w"))
    return s.select("project_id", "cue_no", F.col("k").cast("long").alias("k"), "w.word", half_up(F.col("w.t_ms"), 3).alias("t_ms"), half_up(F.col("w.end_ms"), 3).alias("end_ms"))


@query("b7_expand_phrases", f"""
  p AS (SELECT project_id, word_no // 3 AS ph, min(t_ms) AS t, count(*) AS n FROM v_words GROUP BY ALL),
  q AS (SELECT *, lead(t) OVER (PARTITION BY project_id ORDER BY ph) AS nx FROM p),
  s AS (SELECT *, CASE WHEN nx > t + 40 THEN (nx - t)::DOUBLE ELSE greatest(n * 14e1, 28e1) END AS span FROM q)
  SELECT w.project_id, {half_up_sql('s.t + s.span / s.n * (w.word_no % 3)')} AS t_ms, w.word FROM v_words w JOIN s ON s.project_id = w.project_id AND s.ph = w.word_no // 3""", "v_words")
def q_phrases(spark, sf):
    w = F.col("w")
    t = views.transcripts(spark, sf).select("project_id", views.words_array(F.col("cues")).alias("w"))
    starts = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / 3).cast("int"))
    items = F.transform(starts, lambda i: F.struct(F.get(w, i * 3)["t_ms"].alias("t_ms"), F.concat_ws(" ", *[F.get(w, i * 3 + j)["word"] for j in range(3)]).alias("word")))
    return t.select("project_id", items.alias("items")).select("project_id", F.inline(wd.expand_phrases(F.col("items"))))


@query("b8_word_granular", rf"""
  t AS (SELECT project_id, len({TOK.format(x='text')}) AS n FROM v_turns WHERE trim(text) <> '')
  SELECT project_id, bool_and(n = 1) AS granular, CASE WHEN bool_and(n = 1) THEN count(*) ELSE 0 END AS onsets FROM t GROUP BY project_id""", "v_turns")
def q_granular(spark, sf):
    t = views.turns(spark, sf).filter(F.trim("text") != "").select("project_id", (F.size(tx.tokens(F.col("text"))) == 1).alias("one"))
    g = t.groupBy("project_id").agg(F.bool_and("one").alias("granular"), F.count("*").alias("n"))
    return g.select("project_id", "granular", F.when(F.col("granular"), F.col("n")).otherwise(F.lit(0)).alias("onsets"))


@query("b9_resolve_timings", """
  a AS (SELECT project_id, count(*) FILTER (WHERE project_id % 2 = 0 AND NOT contains(word, '<')) AS tagged FROM v_words GROUP BY project_id),
  b AS (SELECT project_id, CASE WHEN bool_and(n = 1) THEN count(*) ELSE 0 END AS per_word FROM v_cues GROUP BY project_id)
  SELECT a.project_id, CASE WHEN tagged >= 3 THEN 'tagged' WHEN per_word >= 3 THEN 'per_word' ELSE 'none' END AS source,
    CASE WHEN tagged >= 3 THEN tagged WHEN per_word >= 3 THEN per_word ELSE 0 END AS onsets FROM a JOIN b ON b.project_id = a.project_id""", "v_words")
def q_resolve(spark, sf):
    from chronoweave.plans.source_plans import vtt
    from chronoweave.sources.tracks import inline_onsets
    v = vtt(spark, sf).select("project_id", F.size(inline_onsets(F.col("vtt"))).cast("long").alias("tagged"),
                              F.filter(F.split(F.regexp_replace("vtt", r"(?m)^WEBVTT$|^\d\d:.*-->.*$", ""), "\n"), lambda l: F.trim(l) != "").alias("lines"))
    single = F.forall("lines", lambda l: F.size(tx.tokens(l)) == 1)
    v = v.withColumn("per_word", F.when((F.col("project_id") % 2 == 1) & single, F.size("lines").cast("long")).otherwise(F.lit(0)))
    return v.select("project_id", F.when(F.col("tagged") >= 3, "tagged").when(F.col("per_word") >= 3, "per_word").otherwise("none").alias("source"),
                    F.when(F.col("tagged") >= 3, F.col("tagged")).when(F.col("per_word") >= 3, F.col("per_word")).otherwise(F.lit(0)).alias("onsets"))


@query("b10_cue_boundaries", """
  SELECT DISTINCT project_id, 'start' AS edge, start_ms AS at_ms FROM v_turns WHERE trim(text) <> '' AND end_ms - start_ms >= 50
  UNION ALL SELECT DISTINCT project_id, 'end', end_ms FROM v_turns WHERE trim(text) <> '' AND end_ms - start_ms >= 50""", "v_turns")
def q_boundaries(spark, sf):
    t = views.turns(spark, sf).filter((F.trim("text") != "") & (F.col("end_ms") - F.col("start_ms") >= wd.MIN_CUE_MS))
    edges = F.array(F.struct(F.lit("start").alias("edge"), F.col("start_ms").alias("at_ms")), F.struct(F.lit("end").alias("edge"), F.col("end_ms").alias("at_ms")))
    return t.select("project_id", F.inline(edges)).distinct()


INJECT = "replace(replace({x}, ' the ', ' um, the UH '), ' la ', ' hmm la er. ')"


@query("b11_filler_strip", rf"""
  c AS (SELECT project_id, cue_no, array_to_string(list_filter({TOK.format(x=INJECT.format(x="' ' || text || ' '"))},
    lambda w: (NOT regexp_matches(regexp_replace(w, '^[^\p{{L}}\p{{N}}'']+|[^\p{{L}}\p{{N}}'']+$', '', 'g'), '(?i)^(um+|uh+|er+|ah+|hmm+|mm+|uh-huh|mhm)$'))), ' ') AS text FROM v_cues)
  SELECT project_id, cue_no, text, text = '' AS hidden FROM c""", "v_cues")
def q_fillers(spark, sf):
    c = views.cues(spark, sf)
    raw = F.concat(F.lit(" "), "text", F.lit(" "))
    raw = F.replace(F.replace(raw, F.lit(" the "), F.lit(" um, the UH ")), F.lit(" la "), F.lit(" hmm la er. "))
    return c.select("project_id", "cue_no", tx.strip_fillers(raw).alias("text")).withColumn("hidden", F.col("text") == "")


@query("b12_fluency_factor", rf"""
  c AS (SELECT project_id, cue_no, {TOK.format(x="regexp_replace(lower(text), '[^a-z0-9''\\s]', ' ', 'g')")} AS w FROM v_cues),
  d AS (SELECT *, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS reps FROM c)
  SELECT project_id, cue_no, CASE WHEN len(w) < 2 OR reps = 0 THEN 1e0 WHEN reps = 1 THEN 55e-2 ELSE 25e-2 END AS factor FROM d""".replace("\\\\s", "\\s"), "v_cues")
def q_fluency(spark, sf):
    return views.cues(spark, sf).select("project_id", "cue_no", tx.fluency_factor(F.col("text")).alias("factor"))


@query("b13_sentence_split", f"""SELECT doc_id, u.k - 1 AS pos, u.s AS sentence FROM documents, unnest({SENT.format(x='text')}) WITH ORDINALITY AS u(s, k)""")
def q_sentences(spark, sf):
    d = views.documents(spark, sf)
    return d.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query("b14_hook_text", r"""
  WITH a AS (SELECT doc_id, trim(regexp_replace(string_split(regexp_replace(text, '([.?!])\s', '\1' || chr(1)), chr(1))[1], '\s+', ' ', 'g')) AS c FROM documents),
  b AS (SELECT *, substr(c, 1, 90) AS h, CASE WHEN contains(substr(c, 1, 90), ' ') THEN 90 - instr(reverse(substr(c, 1, 90)), ' ') ELSE -1 END AS ls FROM a)
  SELECT doc_id, CASE WHEN length(c) <= 90 THEN c ELSE regexp_replace(CASE WHEN ls > 45 THEN substr(h, 1, ls) ELSE h END, '[,;:.\-–—]+$', '') || '…' END AS hook FROM b""")
def q_hook(spark, sf):
    return views.documents(spark, sf).select("doc_id", tx.hook_text(F.col("text")).alias("hook"))


@query("b15_sample_text", r"""
  SELECT project_id, trim(regexp_replace(substr(string_agg(text, ' ' ORDER BY cue_no), 1, 2000), '\s+', ' ', 'g')) AS sample
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY cue_no) AS rn FROM v_turns) WHERE rn <= 400 GROUP BY project_id""", "v_turns")
def q_sample(spark, sf):
    t = views.turns(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("project_id").orderBy("cue_no"))).filter("rn <= 400")
    g = t.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("cue_no", "text"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["text"]), " ")
    return g.select("project_id", tx.squeeze(F.substring(joined, 1, 2000)).alias("sample"))


LINE1 = "string_split(text, chr(10))[1]"
RAW_T = f"""CASE doc_id % 4 WHEN 0 THEN '"' || regexp_replace({LINE1}, '[^A-Za-z ]', '', 'g') || '" #clip' WHEN 1 THEN source || ': ' || {LINE1}
  WHEN 2 THEN upper(regexp_replace({LINE1}, '[^A-Za-z ]', '', 'g')) ELSE 'Must-watch ' || {LINE1} END"""


@query("b16_title_sanitize", rf"""
  WITH a AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace({RAW_T}, '#[A-Za-z0-9_]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
  b AS (SELECT *, trim(regexp_replace(t, '^["“]|["”]$', '', 'g')) AS t1 FROM a),
  c AS (SELECT *, CASE WHEN starts_with(lower(t1), lower(source) || ':') THEN trim(substr(t1, length(source) + 2)) ELSE t1 END AS t2 FROM b),
  d AS (SELECT *, CASE WHEN t2 = '' OR regexp_matches(t2, '(?i)you won''?t believe|crazy (podcast )?moment|gone wrong|full interview|must[- ]watch|#shorts') THEN 'Clip ' || doc_id ELSE t2 END AS t3 FROM c),
  e AS (SELECT *, CASE WHEN t3 = upper(t3) AND regexp_matches(t3, '[A-Z]') THEN array_to_string(list_transform(string_split(lower(t3), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') ELSE t3 END AS t4 FROM d)
  SELECT doc_id, CASE WHEN length(t4) > 100 THEN trim(regexp_replace(substr(t4, 1, 100), '\s+\S*$', '')) ELSE t4 END AS title FROM e""")
def q_title(spark, sf):
    d = views.documents(spark, sf)
    line = F.split("text", "\n")[0]
    plain = F.regexp_replace(line, "[^A-Za-z ]", "")
    m = F.col("doc_id") % 4
    raw = (F.when(m == 0, F.concat(F.lit('"'), plain, F.lit('" #clip'))).when(m == 1, F.concat("source", F.lit(": "), line))
           .when(m == 2, F.upper(plain)).otherwise(F.concat(F.lit("Must-watch "), line)))
    return d.select("doc_id", tx.sanitize_title(raw, F.concat(F.lit("Clip "), "doc_id"), F.col("source")).alias("title"))


TAGS = r"""array_to_string(list_slice(CASE WHEN len(list_filter({k}, lambda x: lower(x) = '#shorts')) > 0 THEN {k} ELSE list_append({k}, '#Shorts') END, 1, 5), ' ')"""
_MARK = r"list_filter(list_transform({t}, lambda x: '#' || regexp_replace(regexp_replace(x, '^#', ''), '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: length(x) >= 3)"


@query("b17_hashtag_line", rf"""
  WITH a AS (SELECT doc_id, {_MARK.format(t=TOK.format(x='text'))} AS m FROM documents),
  b AS (SELECT *, list_transform(m, lambda x: lower(x)) AS l FROM a),
  c AS (SELECT doc_id, list_slice(list_filter(m, lambda x, i: list_position(l, lower(x)) = i), 1, 5) AS k FROM b)
  SELECT doc_id, {TAGS.format(k='k')} AS tags FROM c""")
def q_tags(spark, sf):
    return views.documents(spark, sf).select("doc_id", tx.hashtag_line(tx.tokens(F.col("text"))).alias("tags"))


@query("b18_description_pack", rf"""
  WITH a AS (SELECT doc_id, source, text AS transcript, trim(regexp_replace(regexp_replace(CASE WHEN doc_id % 5 = 0 THEN '' ELSE text || chr(10) || '#One #two' END, '(?i)https?://\S+', '', 'g'), '[ \t]+\n', chr(10), 'g')) AS t0 FROM documents),
  b AS (SELECT *, CASE WHEN t0 = '' THEN 'A clip' ELSE t0 END AS t FROM a),
  c AS (SELECT *, regexp_extract_all(t, '#([A-Za-z0-9_]+)', 1) AS found,
    list_filter(list_transform(string_split(regexp_replace(t, '\n+', chr(10), 'g'), chr(10)), lambda l: trim(regexp_replace(regexp_replace(l, '(?i)https?://\S+', '', 'g'), '\s+', ' ', 'g'))),
      lambda l: (l <> '' AND NOT regexp_matches(l, '^#[A-Za-z0-9_]+(?:\s+#[A-Za-z0-9_]+)*$') AND NOT regexp_matches(l, '(?i)full conversation on the channel'))) AS prose FROM b),
  d AS (SELECT *, prose[1] AS lead, coalesce(array_to_string(list_slice(prose, 2, greatest(len(prose), 1)), ' '), '') AS ctx FROM c),
  e AS (SELECT *, array_to_string(list_slice(list_filter({SENT.format(x='transcript')}, lambda s: NOT contains(lower(lead || ' ' || ctx), lower(substr(s, 1, 24)))), 1, 2), ' ') AS extra FROM d),
  f AS (SELECT *, CASE WHEN length(lead) + length(ctx) < 220 THEN array_to_string(list_filter([ctx, extra], lambda x: x <> ''), ' ') ELSE ctx END AS ctx2,
    {_MARK.format(t="list_concat(found, ['clipname', 'podcastclips', 'Shorts'])")} AS m FROM e),
  g AS (SELECT *, list_slice(list_filter(m, lambda x, i: list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i), 1, 5) AS k,
    CASE WHEN length(lead) <= 160 THEN lead WHEN regexp_extract(substr(lead, 1, 160), '^([\s\S]+?[.?!])', 1) <> '' THEN trim(regexp_extract(substr(lead, 1, 160), '^([\s\S]+?[.?!])', 1))
      ELSE trim(regexp_replace(substr(lead, 1, 160), '\s+\S*$', '')) END AS fit FROM f),
  h AS (SELECT doc_id, array_to_string(list_filter([fit, ctx2, 'From ' || source || '. Full conversation on the channel.', {TAGS.format(k='k')}], lambda x: x <> ''), chr(10) || chr(10)) AS packed FROM g)
  SELECT doc_id, CASE WHEN length(packed) > 900 THEN trim(regexp_replace(substr(packed, 1, 900), '\s+\S*$', '')) ELSE packed END AS description FROM h""")
def q_description(spark, sf):
    d = views.documents(spark, sf)
    raw = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat("text", F.lit("\n#One #two")))
    return d.select("doc_id", tx.description_pack(raw, F.lit("A clip"), F.col("source"), F.col("text"), F.lit(""), F.lit("clip name")).alias("description"))


@query("b19_speaker_hint", r"""
  WITH a AS (SELECT doc_id, source, trim(string_split(regexp_replace(trim(string_split(text, chr(10))[1]), '(?i)\s+on\s+|\s+talks\s+|\s+explains\s+', chr(1), 'g'), chr(1))[1]) AS lead FROM documents)
  SELECT doc_id, CASE WHEN lead <> '' AND length(lead) < 48 AND NOT regexp_matches(lead, '(?i)^the ') THEN lead ELSE source END AS speaker FROM a""")
def q_speaker(spark, sf):
    return views.documents(spark, sf).select("doc_id", tx.speaker_hint(F.split("text", "\n")[0], F.col("source")).alias("speaker"))


SQUASH = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query("b21_quote_in_note", f"""
  WITH q AS (SELECT item_id, {SQUASH.format(x='text')} AS q FROM benchmark), n AS (SELECT doc_id, {SQUASH.format(x='text')} AS n FROM documents)
  SELECT item_id, doc_id FROM q JOIN n ON length(q.q) >= 3 AND contains(n.n, q.q)""")
def q_quote(spark, sf):
    """Candidates by a key that a note must have, then the exact test.

    From five words on, a quote's second to fourth words are whole words wherever it occurs; a shorter one is met by its first three characters.
    """
    quotes = views.table(spark, sf, "benchmark").select("item_id", tx.squash(F.col("text")).alias("q"))
    notes = views.documents(spark, sf).select("doc_id", tx.squash(F.col("text")).alias("n"))
    qw = F.split("q", " ")
    quotes = quotes.filter(F.length("q") >= 3)
    long = quotes.filter(F.size(qw) >= 5).select("item_id", F.array_join(F.slice(qw, 2, 3), " ").alias("key"))
    short = quotes.filter(F.size(qw) < 5).select("item_id", F.substring("q", 1, 3).alias("key"))
    nw = F.split("n", " ")
    grams = let(nw, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))))
    chars = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("n") - 2, F.lit(1))), lambda i: F.substring(F.col("n"), i, F.lit(3))))
    pairs = notes.select("doc_id", F.explode(grams).alias("key")).join(long, "key").unionByName(notes.select("doc_id", F.explode(chars).alias("key")).join(short, "key")).drop("key")
    return pairs.join(notes, "doc_id").join(quotes, "item_id").filter(F.contains("n", F.col("q"))).select("item_id", "doc_id")


@query("b22_options_cleanup", rf"""
  a AS (SELECT project_id, cue_no, {TOK.format(x='text')} AS ws FROM v_turns),
  b AS (SELECT project_id, cue_no, substr(array_to_string(ws, ' '), 1, 300) AS question, list_transform(ws, lambda w: trim(substr(w, 1, 80))) AS o FROM a),
  c AS (SELECT *, list_slice(list_filter(o, lambda x, i: list_position(list_transform(o, lambda y: lower(y)), lower(x)) = i), 1, 4) AS opts, CASE WHEN len(o) >= 3 THEN o[3] END AS rec FROM b WHERE question <> ''),
  d AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY cue_no) AS rn FROM c)
  SELECT project_id, cue_no, question, CASE WHEN len(opts) >= 2 THEN array_to_string(opts, '|') ELSE '' END AS options,
    CASE WHEN len(opts) >= 2 THEN greatest(coalesce(CASE WHEN list_position(list_transform(o, lambda y: lower(y)), lower(rec)) = 3 THEN list_position(opts, rec) ELSE 0 END, 0) - 1, 0) END AS recommended
  FROM d WHERE rn <= 4""", "v_turns")
def q_options(spark, sf):
    t = views.turns(spark, sf)
    ws = tx.tokens(F.col("text"))
    raw = F.to_json(F.struct(F.array_join(ws, " ").alias("question"), F.transform(ws, lambda w, i: F.concat(w, F.when(i == 2, " (recommended)").otherwise(""))).alias("options")))
    j = t.select("project_id", "cue_no", F.from_json(raw, "question string, options array<string>").alias("a"))
    tag = r"(?i)\s*\(recommended\)\s*"
    written = F.transform(F.coalesce(F.col("a.options"), F.array().cast("array<string>")), lambda o: F.struct(
        F.substring(F.trim(F.regexp_replace(o, tag, "")), 1, 80).alias("label"), o.rlike(tag).alias("rec")))
    low = lambda ws: F.transform(ws, lambda o: F.lower(o["label"]))
    opts = F.slice(let(written, lambda ws: let(low(ws), lambda ls: F.filter(
        ws, lambda o, i: (o["label"] != "") & (F.array_position(ls, F.lower(o["label"])) == i + 1)))), 1, 4)
    j = j.select("project_id", "cue_no", F.substring(F.trim("a.question"), 1, 300).alias("question"), opts.alias("o")).filter("question <> ''")
    j = j.withColumn("rn", F.row_number().over(Window.partitionBy("project_id").orderBy("cue_no"))).filter("rn <= 4")
    at = F.array_position(F.transform("o", lambda x: x["rec"]), True)
    choice = F.size("o") >= 2
    return j.select("project_id", "cue_no", "question", F.when(choice, F.array_join(F.transform("o", lambda x: x["label"]), "|")).otherwise("").alias("options"),
                    F.when(choice, F.greatest(at - 1, F.lit(0))).cast("long").alias("recommended"))


@query("b23_score_band", """
  WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity / 5e0 AS s, floor(l_extendedprice) AS sec, l_extendedprice * 37e0 AS b FROM lineitem),
  c AS (SELECT *, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 ELSE 2 END AS e FROM a),
  d AS (SELECT *, b / CASE e WHEN 0 THEN 1e0 WHEN 1 THEN 1024e0 ELSE 1048576e0 END AS v FROM c)
  SELECT l_orderkey, l_linenumber, CASE WHEN s >= 7 THEN 'strong' WHEN s >= 5 THEN 'promising' ELSE 'risky' END AS band,
    CAST(floor(sec / 60) AS BIGINT) || ':' || lpad(CAST(CAST(sec % 60 AS BIGINT) AS VARCHAR), 2, '0') AS code,
    CASE WHEN v >= 10 OR e = 0 THEN CAST(CAST(floor(v + 5e-1) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', floor(v * 10 + 5e-1) / 1e1) END || CASE e WHEN 0 THEN ' B' WHEN 1 THEN ' KB' ELSE ' MB' END AS size_label FROM d""")
def q_band(spark, sf):
    l = views.table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", tx.score_band(F.col("l_quantity") / 5.0).alias("band"),
                    tx.timecode(F.floor("l_extendedprice").cast("double")).alias("code"), tx.bytes_label(F.col("l_extendedprice") * 37.0).alias("size_label"))
