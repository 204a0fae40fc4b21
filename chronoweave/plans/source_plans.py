"""Queries over sources, sinks and ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.functions.binding import let
from chronoweave.functions.numeric import half_up
from chronoweave.operators.scans import running_max, scan
from chronoweave.operators.staging import stage_root
from chronoweave.plans import views
from chronoweave.plans.registry import query
from chronoweave.sources import tracks as tr


def clock_text(ms):
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(ms / 3600000)
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(F.pmod(ms, F.lit(3600000)) / 60000)), F.lit(":"),
                    two(F.floor(F.pmod(ms, F.lit(60000)) / 1000)), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))


def vtt(spark, sf):
    """Caption text per document: even ids carry word tags and rolling repeats, odd ids are plain."""
    t = views.transcripts(spark, sf)

    def block(cues, c, i):
        head = F.concat(clock_text(c["start_ms"]), F.lit(" --> "), clock_text(c["end_ms"]), F.lit(" align:start\n"))
        tags = F.array_join(F.transform(views.cue_words(c), lambda w: F.concat(F.lit("<"), clock_text(w["t_ms"]), F.lit("><c> "), w["word"], F.lit("</c>"))), "")
        prev = F.when(i > 0, F.concat(F.get(cues, i - 1)["text"], F.lit("\n"))).otherwise(F.lit(""))
        hold = F.concat(F.lit("\n\n"), clock_text(c["end_ms"]), F.lit(" --> "), clock_text(c["end_ms"] + 10), F.lit("\n"), c["text"])
        return F.when(F.col("project_id") % 2 == 0, F.concat(head, prev, tags, hold)).otherwise(F.concat(head, c["text"]))

    body = let(F.col("cues"), lambda cues: F.array_join(F.transform(cues, lambda c, i: block(cues, c, i)), "\n\n"))
    return t.select("project_id", "lang", "source", F.concat(F.lit("WEBVTT\n\n"), body).alias("vtt"))


STRIP = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"""
TAGGED_WORDS = "tw AS (SELECT * FROM v_words WHERE project_id % 2 = 0 AND NOT contains(word, '<'))"


@query("a1_read_cues", "SELECT project_id, cue_no, start_sec, end_sec, text FROM v_cues", "v_cues")
def q_cues(spark, sf):
    return views.cues(spark, sf).select("project_id", "cue_no", "start_sec", "end_sec", "text")


@query("a2_vtt_blocks_to_cues", f"""
  c AS (SELECT project_id, cue_no, start_sec, end_sec, {STRIP.format(x='text')} AS text FROM v_cues),
  d AS (SELECT *, lag(text) OVER (PARTITION BY project_id ORDER BY cue_no) AS p FROM c WHERE text <> '')
  SELECT project_id, start_sec, end_sec, text FROM d WHERE p IS NULL OR p <> text""", "v_cues")
def q_vtt(spark, sf):
    return vtt(spark, sf).select("project_id", F.inline(tr.vtt_cues(F.col("vtt"))))


@query("a3_track_mode", "SELECT project_id, project_id % 2 = 0 AS tagged, count(*) AS kept_lines FROM v_cues GROUP BY project_id", "v_cues")
def q_mode(spark, sf):
    v = vtt(spark, sf).select("project_id", tr.is_tagged(F.col("vtt")).alias("tagged"), F.split("vtt", "\n").alias("lines"))
    text_lines = F.filter("lines", lambda l: (l != "") & ~F.contains(l, F.lit("-->")) & (l != "WEBVTT"))
    kept = F.when(F.col("tagged"), F.filter("lines", lambda l: F.contains(l, F.lit("<c>")))).otherwise(text_lines)
    return v.select("project_id", "tagged", F.size(kept).cast("long").alias("kept_lines"))


@query("a4_prefer_track", """
  SELECT source, doc_id, lang FROM (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id % 2,
    CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END, doc_id) AS rn FROM documents WHERE trim(text) <> '') WHERE rn = 1""")
def q_prefer(spark, sf):
    v = vtt(spark, sf).withColumnRenamed("project_id", "doc_id")
    return tr.prefer_track(v, "source", "lang", "vtt", ["de", "en", "fr"], "doc_id")


@query("a5_inline_word_onsets", TAGGED_WORDS + " SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY word_no) - 1 AS pos, t, word FROM tw", "v_words")
def q_onsets(spark, sf):
    v = vtt(spark, sf).select("project_id", F.posexplode(tr.inline_onsets(F.col("vtt"))).alias("pos", "o"))
    return v.select("project_id", F.col("pos").cast("long").alias("pos"), "o.t", "o.word")


@query("a6_monotonic_filter", """
  SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events)
  WHERE top IS NULL OR value > top""")
def q_monotonic(spark, sf):
    e = views.table(spark, sf, "events").select("user_id", "event_id", "value")
    s = scan(e, ["user_id"], ["event_id"], F.floor(F.col("event_id") / 100_000), top=running_max(F.col("value"), inclusive=False))
    return s.filter("top IS NULL OR value > top").drop("top")


@query("a6_monotonic_onsets", TAGGED_WORDS + " SELECT project_id, count(*) AS onsets, max(t) AS last_t FROM tw GROUP BY project_id", "v_words")
def q_monotonic_track(spark, sf):
    o = vtt(spark, sf).select("project_id", F.posexplode(tr.inline_onsets(F.col("vtt"))).alias("pos", "o")).select("project_id", "pos", "o.t")
    return tr.monotonic(o, "project_id", "pos", "t").groupBy("project_id").agg(F.count("*").alias("onsets"), F.max("t").alias("last_t"))


@query("a7_parse_source_id", r"""
  u AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS host,
    regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS q FROM pages),
  p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: (x <> '')) AS parts FROM u),
  m AS (SELECT *, list_position(list_transform(parts, lambda x: (x IN ('en', 'de', 'es'))), TRUE) AS ix FROM p)
  SELECT page_id, CASE WHEN host LIKE 'blog.%.example.org' THEN nullif(string_split(substr(path, 2), '/')[1], '')
    WHEN host LIKE '%example.com' OR host LIKE '%example.net' THEN coalesce(nullif(q, ''), CASE WHEN ix > 0 THEN parts[ix + 1] END) END AS source_id FROM m""".replace("u AS", "WITH u AS", 1))
def q_source_id(spark, sf):
    p = views.table(spark, sf, "pages")
    sid = tr.source_id(F.col("url"), short_hosts=[""], families=["example.com", "example.net"], param="page", markers=["en", "de", "es"])
    short = tr.source_id(F.col("url"), short_hosts=["x"], families=["x"])
    blog = F.try_parse_url("url", F.lit("HOST")).rlike(r"^blog\..*\.example\.org$")
    path = F.try_parse_url("url", F.lit("PATH"))
    first = F.nullif(F.split(F.substring(path, F.lit(2), F.length(path)), "/")[0], F.lit(""))
    return p.select("page_id", F.when(blog, first).otherwise(F.coalesce(sid, short)).alias("source_id"))


@query("a8_object_key_from_url", r"""SELECT page_id, CASE WHEN contains(url, '.example.com/') THEN string_split(url, '.example.com/')[2]
  WHEN starts_with(url, 'https://m.') THEN regexp_replace(substr(url, 11), '^/+', '') END AS object_key FROM pages""")
def q_key(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", tr.object_key(F.col("url"), ".example.com/", "https://m.").alias("object_key"))


def answers(spark, sf):
    """Event properties wrapped in prose, in a fence, or with a trailing comma."""
    e = views.table(spark, sf, "events")
    m = F.col("event_id") % 3
    text = (F.when(m == 0, F.concat(F.lit("Here you go: "), "props", F.lit(" - done.")))
            .when(m == 1, F.concat(F.lit("Sure.\n```json\n"), "props", F.lit("\n```\nAnything else? {no}")))
            .otherwise(F.concat(F.lit("Answer "), F.regexp_replace("props", r"\}$", ",}"))))
    return e.select("event_id", text.alias("text"))


@query("a9_json_answer_extract", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def q_answer(spark, sf):
    return answers(spark, sf).select("event_id", tr.json_answer(F.col("text"), "k bigint", "k")["k"].alias("k"))


@query("a10_asr_json_to_words", """
  w AS (SELECT project_id, word_no, word, t_ms, t_ms + 300 AS e FROM v_words)
  SELECT project_id, t_ms / 1e3 AS start_sec, CASE WHEN word_no % 3 = 2 THEN t_ms / 1e3 + 5e-2 ELSE e / 1e3 END AS end_sec, word FROM w WHERE word_no % 7 <> 6""", "v_words")
def q_asr(spark, sf):
    def entry(w):
        end = w["t_ms"] + 300
        kind = F.pmod(w["word_no"], F.lit(3))
        return F.struct(
            F.when(kind == 0, w["word"]).alias("word"), F.when(kind != 0, w["word"]).alias("text"),
            F.when(kind == 2, (w["t_ms"] / 1000.0).cast("string")).alias("start"),
            F.when(F.pmod(w["word_no"], F.lit(7)) == 6, F.lit("oops")).when(kind == 2, F.lit("0")).alias("end"),
            F.when((kind == 1) & (F.pmod(w["word_no"], F.lit(7)) != 6), F.struct(w["t_ms"].cast("double").alias("from"), end.cast("double").alias("to"))).alias("offsets"),
            F.when((kind == 0) & (F.pmod(w["word_no"], F.lit(7)) != 6), F.struct(clock_text(w["t_ms"]).alias("from"), clock_text(end).alias("to"))).alias("timestamps"))

    t = views.transcripts(spark, sf)
    doc = F.to_json(F.struct(F.transform(views.words_array(F.col("cues")), entry).alias("words")))
    j = t.select("project_id", doc.alias("json"))
    return j.select("project_id", F.inline(tr.asr_words(F.col("json")))).select(
        "project_id", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), "word")


@query("a11_object_listing", "SELECT 'p/' || o_custkey || '/' || o_orderkey AS key, CAST(floor(o_totalprice * 1e2 + 5e-1) AS BIGINT) AS size, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS modified FROM orders")
def q_listing(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select(F.concat(F.lit("p/"), "o_custkey", F.lit("/"), "o_orderkey").alias("key"), half_up(F.col("o_totalprice") * 100).alias("size"),
                    F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("modified"))


@query("a12_sidecar_catalog", "SELECT p_partkey AS asset_id, p_name AS label, p_type AS kind, p_size AS size FROM part WHERE p_partkey % 17 <> 0")
def q_sidecars(spark, sf):
    p = views.table(spark, sf, "part")
    good = F.to_json(F.struct(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"), F.col("p_size").alias("size")))
    j = p.select(F.when(F.col("p_partkey") % 17 == 0, F.concat(F.lit("{broken"), good)).otherwise(good).alias("json"))
    return tr.parse_sidecars(j, "json", tr.ASSET_SCHEMA, "asset_id").select("__r.asset_id", "__r.label", "__r.kind", "__r.size")


@query("a13_replace_partition", """SELECT o_orderstatus AS status, o_orderkey AS clip_id, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS revision FROM orders""")
def q_replace(spark, sf):
    path = f"{stage_root(spark)}/chronoweave/clips-{uuid.uuid4().hex}"
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip_id"), F.col("o_orderstatus").alias("status"))
    tr.replace_partitions(o.withColumn("revision", F.lit(1)), path, "status")
    again = o.filter("status = 'F'").withColumn("revision", F.lit(2))
    tr.replace_partitions(again, path, "status")
    tr.replace_partitions(again, path, "status")
    return spark.read.parquet(path).select("status", "clip_id", "revision")


@query("a14_revision_guarded_upsert", """
  SELECT user_id AS entity, arg_max(event_id, rev) AS revision, arg_max(event_type, rev) AS state FROM (SELECT *, event_id AS rev FROM events) GROUP BY user_id""")
def q_upsert(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("revision"), F.col("event_type").alias("state"))
    return tr.guarded_upsert(e.filter("revision % 2 = 0"), e.filter("revision % 2 = 1"), "entity", "revision", ["state"])


@query("a15_idempotent_submit", """
  j AS (SELECT user_id AS job_id, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' ELSE 'live' END AS status FROM events WHERE event_type IN ('error', 'purchase') AND user_id % 4 <> 0 GROUP BY user_id)
  SELECT s.job_id, CASE WHEN j.status IS NULL THEN 'new' WHEN j.status = 'failed' THEN 'retry' ELSE 'existing' END AS action
  FROM (SELECT DISTINCT user_id AS job_id FROM events WHERE event_type = 'signup') s LEFT JOIN j ON j.job_id = s.job_id""".replace("j AS", "WITH j AS", 1))
def q_submit(spark, sf):
    e = views.table(spark, sf, "events")
    jobs = e.filter(F.col("event_type").isin("error", "purchase") & (F.col("user_id") % 4 != 0)).groupBy(F.col("user_id").alias("job_id")).agg(
        F.when(F.max_by("event_type", "event_id") == "error", "failed").otherwise("live").alias("status"))
    return tr.idempotent_submit(e.filter("event_type = 'signup'").select(F.col("user_id").alias("job_id")), jobs, "job_id", "status")


@query("a16_incremental_describe", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 12")
def q_describe(spark, sf):
    return tr.incremental_describe(views.table(spark, sf, "documents").select("doc_id", "lang"), views.table(spark, sf, "labels"), "doc_id")
