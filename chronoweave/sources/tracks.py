"""Caption tracks, recogniser output, source ids, listings and sidecars as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.binding import let
from chronoweave.functions.numeric import finite_or
from chronoweave.functions.text import strip_tags, timestamp_to_sec

# The word-tag pattern, marker, hosts and path markers.
WORD_TAG = r"<(\d{2}:\d{2}:\d{2}\.\d{3})><c>([^<]*)</c>"
TAG_MARK = "<c>"
SHORT_HOSTS = ["youtu.be"]
HOST_FAMILIES = ["youtube.com", "youtube-nocookie.com"]
PATH_MARKERS = ["shorts", "embed", "live", "v"]
STORE_MARK = ".amazonaws.com/"
MIN_WORD_SEC = 0.05

CUE_SCHEMA = T.StructType([
    T.StructField("project_id", T.LongType()), T.StructField("start_sec", T.DoubleType()),
    T.StructField("end_sec", T.DoubleType()), T.StructField("text", T.StringType())])
ASSET_SCHEMA = "asset_id long, label string, kind string, source string, size int"


def read_cues(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(CUE_SCHEMA).format(fmt).load(path)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row per track file: path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("vtt"))


def is_tagged(vtt: Column) -> Column:
    """Decided once per track: do any lines carry word tags?"""
    return F.contains(vtt, F.lit(TAG_MARK))


def vtt_cues(vtt: Column) -> Column:
    """Track text -> array of (start_sec, end_sec, text); only tagged lines count in a tagged track."""
    tagged = is_tagged(vtt)
    blocks = F.split(F.replace(vtt, F.lit("\r\n"), F.lit("\n")), "\n\n")

    def parse(b):
        lines = F.split(F.trim(b), "\n")
        at = F.coalesce(F.array_position(F.transform(lines, lambda l: F.contains(l, F.lit("-->"))), True), F.lit(0))
        timing = F.split(F.get(lines, (at - 1).cast("int")), "-->")
        body = F.slice(lines, at.cast("int") + 1, F.greatest(F.size(lines) - at.cast("int"), F.lit(0)))
        used = F.when(tagged, F.filter(body, lambda l: F.contains(l, F.lit(TAG_MARK)))).otherwise(body)
        return F.struct((at > 0).alias("ok"), timestamp_to_sec(F.get(timing, F.lit(0))).alias("start_sec"),
                        timestamp_to_sec(F.split(F.trim(F.get(timing, F.lit(1))), " ")[0]).alias("end_sec"),
                        strip_tags(F.array_join(used, " ")).alias("text"))

    cues = F.filter(F.transform(blocks, parse), lambda c: c["ok"] & (c["text"] != ""))
    kept = let(cues, lambda cs: F.filter(cs, lambda c, i: (i == 0) | (c["text"] != F.get(cs, i - 1)["text"])))
    return F.transform(kept, lambda c: F.struct(c["start_sec"], c["end_sec"], c["text"]))


def inline_onsets(vtt: Column) -> Column:
    """Word tags of a track in order: array of (t, word), blanks dropped."""
    times = F.regexp_extract_all(vtt, F.lit(WORD_TAG), 1)
    texts = F.regexp_extract_all(vtt, F.lit(WORD_TAG), 2)
    both = F.zip_with(times, texts, lambda t, w: F.struct(timestamp_to_sec(t).alias("t"), F.trim(w).alias("word")))
    return F.filter(both, lambda x: x["word"] != "")


def monotonic(onsets: DataFrame, key: str, pos: str, t: str) -> DataFrame:
    """Drop an onset that does not advance past every onset before it in its track (one source row)."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    top = onsets.withColumn("__top", F.max(t).over(before))
    return top.filter(F.col("__top").isNull() | (F.col(t) > F.col("__top"))).drop("__top")


def prefer_track(tracks: DataFrame, key: str, lang: str, vtt: str, order: list[str], tie: str) -> DataFrame:
    """One track per key: first in language order with word tags, else first that is not empty."""
    rank = F.array_position(F.lit(order), F.col(lang))
    choice = F.struct((~is_tagged(F.col(vtt))).alias("untagged"), F.when(rank > 0, rank).otherwise(len(order) + 1).alias("rank"), F.col(tie).alias("tie"))
    # An empty track has no rank. A filter on the text would be pushed below the projections that build it, and build it again.
    ranked = F.when(F.trim(vtt) != "", choice)
    best = tracks.groupBy(key).agg(F.min_by(F.struct(tie, lang), ranked).alias("best")).filter(F.col("best").isNotNull())
    return best.select(key, f"best.{tie}", f"best.{lang}")


def source_id(url: Column, short_hosts=SHORT_HOSTS, families=HOST_FAMILIES, param: str = "v", markers=PATH_MARKERS) -> Column:
    """Canonical id from a bare id, a short link, a query parameter or a marked path part."""
    x = F.trim(url)
    host = F.regexp_replace(F.lower(F.try_parse_url(x, F.lit("HOST"))), r"^www\.", "")
    path = F.try_parse_url(x, F.lit("PATH"))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first = F.nullif(F.split(F.substring(path, F.lit(2), F.length(path)), "/")[0], F.lit(""))
    spots = F.filter(F.transform(parts, lambda p, i: F.when(p.isin(*markers), i)), lambda i: i.isNotNull())
    marked = F.get(parts, F.get(spots, F.lit(0)) + 1)
    member = F.lit(False)
    for f in families:
        member = member | F.endswith(host, F.lit(f))
    query = F.nullif(F.try_parse_url(x, F.lit("QUERY"), F.lit(param)), F.lit(""))
    return (F.when(x == "", None).when(x.rlike("^[A-Za-z0-9_-]{11}$"), x).when(host.isin(*short_hosts), first)
            .when(member, F.coalesce(query, marked)))


def object_key(url: Column, mark: str = STORE_MARK, cdn: str | None = None) -> Column:
    """Storage key behind a bucket or CDN address."""
    parts = F.split(url, mark.replace(".", r"\."))
    out = F.when(F.size(parts) >= 2, parts[1])
    if cdn:
        out = out.when(F.startswith(url, F.lit(cdn)), F.regexp_replace(F.substring(url, F.lit(len(cdn) + 1), F.length(url)), "^/+", ""))
    return out


def json_slice(text: Column) -> Column:
    """The outermost object of a noisy answer: fenced body first, then first brace to last brace."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))


def json_answer(text: Column, schema: str, probe: str) -> Column:
    """Parse the slice; a trailing comma is the only repair. ``probe`` is a field that must be present."""
    raw = json_slice(text)
    first = F.from_json(raw, schema)
    fixed = F.from_json(F.regexp_replace(raw, r",(\s*[}\]])", "$1"), schema)
    return F.when(first[probe].isNotNull(), first).otherwise(fixed)


ASR_SCHEMA = ("words array<struct<word:string,text:string,start:string,end:string,"
              "offsets:struct<from:double,to:double>,timestamps:struct<from:string,to:string>>>")
CLOCK = r"^\d\d:\d\d:\d\d[.,]\d+$"


def _clock(x: Column) -> Column:
    return F.when(x.rlike(CLOCK), timestamp_to_sec(F.replace(x, F.lit(","), F.lit("."))))


def _asr_time(w: Column, side: str, plain: str) -> Column:
    stamp, offset = w["timestamps"][side], w["offsets"][side]
    number = w[plain].try_cast("double")
    return F.when(stamp.isNotNull(), _clock(stamp)).when(offset.isNotNull(), offset / 1000.0).otherwise(
        F.when(finite_or(number, -1e300) != F.lit(-1e300), number))


def asr_words(json: Column) -> Column:
    """Recogniser JSON -> array of (start, end, word); rows without text or times are dropped, sorted by start."""
    ws = F.from_json(json, ASR_SCHEMA)["words"]
    rows = F.transform(ws, lambda w: F.struct(_asr_time(w, "from", "start").alias("start"), _asr_time(w, "to", "end").alias("end"),
                                              F.trim(F.coalesce(w["word"], w["text"], F.lit(""))).alias("word")))
    good = F.filter(rows, lambda r: (r["word"] != "") & r["start"].isNotNull() & r["end"].isNotNull())
    fixed = F.transform(good, lambda r: F.struct(F.greatest(F.lit(0.0), r["start"]).alias("start"),
                                                 F.greatest(r["end"], F.greatest(F.lit(0.0), r["start"]) + MIN_WORD_SEC).alias("end"), r["word"].alias("word")))
    return F.sort_array(fixed)


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects with size and time; file contents are never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")))


def read_sidecars(spark: SparkSession, path: str, schema: str = ASSET_SCHEMA) -> DataFrame:
    """One-JSON-per-asset sidecars with file time; corrupt ones are dropped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)
    return df.select("*", F.col("_metadata.file_modification_time").alias("mtime")).orderBy(F.desc("mtime"), "asset_id")


def parse_sidecars(df: DataFrame, json: str, schema: str, probe: str) -> DataFrame:
    rec = F.from_json(F.col(json), schema)
    return df.withColumn("__r", rec).filter(F.col(f"__r.{probe}").isNotNull()).drop(json)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions present in ``df``; a re-run gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def guarded_upsert(current: DataFrame, writes: DataFrame, key: str, revision: str, fields: list[str]) -> DataFrame:
    """Latest state per key: a write counts only if its revision is not older than what is stored."""
    both = current.unionByName(writes)
    return both.groupBy(key).agg(F.max_by(F.struct(revision, *fields), F.struct(revision, *fields)).alias("__s")).select(key, "__s.*")


def idempotent_submit(submits: DataFrame, jobs: DataFrame, job_id: str, status: str) -> DataFrame:
    """One row per submitted job id: new, a retry of a failed job, or the existing live one."""
    return (submits.select(job_id).distinct().join(jobs.select(job_id, status), job_id, "left")
            .select(job_id, F.when(F.col(status).isNull(), "new").when(F.col(status) == "failed", "retry").otherwise("existing").alias("action")))


def incremental_describe(items: DataFrame, described: DataFrame, key: str, budget: int = 12) -> DataFrame:
    """The next batch without a description; the rest waits for the next run."""
    return items.join(described.select(key).distinct(), key, "left_anti").orderBy(key).limit(budget)
