"""Projections and aggregates over operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.numeric import half_up
from chronoweave.operators.scans import running_sum, scan

# Fixed values.
LIST_DEFAULT, LIST_MAX = 50, 200
BATCH = 1000
MIN_SHARE, MIN_BYTES = 0.85, 10_000


def project_list(df: DataFrame, created: str, key: str, status: str | None = None, limit: int = LIST_DEFAULT) -> DataFrame:
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df.orderBy(F.desc(created), key).limit(max(1, min(LIST_MAX, limit)))


def progress(done: Column, total: Column) -> tuple[Column, Column]:
    pct = 45 + half_up(done / F.greatest(F.lit(1), total) * 50)
    stage = F.when(total > 1, F.concat(F.lit("Mining chunk "), done.cast("string"), F.lit("/"), total.cast("string"))).otherwise("Finding the clips")
    return pct, stage


def storage_total(projects: DataFrame, clips: DataFrame, key: str, size: str) -> DataFrame:
    sums = clips.groupBy(key).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("bytes"))
    return projects.select(key).join(sums, key, "left").select(key, F.coalesce("bytes", F.lit(0)).alias("bytes"))


def pipeline_timings(df: DataFrame, group: str, ingest: str, mining: str) -> DataFrame:
    """Totals and exact percentiles from per-second counts (bounded by the range of seconds, not by rows)."""
    c = df.withColumn("total", F.col(ingest) + F.col(mining)).groupBy(group, "total").agg(F.count("*").alias("n"))
    return c.groupBy(group).agg(F.sum("n").alias("projects"), F.sum(F.col("total") * F.col("n")).alias("total_sec"),
                                F.percentile("total", F.lit(0.5), F.col("n")).alias("p50"), F.percentile("total", F.lit(0.9), F.col("n")).alias("p90"))


def usage_rollup(df: DataFrame, dims: list[str], tokens: Column, cost: Column) -> DataFrame:
    return df.rollup(*dims).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.sum(cost).alias("cost"))


def merge_clips(clips: DataFrame, owner: str, pos: str) -> DataFrame:
    """Ordered parts of one owner (a user's selection) as one clip; the strongest part gives the display fields.

    Columns: start_ms, end_ms, text, score, themes (array), clip_id.
    """
    parts = F.array_sort(F.collect_list(F.struct(pos, "text", "themes")))
    g = clips.groupBy(owner).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
                                 F.max_by("clip_id", F.struct(F.col("score"), -F.col(pos))).alias("strongest"), F.max("score").alias("score"),
                                 (F.max("rank") + 1).alias("rank"), F.count("*").alias("parts"), parts.alias("p"))
    g = g.filter("parts >= 2").withColumn("transcript", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"))
    return g.withColumn("themes", F.slice(F.array_distinct(F.flatten(F.transform("p", lambda x: x["themes"]))), 1, 6)).drop("p")


def segments_summary(segs: DataFrame, owner: str) -> DataFrame:
    return segs.groupBy(owner).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def selected_bytes(rows: DataFrame, selection: DataFrame, key: str, size: str) -> DataFrame:
    return rows.join(selection.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def batch_keys(keys: DataFrame, key: str, bucket: Column, batch: int = BATCH) -> DataFrame:
    """Distinct keys numbered into batches; the numbering is a bucketed scan, not one global window."""
    d = keys.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("__one", F.lit(1))
    n = scan(d, ["__one"], [key], bucket, rn=running_sum(F.lit(1).cast("long"), False))
    return n.select(key, F.floor(F.col("rn") / batch).alias("batch"))


def invalid_renders(df: DataFrame, actual: Column, expected: Column, size: Column) -> DataFrame:
    why = F.when(size < MIN_BYTES, "too_small").when(actual < expected * MIN_SHARE, "too_short")
    return df.withColumn("reason", why).filter("reason IS NOT NULL")
