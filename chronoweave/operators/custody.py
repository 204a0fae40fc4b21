"""Orphans, retention and reconciliation as reports; nothing is ever deleted.

Every rule is a semi or anti join on the key, an age filter and a sum. ``now``
is always passed in, so a report is a function of its inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
OBJECT_ID = r"^[0-9a-f]{24}$"
YOUNG_SEC = 15 * 60
STOCK_SEC = 24 * 3600


def older(modified: Column, now: Column, seconds: int) -> Column:
    return modified < now - seconds


def orphan_objects(objects: DataFrame, clips: DataFrame, project: str, key: str, now: Column, young_sec: int = YOUNG_SEC) -> DataFrame:
    """Per project: objects no live clip names. Young ones are only counted; nothing counts while a clip renders.

    ``objects``: project, key, size, modified. ``clips``: project, key, rendering.
    """
    busy = clips.groupBy(project).agg(F.bool_or("rendering").alias("rendering"))
    orphan = objects.join(clips.select(key).distinct(), key, "left_anti").join(busy, project, "left").filter(~F.coalesce("rendering", F.lit(False)))
    old = older(F.col("modified"), now, young_sec)
    return orphan.groupBy(project).agg(F.count_if(old).alias("orphans"), F.coalesce(F.sum(F.when(old, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(~old).alias("skipped_young"))


def orphan_dirs(files: DataFrame, projects: DataFrame, dir_name: str, project: str) -> DataFrame:
    """Directories named like a project id without a project, with the size they hold."""
    return (files.filter(F.col(dir_name).rlike(OBJECT_ID)).groupBy(dir_name).agg(F.sum("size").alias("bytes"))
            .join(projects.select(F.col(project).alias(dir_name)).distinct(), dir_name, "left_anti"))


def unowned_outputs(files: DataFrame, projects: DataFrame, clips: DataFrame, project: str, path: str, now: Column, age_sec: int) -> DataFrame:
    """Old files of live projects that no clip path names."""
    live = files.filter(older(F.col("modified"), now, age_sec)).join(projects.select(project).distinct(), project, "left_semi")
    return live.join(clips.select(path).distinct(), path, "left_anti")


def abandoned_uploads(files: DataFrame, owners: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Files that none of the owner columns names."""
    named = None
    for c in columns:
        one = owners.select(F.col(c).alias(path)).filter(F.col(path).isNotNull())
        named = one if named is None else named.unionByName(one)
    return files.join(named.distinct(), path, "left_anti")


def media_fragments(files: DataFrame, projects: DataFrame, project: str, now: Column, age_sec: int) -> DataFrame:
    """Classify media files: orphan directory, live file, cache entry, young, or fragment.

    ``projects``: project, media_status, media_path. Also flags projects whose lost source resets their status.
    """
    j = files.join(projects.select(project, "media_status", "media_path"), project, "left")
    live = (F.col("media_status") == "ready") & (F.col("media_path") == F.col("path"))
    cls = (F.when(F.col("media_status").isNull(), "orphan_dir").when(live, "live").when(F.col("name") == "matte", "cache")
           .when(~older(F.col("modified"), now, age_sec), "young").otherwise("fragment"))
    j = j.withColumn("class", cls)
    reset = (F.col("class") == "fragment") & (F.col("name") == "source.mp4") & (F.col("media_status") != "ready")
    return j.withColumn("reset_status", F.coalesce(reset, F.lit(False)))


def cache_owner_check(cached: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """A cached file is kept only when its owner row names exactly that path."""
    o = owners.select(owner, F.col("path").alias("owned"))
    return cached.join(o, owner, "left").withColumn("keep", F.coalesce(F.col("owned") == F.col("path"), F.lit(False))).drop("owned")


def unreferenced(assets: DataFrame, references: DataFrame, asset: str, refs: str, now: Column, age_sec: int = STOCK_SEC) -> DataFrame:
    """Old stock assets no plan refers to; uploads are never listed."""
    used = references.select(F.explode(refs).alias(asset)).distinct()
    return assets.filter((F.col("kind") == "stock") & older(F.col("modified"), now, age_sec)).join(used, asset, "left_anti")


def ttl_sweep(files: DataFrame, now: Column, age_sec: int) -> DataFrame:
    return files.filter(older(F.col("modified"), now, age_sec))


def freed_report(removed: DataFrame) -> DataFrame:
    """Removed count and bytes by sweep and reason, by sweep, and in total."""
    return removed.rollup("sweep", "reason").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("removed"), F.sum("size").alias("bytes"))


def promote_shared(shared: DataFrame, project_items: DataFrame, name: str, item: str) -> DataFrame:
    """Project items join the shared library once per name; a name that exists there already wins."""
    fresh = project_items.join(shared.select(name).distinct(), name, "left_anti")
    return fresh.groupBy(name).agg(F.min(item).alias(item))
