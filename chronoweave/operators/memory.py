"""Preference memory, edit diffs and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.numeric import half_up
from chronoweave.functions.text import squash, squeeze
from chronoweave.operators.scans import running_sum, scan

# Fixed values.
LESSON_LIMIT = 18
CROWDED, KEEP = 40, 20
HISTORY = 12
MAX_ATTEMPTS = 2
JOB_LIST = 40
GLOBAL = "global"


def lessons_for(lessons: DataFrame, projects: DataFrame, project: str, limit: int = LESSON_LIMIT) -> DataFrame:
    """Strongest, newest lessons per project, shared ones included.

    Only the best ``limit`` shared lessons can ever appear, so at most that many rows meet every project.
    """
    order = [F.desc("weight"), F.desc("at"), F.asc("lesson_id")]
    shared = lessons.filter(F.col("scope") == GLOBAL).orderBy(*order).limit(limit)
    everywhere = projects.select(project).distinct().withColumn("__one", F.lit(1)).join(F.broadcast(shared.withColumn("__one", F.lit(1))), "__one").drop("__one", "scope")
    own = lessons.filter(F.col("scope") != GLOBAL).withColumnRenamed("scope", project)
    w = Window.partitionBy(project).orderBy(*order)
    both = own.unionByName(everywhere)
    return both.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def review_lessons(reviews: DataFrame, key: str, review: str) -> DataFrame:
    """Reviews below 8 teach their first two issues, when these carry a fix."""
    r = reviews.filter(F.col(review)["score"] < 8).select(key, F.explode(F.slice(F.col(review)["issues"], 1, 2)).alias("i"))
    r = r.filter(F.coalesce(F.col("i.fix"), F.lit("")) != "")
    return r.select(key, F.substring(F.concat("i.what", F.lit(" → "), "i.fix"), 1, 400).alias("text"), F.lit(4).alias("weight"))


def feedback_lessons(df: DataFrame, verdict: Column, note: Column, scope: Column) -> DataFrame:
    down = verdict == "down"
    text = F.concat(F.when(down, "Avoid: ").otherwise("Keep doing: "), F.trim(note))
    return df.filter(F.trim(note) != "").withColumn("text", text).withColumn("weight", F.when(down, 9).otherwise(8)).withColumn("scope", scope)


def crowded_scopes(lessons: DataFrame, scope: str, order: str, above: int = CROWDED, keep: int = KEEP) -> DataFrame:
    """Scopes with too many lessons: equal texts merge (the later wins), then the strongest are kept."""
    crowded = lessons.groupBy(scope).agg(F.count("*").alias("n")).filter(F.col("n") > above)
    key = squash(F.col("text"))
    merged = lessons.withColumn("__k", key).groupBy(scope, "__k").agg(F.max_by(F.struct(order, "weight", "text"), order).alias("l"))
    merged = merged.join(crowded.select(scope), scope, "left_semi").select(scope, "l.*")
    w = Window.partitionBy(scope).orderBy(F.desc("weight"), F.desc(order))
    return merged.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= keep)


def describe_plan(spans: DataFrame, keys: list[str], order: list[str], line: Column, bucket: Column) -> DataFrame:
    """Numbered text lines per lane, one row per line; a long lane is numbered by a bucketed scan."""
    n = scan(spans.select(*keys, *order, line.alias("line"), bucket.alias("__o")), keys, order, F.col("__o"), line_no=running_sum(F.lit(1).cast("long"), False))
    return n.select(*keys, "line_no", "line")


def lane_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Lanes whose lines differ between two states (absent lanes included), with how many lines do."""
    on = [*keys, "line_no"]
    j = before.withColumnRenamed("line", "__b").join(after.withColumnRenamed("line", "__a"), on, "full")
    changed = F.count_if(~F.col("__b").eqNullSafe(F.col("__a")))
    return j.groupBy(*keys).agg(changed.alias("changed")).filter("changed > 0")


def apply_selection(current: DataFrame, candidates: DataFrame, chosen: DataFrame, keys: list[str], item: str) -> DataFrame:
    """User rows stay; candidate rows follow, enabled where the answer chose them."""
    mark = chosen.select(*keys, item).distinct().withColumn("__on", F.lit(True))
    c = candidates.join(mark, [*keys, item], "left").select(*keys, item, F.coalesce("__on", F.lit(False)).alias("enabled"), F.lit("director").alias("source"))
    u = current.filter(F.col("source") == "user").select(*keys, item, "enabled", "source")
    return u.unionByName(c)


def lane_merge(current: DataFrame, answer: DataFrame, locked: DataFrame, keys: list[str]) -> DataFrame:
    """A lane's lines are replaced only when answered and not locked."""
    replaced = answer.select(*keys).distinct().join(locked, keys, "left_anti")
    return current.join(replaced, keys, "left_anti").unionByName(answer.join(replaced, keys, "left_semi"))


def place_without_repeat(user: DataFrame, placed: DataFrame, owner: str, asset: str, order: str, cap: int) -> DataFrame:
    """Placements whose asset the user already laid are dropped; user rows first, then placements up to the cap."""
    fresh = placed.join(user.select(owner, asset).distinct(), [owner, asset], "left_anti")
    both = user.withColumn("__p", F.lit(0)).unionByName(fresh.withColumn("__p", F.lit(1)))
    w = Window.partitionBy(owner).orderBy("__p", order)
    return both.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= cap).drop("__p")


def turn_history(turns: DataFrame, key: str, order: str, keep: int = HISTORY) -> DataFrame:
    """The last turns per conversation in order, empty ones dropped."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    t = turns.filter(squeeze(F.col("text")) != "").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep)
    return t.drop("__n")


def latest_standing(turns: DataFrame, saved: DataFrame, key: str, order: str) -> DataFrame:
    """Newest pass that was not taken back, with its saved before-state if there is one."""
    p = turns.filter((F.coalesce("kind", F.lit("pass")) == "pass") & ~F.coalesce("undone", F.lit(False)))
    last = p.groupBy(key).agg(F.max(order).alias(order))
    return last.join(saved, [key, order], "left")


def undo_apply(turns: DataFrame, standing: DataFrame, key: str, order: str) -> DataFrame:
    """Mark the standing pass undone and append a turn that says so; no before-state means no change."""
    can = standing.filter(F.col("before").isNotNull()).select(key, F.col(order).alias("__at"))
    t = turns.join(can, key, "left").withColumn("undone", F.coalesce("undone", F.lit(False)) | F.coalesce(F.col(order) == F.col("__at"), F.lit(False)))
    t = t.select(key, order, "kind", "undone")
    tops = turns.groupBy(key).agg((F.max(order) + 1).alias(order))
    extra = tops.join(can.select(key), key, "left_semi").select(key, order, F.lit("undo").alias("kind"), F.lit(False).alias("undone"))
    return t.unionByName(extra)


def job_swap_in(spans: DataFrame, jobs: DataFrame, span: str) -> DataFrame:
    """A finished job's asset replaces the asset of the span it was made for."""
    done = jobs.filter("status = 'done'").select(span, F.col("asset").alias("__a"))
    return spans.join(done, span, "left").withColumn("asset", F.coalesce("__a", "asset")).drop("__a")


def retry_exhausted(events: DataFrame, job: str, failed: Column, order: str, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs whose last event is a failure: final when attempts are used up, else pending."""
    g = events.groupBy(job).agg(F.count_if(failed).alias("failures"), F.max_by(failed, order).alias("last_failed"))
    return g.filter("last_failed").select(job, "failures", F.when(F.col("failures") >= attempts, "failed").otherwise("pending").alias("state"))


def lenient_number(x: Column, lo: float, hi: float, digits: int | None = None) -> Column:
    """Coerce to a number and clamp; what is not a finite number becomes null (dropped)."""
    v = x.try_cast("double")
    v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    v = v if digits is None else half_up(v, digits)
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def strict_number(x: Column, lo: float, hi: float, name: str) -> Column:
    """Null when fine, else the reason a strict reader would raise."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(f"{name} is not a number")).when((v < lo) | (v > hi), F.lit(f"{name} is out of range"))
