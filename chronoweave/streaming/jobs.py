"""Structured Streaming jobs over an event log (file source, ``availableNow``).

Late-data policy (ours): rows older than the watermark are dropped and counted.
State is keyed per job; one micro-batch of a key is bounded by the trigger.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from chronoweave.operators import joins
from chronoweave.operators.series import Linker
from chronoweave.operators.staging import stage_root

# Fixed values.
MAX_ATTEMPTS = 2
MAX_REDELIVERIES = 5
BASE_DELAY_SEC = 5
THROTTLE_DONE = 99
REARM = 0.25

FILES_PER_BATCH = 64


def read_log(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """Stream one table's file out of a folder, with the schema the table has."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _new_path(spark: SparkSession) -> str:
    return f"{stage_root(spark)}/chronoweave/stream-{uuid.uuid4().hex}"


def _empty(spark: SparkSession, schema: StructType, path: str) -> None:
    spark.createDataFrame([], schema).write.parquet(path)


def run_append(df: DataFrame, path: str | None = None) -> tuple[DataFrame, list]:
    """Drain what is available into a Parquet table; a second call with the same path continues from the checkpoint."""
    spark = df.sparkSession
    path = path or _new_path(spark)
    q = (df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data").option("checkpointLocation", f"{path}/ck")
         .trigger(availableNow=True).start())
    seen = {}
    while True:  # a query keeps only its last progress reports, so they are gathered while it runs
        done = q.awaitTermination(1)
        seen.update({(p["runId"], p["batchId"], p["timestamp"]): p for p in q.recentProgress})
        if done:
            return spark.read.schema(df.schema).parquet(f"{path}/data"), list(seen.values())


def run_update(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drain an aggregate in update mode: each batch writes the keys it changed, readers take a key's latest batch.

    A batch writes under its own number, so a repeated batch overwrites itself; state past the watermark is freed.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    _empty(spark, df.schema, f"{path}/data/batch=-1")  # an empty log has no batch
    q = (df.writeStream.outputMode("update").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True)
         .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/data/batch={n}")).start())
    q.awaitTermination()
    log = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/data")
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("s"))
    return last.select(*keys, "s.*")


def run_complete(df: DataFrame) -> DataFrame:
    """Drain a complete-mode aggregate (session windows know no update mode); the table always holds the latest full result."""
    path = _new_path(df.sparkSession)
    _empty(df.sparkSession, df.schema, f"{path}/data")
    q = (df.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True)
         .foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{path}/data")).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")


def latest_status(log: DataFrame, key: str, revision: str, fields: list[str]) -> DataFrame:
    """Current state per entity; an older revision never replaces a newer one."""
    return log.groupBy(key).agg(F.max_by(F.struct(revision, *fields), revision).alias("s")).select(key, "s.*")


def dedupe_jobs(log: DataFrame, job: str, delay: str) -> DataFrame:
    return log.withWatermark("ts", delay).select(job, "ts").dropDuplicatesWithinWatermark([job]).select(job)


def stage_throughput(log: DataFrame, stage: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.withWatermark("ts", delay).groupBy(w.alias("w"), stage).agg(F.count("*").alias("n"))


def speech_sessions(log: DataFrame, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    return log.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def fan_in_progress(log: DataFrame, key: str, done: Column, total: int) -> DataFrame:
    return log.groupBy(key).agg(F.count_if(done).alias("done")).withColumn("complete", F.col("done") >= total)


def asof_enrich(log: DataFrame, spans: DataFrame, key: str, t: str, bin_ms: float) -> DataFrame:
    """Each event joined to the spans in force at its time (stream-static, binned equi-join)."""
    return joins.points_in_spans(log, spans, [key], t, F.col("start_ms"), F.col("end_ms") - 1, bin_ms)


def keyed_fold(log: DataFrame, key: str, order: str, fields: list[str], out: str, state: str, init: tuple, step: Callable) -> DataFrame:
    """Run ``step(state, row) -> (state, output row or None)`` over each key's rows in order, state kept between batches."""
    def run(k: tuple, chunks: Iterator[pd.DataFrame], st: GroupState):
        s = tuple(st.get) if st.exists else init
        rows = []
        for r in pd.concat(list(chunks)).sort_values(order).itertuples(index=False):
            s, o = step(s, r)
            if o is not None:
                rows.append((k[0], int(getattr(r, order)), *o))
        st.update(s)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(",")])

    return log.select(key, order, *fields).groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def retry_state(log: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """Attempts so far, the exponential delay before the next one, and whether the job is final."""
    def step(s, r):
        if not getattr(r, failed):
            return s, None
        n = s[0] + 1
        return (n,), (n, BASE_DELAY_SEC * 2 ** min(n - 1, 30), n >= MAX_ATTEMPTS)
    return keyed_fold(log, key, order, [failed], f"{key} long,{order} long,attempts long,delay_sec long,final boolean", "n long", (0,), step)


def progress_throttle(log: DataFrame, key: str, order: str, min_gap: int) -> DataFrame:
    """Emit on change when enough time has passed, always near the end."""
    def step(s, r):
        last_t, last_p = s
        go = last_p < 0 or (r.pct != last_p and (r.t_ms - last_t >= min_gap or r.pct >= THROTTLE_DONE))
        return ((int(r.t_ms), int(r.pct)), (int(r.pct),)) if go else (s, None)
    return keyed_fold(log, key, order, ["t_ms", "pct"], f"{key} long,{order} long,pct long", "t long, p long", (0, -1), step)


def switch_detector(log: DataFrame, key: str, order: str, hold: int) -> DataFrame:
    """A challenger takes over after leading ``hold`` frames in a row; one row per frame."""
    def step(s, r):
        cur, ch, n = s
        cur = cur or r.best
        lead = bool(r.clear) and r.best != cur
        n = (n + 1 if ch == r.best else 1) if lead else 0
        if lead and n >= hold:
            return (r.best, "", 0), (r.best, True)
        return (cur, r.best if lead else "", n), (cur, False)
    return keyed_fold(log, key, order, ["best", "clear"], f"{key} long,{order} long,choice string,switched boolean", "cur string, ch string, n long", ("", "", 0), step)


def crossing_once(log: DataFrame, key: str, order: str, mark: float, rearm: float) -> DataFrame:
    """Fire once when a clock passes a mark; a jump back re-arms it."""
    def step(s, r):
        prev, fired = s
        fired = fired and r.pos >= prev - rearm
        go = prev <= mark <= r.pos and not fired
        return (float(r.pos), bool(fired or go)), ((True,) if go else None)
    return keyed_fold(log, key, order, ["pos"], f"{key} long,{order} long,fired boolean", "prev double, fired boolean", (0.0, False), step)


def stalled_jobs(log: DataFrame, key: str, order: str, done: str, timeout_ms: int, delay: str) -> DataFrame:
    """A row per stall: ``key, stall_ms, last_ms, redeliveries, final``.

    A job stalls when no event of it comes for the timeout; it is then delivered again
    and may stall again after another timeout. The stall after ``MAX_REDELIVERIES``
    redeliveries is final: later events do not revive the job. An event with ``done``
    ends the job; one after that starts it anew. Deadlines between two events of a batch
    count as they come, those after the last event by event-time timers, so the rows do
    not depend on how the log is cut into batches. State per job is four numbers.
    """
    w = log.withWatermark("ts", delay).select(key, order, "ts", F.unix_millis("ts").alias("t_ms"), F.col(done).alias("done"))
    kind = next(f.dataType.simpleString() for f in w.schema if f.name == key)
    schema = f"{key} {kind}, stall_ms bigint, last_ms bigint, redeliveries bigint, final boolean"
    names = [f.strip().split()[0] for f in schema.split(",")]

    class Watch(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.job = handle.getValueState("job", "deadline bigint, last bigint, stalls bigint, final boolean")

        def _stalls(self, k, s: list, until: int) -> list[tuple]:
            """Stalls up to ``until``; changes ``s``."""
            out = []
            while s[0] >= 0 and not s[3] and s[0] <= until:
                s[2] += 1
                s[3] = s[2] > MAX_REDELIVERIES
                out.append((k, s[0], s[1], s[2], s[3]))
                s[0] += timeout_ms
            return out

        def _keep(self, s: list) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if s[0] >= 0 and not s[3]:
                self.handle.registerTimer(s[0])
            self.job.update(tuple(s))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            s = list(self.job.get()) if self.job.exists() else [-1, -1, 0, False]
            out = []
            events = pd.concat(list(rows)).sort_values(["t_ms", order])
            for t, ended in zip(events["t_ms"].tolist(), events["done"].fillna(False).tolist()):
                out += self._stalls(key[0], s, t - 1)
                if s[3]:
                    break
                s = [-1, t, 0, False] if ended else [t + timeout_ms, t, s[2], False]
            self._keep(s)
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            s = list(self.job.get())
            out = self._stalls(key[0], s, timerValues.getCurrentWatermarkInMs())
            self._keep(s)
            yield pd.DataFrame(out, columns=names)

        def close(self) -> None:
            pass

    return w.groupBy(key).transformWithStateInPandas(Watch(), schema, "Append", "EventTime")


def linked_detections(log: DataFrame, key: str, frame_ms: int, gate: float, delay: str) -> DataFrame:
    """Stream twin of ``series.link_tracks``: ``key, seq, shot, track`` of every frame that the watermark has closed.

    ``log``: key, seq, ts, t_ms, x, y, cut; a row with ``cut`` starts a new shot. Rows wait in
    the state until their frame (``t_ms`` in steps of ``frame_ms``) is over, then a timer links
    it and lets them go: what stays is the rows of open frames and the live tracks. A key has
    one timer, for the first of its open frames; it links all frames that are over by then.
    """
    w = log.withWatermark("ts", delay).select(key, "seq", "ts", "t_ms", "x", "y", F.coalesce("cut", F.lit(False)).alias("cut"), (F.unix_millis("ts") - F.col("t_ms")).alias("origin"))
    kind = w.schema[key].dataType.simpleString()
    names = [key, "seq", "shot", "track"]

    def over_at(r: tuple) -> int:
        return (r[0] // frame_ms + 1) * frame_ms + r[5]

    class Link(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "t_ms bigint, seq bigint, x double, y double, cut boolean, origin bigint")
            self.tracks = handle.getValueState("tracks", "state string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new = [tuple(r) for b in rows for r in zip(*(b[c].tolist() for c in ("t_ms", "seq", "x", "y", "cut", "origin")))]
            self.waiting.appendList(new)
            due, held = min(map(over_at, new)), list(self.handle.listTimers())
            if not held or due < min(held):
                self.handle.registerTimer(due)
                for t in held:
                    self.handle.deleteTimer(t)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            mark = timerValues.getCurrentWatermarkInMs()
            rows = sorted(tuple(r) for r in self.waiting.get())
            ready, rest = [r for r in rows if over_at(r) <= mark], [r for r in rows if over_at(r) > mark]
            state = self.tracks.get()
            state = json.loads(state[0]) if state else {"shot": 0, "live": [], "next": 0, "frame": None}
            linker, shot, out = Linker(gate, state["live"], state["next"], state["frame"]), state["shot"], []
            frames = []  # (shot, frame, rows): a cut within a frame parts it
            for r in ready:
                shot += r[4]
                if not frames or frames[-1][:2] != (shot, r[0] // frame_ms):
                    frames.append((shot, r[0] // frame_ms, []))
                frames[-1][2].append(r)
            at = state["shot"]
            for shot, frame, held in frames:
                if shot != at:
                    linker, at = Linker(gate), shot
                held.sort(key=lambda r: r[1])
                out += [(key[0], r[1], shot, t) for r, t in zip(held, linker.link(frame, [(r[2], r[3]) for r in held]))]
            self.tracks.update((json.dumps({"shot": at, "live": linker.live, "next": linker.next, "frame": linker.frame}),))
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(map(over_at, rest)))
            else:
                self.waiting.clear()
            yield pd.DataFrame(out, columns=names)

        def close(self) -> None:
            pass

    return w.groupBy(key).transformWithStateInPandas(Link(), f"{key} {kind}, seq bigint, shot bigint, track bigint", "Append", "EventTime")


@contextmanager
def keyed_timers(spark: SparkSession):
    """The state store that timers need, for the queries started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_turns(spark: SparkSession, parts: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list]:
    """Deliver parts one after another to the same query (same checkpoint), as a restarted job would see them."""
    src, path, progress, out = _new_path(spark), _new_path(spark), [], None
    for p in parts:
        p.write.mode("append").parquet(src)
        out, prog = run_append(build(spark.readStream.schema(parts[0].schema).parquet(src)), path)
        progress.extend(prog)
    return out, progress


def late_rows(spark: SparkSession, parts: list[DataFrame], key: str, delay: str) -> DataFrame:
    """Rows kept, and rows the watermark dropped and counted."""
    kept, progress = in_turns(spark, parts, lambda s: s.withWatermark("ts", delay).dropDuplicates([key, "ts"]).select(key))
    dropped = sum(int(o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"])
    return kept.agg(F.count("*").alias("kept")).withColumn("dropped", F.lit(dropped).cast("long"))


def stage_chain(log: DataFrame, ingest: Callable[[DataFrame], DataFrame], mining: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each ingest batch writes its table and triggers the mining rows; both are keyed by batch id, so a retry overwrites itself."""
    spark = log.sparkSession
    path = _new_path(spark)

    def chain(batch: DataFrame, batch_id: int) -> None:
        ingest(batch).write.mode("overwrite").parquet(f"{path}/ingest/batch={batch_id}")
        mining(spark.read.parquet(f"{path}/ingest/batch={batch_id}")).write.mode("overwrite").parquet(f"{path}/mining/batch={batch_id}")

    log.writeStream.option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).foreachBatch(chain).start().awaitTermination()
    return spark.read.parquet(f"{path}/mining").drop("batch")
