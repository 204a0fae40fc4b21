"""Contiguous shards of near-equal byte size from global prefix sums; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.staging import stage

OVERHEAD = 16


def prefix_sums(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add exclusive running sums over a global order.

    Rows are range-partitioned on ``order``; each part is summed, the part totals
    (one row per part) are scanned, and a part's offset is added to the running
    sum inside it. A run of equal leading keys is split by the later ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = stage(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = part.groupBy("__part").agg(*[F.sum(v).alias(f"__t_{k}") for k, v in values.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in values])
    inside = Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = part.select("*", *[(F.sum(v).over(inside) - F.col(v)).alias(f"__w_{k}") for k, v in values.items()])
    joined = summed.join(F.broadcast(offsets), "__part")  # one row per part
    return joined.select(*df.columns, *[(F.col(f"__o_{k}") + F.col(f"__w_{k}")).alias(k) for k in values])


def byte_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: shards 0 to ``shards - 1`` of near-equal bytes.

    Rows are ordered by (text hash, doc_id), so copies of a text are neighbours.
    The total is cut at equal targets; a row goes to the shard its first byte
    falls in. Copies of a text move together to the shard of their first byte as
    long as all of them are no larger than the largest single row, so that no
    shard differs from its target by more than that; a larger group spans the
    shards it has to. Null texts have no bytes and the checksum of an empty text;
    null ids sort first; equal rows get neighbouring slots. Extra columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), F.lit(1).cast("long").alias("one"))
    summed = stage(prefix_sums(rows, ["h1", "h2", "doc_id"], {"at": "size", "row_no": "one"}), "summed")
    whole = summed.agg(F.sum("size").alias("total"), F.max("size").alias("largest")).first()
    total, largest = whole["total"] or 1, whole["largest"] or 0
    copies = summed.groupBy("h1", "h2").agg(F.min("at").alias("start"), F.sum("size").alias("bytes"), F.count("*").alias("n")).where(
        (F.col("n") > 1) & (F.col("bytes") <= largest)).select("h1", "h2", "start")
    copies = stage(copies, "copies")  # a table of its own, so that the join can split a very common text
    cut = summed.join(copies, ["h1", "h2"], "left").withColumn(
        "shard", F.expr(f"cast(least(cast(coalesce(start, at) as decimal(38,0)) * {shards} div {total}, {shards - 1}) as int)"))
    first = cut.groupBy("shard").agg(F.min("row_no").alias("first"))  # one row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("first")).alias("slot"))
