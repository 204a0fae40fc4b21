"""Written intermediate tables: cut lineage where a result is read more than once.

The table goes to the shared folder named by ``spark.checkpoint.dir``, so it
survives the loss of executors. In local mode, where driver and executors are one
machine, a temporary folder stands in for an absent setting; on a cluster that is
an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="chronoweave-stage-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _LOCAL[app]


def stage(df: DataFrame, hint: str = "t") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/chronoweave/{hint}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
