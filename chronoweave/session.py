"""Session builder for tests and the bench. On a cluster the submitter's own settings win."""

from __future__ import annotations



from pyspark.sql import SparkSession


def build(master: str | None = None, partitions: int | None = None, memory: str = "12g", app: str = "chronoweave") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    b = (b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    spark = b.getOrCreate()


    spark.sparkContext.setLogLevel("ERROR")
    return spark
