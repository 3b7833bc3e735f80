"""Structured Streaming over the events: windowed counts and latest findings.

The surveyed system has no streams; these are extensions of our own. Streams run until what is
there has been read (``availableNow``), with checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import new_path

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{sf_dir}/events.parquet"
    fields = spark.read.parquet(table).schema
    # a table is a file or a folder of files
    return spark.readStream.schema(fields).option("recursiveFileLookup", "true").parquet(table) if _is_folder(spark, table) else spark.readStream.schema(fields).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type: each micro-batch is counted and stored under its number, then merged. No
    watermark drops what comes late, no state grows with the windows, and a batch that is run again
    takes the place of what it wrote before."""
    out = new_path(spark, "hourly")

    def counted(batch: DataFrame, number: int) -> None:
        hour = F.window(F.col("ts").cast("timestamp"), "1 hour").start
        batch.groupBy(hour.alias("window_start"), "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    events(spark, sf_dir).writeStream.foreachBatch(counted).option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("window_start timestamp, event_type string, n bigint").parquet(out)
    return rows.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.sum("n").alias("n"))


def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type: each micro-batch is reduced and appended, then merged."""
    out = new_path(spark, "latest")

    def reduce(batch: DataFrame, number: int) -> None:
        batch.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_event")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    events(spark, sf_dir).writeStream.foreachBatch(reduce).option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy(F.col("user_id").alias("root"), F.col("event_type").alias("code")).agg(F.max("last_event").alias("last_event"))
