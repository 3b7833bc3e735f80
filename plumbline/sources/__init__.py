"""Where evidence comes from and goes to: stores, headers, tables in the shared folder, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only
    where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back, cutting its lineage."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, as a path for plain file access: for stores of many small objects,
    which have no Spark writer. The shared folder must be mounted where tasks run."""
    path = new_path(spark, name)
    scheme, _, rest = path.partition(":")
    if "/" not in scheme and rest and scheme != "file":
        raise RuntimeError(f"objects can't be written to {path}: the shared folder is no mounted file system")
    return "/" + path.removeprefix("file:").lstrip("/")
