"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task turns into objects at once, and bytes of an Arrow batch.
BATCH_ROWS = 512
BATCH_BYTES = 4_000_000
#: Rows of a few bytes each that may be sent to all tasks (some 32 MB).
FEW_ROWS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, as texts can be long; a bound that is smaller
    already stays. All operators ask for the same, so their order does not matter."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``; at the end, ``release``."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def release() -> None:
    """Give back the memory that Arrow and the C library hold for reuse: at the end of a task, as its worker may stay idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; a folder of our own is made only where that is unset and
    Spark runs in one process (tests). On a cluster that is an error, as machines share no folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that ran on it, and nothing that
    was made by earlier jobs is made again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more: what was made of it is stored itself."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df`` (stored, narrow rows) marked for broadcasting if it has at most ``rows`` rows; a
    larger one is left to shuffled joins."""
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(col: str = "text"):
    """Null text counts as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))
