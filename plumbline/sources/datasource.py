"""Spark source ``evidence_store``: observations of objects in a store.

Options: ``base`` (folder or URL), ``op`` (head, get, json, list, range, suffix), ``paths`` (one
per line), ``batch`` (paths a task, 64), ``start``, ``length``, ``max_rps`` (for the whole scan,
shared among ``tasks``), ``replay`` (routes as JSON). For reads that depend on rows, use
``observed``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import functions as fn
from .transport import observe, open_store

SCHEMA = "path string, op string, state string, reason string, status int, size bigint, body binary, entries array<string>, error string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class EvidenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        paths = [p for p in self.options.get("paths", "").split("\n") if p]
        size = int(self.options.get("batch", "64"))
        return [Paths(paths[i : i + size]) for i in range(0, len(paths), size)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        o = self.options
        rate = float(o.get("max_rps", "0")) / max(1, int(o.get("tasks", "1")))
        base = o.get("base", "")
        store = open_store(base, o.get("replay"), **({"max_rps": rate} if base.startswith("http") and rate else {}))
        for p in partition.paths:
            row = observe(store, o.get("op", "json"), p, int(o.get("start", "0")), int(o.get("length", "0")))
            yield tuple(row[f] for f in FIELDS)


class EvidenceStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EvidenceReader(dict(self.options))


def with_reason(rows: DataFrame) -> DataFrame:
    """Observations with state and reason of their error texts."""
    e = fn.evidence_of_error("error", listing=True)
    return rows.withColumns({"state": F.when(F.col("error").isNull(), F.col("state")).otherwise(e.state), "reason": F.when(F.col("error").isNull(), F.col("reason")).otherwise(e.reason)})


def scan(spark: SparkSession, base: str, op: str, paths: list[str], **options) -> DataFrame:
    """Observations of a list of paths."""
    spark.dataSource.register(EvidenceStore)
    reader = spark.read.format("evidence_store").option("base", base).option("op", op).option("paths", "\n".join(paths))
    for k, v in options.items():
        reader = reader.option(k, v)
    return with_reason(reader.load())


def observed(rows: DataFrame, base: str, op: str, path_col: str = "path", replay: str | None = None, start_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """Observations of the paths in a column: reads that depend on what was found before. Ranges and
    suffixes take their start and length from columns."""
    zero = F.lit(0).cast("bigint")
    rows = rows.select(F.col(path_col).alias("path"), (F.col(start_col) if start_col else zero).alias("start"), (F.col(length_col) if length_col else zero).alias("length"))

    def run(batches):
        import pandas as pd

        store = open_store(base, replay)
        for b in batches:
            yield pd.DataFrame([observe(store, op, p, int(s), int(n)) for p, s, n in zip(b["path"], b["start"], b["length"])], columns=FIELDS)

    return with_reason(rows.mapInPandas(run, SCHEMA))
