"""Sinks: JSON lines, CSV with empty text for null, one-document JSON, and runs with their provenance."""

from __future__ import annotations

import json
import platform
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import files, new_path


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; fails if the folder exists, so nothing is overwritten."""
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and text columns; null as the empty string, quotes doubled."""
    text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    text.write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text; what is missing is the empty string."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(", ".join(f"{c} string" for c in columns)).csv(path)
    return df.fillna("")


def write_document(df: DataFrame, path: str) -> None:
    """A summary of one row as a JSON document."""
    df.limit(1).coalesce(1).write.mode("errorifexists").json(path)


class Run:
    """Outputs of one run in a folder, with a manifest beside them.

    An output is written to a folder of its own and renamed into place when it is whole, so a run that is
    killed leaves what was there before. What was there is kept: it is renamed to
    ``<name>.<time>.bak``, with a number if that is taken. Counters are observed by the job that writes
    the output, not by one of their own. The manifest is written at each output and when the run ends.
    """

    FORMATS = {"jsonl": ("json", {}), "csv": ("csv", {"header": True, "escape": '"', "emptyValue": ""}), "parquet": ("parquet", {}), "text": ("text", {})}

    def __init__(self, spark: SparkSession, folder: str, tool: str, argv: list[str] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.data = {
            "tool": tool, "argv": argv or [], "host": platform.node(), "spark": spark.version, "python": platform.python_version(),
            "started": _now(), "finished": None, "ok": None, "error": None, "counters": {}, "outputs": {},
        }
        files.make(spark, self.folder)
        self.manifest = f"{self.folder}/{tool}.manifest.json"
        self._kept(self.manifest)

    def __enter__(self) -> "Run":
        self._save()
        return self

    def __exit__(self, kind, error, _) -> None:
        self.data |= {"finished": _now(), "ok": kind is None, "error": None if kind is None else f"{kind.__name__}: {error}"[:500]}
        self._save()

    def _save(self) -> None:
        files.write_text(self.spark, self.manifest, json.dumps(self.data, indent=1))

    def _kept(self, path: str) -> str | None:
        """Move what is at a path out of the way; never over an earlier one."""
        if not files.exists(self.spark, path):
            return None
        kept = base = f"{path}.{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}.bak"
        n = 0
        while files.exists(self.spark, kept):
            n += 1
            kept = f"{base}.{n}"
        files.rename(self.spark, path, kept)
        return kept

    def write(self, df: DataFrame, name: str, kind: str = "parquet", counters: dict[str, Column] | None = None, mode: str = "write", note: str = "") -> str:
        """Write an output and return its path; ``counters``: aggregates over its rows by name."""
        if mode != "write":
            raise ValueError("outputs are written whole: appending would mix two runs")
        seen, path, draft = Observation(), f"{self.folder}/{name}", f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in (counters or {}).items()))
        if kind == "csv":
            rows = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns))
        form, options = self.FORMATS[kind]
        try:
            rows.write.options(**options).format(form).save(draft)
            got = seen.get
            kept = self._kept(path)
            files.rename(self.spark, draft, path)
        except BaseException:
            files.delete(self.spark, draft)
            raise
        self.data["outputs"][name] = {"kind": kind, "rows": got["rows"], "backup": kept, "note": note}
        for k, v in got.items():
            if k != "rows":
                self.data["counters"][k] = self.data["counters"].get(k, 0) + (v or 0)
        self._save()
        return path

    def count(self, name: str, n: int = 1) -> None:
        self.data["counters"][name] = self.data["counters"].get(name, 0) + n


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


MANIFEST = "tool string, argv array<string>, host string, spark string, python string, started string, finished string, ok boolean, error string, counters map<string,bigint>, outputs map<string,struct<kind:string,rows:bigint,backup:string,note:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as one row."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def stored_jsonl(df: DataFrame) -> DataFrame:
    """Written as JSON lines in the shared folder and read again with the same columns."""
    path = new_path(df.sparkSession, "jsonl")
    write_jsonl(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)
