"""Breadth-first crawls, one job per depth: over a listing relation, and over a store by its listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..sources import arrays, files
from ..sources.transport import observe, open_store

#: Directory names that are never entered.
SKIPPED = ("__pycache__", ".git", ".ipynb_checkpoints", "node_modules")


def classified(dirs: DataFrame, max_depth: int = 10) -> DataFrame:
    """What becomes of each directory: root, surface, or why it is pruned, else descend.

    A pyramid is recognised before anything is pruned.
    """
    name, parent = fn.base_name("path"), fn.base_name(F.regexp_replace("path", "/[^/]*/?$", ""))
    step = (
        F.when(fn.is_zarr_name(name), "root")
        .when(name.isin(*SKIPPED), "skipped")
        .when(name.endswith(".tifxyz"), "surface")
        .when(fn.is_coordinate_name(name), "coordinate")
        .when((parent == "paths") & fn.is_timestamp_name(name), "timestamp")
        .when(F.col("depth") >= max_depth, "deep")
        .otherwise("descend")
    )
    return dirs.withColumn("step", step)


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, store=lambda df: df.checkpoint()) -> DataFrame:
    """All directories reached from ``seeds (path)`` over ``edges (parent, path)``.

    Each depth is a join of the frontier with the listing; what was seen before is dropped, so a
    directory is listed once.
    """
    seen = store(classified(seeds.select("path").distinct().withColumn("depth", F.lit(0)), max_depth))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.filter("step = 'descend'").select(F.col("path").alias("parent")).join(edges, "parent").select("path").distinct()
        step = step.join(seen.select("path"), "path", "left_anti").withColumn("depth", F.lit(depth))
        frontier = store(classified(step, max_depth))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


# ------------------------------------------------------------------ live crawl of a store
LISTED = "path string, depth int, state string, error string, files array<string>, dirs array<string>, n_files bigint, calls int"
#: Files that are looked for in a listing; only these are kept of it.
MARKS = (".zgroup", "zarr.json", "x.tif", "y.tif", "z.tif")


def _listings(frontier: DataFrame, base: str, tasks: int, max_rps: float) -> DataFrame:
    """``LISTED`` of each path of the frontier: one listing in a task, whatever comes of it."""
    rate = {"max_rps": max_rps / tasks} if max_rps and base.startswith(("http", "s3")) else {}
    kinds = pa.schema([("path", pa.string()), ("depth", pa.int32()), ("state", pa.string()), ("error", pa.string()), ("files", pa.list_(pa.string())), ("dirs", pa.list_(pa.string())), ("n_files", pa.int64()), ("calls", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = arrays.Counted(open_store(base, **rate))
        for b in batches:
            for r in b.to_pylist():
                row = observe(store, "list", r["path"])
                names = row["entries"] or []
                files = [n for n in names if not n.endswith("/")]
                out = r | {"state": row["state"], "error": row["error"], "dirs": [n.rstrip("/") for n in names if n.endswith("/")], "files": [n for n in files if n in MARKS], "n_files": len(files), "calls": store.spent()[0]}
                yield pa.RecordBatch.from_pylist([out], kinds)

    return frontier.repartition(tasks, "path").mapInArrow(run, LISTED)


def _outcomes(listed: DataFrame) -> DataFrame:
    """Listed folders with what they are: root, surface, folder, or unknown where the listing failed."""
    has = lambda *names: F.arrays_overlap("files", F.array(*(F.lit(n) for n in names)))
    root = has(".zgroup", "zarr.json") | fn.is_zarr_name(fn.base_name("path"))
    channels = F.size(F.array_intersect("files", F.array(*(F.lit(f"{a}.tif") for a in "xyz")))) == 3
    return listed.withColumn("is", F.when(F.col("state") != "PRESENT", "unlisted").when(root, "root").when(channels, "surface").otherwise("folder"))


def _children(listed: DataFrame, max_depth: int, leaves: bool, segments: bool) -> DataFrame:
    """``(path, depth, step)`` of the folders in listed ones. A pyramid is recognised before anything is pruned."""
    inside = listed.filter("is in ('surface', 'folder')")
    rows = inside.select("path", "depth", F.explode("dirs").alias("name"))
    parent = fn.base_name("path")
    step = (
        F.when(F.col("depth") >= max_depth, "deep")
        .when(fn.is_zarr_name("name"), "root")
        .when(F.col("name").isin(*SKIPPED), "skipped")
        .when(fn.is_coordinate_name("name"), "coordinate")
        .when(F.col("name").endswith(".tifxyz") & F.lit(not leaves), "surface")
        .when((parent == "paths") & fn.is_timestamp_name("name") & F.lit(not segments), "timestamp")
        .otherwise("descend")
    )
    path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
    return rows.select(path.alias("path"), (F.col("depth") + 1).alias("depth"), step.alias("step")).dropDuplicates(["path"])


def crawl_store(spark: SparkSession, base: str, folder: str, prefixes: tuple[str, ...] = ("",), max_depth: int = 6, leaves: bool = False, segments: bool = False, tasks: int | None = None, max_rps: float = 0.0) -> DataFrame:
    """Breadth-first crawl of a store from its listings: ``(path, depth, step, state, error)``.

    Step is what became of a folder: root, surface, folder, unlisted, or why it was not listed (skipped,
    coordinate, timestamp, surface, root, deep). Each depth is one job, whose tasks list the folders of
    the frontier; listings and children are stored in ``folder`` before the next. A crawl that is started
    again with the same folder goes on after the last depth that was stored whole. A failed listing stays
    with its state and error: nothing below it is claimed to be absent.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    table = lambda kind, depth: f"{folder.rstrip('/')}/{kind}-{depth}"

    def stored(df: DataFrame, kind: str, depth: int) -> DataFrame:
        path = table(kind, depth)
        if not files.exists(spark, f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    frontier = spark.createDataFrame([(p.strip("/"), 0) for p in dict.fromkeys(prefixes)], "path string, depth int")
    seen, out = frontier.select("path"), None
    for depth in range(max_depth + 1):
        listed = _outcomes(stored(_listings(frontier, base, tasks, max_rps), "listed", depth))
        found = stored(_children(listed, max_depth, leaves, segments).join(seen, "path", "left_anti"), "children", depth)
        here = listed.select("path", "depth", F.col("is").alias("step"), "state", "error")
        rest = found.filter("step <> 'descend'").select("path", "depth", "step", F.lit("PRESENT").alias("state"), F.lit(None).cast("string").alias("error"))
        out = here.unionByName(rest) if out is None else out.unionByName(here).unionByName(rest)
        frontier = found.filter("step = 'descend'").select("path", "depth")
        seen = seen.unionByName(found.select("path"))
        if frontier.isEmpty():
            break
    return with_evidence(out)


def with_evidence(rows: DataFrame) -> DataFrame:
    """States of failed listings by what their errors prove."""
    e = fn.evidence_of_error("error", listing=True)
    failed = F.col("error").isNotNull()
    return rows.withColumns({"state": F.when(failed, e.state).otherwise(F.col("state")), "reason": F.when(failed, e.reason)})
