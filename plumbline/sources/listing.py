"""All keys below prefixes of an object store, listed in parallel although a listing is a chain of pages.

A task lists some pages of its part of the key space. If more follows, the rest is split where the keys
branch (at the delimiter), and the branches are parts of the next round; so a prefix with many keys is
spread over tasks although its number of keys isn't known before. Rounds are stored: a lost executor
repeats its parts only. A part that is refused is a row that says so, and never an empty listing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .transport import PlantedStore, StoreError, listed_pages, open_store

ROW = "store string, kind string, key string, size bigint, after string, error string"


def listed_part(store, prefix: str, after: str, size: int, pages: int) -> Iterator[dict]:
    """Keys of a part, and the parts that are left: rows of kind ``key``, ``part`` and ``error``."""
    last, more = after, False
    try:
        for keys, _, more in listed_pages(store, prefix, after, size=size, pages=pages):
            for key, n in keys:
                yield {"kind": "key", "key": key, "size": n}
                last = max(last, key)
        if not more:
            return
        # the branch that the last key lies in goes on behind it; the others begin where they begin
        deeper = last.find("/", len(prefix))
        if deeper >= 0:
            yield {"kind": "part", "key": last[: deeper + 1], "after": last}
        behind = last[: deeper + 1] + "\U0010ffff" if deeper >= 0 else last
        for keys, branches, more in listed_pages(store, prefix, behind, "/", size, 1):
            for key, n in keys:
                yield {"kind": "key", "key": key, "size": n}
            branches = [b for b in branches if b > behind]
            yield from ({"kind": "part", "key": b, "after": ""} for b in branches)
            if more:
                end = max([k for k, _ in keys] + branches)
                yield {"kind": "part", "key": prefix, "after": end + "\U0010ffff" if end.endswith("/") else end}
    except StoreError as e:
        yield {"kind": "error", "key": prefix, "after": last, "error": str(e)}


def all_keys(prefixes: DataFrame, base: str | None = None, size: int = 1000, pages: int = 10, tasks: int | None = None) -> DataFrame:
    """``ROW`` of kind ``key`` for every key below the distinct prefixes ``(store, key)``, and of kind
    ``error`` for each part that could not be listed. Without a base, columns ``objects`` and ``faults``
    hold what each ``store`` has."""
    from . import store_table

    spark, planted = prefixes.sparkSession, base is None
    # made once, and dealt by store in every round: a row for each store, with its parts
    plants = store_table(prefixes.select("store", "objects", "faults").dropDuplicates(["store"])) if planted else None
    work = prefixes.select("store", "key", F.lit("").alias("after")).distinct()
    kinds = pa.schema([("store", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("size", pa.int64()), ("after", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None if planted else open_store(base)
        out = []
        for b in slices(batches, 32):
            for r in b.to_pylist():
                store = PlantedStore(dict(r["objects"] or ()), dict(r["faults"] or ())) if planted else shared
                for part in r["parts"] if planted else [r]:
                    for row in listed_part(store, part["key"], part["after"], size, pages):
                        out.append({"store": r["store"]} | row)
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out = []
        yield pa.RecordBatch.from_pylist(out, kinds)

    whole = None
    while True:
        parts = work.groupBy("store").agg(F.collect_list(F.struct("key", "after")).alias("parts")).join(plants.hint("merge"), "store") if planted else work.repartition(tasks or spark.sparkContext.defaultParallelism)
        found = store_table(parts.mapInArrow(run, ROW))
        done = found.filter("kind <> 'part'")
        whole = done if whole is None else whole.unionByName(done)
        work = found.filter("kind = 'part'").select("store", "key", "after")
        if work.isEmpty():
            return whole
