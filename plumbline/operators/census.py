"""Census of stored chunks from listings: how many there are, and what a few evenly chosen ones weigh.

A task lists a level's folder. Flat keys, and nested ones of few directories, are chosen and weighed in
the same task. Of other levels each directory of the first axis is a step of its own, so a large level is
spread over tasks. Keys are numbered as they are listed, and the counts of the directories before give
each its place in the level; so the places ``floor(i * n / k)`` are found without sorting or gathering a
level. HEADs and reads follow for these keys alone.

A listing that fails leaves the number of chunks unknown (null), never smaller; a folder that is
confirmed absent holds none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from ..sources import arrays, store_table
from ..sources.transport import PlantedStore, StoreError, head, open_store

HEAD_SAMPLE, READ_SAMPLE = 40, 6
#: Directories of the first axis, and keys in them, up to which a level is one step; larger ones are spread over tasks.
STEP_FOLDERS, STEP_KEYS = 16, 10_000
NUMBER = re.compile(r"\d+")
#: Codecs of chunks that are stored as they are.
PLAIN = ("", "none", "null", "bytes")
LEVEL = ["shape", "chunks", "dtype", "compressor_id", "separator", "zarr_format"]


def _names(store, path: str) -> list[str]:
    """A listing; a folder that is confirmed absent is empty."""
    try:
        return store.list(path)
    except StoreError as e:
        if "404" in str(e):
            return []
        raise


def _nested(row: dict) -> bool:
    """Whether each axis is a directory, as in chunk keys of the newer format."""
    return row["zarr_format"] == 3 or row["separator"] == "/"


def tops(store, row: dict) -> Iterator[tuple[str, bool]]:
    """(key or directory below the level, whether it is a directory) of a level."""
    base, ndim = f"{row['root']}/{row['level']}", len(row["shape"])
    own = "c/" if row["zarr_format"] == 3 else ""
    if _nested(row):
        for name in _names(store, f"{base}/{own}".rstrip("/")):
            if NUMBER.fullmatch(name.rstrip("/")) and name.endswith("/") == (ndim > 1):
                yield own + name.rstrip("/"), ndim > 1
        return
    key = re.compile(r"\.".join([r"\d+"] * ndim))
    yield from ((name, False) for name in _names(store, base) if key.fullmatch(name))


def below(store, base: str, prefix: str, left: int) -> Iterator[str]:
    """Keys in a directory, ``left`` axes deep."""
    for name in _names(store, f"{base}/{prefix}"):
        if NUMBER.fullmatch(name.rstrip("/")) and name.endswith("/") == (left > 1):
            if left > 1:
                yield from below(store, base, f"{prefix}/{name.rstrip('/')}", left - 1)
            else:
                yield f"{prefix}/{name}"


def _run(rows: DataFrame, base: str | None, work, ddl: str, extra: list[str], tasks: int | None) -> DataFrame:
    """``work(store, row)`` over rows of levels, in tasks."""
    planted = base is None
    rows = rows.select("root", "level", *LEVEL, *extra, *(["objects", "faults"] if planted else []))
    rows = rows if planted else rows.repartition(tasks or rows.sparkSession.sparkContext.defaultParallelism, "root", "level", *extra)
    names = [x.split()[0] for x in ddl.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None if planted else open_store(base)
        for b in batches:
            out = []
            for row in b.to_pylist():
                store = PlantedStore(dict(row["objects"] or ()), dict(row["faults"] or ())) if planted else shared
                for found in work(store, row):
                    out.append({"root": row["root"], "level": row["level"]} | found)
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, ddl)


def keys(levels: DataFrame, base: str | None = None, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``(root, level, place, key)``, ``(root, level, n, error)``): the chunks of levels with their
    places in the order of the listings, and how many there are; the number is null after an error."""

    def first(store, row: dict) -> Iterator[dict]:
        n = 0
        try:
            for n, (name, folder) in enumerate(tops(store, row), 1):
                yield {"top": name, "folder": folder, "seq": n - 1}
        except StoreError as e:
            yield {"error": str(e), "seq": n}

    def second(store, row: dict) -> Iterator[dict]:
        n = 0
        try:
            for n, key in enumerate(below(store, f"{row['root']}/{row['level']}", row["top"], len(row["shape"]) - 1), 1):
                yield {"top": row["top"], "key": key, "seq": n - 1}
        except StoreError as e:
            yield {"top": row["top"], "error": str(e), "seq": n}

    found = store_table(_run(levels, base, first, "root string, level string, top string, folder boolean, seq bigint, error string", [], tasks))
    folders = levels.join(found.filter("folder").select("root", "level", "top"), ["root", "level"])
    inner = store_table(_run(folders, base, second, "root string, level string, top string, key string, seq bigint, error string", ["top"], tasks))
    sizes = inner.filter("key is not null").groupBy("root", "level", "top").agg(F.count("*").alias("size"))
    # a row for each directory of the first axis
    rows = found.filter("top is not null").join(sizes, ["root", "level", "top"], "left").withColumn("size", F.when(F.col("folder"), F.coalesce("size", F.lit(0))).otherwise(F.lit(1)))
    before = F.sum("size").over(W.partitionBy("root", "level").orderBy("seq")) - F.col("size")
    rows = store_table(rows.select("root", "level", "top", "folder", before.alias("before"), "size"))
    flat = rows.filter("not folder").select("root", "level", F.col("before").alias("place"), F.col("top").alias("key"))
    deep = inner.filter("key is not null").join(rows.filter("folder"), ["root", "level", "top"]).select("root", "level", (F.col("before") + F.col("seq")).alias("place"), "key")
    errors = found.select("root", "level", "error").unionByName(inner.select("root", "level", "error")).filter("error is not null").groupBy("root", "level").agg(F.min("error").alias("error"))
    totals = levels.select("root", "level").join(rows.groupBy("root", "level").agg(F.sum("size").alias("n")), ["root", "level"], "left").join(errors, ["root", "level"], "left")
    return flat.unionByName(deep), totals.select("root", "level", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).alias("n"), "error")


def chosen(places: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """The keys at the places ``floor(i * n / k)``, or all of a level with k or fewer."""
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("n") / k))
    rows = places.join(totals.filter("n > 0").select("root", "level", "n"), ["root", "level"])
    return rows.filter((F.col("n") <= k) | F.array_contains(wanted, F.col("place"))).select("root", "level", "key")


def _size(store, path: str) -> int | None:
    """What an object weighs; one that can't be weighed is no sample."""
    try:
        r = head(store, path)
    except StoreError:
        return None
    length = r.headers.get("content-length", "")
    return int(length) if r.status < 400 and length.isdigit() else None


def _packed(store, path: str) -> tuple[int, int] | None:
    """An object's bytes as they are and deflated."""
    try:
        raw = arrays.fetched(store, path)
    except (StoreError, arrays.Absent):
        return None
    return len(raw), len(zlib.compress(raw, 6))


def listed(store, row: dict) -> tuple[list[str] | None, str | None]:
    """(keys of a level in the order of its listings, error); no keys where it is too large to be one step."""
    found, errors = [], []
    try:
        first = list(tops(store, row))
    except StoreError as e:
        return [], str(e)
    if sum(folder for _, folder in first) > STEP_FOLDERS:
        return None, None
    for name, folder in first:
        if not folder:
            found.append(name)
            continue
        try:
            for key in below(store, f"{row['root']}/{row['level']}", name, len(row["shape"]) - 1):
                found.append(key)
                if len(found) > STEP_KEYS:
                    return None, None
        except StoreError as e:
            errors.append(str(e))
    return found, min(errors, default=None)


def evenly(keys: list[str], k: int) -> list[str]:
    """The keys at the places ``floor(i * n / k)``, or all if there are k or fewer."""
    n = len(keys)
    return keys if n <= k else [keys[at] for at in dict.fromkeys(i * n // k for i in range(k))]


def visited(store, row: dict, head_sample: int, read_sample: int) -> dict:
    """``VISIT`` of one level, but for its names; ``large`` if it has to be spread over tasks."""
    keys, error = listed(store, row)
    if keys is None:
        return {"large": True}
    out = {"large": False, "n": None if error else len(keys), "error": error, "head_n": 0, "read_n": 0}
    base = f"{row['root']}/{row['level']}"
    sizes = [] if error else [n for key in evenly(keys, head_sample) if (n := _size(store, f"{base}/{key}")) is not None]
    if sizes:
        out |= {"head_n": len(sizes), "least": min(sizes), "most": max(sizes), "total": sum(sizes)}
    packs = [] if error or (row["compressor_id"] or "").lower() not in PLAIN else [p for key in evenly(keys, read_sample) if (p := _packed(store, f"{base}/{key}")) is not None]
    return out | ({"read_n": len(packs), "raw": sum(r for r, _ in packs), "packed": sum(p for _, p in packs)} if packs else {})


OWN = {"root": pa.string(), "level": pa.string(), "shape": pa.list_(pa.int64()), "chunks": pa.list_(pa.int64()), "dtype": pa.string(), "compressor_id": pa.string()}
FOUND = {"n": pa.int64(), "error": pa.string(), "head_n": pa.int64(), "least": pa.int64(), "most": pa.int64(), "total": pa.int64(), "read_n": pa.int64(), "raw": pa.int64(), "packed": pa.int64()}
VISIT = "root string, level string, shape array<bigint>, chunks array<bigint>, dtype string, compressor_id string, n bigint, error string, head_n bigint, least bigint, most bigint, total bigint, read_n bigint, raw bigint, packed bigint, large boolean"


def visits(levels: DataFrame, base: str | None, head_sample: int, read_sample: int, tasks: int | None) -> DataFrame:
    """``VISIT``: a row for each level, listed and weighed by one task, or marked as large."""
    planted = base is None
    rows = levels.select("root", "level", *LEVEL, *(["objects", "faults"] if planted else []))
    rows = rows if planted else rows.repartition(tasks or rows.sparkSession.sparkContext.defaultParallelism, "root", "level")
    kinds = pa.schema([*(OWN | FOUND).items(), ("large", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None if planted else open_store(base)
        for b in arrays.slices(batches):
            out = []
            for row in arrays.rows_of(b):
                store = PlantedStore(dict(row["objects"] or ()), dict(row["faults"] or ())) if planted else shared
                out.append(visited(store, row, head_sample, read_sample))
            # what is known of a level stays as it came
            yield pa.RecordBatch.from_arrays([*(b[c].cast(kind) for c, kind in OWN.items()), *(pa.array([r.get(c) for r in out], kinds.field(c).type) for c in (*FOUND, "large"))], schema=kinds)

    return rows.mapInArrow(run, VISIT)


def spread_visits(levels: DataFrame, base: str | None, head_sample: int, read_sample: int, tasks: int | None) -> DataFrame:
    """``VISIT`` of large levels, spread over tasks by their directories and keys."""
    levels = store_table(levels)
    places, totals = keys(levels, base, tasks)
    places, totals = store_table(places), store_table(totals)

    def weigh(store, row: dict) -> Iterator[dict]:
        size = _size(store, f"{row['root']}/{row['level']}/{row['key']}")
        if size is not None:
            yield {"size": size}

    def pack(store, row: dict) -> Iterator[dict]:
        found = _packed(store, f"{row['root']}/{row['level']}/{row['key']}")
        if found is not None:
            yield {"raw": found[0], "packed": found[1]}

    heads = levels.join(chosen(places, totals, head_sample), ["root", "level"])
    reads = levels.filter(_plain()).join(chosen(places, totals, read_sample), ["root", "level"])
    sizes = _run(heads, base, weigh, "root string, level string, size bigint", ["key"], tasks)
    packs = _run(reads, base, pack, "root string, level string, raw bigint, packed bigint", ["key"], tasks)
    weighed = sizes.groupBy("root", "level").agg(F.count("*").alias("head_n"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("total"))
    packed = packs.groupBy("root", "level").agg(F.count("*").alias("read_n"), F.sum("raw").alias("raw"), F.sum("packed").alias("packed"))
    rows = levels.select(*OWN).join(totals, ["root", "level"], "left").join(weighed, ["root", "level"], "left").join(packed, ["root", "level"], "left")
    return rows.select(*OWN, *FOUND, F.lit(True).alias("large"))


def _plain() -> Column:
    return F.lower(F.coalesce("compressor_id", F.lit(""))).isin(*PLAIN)


def census(levels: DataFrame, base: str | None = None, head_sample: int = HEAD_SAMPLE, read_sample: int = READ_SAMPLE, tasks: int | None = None) -> DataFrame:
    """One row for each present level of ``levels``: chunks and stored bytes, exact where an uncompressed
    level's chosen chunks are all whole, else estimated from their mean; what deflating would save, from
    chosen chunks of uncompressed levels."""
    levels = levels.filter("present and size(shape) > 0 and size(shape) = size(chunks)").withColumnsRenamed({"path": "level"})
    rows = store_table(visits(levels, base, head_sample, read_sample, tasks))
    large = rows.filter("large").select("root", "level")
    if not large.isEmpty():
        rows = rows.filter("not large").unionByName(spread_visits(levels.join(large, ["root", "level"], "left_semi"), base, head_sample, read_sample, tasks))
    width = F.create_map(*(F.lit(x) for name, (_, n) in _widths().items() for x in (name, n)))[F.col("dtype")]
    full = fn.product("chunks").cast("bigint") * width
    grid = fn.product(F.transform(fn.grid("shape", "chunks"), lambda n: F.greatest(F.lit(1).cast("bigint"), n))).cast("bigint")
    rows = rows.withColumns({"grid": grid, "full": full, "plain": _plain(), "mean": F.try_divide("total", "head_n")})
    exact = F.col("plain") & F.coalesce((F.col("least") == F.col("full")) & (F.col("most") == F.col("full")), F.lit(False))
    stored = F.when(F.col("n") == 0, F.lit(0)).when(exact, F.col("n") * F.col("full")).otherwise(F.floor(F.col("mean") * F.col("n"))).cast("bigint")
    return rows.select(
        "root",
        "level",
        F.col("grid").alias("grid_chunks"),
        F.col("n").alias("present_chunks"),
        F.round(F.col("n") / F.col("grid"), 6).alias("present_fraction"),
        F.coalesce("head_n", F.lit(0)).alias("head_n"),
        stored.alias("stored_bytes"),
        F.when(F.col("n").isNull() | stored.isNull(), None).when(exact, "exact").otherwise("estimated").alias("basis"),
        F.round(F.try_divide("raw", "packed"), 6).alias("ratio"),
        F.floor(stored * (1 - F.try_divide("packed", "raw"))).cast("bigint").alias("recoverable_bytes"),
        "error",
    )


def _widths() -> dict[str, tuple[str, int]]:
    from .. import schema

    return schema.DTYPES
