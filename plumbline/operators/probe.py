"""Chunk probes: a few present chunks of each level, read and judged by reads that depend on each other.

Each level is a row; a task asks a store for one object after the other and stops as soon as a level
has its samples, so what is read grows with the samples and not with what the store holds:

* plain chunks: HEAD of spread candidates in their order, until k are present; of an uncompressed
  chunk of integers with fill zero, a range of 4 kB, and the rest only if that is all zero;
* shards: the index from the end of spread shards, its checksum, then the inner chunks chosen, with
  neighbours in one range;
* windows: small boxes at fixed shares of a level's extent, for sharded levels.

Rows go to tasks by root; ``max_rps`` is shared by the tasks, so each has its part of it. A store is a base
(folder, URL), or planted objects that come with the row. Every failure is a sample, never an end.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import binary
from ..sources import arrays
from ..sources.transport import PlantedStore, StoreError, head, open_store

#: Bytes from the start of an object that are looked at before the whole of it.
PREFIX_BYTES = 4096
#: Extent of a window, where windows begin (shares of the extent), and how that moves from axis to axis.
WINDOW = 64
SHARES, SHIFT = (0.15, 0.5, 0.85), 0.23
SAMPLE = "root string, level string, place int, chunk array<bigint>, path string, status string, detail string, calls int, bytes bigint, index_crc string"
ARROW = pa.schema([("root", pa.string()), ("level", pa.string()), ("place", pa.int32()), ("chunk", pa.list_(pa.int64())), ("path", pa.string()), ("status", pa.string()), ("detail", pa.string()), ("calls", pa.int32()), ("bytes", pa.int64()), ("index_crc", pa.string())])
#: Columns of a level that a probe looks at, with their types; those a relation lacks are null.
LEVEL = {"shape": "array<bigint>", "chunks": "array<bigint>", "dtype": "string", "fill_value": "string", "compressor_id": "string", "separator": "string", "zarr_format": "int", "filters": "boolean"}


def unravelled(flat: Column, grid: Column) -> Column:
    """Index along each axis of a flat position, last axis fastest."""
    start = F.struct(flat.cast("bigint").alias("rest"), F.array().cast("array<bigint>").alias("at"))
    step = lambda a, n: F.struct(((a.rest - a.rest % n) / n).cast("bigint").alias("rest"), F.concat(F.array(a.rest % n), a.at).alias("at"))
    return F.aggregate(F.reverse(grid), start, step).at


def good_level() -> Column:
    """Whether a level is present, with a grid."""
    return F.col("present") & (F.size("shape") > 0) & (F.size("shape") == F.size("chunks")) & F.forall("chunks", lambda c: c > 0)


def candidates(levels: DataFrame, k: int) -> DataFrame:
    """``levels`` with ``place`` and ``path`` of 3 k chunks spread over each level's grid."""
    grid = F.transform(fn.grid("shape", "chunks"), lambda n: F.greatest(F.lit(1).cast("bigint"), n))
    rows = levels.filter(good_level()).withColumnsRenamed({"path": "level"}).withColumn("grid", grid)
    rows = rows.withColumn("flat", fn.spread_positions(fn.product("grid").cast("bigint"), 3 * k))
    rows = rows.select(*(c for c in rows.columns if c != "flat"), F.posexplode("flat").alias("place", "flat"))
    key = fn.chunk_key(unravelled(F.col("flat"), F.col("grid")), F.col("separator"), F.col("zarr_format"))
    return rows.withColumn("path", F.concat_ws("/", "root", "level", key)).drop("grid", "flat")


@functools.lru_cache(4096)
def flat_places(total: int, k: int) -> list[int]:
    """k positions spread over 0 ... total - 1, first and last included."""
    k = min(k, total)
    return sorted({round(i * (total - 1) / (k - 1)) for i in range(k)}) if k > 1 else [0]


def unravel(flat: int, grid: tuple[int, ...]) -> tuple[int, ...]:
    """Index along each axis of a flat position, last axis fastest."""
    at = []
    for n in reversed(grid):
        flat, i = divmod(flat, n)
        at.append(i)
    return tuple(reversed(at))


def spread(grid: tuple[int, ...], k: int) -> Iterator[tuple[int, ...]]:
    """k places spread over a grid, first and last included, each made when it is asked for."""
    return (unravel(n, grid) for n in flat_places(math.prod(grid), k))


def _verdict(values: np.ndarray, header: arrays.Header) -> tuple[str, str]:
    fill = arrays.fill_number(header)
    same = np.isnan(values) if fill != fill else values == fill
    other = values.size - int(np.count_nonzero(same))
    if not other:
        return "empty", f"all {values.size} values are the fill value {header.fill or 0}"
    return "populated", f"{other} of {values.size} values differ from the fill value {header.fill or 0}"


def _prefix_proves(header: arrays.Header) -> bool:
    """Whether a byte that is not zero proves content: uncompressed integers with fill zero."""
    try:
        return not header.codecs and header.dtype.kind in "biu" and arrays.fill_number(header) == 0
    except arrays.Undecodable:
        return False


def _chunk(store, path: str, header: arrays.Header, early: bool) -> tuple[str, str]:
    """Status and detail of one object; ``early``: a byte of its start can prove content."""
    try:
        r = head(store, path)
    except StoreError as e:
        return "fetch_error", f"existence check failed: {e}"
    if r.status == 404:
        return "absent", "no such chunk"
    if r.status >= 400:
        return "fetch_error", f"existence check failed: HTTP {r.status}"
    size = int(r.headers["content-length"]) if r.headers.get("content-length", "").isdigit() else None
    try:
        raw = None
        if early and size != 0:
            n = min(PREFIX_BYTES, size or PREFIX_BYTES)
            first = arrays.fetched(store, path, 0, n)
            if first.count(0) != len(first):
                return "populated", f"a byte of the first {n} is not zero"
            raw = first if size == n else None
        raw = arrays.fetched(store, path) if raw is None else raw
    except (StoreError, arrays.Absent) as e:
        return "fetch_error", f"fetch failed: {e}"
    try:
        return _verdict(arrays.decoded(raw, header), header)
    except arrays.Undecodable as e:
        return "undecodable", f"cannot decode: {e}"


def plain_samples(store, base: str, header: arrays.Header, k: int) -> Iterator[dict]:
    """The first k present of 3 k candidates; the calls that found the absent ones go with the next sample."""
    found, early = 0, _prefix_proves(header)
    for place, index in enumerate(spread(header.grid, 3 * k)):
        if found == k:
            return
        path = f"{base}/{header.key(index)}"
        status, detail = _chunk(store, path, header, early)
        if status == "absent":
            continue
        found += 1
        calls, size = store.spent()
        yield {"place": place, "chunk": index, "path": path, "status": status, "detail": detail, "calls": calls, "bytes": size}


def shard_samples(store, base: str, header: arrays.Header, k: int, inner: int) -> Iterator[dict]:
    """Inner chunks of k shards. What was read for the index goes with the first sample of a shard."""
    place = 0

    def sample(chunk, path, status, detail, crc="", spent=None):
        nonlocal place
        calls, size = spent or store.spent()
        place += 1
        return {"place": place - 1, "chunk": chunk, "path": path, "status": status, "detail": detail, "calls": calls, "bytes": size, "index_crc": crc}

    for shard in spread(header.grid, k):
        path = f"{base}/{header.key(shard)}"
        try:
            index, crc = arrays.index_of(store, path, header)
        except arrays.Absent:
            yield sample(shard, path, "missing", "no such shard: reads as fill")
            continue
        except arrays.ChecksumMismatch:
            yield sample(shard, path, "checksum_mismatch", "the index's checksum is wrong: its offsets are not followed", "mismatch")
            continue
        except arrays.TooSmall as e:  # the rest of the level would say no more
            yield sample(shard, path, "undecodable", str(e))
            return
        except StoreError as e:
            yield sample(shard, path, "fetch_error", f"index: {e}")
            return
        begin = tuple(p * c for p, c in zip(shard, header.chunks))
        inside = tuple(min(g, -(-max(1, s - b) // i)) for g, s, b, i in zip(header.inner_grid, header.shape, begin, header.inner))
        chosen = list(spread(inside, inner))
        numbers = [int(np.ravel_multi_index(i, header.inner_grid)) for i in chosen]
        bodies = arrays.inner_bodies(store, path, index, numbers)
        spent = store.spent()
        for at, body in zip(chosen, bodies.values()):
            start = tuple(b + i * e for b, i, e in zip(begin, at, header.inner))
            whole = tuple(s // e for s, e in zip(start, header.inner))
            name = f"{path}#{'.'.join(map(str, at))}"
            if body is None:
                status, detail = "missing", "not in the shard's index: reads as fill"
            elif isinstance(body, Exception):
                status, detail = "fetch_error", f"fetch failed: {body}"
            else:
                try:
                    status, detail = _verdict(arrays.shaped(body, header, header.inner)[header.valid(start, header.inner)], header)
                except arrays.Undecodable as e:
                    status, detail = "undecodable", f"cannot decode: {e}"
            yield sample(whole, name, status, detail, crc, spent)
            spent = (0, 0)


def window_samples(store, base: str, header: arrays.Header, k: int) -> Iterator[dict]:
    """k boxes of at most WINDOW cells along the first three axes, whole along others."""
    for place in range(k):
        start, stop = [], []
        for axis, extent in enumerate(header.shape):
            size = min(WINDOW, extent) if axis < 3 else extent
            share = (SHARES[place % 3] if k > 1 else SHARES[1]) + SHIFT * axis
            start.append(int((extent - size) * (share % 1.0)))
            stop.append(start[-1] + size)
        try:
            status, detail = _verdict(arrays.read_box(store, base, header, tuple(start), tuple(stop)), header)
        except arrays.Undecodable as e:
            status, detail = "undecodable", f"cannot decode: {e}"
        except (StoreError, arrays.ChecksumMismatch, arrays.TooSmall) as e:
            status, detail = "fetch_error", f"window: {e}"
        calls, size = store.spent()
        yield {"place": place, "chunk": tuple(start), "path": f"{base}/<window>", "status": status, "detail": detail, "calls": calls, "bytes": size}


def level_samples(store, row: dict, k: int, inner: int, windows: bool) -> Iterator[dict]:
    """Samples of one level. Of sharded levels the header is read, as it holds what the relation doesn't."""
    base = f"{row['root']}/{row['level']}"
    one = {"place": 0, "chunk": (), "path": base}
    sharded = (row["compressor_id"] or "").lower() == "sharding_indexed"
    try:
        if sharded:
            header = arrays.header_of(store, base, ("zarr.json",))
            if not header.inner:
                raise arrays.Undecodable("header names no shards")
        else:
            shape, chunks = row["shape"], row["chunks"]
            if shape is None or chunks is None or not len(shape) or len(shape) != len(chunks):
                return
            codec = (row["compressor_id"] or "none").lower()
            if row["filters"]:
                raise arrays.Undecodable("filters")
            dtype = np.dtype(row["dtype"] or "uint8")
            dtype = dtype.newbyteorder("<") if codec == "bytes" else dtype
            chunks = tuple(int(c) or max(1, int(s)) for s, c in zip(shape, chunks))
            header = arrays.Header(tuple(map(int, shape)), chunks, None, dtype, row["fill_value"], () if codec in ("none", "bytes") else (codec.split(":")[0],), (), "/" if row["zarr_format"] == 3 else row["separator"] or ".", row["zarr_format"] or 2, ())
    except (arrays.Undecodable, TypeError) as e:
        calls, size = store.spent()
        yield one | {"status": "undecodable", "detail": str(e), "calls": calls, "bytes": size}
        return
    except (StoreError, arrays.Absent) as e:
        calls, size = store.spent()
        yield one | {"status": "fetch_error", "detail": f"header: {e}", "calls": calls, "bytes": size}
        return
    yield from window_samples(store, base, header, k) if sharded and windows else shard_samples(store, base, header, k, inner) if sharded else plain_samples(store, base, header, k)
    calls, size = store.spent()
    if calls:  # candidates after the last sample, all of them absent
        yield {"place": None, "chunk": None, "path": None, "status": "absent", "detail": "no further chunk among the candidates", "calls": calls, "bytes": size}


def samples(levels: DataFrame, base: str | None = None, k: int = 3, inner: int = 3, windows: bool = False, tasks: int | None = None, max_rps: float = 0.0) -> DataFrame:
    """``SAMPLE`` for the present levels of a relation; what was asked for in vain is a row of status
    ``absent`` without a path, so that calls and bytes add up to all that was read.

    base: a folder or URL; without one, columns ``objects`` (map of path to bytes) and ``faults`` (map
    of path to status) hold each level's part of a store.
    """
    planted = base is None
    tasks = tasks or max(1, levels.sparkSession.sparkContext.defaultParallelism)
    rate = {"max_rps": max_rps / tasks} if max_rps and base and base.startswith("http") else {}
    codecs = dict(binary.CODECS)
    rows = levels.filter("present").withColumnsRenamed({"path": "level"})
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in LEVEL.items() if c not in rows.columns})
    rows = rows.select("root", "level", *LEVEL, *(["objects", "faults"] if planted else []))
    if not planted:
        rows = rows.repartition(tasks, "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binary.CODECS.update(codecs)
        shared = None if planted else open_store(base, **rate)
        for b in arrays.slices(batches):
            out = []
            for row in arrays.rows_of(b):
                store = arrays.Counted(PlantedStore(dict(row["objects"] or ()), dict(row["faults"] or ())) if planted else shared)
                names = {"root": row["root"], "level": row["level"], "index_crc": ""}
                out += (tuple(map((names | s).__getitem__, ARROW.names)) for s in level_samples(store, row, k, inner, windows))
            columns = zip(*out) if out else [()] * len(ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    return rows.mapInArrow(run, SAMPLE)


def statuses(found: DataFrame) -> DataFrame:
    """``(root, level, path, status)`` of the samples."""
    return found.filter("path is not null").select("root", "level", "path", "status")


def cost(found: DataFrame) -> DataFrame:
    """``(root, level, calls, bytes)``: what each level's samples took."""
    return found.groupBy("root", "level").agg(F.sum("calls").cast("bigint").alias("calls"), F.sum("bytes").cast("bigint").alias("bytes"))
