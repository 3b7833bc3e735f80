"""Chunked arrays in a store: headers, addresses, and reads of no more than what is asked for.

Small helpers that run inside tasks. An array is a header and objects named by their place in the grid;
an object is one chunk, or a shard of inner chunks with an index of offsets and lengths at its end. An
object or inner chunk that is absent reads as the fill value. What can't be understood raises
``Undecodable``; it is never guessed.
"""

from __future__ import annotations

import functools
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions import binary
from .transport import StoreError, checked_range, observe, trailing

#: Inner chunks of a shard that lie at most this many bytes apart are fetched by one range.
GAP_BYTES = 4096


#: Rows of a batch that are Python objects at a time.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a task's Python objects don't grow with its batches."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def values_of(column: pa.Array) -> list:
    """A column as Python values, as ``to_pylist`` gives them; nested ones are converted flat and cut after that."""
    kind = column.type
    if pa.types.is_map(kind) or pa.types.is_list(kind):
        ends = column.offsets.to_pylist() if len(column) < 2 else column.offsets.to_numpy().tolist()
        first, last = (ends[0], ends[-1]) if ends else (0, 0)
        if pa.types.is_map(kind):
            flat = list(zip(values_of(column.keys.slice(first, last - first)), values_of(column.items.slice(first, last - first))))
        else:
            flat = values_of(column.values.slice(first, last - first))
        out = [flat[a - first : b - first] for a, b in zip(ends, ends[1:])]
        return [None if null else v for v, null in zip(out, column.is_null().to_numpy(zero_copy_only=False).tolist())] if column.null_count else out
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or (pa.types.is_integer(kind) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, as ``to_pylist`` gives them."""
    names = batch.schema.names
    return (dict(zip(names, row)) for row in zip(*map(values_of, batch.columns)))


class Undecodable(Exception):
    """Header, codec or payload outside what is understood."""


class TooSmall(Exception):
    """A shard that is smaller than its index."""


class ChecksumMismatch(Exception):
    """An index of a shard whose checksum is wrong: its offsets can't be trusted."""


class Absent(Exception):
    """The store confirmed that an object isn't there."""


class Counted:
    """A store that counts calls and the bytes of bodies."""

    def __init__(self, store):
        self.store, self.calls, self.bytes = store, 0, 0

    def request(self, method: str, path: str, headers: dict | None = None, query: dict | None = None):
        self.calls += 1
        r = self.store.request(method, path, headers, query) if query else self.store.request(method, path, headers)
        self.bytes += len(r.body)
        return r

    def list(self, path: str) -> list[str]:
        self.calls += 1
        return self.store.list(path)

    def spent(self) -> tuple[int, int]:
        """Calls and bytes since this was last asked."""
        out = self.calls, self.bytes
        self.calls = self.bytes = 0
        return out


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    #: Extent of what one object holds, and of the inner chunks if objects are shards.
    chunks: tuple[int, ...]
    inner: tuple[int, ...] | None
    dtype: np.dtype
    fill: str | None
    codecs: tuple[str, ...]
    index_codecs: tuple[str, ...]
    separator: str
    zarr_format: int
    names: tuple[str, ...]
    order: str = "C"

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(max(1, -(-s // c)) for s, c in zip(self.shape, self.chunks))

    @property
    def inner_grid(self) -> tuple[int, ...]:
        """Places in a shard's index, whether or not they lie inside the array."""
        return tuple(o // i for o, i in zip(self.chunks, self.inner))

    def key(self, index: tuple[int, ...]) -> str:
        parts = [str(i) for i in index]
        if self.zarr_format == 3:
            return self.separator.join(["c", *parts])
        return self.separator.join(parts or ["0"])

    def valid(self, start: tuple[int, ...], extent: tuple[int, ...]) -> tuple[slice, ...]:
        """The part of a chunk that lies inside the array."""
        return tuple(slice(0, max(0, min(e, s - a))) for a, e, s in zip(start, extent, self.shape))


def parsed(doc: dict) -> Header:
    """A header of either format."""
    try:
        if doc.get("zarr_format") != 3:
            if doc.get("filters"):
                raise Undecodable("filters")
            codec = (doc.get("compressor") or {}).get("id")
            return Header(tuple(doc["shape"]), tuple(doc["chunks"]), None, np.dtype(doc["dtype"]), _text(doc.get("fill_value")), (codec,) if codec else (), (), doc.get("dimension_separator", "."), 2, (), doc.get("order", "C"))
        codecs, inner, index_codecs = doc["codecs"], None, ()
        if codecs and codecs[0]["name"] == "sharding_indexed":
            if len(codecs) > 1:
                raise Undecodable("codecs around shards")
            own = codecs[0]["configuration"]
            inner, codecs = tuple(own["chunk_shape"]), own.get("codecs") or []
            index_codecs = tuple(c["name"] for c in own.get("index_codecs") or [])
            if own.get("index_location", "end") != "end":
                raise Undecodable(f"index_location {own['index_location']}")
            if set(index_codecs) - {"bytes", "crc32c"}:
                raise Undecodable("index codec " + ", ".join(sorted(set(index_codecs) - {"bytes", "crc32c"})))
        if any(c["name"] == "transpose" for c in codecs):
            raise Undecodable("codec transpose")
        big = any(c["name"] == "bytes" and (c.get("configuration") or {}).get("endian") == "big" for c in codecs)
        dtype = np.dtype(doc["data_type"]).newbyteorder(">" if big else "<")
        encoding = doc.get("chunk_key_encoding") or {}
        if encoding.get("name", "default") != "default":
            raise Undecodable(f"chunk keys {encoding['name']}")
        separator = (encoding.get("configuration") or {}).get("separator", "/")
        out = Header(tuple(doc["shape"]), tuple(doc["chunk_grid"]["configuration"]["chunk_shape"]), inner, dtype, _text(doc.get("fill_value")), tuple(c["name"] for c in codecs if c["name"] != "bytes"), index_codecs, separator, 3, tuple(doc.get("dimension_names") or ()))
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        raise Undecodable(f"header: {e!r}") from e
    if len(out.shape) != len(out.chunks) or min(out.chunks, default=1) < 1 or inner and (len(inner) != len(out.shape) or min(inner) < 1 or any(o % i for o, i in zip(out.chunks, inner))):
        raise Undecodable("chunks don't fit the shape")
    return out


def _text(fill) -> str | None:
    return None if fill is None else fill if isinstance(fill, str) else json.dumps(fill)


def header_of(store, path: str, names: tuple[str, ...] = (".zarray", "zarr.json")) -> Header:
    """The header at a path: the older format first, the newer one only where that is confirmed absent."""
    for name in names:
        row = observe(store, "json", f"{path}/{name}")
        if row["state"] == "PRESENT" and row["reason"] is None:
            return parsed(json.loads(row["body"]))
        if row["state"] != "ABSENT":
            raise Undecodable("header is no JSON") if row["reason"] else StoreError(row["error"])
    raise Absent(path)


def fetched(store, path: str, start: int | None = None, length: int = 0) -> bytes:
    """A whole object or a range of it."""
    headers = {} if start is None else {"Range": f"bytes={start}-{start + length - 1}"}
    r = store.request("GET", path, headers)
    if r.status == 404:
        raise Absent(path)
    if start is not None:
        return checked_range(r, start, length)
    if r.status >= 400:
        raise StoreError(f"HTTP {r.status}")
    return r.body


def decoded(raw: bytes, header: Header) -> np.ndarray:
    """Values of a payload, flat; trailing bytes that are no whole value are left out."""
    for name in reversed(header.codecs):
        if name not in binary.CODECS:
            raise Undecodable(f"codec {name}")
        try:
            raw = binary.CODECS[name](raw)
        except (ValueError, TypeError, zlib.error, OSError) as e:
            raise Undecodable(f"codec {name}: {e}") from e
    n = len(raw) // header.dtype.itemsize
    if not n:
        raise Undecodable("no whole value")
    return np.frombuffer(raw[: n * header.dtype.itemsize], header.dtype)


def shaped(raw: bytes, header: Header, extent: tuple[int, ...]) -> np.ndarray:
    values = decoded(raw, header)
    if len(values) != math.prod(extent):
        raise Undecodable(f"{len(values)} values, not {math.prod(extent)}")
    return values.reshape(extent, order=header.order)


def fill_number(header: Header) -> float | int:
    """The fill value as a number; none is zero."""
    return _number(header.fill)


@functools.lru_cache(1024)
def _number(fill: str | None) -> float | int:
    text = (fill or "0").strip('"')
    special = {"nan": math.nan, "infinity": math.inf, "-infinity": -math.inf}
    try:
        n = special[text.lower()] if text.lower() in special else json.loads(text)
    except ValueError:
        n = None
    if not isinstance(n, (int, float)):
        raise Undecodable(f"fill value {fill}")
    return n


def fill_value(header: Header):
    """The fill value as a value of the array's type."""
    n = fill_number(header)
    try:
        value = header.dtype.type(n)
    except (TypeError, ValueError, OverflowError):
        value = None
    if value is None or header.dtype.kind != "f" and value != n:
        raise Undecodable(f"fill value {header.fill} is no {header.dtype}")
    return value


def is_fill(values: np.ndarray, fill) -> bool:
    same = np.isnan(values) if fill != fill else values == fill
    return bool(same.all())


def index_of(store, path: str, header: Header) -> tuple[np.ndarray, str]:
    """A shard's index as rows (offset, length), and what its checksum proves: verified or unchecksummed."""
    n, summed = math.prod(header.inner_grid), "crc32c" in header.index_codecs
    try:
        raw = trailing(store, path, 16 * n + 4 * summed)
    except StoreError as e:
        if str(e).startswith("404"):
            raise Absent(path) from e
        if "smaller than its index" in str(e) or "short suffix" in str(e):
            raise TooSmall(str(e)) from e
        raise
    if summed and int(binary.crc32c_of([raw[:-4]])[0]) != int.from_bytes(raw[-4:], "little"):
        raise ChecksumMismatch(path)
    return np.frombuffer(raw[: 16 * n], "<u8").reshape(-1, 2), "verified" if summed else "unchecksummed"


def coalesced(spans: list[tuple[int, int, int]], gap: int = GAP_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Ranges (start, end, members) that cover spans (offset, length, name), neighbours together."""
    start = end = None
    members: list[tuple[int, int, int]] = []
    for span in sorted(spans):
        if members and span[0] - end <= gap:
            end = max(end, span[0] + span[1])
            members.append(span)
            continue
        if members:
            yield start, end, members
        start, end, members = span[0], span[0] + span[1], [span]
    if members:
        yield start, end, members


def inner_bodies(store, path: str, index: np.ndarray, wanted: list[int]) -> dict[int, bytes | None | Exception]:
    """Payloads of inner chunks by their place in the index; None is missing, an exception a failed read."""
    out: dict[int, bytes | None | Exception] = {n: None for n in wanted}
    spans = [(int(index[n][0]), int(index[n][1]), n) for n in wanted if binary.MISSING not in index[n]]
    for start, end, members in coalesced(spans):
        try:
            body = fetched(store, path, start, end - start) if end > start else b""
        except (StoreError, Absent) as e:
            out |= dict.fromkeys((n for _, _, n in members), e)
            continue
        out |= {n: body[at - start : at - start + size] for at, size, n in members}
    return out


class Units:
    """The chunks (of shards: inner chunks) of the objects that meet a box, numbered so that those of an
    object stand together. Numbers are arithmetic, so any range of them can go to any task."""

    def __init__(self, header: Header, start: tuple[int, ...], stop: tuple[int, ...]):
        self.header, self.start, self.stop = header, start, stop
        self.extent = header.inner or header.chunks
        self.inner = header.inner_grid if header.inner else (1,) * len(self.extent)
        self.first = tuple(a // c for a, c in zip(start, header.chunks))
        empty = any(a >= b for a, b in zip(start, stop))
        self.objects = (0,) * len(start) if empty else tuple((b - 1) // c + 1 - f for b, c, f in zip(stop, header.chunks, self.first))
        self.per_object = math.prod(self.inner)

    def __len__(self) -> int:
        return math.prod(self.objects) * self.per_object if self.objects or not self.start else 0

    def object_of(self, n: int) -> tuple[int, ...]:
        return tuple(f + int(i) for f, i in zip(self.first, np.unravel_index(n // self.per_object, self.objects))) if self.objects else ()

    def box_of(self, place: tuple[int, ...], inner: int) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]] | None:
        """(where the unit begins, where its part of the box begins and ends), or None if it doesn't meet it."""
        at = np.unravel_index(inner, self.inner) if self.inner else ()
        begin = tuple(p * c + int(i) * e for p, c, i, e in zip(place, self.header.chunks, at, self.extent))
        low = tuple(max(a, b) for a, b in zip(self.start, begin))
        high = tuple(min(z, b + e) for z, b, e in zip(self.stop, begin, self.extent))
        return None if any(a >= b for a, b in zip(low, high)) else (begin, low, high)


def blocks(store, path: str, units: Units, first: int, last: int, at_once: int = 64) -> Iterator[tuple[tuple[int, ...], tuple[int, ...], np.ndarray | None]]:
    """(low, high, values) of the units ``first`` to ``last``, clipped to the box; None where nothing is stored.

    The index of a shard is read once, and its inner chunks ``at_once`` at a time.
    """
    header = units.header
    n = first
    while n < last:
        place, inner = units.object_of(n), n % units.per_object
        end = min(last, n - inner + units.per_object)
        wanted = [(k, box) for k in range(inner, inner + end - n) if (box := units.box_of(place, k))]
        n = end
        if not wanted:
            continue
        name = f"{path}/{header.key(place)}"
        try:
            if header.inner:
                index, _ = index_of(store, name, header)
            else:
                bodies = {0: fetched(store, name)}
        except Absent:
            yield from ((low, high, None) for _, (_, low, high) in wanted)
            continue
        for at in range(0, len(wanted), at_once):
            part = wanted[at : at + at_once]
            if header.inner:
                bodies = inner_bodies(store, name, index, [k for k, _ in part])
            for k, (begin, low, high) in part:
                body = bodies[k]
                if isinstance(body, Exception):
                    raise body
                inside = tuple(slice(lo - b, hi - b) for lo, hi, b in zip(low, high, begin))
                yield low, high, None if body is None else shaped(body, header, units.extent)[inside]


def read_box(store, path: str, header: Header, start: tuple[int, ...], stop: tuple[int, ...]) -> np.ndarray:
    """The values of a box; only objects and inner chunks that meet it are read."""
    out = np.full([b - a for a, b in zip(start, stop)], fill_value(header), header.dtype)
    units = Units(header, start, stop)
    for low, high, values in blocks(store, path, units, 0, len(units)):
        if values is not None:
            out[tuple(slice(lo - a, hi - a) for lo, hi, a in zip(low, high, start))] = values
    return out
