"""Bytes: checksums, shard indexes, TIFF headers, codecs. Arrow batches; small helpers only."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Reflected Castagnoli polynomial (fixed value).
CASTAGNOLI = 0x82F63B78
MISSING = 2**64 - 1
CODECS = {"none": lambda b: b, "bytes": lambda b: b, "zlib": zlib.decompress}


#: Bytes of a value, by name of its type.
WIDTHS = {name: np.dtype(name).itemsize for name in ("|u1", "|i1", "<u2", "<i2", "<u4", "<i4", "<f4", "<f8")}


def register_codec(name: str, decode) -> None:
    """Decode chunks of another codec by a function from bytes to bytes. Plans made after this carry it to
    their tasks, so it need not be importable there."""
    CODECS[name] = decode


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


TABLE = _table()


#: Bytes of a slice; the slices of all blobs go through the table together.
SLICE = 256


def _steps(crc: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Registers after the bytes of the rows of ``data``."""
    for column in data.T:
        crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc


def _shift_tables() -> np.ndarray:
    """What ``SLICE`` zero bytes make of a register, as tables by its bytes: the step is linear."""
    zeros = np.zeros((256, SLICE), np.uint8)
    return np.stack([_steps(np.arange(256, dtype=np.uint32) << np.uint32(8 * i), zeros) for i in range(4)])


SHIFT = _shift_tables()
#: Bytes in all up to which a loop over bytes is quicker than steps of whole arrays, whose cost doesn't fall with the bytes.
FEW_BYTES = 16_384
ENTRIES = TABLE.tolist()


def _bytewise(blob: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in blob:
        crc = crc >> 8 ^ ENTRIES[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


def crc32c_of(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of several blobs at once; of few bytes, one after the other. Each is cut into slices of ``SLICE`` bytes, padded in front (zero
    bytes change nothing of a zero register); the slices are stepped together and then joined."""
    lens = np.array([len(b) for b in blobs], np.int64)
    if lens.sum() <= FEW_BYTES:
        return np.array([_bytewise(b) for b in blobs], np.uint32)
    counts = -(-lens // SLICE)
    padded = np.zeros(int(counts.sum()) * SLICE, np.uint8)
    ends = np.cumsum(counts) * SLICE
    for blob, n, end in zip(blobs, lens.tolist(), ends.tolist()):
        padded[end - n : end] = np.frombuffer(blob, np.uint8)
        # the start value is the same as turning the first four bytes over
        padded[end - n : end - n + min(4, n)] ^= 0xFF
    own = _steps(np.zeros(len(padded) // SLICE, np.uint32), padded.reshape(-1, SLICE))
    crc, first = np.zeros(len(blobs), np.uint32), np.cumsum(counts) - counts
    for at in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > at)
        c = crc[live]
        moved = SHIFT[0][c & 0xFF] ^ SHIFT[1][c >> np.uint32(8) & 0xFF] ^ SHIFT[2][c >> np.uint32(16) & 0xFF] ^ SHIFT[3][c >> np.uint32(24)]
        crc[live] = moved ^ own[first[live] + at]
    # of a blob shorter than four bytes, what is left of the start value is in the register still
    short = np.array([0xFFFFFFFF >> (8 * n) if n < 4 else 0 for n in lens.tolist()], np.uint32)
    return crc ^ short ^ np.uint32(0xFFFFFFFF)


@pandas_udf(T.LongType())
def crc32c(blob: pd.Series) -> pd.Series:
    return pd.Series(crc32c_of([b or b"" for b in blob]).astype(np.int64))


def unpack(raw: bytes | None, n: int, checksummed: bool) -> list[dict] | None:
    """(offset, length) of each inner chunk; -1 for one that is missing; null if the size is wrong."""
    if raw is None or len(raw) != 16 * n + 4 * checksummed:
        return None
    pairs = np.frombuffer(raw[: 16 * n], "<u8").reshape(-1, 2)
    return [{"off": -1, "len": -1} if o == MISSING and m == MISSING else {"off": int(o), "len": int(m)} for o, m in pairs.tolist()]


@pandas_udf(T.ArrayType(T.StructType([T.StructField("off", T.LongType()), T.StructField("len", T.LongType())])))
def unpack_index(raw: pd.Series, n: pd.Series, checksummed: pd.Series) -> pd.Series:
    return pd.Series([unpack(r, int(k), bool(c)) for r, k, c in zip(raw, n, checksummed)])


@pandas_udf(T.BooleanType())
def index_checksum_ok(raw: pd.Series, checksummed: pd.Series) -> pd.Series:
    """True or false where there is a checksum, else null."""
    bodies = [(r or b"")[:-4] for r in raw]
    want = crc32c_of(bodies)
    return pd.Series([bool(int.from_bytes(r[-4:], "little") == w) if c and r and len(r) >= 4 else None for r, c, w in zip(raw, checksummed, want.tolist())], dtype="object")


TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 317: "predictor", 339: "format"}
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}


def tiff_header(raw: bytes | None) -> dict | None:
    """Tags of the first directory of a classic or big TIFF of either byte order; None if it isn't one."""
    try:
        end = {b"II": "<", b"MM": ">"}[raw[:2]]
        big = struct.unpack(end + "H", raw[2:4])[0]
        if big not in (42, 43):
            return None
        wide = big == 43
        at = struct.unpack(end + ("Q" if wide else "I"), raw[8:16] if wide else raw[4:8])[0]
        n = struct.unpack_from(end + ("Q" if wide else "H"), raw, at)[0]
        at += 8 if wide else 2
        step, head = (20, 12) if wide else (12, 8)
        out = {"little": end == "<", "big": wide}
        for i in range(n):
            tag, kind = struct.unpack_from(end + "HH", raw, at + i * step)
            count = struct.unpack_from(end + ("Q" if wide else "I"), raw, at + i * step + 4)[0]
            if tag in TAGS and kind in SIZES:
                code, size = SIZES[kind]
                place = at + i * step + head
                if size * count > (8 if wide else 4):
                    place = struct.unpack_from(end + ("Q" if wide else "I"), raw, place)[0]
                out[TAGS[tag]] = list(struct.unpack_from(f"{end}{count}{code}", raw, place))
        return out if "width" in out and "height" in out else None
    except (KeyError, struct.error, TypeError, IndexError):
        return None


def tiff_grid(raw: bytes, header: dict) -> np.ndarray | None:
    """Float samples of strips that are stored or deflated without predictor; else None."""
    bits, kind, packed = header.get("bits", [0])[0], header.get("format", [1])[0], header.get("compression", [1])[0]
    if kind != 3 or bits not in (32, 64) or packed not in (1, 8, 32946) or header.get("predictor", [1])[0] != 1:
        return None
    parts = [raw[o : o + c] for o, c in zip(header["offsets"], header["counts"])]
    data = b"".join(zlib.decompress(p) if packed != 1 else p for p in parts)
    shape = (header["height"][0], header["width"][0])
    grid = np.frombuffer(data, ("<" if header["little"] else ">") + f"f{bits // 8}")
    return grid.reshape(shape) if grid.size == shape[0] * shape[1] else None


def build_tiff(grid: np.ndarray) -> bytes:
    """A classic little-endian TIFF of one stored float strip, directory last."""
    data = grid.astype("<f4").tobytes()
    h, w = grid.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(data)), (339, 3, 3)]
    entries = b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


@pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("width", "height", "bits", "format")]))
def parse_tiff(raw: pd.Series) -> pd.DataFrame:
    rows = [tiff_header(r) or {} for r in raw]
    return pd.DataFrame({k: pd.array([r.get(k, [None])[0] for r in rows], dtype="Int32") for k in ("width", "height", "bits", "format")})


def fill_of(text: str | None, dtype: str) -> float:
    """The fill value as a number; special floats by name, none is zero."""
    if text is None:
        return 0.0
    return {"nan": np.nan, "infinity": np.inf, "-infinity": -np.inf}.get(text.strip('"').lower()) if text.strip('"').lower() in ("nan", "infinity", "-infinity") else float(text.strip('"'))


def chunk_status(raw: bytes | None, dtype: str, compressor: str, fill: str | None) -> str:
    """populated, empty, or undecodable: what can't be decoded or compared is never called clean."""
    codec = CODECS.get(compressor.split(":")[0])
    names = {"uint8": "|u1", "int8": "|i1", "uint16": "<u2", "int16": "<i2", "float32": "<f4", "float64": "<f8"}
    if raw is None:
        return "absent"
    if codec is None:
        return "undecodable"
    try:
        kind, body = np.dtype(names.get(dtype, dtype)), codec(raw)
        if len(body) < kind.itemsize:
            return "undecodable"
        values, want = np.frombuffer(body[: len(body) // kind.itemsize * kind.itemsize], kind), fill_of(fill, dtype)
    except (ValueError, TypeError, zlib.error):
        return "undecodable"
    same = np.isnan(values) if want != want else values == want
    return "empty" if same.all() else "populated"


def decoded_status(raw, dtype, compressor, fill) -> Column:
    """Status column of chunks; codecs that are registered here go to the tasks with it."""
    codecs = dict(CODECS)

    @pandas_udf(T.StringType())
    def status(raw: pd.Series, dtype: pd.Series, compressor: pd.Series, fill: pd.Series) -> pd.Series:
        CODECS.update(codecs)
        return pd.Series([chunk_status(*x) for x in zip(raw, dtype, compressor, (None if f is None or f != f else f for f in fill))])

    return status(raw, dtype, compressor, fill)
