"""Table functions for SQL: headers, directories and indexes as rows, joined by LATERAL.

    register(spark)
    select h.root, t.* from headers h, lateral array_header(h.raw) t

Each gives no row for null, and one with ``error`` for bytes or text that it doesn't understand.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, IntegerType, IntegralType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


KINDS = {"int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "string": StringType(), "boolean": BooleanType()}


def _struct(text: str) -> StructType:
    """A schema from ``name type`` pairs; functions are analysed where no session is there to parse one."""

    def kind(name: str) -> DataType:
        return ArrayType(KINDS[name[6:-1]]) if name.startswith("array<") else KINDS[name]

    out = StructType()
    for field in text.split(", "):
        out.add(field.split()[0], kind(field.split()[1]))
    return out


def _checked(name: str, ddl: str, arguments: list[tuple[AnalyzeArgument, type | tuple, str]]) -> AnalyzeResult:
    """The schema, after a look at the arguments' types: a wrong one is an error of analysis, not of a task."""
    for argument, kind, what in arguments:
        if not isinstance(argument.dataType, kind):
            raise TypeError(f"{name}: {what} expected, not {argument.dataType.simpleString()}")
    return AnalyzeResult(_struct(ddl))


ARRAY_HEADER = "zarr_format int, shape array<bigint>, chunks array<bigint>, inner_chunks array<bigint>, dtype string, fill_value string, codecs array<string>, separator string, error string"


@udtf
class ArrayHeader:
    """An array's header of either format: one row."""

    @staticmethod
    def analyze(raw: AnalyzeArgument) -> AnalyzeResult:
        return _checked("array_header", ARRAY_HEADER, [(raw, StringType, "text")])

    def eval(self, raw: str | None) -> Iterator[tuple]:
        from plumbline.sources import arrays

        if raw is None:
            return
        try:
            h = arrays.parsed(json.loads(raw))
        except (ValueError, arrays.Undecodable, AttributeError) as e:
            yield (*[None] * 8, str(e)[:200])
            return
        yield h.zarr_format, list(h.shape), list(h.chunks), list(h.inner) if h.inner else None, h.dtype.name, h.fill, list(h.codecs), h.separator, None


PYRAMID_LEVELS = "idx int, path string, scale array<double>, axes array<string>, version string, error string"


@udtf
class PyramidLevels:
    """The datasets of a pyramid's attributes or group header: a row for each level."""

    @staticmethod
    def analyze(raw: AnalyzeArgument) -> AnalyzeResult:
        return _checked("pyramid_levels", PYRAMID_LEVELS, [(raw, StringType, "text")])

    def eval(self, raw: str | None) -> Iterator[tuple]:
        if raw is None:
            return
        try:
            doc = json.loads(raw)
            doc = doc.get("attributes", doc)
            ome = doc.get("ome") if isinstance(doc.get("ome"), dict) else {}
            block = (doc.get("multiscales") or ome.get("multiscales") or [None])[0]
            if not isinstance(block, dict):
                raise ValueError("no multiscales")
            axes = [str(a.get("name", "?")) if isinstance(a, dict) else str(a) for a in block.get("axes") or []]
            version = ome.get("version", block.get("version"))
            for i, d in enumerate(block.get("datasets") or []):
                scales = [t.get("scale") for t in d.get("coordinateTransformations") or [] if isinstance(t, dict) and t.get("type") == "scale"]
                yield i, str(d.get("path", i)), [float(v) for v in scales[0]] if scales and scales[0] else None, axes, None if version is None else str(version), None
        except (ValueError, AttributeError, TypeError) as e:
            yield None, None, None, None, None, str(e)[:200]


TIFF_DIRECTORY = "width bigint, height bigint, bits int, samples int, format string, compression int, predictor int, tiled boolean, little boolean, strips int, error string"


@udtf
class TiffDirectory:
    """The first directory of a TIFF that is wholly in a column: one row."""

    @staticmethod
    def analyze(raw: AnalyzeArgument) -> AnalyzeResult:
        return _checked("tiff_directory", TIFF_DIRECTORY, [(raw, BinaryType, "bytes")])

    def eval(self, raw: bytes | None) -> Iterator[tuple]:
        from plumbline.sources import surface_scan

        if raw is None:
            return
        raw = bytes(raw)
        try:
            d = surface_scan.tiff_directory(lambda start, n: raw[start : start + n], len(raw))
        except surface_scan.TiffError as e:
            yield (*[None] * 10, str(e)[:200])
            return
        yield d["width"], d["height"], d["bits"], d["samples"], d["format"], d["compression"], d["predictor"], d["tiled"], d["little"], len(d["offsets"]), None


SHARD_INDEX = "place int, offset bigint, length bigint, checksum_ok boolean, error string"


@udtf
class ShardIndex:
    """The entries of a shard's index, from its bytes, the number of inner chunks, and whether a
    checksum stands behind: a row for each; offset and length are null for one that is missing."""

    @staticmethod
    def analyze(raw: AnalyzeArgument, n: AnalyzeArgument, checksummed: AnalyzeArgument) -> AnalyzeResult:
        kinds = [(raw, BinaryType, "bytes"), (n, IntegralType, "a whole number"), (checksummed, BooleanType, "true or false")]
        return _checked("shard_index", SHARD_INDEX, kinds)

    def eval(self, raw: bytes | None, n: int | None, checksummed: bool | None) -> Iterator[tuple]:
        from plumbline.functions import binary

        if raw is None or n is None:
            return
        raw = bytes(raw)
        entries = binary.unpack(raw, n, bool(checksummed))
        if entries is None:
            yield None, None, None, None, f"{len(raw)} bytes are no index of {n}"
            return
        ok = int(binary.crc32c_of([raw[:-4]])[0]) == int.from_bytes(raw[-4:], "little") if checksummed else None
        for i, e in enumerate(entries):
            yield i, *((None, None) if e["off"] < 0 else (e["off"], e["len"])), ok, None


FUNCTIONS = {"array_header": ArrayHeader, "pyramid_levels": PyramidLevels, "tiff_directory": TiffDirectory, "shard_index": ShardIndex}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
