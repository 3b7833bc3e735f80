"""Spark source ``array_cells``: an array of a store as rows of coordinates and a value.

Options: ``base`` (folder or URL), ``path`` of the array in it, ``replay`` (routes as JSON), ``axes``
(names, comma-separated; else the header's names, or z, y, x), ``task_bytes`` (decoded bytes a task,
64 MB), ``stored`` (true: leave out cells of chunks that are absent; else they have the fill value).

Comparisons of coordinates with numbers are pushed down: they bound a box, and only objects, and only
inner chunks of shards, that meet it are read. A task has a range of numbered chunks, so planning holds
two numbers for each task, however many chunks there are. Reads that fail end the job, as an array with
holes that are not its own would be wrong; for evidence of failures use ``probe``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import binary
from . import arrays
from .transport import open_store

#: Cells of an Arrow batch, and tasks of a scan at most.
BATCH_CELLS = 65_536
MOST_TASKS = 100_000


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def axes_of(header: arrays.Header, given: str | None) -> list[str]:
    names = given.split(",") if given else list(header.names)
    if len(names) != len(header.shape) or len(set(names)) < len(names) or not all(names):
        names = ["z", "y", "x"][-len(header.shape) :] if len(header.shape) <= 3 else [f"axis{i}" for i in range(len(header.shape))]
    return names


class CellReader(DataSourceReader):
    def __init__(self, options: dict, codecs: dict):
        self.options, self.codecs = {k.lower(): v for k, v in options.items()}, codecs
        self.header = arrays.header_of(self.store(), self.options["path"].strip("/"))
        self.axes = axes_of(self.header, self.options.get("axes"))
        self.start, self.stop = [0] * len(self.axes), list(self.header.shape)

    def store(self):
        return open_store(self.options.get("base", ""), self.options.get("replay"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow the box; what a box can't say exactly stays with Spark."""
        for f in filters:
            axis = self.axes.index(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 and f.attribute[0] in self.axes else None
            low, high, exact = -math.inf, math.inf, True
            if axis is not None and isinstance(f, (EqualTo, EqualNullSafe)):
                low, high = f.value, f.value + 1
            elif axis is not None and isinstance(f, GreaterThan):
                low = f.value + 1
            elif axis is not None and isinstance(f, GreaterThanOrEqual):
                low = f.value
            elif axis is not None and isinstance(f, LessThan):
                high = f.value
            elif axis is not None and isinstance(f, LessThanOrEqual):
                high = f.value + 1
            elif axis is not None and isinstance(f, In) and f.value:
                low, high, exact = min(f.value), max(f.value) + 1, False
            else:
                yield f
                continue
            self.start[axis], self.stop[axis] = int(max(self.start[axis], low)), int(min(self.stop[axis], high))
            if not exact:
                yield f

    def units(self) -> arrays.Units:
        return arrays.Units(self.header, tuple(self.start), tuple(self.stop))

    def partitions(self) -> list[InputPartition]:
        units = self.units()
        size = math.prod(units.extent) * self.header.dtype.itemsize
        each = max(1, int(self.options.get("task_bytes", 64 << 20)) // max(1, size), -(-len(units) // MOST_TASKS))
        return [Range(n, min(len(units), n + each)) for n in range(0, len(units), each)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        binary.CODECS.update(self.codecs)
        stored = self.options.get("stored", "false").lower() == "true"
        fill = arrays.fill_value(self.header)
        for low, high, values in arrays.blocks(self.store(), self.options["path"].strip("/"), self.units(), partition.first, partition.last):
            if values is None and stored:
                continue
            extent = tuple(b - a for a, b in zip(low, high))
            flat = None if values is None else values.reshape(-1)
            for at in range(0, math.prod(extent), BATCH_CELLS):
                n = min(BATCH_CELLS, math.prod(extent) - at)
                places = np.unravel_index(np.arange(at, at + n), extent) if extent else ()
                columns = [pa.array(p.astype(np.int64) + a) for p, a in zip(places, low)]
                value = np.full(n, fill, np.float64) if flat is None else flat[at : at + n].astype(np.float64)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], names=[*self.axes, "value"])


class ArrayCells(DataSource):
    codecs: dict = {}

    @classmethod
    def name(cls) -> str:
        return "array_cells"

    def reader(self, schema) -> CellReader:
        return CellReader(dict(self.options), type(self).codecs)

    def schema(self) -> str:
        return ", ".join([*(f"`{a}` bigint" for a in self.reader(None).axes), "value double"])


def cells(spark: SparkSession, base: str, path: str, **options: str) -> DataFrame:
    """The cells of an array. Codecs registered before this call reach the tasks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # a class made here is sent as it is, with the codecs it holds
    spark.dataSource.register(type("ArrayCells", (ArrayCells,), {"codecs": dict(binary.CODECS), "__module__": "__main__"}))
    reader = spark.read.format("array_cells").option("base", base).option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
