"""Lists of roots and levels as JSON lines, in the order in which they were written.

A line's place is its file, where its split begins in it, and its number inside the split; none of these
depends on how many splits a task reads. Line numbers come from the counts of the splits before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import sampling
from . import store_table

PLACE = ["file", "line"]


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``(file, line, value)``: every line of the text files, numbered from 1 in each."""
    text = spark.read.text(list(paths))
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    rows = store_table(rows)
    counts = rows.groupBy("file", "split").agg(F.count("*").alias("size"))
    before = counts.select("file", "split", (F.sum("size").over(W.partitionBy("file").orderBy("split")) - F.col("size")).alias("before"))
    inside = F.row_number().over(W.partitionBy("file", "split").orderBy("n"))
    return rows.withColumn("own", inside).join(before, ["file", "split"]).select("file", (F.col("before") + F.col("own")).alias("line"), "value")


def roots(lines: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``(root, file, line)`` of the first line of each root, counts of lines by what became of them).

    Blank lines are nothing; a line that is no object with a text ``root`` is bad: it is counted and left
    out, or with ``strict`` an error that names its place.
    """
    row = lines.filter(F.trim("value") != "")
    parsed = row.withColumn("root", F.get_json_object("value", "$.root"))
    good = F.col("root").isNotNull() & F.try_parse_json("value").isNotNull()
    if strict:
        place = F.concat_ws(" ", F.lit("no root in"), "file", F.lit("line"), F.col("line").cast("string"))
        parsed = parsed.withColumn("root", F.when(good, F.col("root")).otherwise(F.raise_error(place)))
    kept = parsed.filter(good).select("root", *PLACE)
    first = sampling.keep_first(kept, ["root"], PLACE)
    counts = parsed.agg(F.count("*").alias("lines"), F.count_if(~good).alias("bad"), F.count_distinct(F.when(good, F.col("root"))).alias("roots"))
    return first, counts.select("lines", "bad", "roots", (F.col("lines") - F.col("bad") - F.col("roots")).alias("repeated"))


LEVEL = "root string, level string, index int, present boolean, shape array<bigint>, chunks array<bigint>, dtype string, fill_value string, compressor string, dimension_separator string, zarr_format int, has_chunks boolean"


def levels(lines: DataFrame, only_sharded: bool = False, root_parts: tuple[str, ...] = (), random_roots: int = 0, seed: int = 0, most_roots: int | None = None) -> DataFrame:
    """Levels of a scan's JSON lines with their place: present ones with a shape and chunks, of the roots
    that are chosen: those that hold one of ``root_parts`` (all, without any), then ``random_roots`` of
    the others, the same on every run, at most ``most_roots`` in the order of their first lines."""
    row = F.from_json("value", LEVEL)
    rows = lines.filter(F.trim("value") != "").select(*PLACE, row.alias("r")).select(*PLACE, "r.*")
    rows = rows.filter("present and size(shape) > 0 and size(chunks) > 0 and root is not null")
    if only_sharded:
        rows = rows.filter(F.lower(F.coalesce("compressor", F.lit(""))) == "sharding_indexed")
    if not root_parts and most_roots is None:
        return rows
    rows = store_table(rows)
    first = rows.groupBy("root").agg(F.min(F.struct(*PLACE)).alias("first"))
    named = F.lit(True) if not root_parts else F.greatest(*(F.col("root").contains(p).cast("int") for p in root_parts), F.lit(0)) == 1
    chosen = first.filter(named).withColumn("draw", F.lit(0))
    if random_roots and root_parts:
        others = sampling.hashed_sample(first.filter(~named), "root", random_roots, seed)
        chosen = chosen.unionByName(others.withColumn("draw", F.lit(1)))
    if most_roots is not None:
        chosen = chosen.orderBy("draw", "first").limit(most_roots)
    return rows.join(chosen.select("root"), "root", "left_semi").select(*rows.columns)
