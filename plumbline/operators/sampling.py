"""Order-dependent choices of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from ..sources import store_table


def placed(rows: DataFrame, order: Sequence[str], place: str, by: Sequence[str] = (), size: str | None = None) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in ``order`` inside each key, and the key's ``size``.

    Rows are dealt to ranges of (key, order), numbered there, and moved on by the counts of the
    ranges before, so neither a hot key nor the whole relation is sorted by one task.
    """
    dealt = store_table(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    own = W.partitionBy(*by)  # a row per key and range that it lies in
    before = counts.select(*by, "__part", (F.sum("__n").over(own.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(own).alias("__size"))
    inside = F.row_number().over(W.partitionBy("__part", *by).orderBy(*order))
    out = dealt.withColumn("__own", inside).join(before, ["__part", *by])
    return out.select(*rows.columns, (F.col("__before") + F.col("__own")).alias(place), *([F.col("__size").alias(size)] if size else []))


def keep_first(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by a struct minimum: no sort, and partial on the map side."""
    rest = [c for c in rows.columns if c not in by and c not in order]
    first = rows.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(*by, *(F.col(f"first.{c}").alias(c) for c in (*order, *rest)))


def first_hits(rows: DataFrame, by: Sequence[str], order: Sequence[str], hit: Column, k: int, candidates: int) -> DataFrame:
    """The first k rows with ``hit`` among the first ``candidates`` of each key."""
    own = W.partitionBy(*by).orderBy(*order)
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ranked = rows.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= candidates)
    return ranked.withColumn("__hits", F.sum(hit.cast("int")).over(upto)).filter(hit & (F.col("__hits") <= k)).drop("__n", "__hits")


def until_gap(rows: DataFrame, by: str, position: str) -> DataFrame:
    """Positions of each key up to the first one missing, counted from its first."""
    own = W.partitionBy(by).orderBy(position)
    distinct = rows.select(by, position).distinct()
    return distinct.withColumn("__n", F.col(position) - F.row_number().over(own)).withColumn("__first", F.first("__n").over(own)).filter(F.col("__n") == F.col("__first")).select(by, position)


def undeclared(found: DataFrame, declared: DataFrame, by: str, position: str, last: str, most: int) -> DataFrame:
    """Of the positions ``found`` of each key, those that follow its last declared one without a gap, at most ``most``."""
    beyond = found.join(declared.select(by, last), by).filter((F.col(position) > F.col(last)) & (F.col(position) <= F.col(last) + most)).distinct()
    own = W.partitionBy(by).orderBy(position)  # ``most`` rows of a key
    return beyond.withColumn("__n", F.row_number().over(own)).filter(F.col(position) == F.col(last) + F.col("__n")).select(by, position)


def first_of_each(rows: DataFrame, by: str, name: str, k: int) -> DataFrame:
    """The first k names of each key as text, and how many there are: ranked, so a key's names are never gathered."""
    ranked = rows.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(name))).filter(F.col("__n") <= k)
    heads = ranked.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"))
    return heads.join(rows.groupBy(by).agg(F.count("*").alias("n")), by)


def even_sample(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """n rows of each key, evenly by position: places floor(i * size / n)."""
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("__size") / n))
    ranked = placed(rows, order, "place", by, "__size").withColumn("place", (F.col("place") - 1).cast("int"))
    return ranked.filter((F.col("__size") <= n) | F.array_contains(wanted, F.col("place").cast("bigint"))).drop("__size")


def spread_sample(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k rows of each key spread over its whole extent, both ends included."""
    ranked = placed(rows, order, "place", by, "__size").withColumn("place", (F.col("place") - 1).cast("int"))
    return ranked.filter(F.array_contains(fn.spread_positions(F.col("__size"), k), F.col("place").cast("bigint"))).drop("__size")


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same ones on every run."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.orderBy(order, key).limit(n)


def suffixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda i: F.substring(text, i, F.length(text)))


def prefixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda i: F.substring(text, F.lit(1), i))


def first_suffix(rows: DataFrame, name: str, table: DataFrame, suffix: str, order: str) -> DataFrame:
    """Each row with the first entry of a table whose suffix ends its name (left join).

    The names' suffixes are joined by equality, so neither side is sent whole to every task.
    """
    distinct = rows.select(F.col(name).alias("__name")).distinct()
    ends = distinct.select("__name", F.explode(suffixes(F.col("__name"))).alias(suffix))
    rest = [c for c in table.columns if c != order]
    first = ends.join(table, suffix).groupBy("__name").agg(F.min(F.struct(order, *rest)).alias("first"))
    found = rows.join(first, F.col(name) == F.col("__name"), "left")
    return found.select(*rows.columns, *(F.col(f"first.{c}").alias(c) for c in (order, *rest)))


def tile_starts(size: Column, tile: int, count: int) -> Column:
    """Starts of ``count`` tiles spread over an axis; one tile stands in the middle."""
    last = F.greatest(F.lit(0), size - tile)
    if count == 1:
        return F.array(F.floor(last / 2))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * last / F.lit(float(count - 1))).cast("bigint")))


def slab_starts(depth: Column, chunk: int, stride: int) -> Column:
    """Every ``stride``-th slab of ``chunk`` planes."""
    return F.when(depth > 0, F.sequence(F.lit(0), (depth - 1).cast("int"), F.lit(chunk * stride))).otherwise(F.array().cast("array<int>"))
