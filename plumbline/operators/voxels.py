"""Voxel support and depth statistics as relational aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from . import selection

PERCENTILES = {"p01": 0.01, "p50": 0.5, "p99": 0.99}


def support(voxels: DataFrame, plane: str, predicted: Column, supported: Column) -> DataFrame:
    """Positives and phantoms by plane and in total (null plane); fractions null without positives."""
    rows = voxels.rollup(plane).agg(F.count_if(predicted).alias("positives"), F.count_if(predicted & ~supported).alias("phantom"))
    return rows.withColumn("phantom_fraction", F.round(F.try_divide(F.col("phantom"), F.col("positives")), 6))


def depth_statistics(rows: DataFrame, depth: str, value: str) -> DataFrame:
    """Moments and exact percentiles over the finite values of each depth. The percentiles are selected by
    ranks over ranges of values, so no task holds a depth."""
    finite = fn.is_finite(value)
    x = F.when(finite, F.col(value))
    mean, square = F.avg(x), F.avg(x * x)
    stats = rows.groupBy(depth).agg(
        F.count("*").alias("n"),
        F.round(F.count_if(finite) / F.count("*"), 6).alias("finite_fraction"),
        F.round(F.count_if(finite & (F.col(value) != 0)) / F.count("*"), 6).alias("nonzero_fraction"),
        F.round(mean, 6).alias("mean"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)), 6).alias("std"),
    )
    found = selection.percentiles(rows.filter(finite).withColumnRenamed(depth, "__depth"), ["__depth"], value, PERCENTILES)
    both = stats.join(found, stats[depth].eqNullSafe(found["__depth"]), "left").drop("__depth")
    return both.withColumns({name: F.round(name, 6) for name in PERCENTILES})


def gradient(rows: DataFrame, depth: str, line: str, position: str, value: str) -> DataFrame:
    """Mean absolute difference between neighbours along each line."""
    step = F.abs(F.col(value) - F.lag(value).over(W.partitionBy(depth, line).orderBy(position)))
    steps = rows.withColumn("__step", step).filter(fn.is_finite("__step"))
    return steps.groupBy(depth).agg(F.round(F.try_divide(F.sum("__step"), F.count("*")), 6).alias("gradient_energy"))


def duplicates(rows: DataFrame, key: str, digest: Column) -> DataFrame:
    """Groups of two or more equal digests, named by their first key."""
    groups = rows.select(F.col(key).alias("k"), digest.alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    return groups.filter("n > 1").select("digest", "n", "first")


def peak(stats: DataFrame, depth: str, value: str) -> DataFrame:
    """The depth with the largest value, the first on ties, and its distance from the middle."""
    return stats.agg(F.max_by(F.col(depth), F.struct(F.col(value), -F.col(depth))).alias("peak"), ((F.min(depth) + F.max(depth)) / 2).alias("centre")).select("peak", (F.col("peak") - F.col("centre")).alias("offset"))
