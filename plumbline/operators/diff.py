"""Differences between two snapshots of findings or levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Each root as common, added or dropped."""
    both = before.select(key).distinct().withColumn("b", F.lit(True)).join(after.select(key).distinct().withColumn("a", F.lit(True)), key, "full_outer")
    return both.select(key, F.when(F.col("b") & F.col("a"), "common").when(F.col("a"), "added").otherwise("dropped").alias("change"))


def fixed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of the first snapshot, on common roots, that the second hasn't."""
    return before.join(after.select(key).distinct(), key, "left_semi").select(*before.columns).subtract(after.select(*before.columns))


def new(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return fixed(after, before, key)


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.intersect(after.select(*before.columns))


def on_new_roots(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return after.join(before.select(key).distinct(), key, "left_anti").select(*after.columns).distinct()


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer comparison on keys: which rows are on one side only, which values differ.

    Missing values equal each other.
    """
    b = before.select(*keys, F.struct(*values).alias("b"))
    a = after.select(*keys, F.struct(*values).alias("a"))
    differing = F.filter(F.array(*(F.when(~F.equal_null(F.col(f"b.{v}"), F.col(f"a.{v}")), v) for v in values)), lambda x: x.isNotNull())
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "dropped").when(F.size(differing) > 0, "changed").otherwise("same")
    return b.join(a, list(keys), "full_outer").select(*keys, state.alias("change"), F.when(state == "changed", F.array_join(differing, ",")).otherwise("").alias("fields"))


def totals(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts by key on both sides, zero where there are none."""
    b, a = before.groupBy(key).agg(F.count("*").alias("n_before")), after.groupBy(key).agg(F.count("*").alias("n_after"))
    return b.join(a, key, "full_outer").select(key, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
