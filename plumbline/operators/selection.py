"""Exact percentiles by distributed selection: no task holds a group, and no group is sorted.

Equal values of a key are counted first, so a value that a third of the rows have is one row. The
distinct values are dealt to ranges of (key, value); the counts of the ranges say which of them hold the
ranks that are asked for, and only these are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import store_table


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and, for each name in ``shares``, the percentile of the values that are neither null nor
    NaN, interpolated between neighbours; a key without such values has no row."""
    by = list(by)
    x = F.col(value).cast("double")
    # both zeros are one value, as in a comparison
    counts = rows.filter(x.isNotNull() & ~F.isnan(x)).select(*by, (x + F.lit(0.0)).alias("__x")).groupBy(*by, "__x").agg(F.count("*").alias("__c"))
    dealt = store_table(counts.repartitionByRange(*by, "__x").withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__c").alias("__n"))
    own = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a row for each range that a key lies in
    parts = parts.select(*by, "__part", (F.sum("__n").over(own.orderBy("__part")) - F.col("__n")).alias("__before"), "__n", F.sum("__n").over(own).alias("__size"))
    rank = lambda share: F.lit(float(share)) * (F.col("__size") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(rank(s)), F.ceil(rank(s))) for s in shares.values()))))
    # row numbers of the wanted ranks that lie in a range, from 0
    parts = parts.withColumn("__wanted", F.filter(wanted, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n"))))
    parts = parts.filter(F.size("__wanted") > 0)
    inside = W.partitionBy(*by, "__part").orderBy("__x")
    parts = parts.select(*(F.col(c).alias(f"__of{i}") for i, c in enumerate(by)), F.col("__part").alias("__in"), "__before", "__size", "__wanted")
    same = F.col("__part") == F.col("__in")
    for i, c in enumerate(by):  # null is a key like any other
        same = same & F.col(c).eqNullSafe(F.col(f"__of{i}"))
    upto = dealt.join(parts, same).withColumn("__upto", F.col("__before") + F.sum("__c").over(inside))
    hits = upto.select(*by, "__size", "__x", F.explode(F.filter("__wanted", lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__c")))).alias("__rank"))
    found = hits.groupBy(*by, "__size").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__at"))
    at = lambda r: F.element_at("__at", r)
    between = lambda s: at(F.floor(rank(s))) + (at(F.ceil(rank(s))) - at(F.floor(rank(s)))) * (rank(s) - F.floor(rank(s)))
    one = lambda s: F.when(F.floor(rank(s)) == F.ceil(rank(s)), at(F.floor(rank(s)))).otherwise(between(s))
    return found.select(*by, *(one(s).alias(name) for name, s in shares.items()))
