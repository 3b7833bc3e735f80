"""Roll-ups of findings and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .. import schema


def counts(findings: DataFrame, by: tuple[str, ...] = ("code", "severity")) -> DataFrame:
    """Rows by each column alone and in total, in one pass; ``*`` stands for all values."""
    sets = [[F.col(c)] for c in by] + [[]]
    rows = findings.groupingSets(sets, *(F.col(c) for c in by)).agg(F.count("*").alias("n"))
    return rows.select(*(F.coalesce(F.col(c), F.lit("*")).alias(c) for c in by), "n")


def run_summary(roots: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: how many roots were asked for, have findings, are clean; findings by kind."""
    per_root = findings.groupBy("root").agg(F.count("*").alias("n"), F.count_if("actionable").alias("actionable"))
    return roots.select("root").join(per_root, "root", "left").agg(
        F.count("*").alias("roots"),
        F.count("n").alias("roots_with_findings"),
        F.count_if(F.col("n").isNull()).alias("roots_clean"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings"),
        F.coalesce(F.sum("actionable"), F.lit(0)).alias("actionable"),
        F.coalesce(F.sum(F.col("n") - F.col("actionable")), F.lit(0)).alias("informational"),
        F.count_if(F.col("actionable") > 0).alias("roots_with_defects"),
    )


def coverage(levels: DataFrame, by: str = "root") -> DataFrame:
    """How much of what is declared was observed; unknown is counted, never taken as clean."""
    tally = lambda c, v, on=F.lit(True): F.count_if((F.col(c) == v) & on)
    return levels.groupBy(by).agg(
        F.count("*").alias("declared"),
        F.count_if("present").alias("present"),
        tally("state", schema.UNKNOWN).alias("unknown"),
        tally("state", schema.ABSENT).alias("absent"),
        *(tally("chunk_state", v, F.col("present")).alias(f"chunks_{v.lower()}") for v in (schema.PRESENT, schema.ABSENT, schema.UNKNOWN)),
    )


def drift(rows: DataFrame, by: str, value: Column, code: str) -> DataFrame:
    """Keys whose values differ, with the values; a missing value is a value of its own."""
    seen = F.coalesce(value.cast("string"), F.lit("None"))
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(seen)).alias("values")).filter(F.size("values") > 1).select(by, F.lit(code).alias("code"), F.array_join("values", ",").alias("observed"))


def registry(findings: DataFrame, by: str = "root") -> DataFrame:
    """One row per defective root: sorted codes and the largest severity."""
    rank = fn.severity_rank("severity")
    rows = findings.filter("actionable").groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.max(rank).alias("top"), F.bool_or(rank == 3).alias("high"))
    names = F.array(*(F.lit(s) for s in schema.SEVERITIES))
    # the published registry knows high and low only; both are given
    return rows.select(by, "codes", F.get(names, F.col("top")).alias("max_severity"), F.when(F.col("high"), "high").otherwise("low").alias("compat_severity"))


def reports(rolled: DataFrame, findings: DataFrame, levels: DataFrame) -> DataFrame:
    """One nested document per root: verdict, coverage and findings in order."""
    found = findings.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("level", "code", "severity", "evidence_state"))).alias("findings"))
    return rolled.join(found, "root", "left").join(coverage(levels), "root", "left").select(
        "root",
        "integrity",
        "max_severity",
        "verdict",
        F.struct("declared", "present", "unknown", "absent").alias("coverage"),
        F.coalesce("findings", F.array().cast("array<struct<level:string,code:string,severity:string,evidence_state:string>>")).alias("findings"),
    )


def queue(rolled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Roots with a policy weight above zero."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("integrity")], F.lit(0.0))
    return rolled.select("root", "integrity", weight.alias("weight")).filter("weight > 0")
