"""Chunk samples to codes, and the census of stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn

#: Code of each sample status; anything else is a fetch error.
STATUS_CODES = {
    "populated": "CHUNK_SAMPLE_POPULATED",
    "empty": "CHUNK_SAMPLE_EMPTY",
    "missing": "CHUNK_SAMPLE_MISSING",
    "absent": "CHUNK_SAMPLE_ABSENT",
    "undecodable": "CHUNK_UNDECODEABLE",
    "checksum_mismatch": "SHARD_INDEX_CHECKSUM_MISMATCH",
}


def sample_codes(samples: DataFrame) -> DataFrame:
    code = F.coalesce(F.create_map(*(F.lit(x) for kv in STATUS_CODES.items() for x in kv))[F.col("status")], F.lit("CHUNK_FETCH_ERROR"))
    return samples.withColumn("code", code).withColumn("severity", fn.severity_of("code"))


def level_codes(levels: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Levels with no samples, and levels of which every decodable sample is empty.

    Absent samples say nothing: missing, empty and zero-filled are three things.
    """
    decodable = F.col("status").isin("populated", "empty")
    sums = samples.filter("status <> 'absent'").groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(decodable).alias("decodable"), F.count_if(F.col("status") == "empty").alias("empty"))
    rows = levels.join(sums, keys, "left")
    none = F.when(F.equal_null("has_chunks", F.lit(False)), "CHUNK_LEVEL_NO_CHUNKS").otherwise("CHUNK_LEVEL_NO_SAMPLES")
    code = F.when(F.col("n").isNull(), none).when((F.col("decodable") > 0) & (F.col("decodable") == F.col("empty")), "CHUNK_SAMPLE_ALL_EMPTY")
    return rows.select(*keys, code.alias("code")).filter("code is not null").withColumn("severity", fn.severity_of("code"))


def census(chunks: DataFrame, keys: list[str], size: str, full: str, uncompressed: str, grid: int) -> DataFrame:
    """Present chunks and stored bytes of each level: exact if uncompressed and whole, else estimated."""
    rows = chunks.groupBy(*keys).agg(
        F.count("*").alias("present_chunks"),
        F.bool_and(F.col(uncompressed) & (F.col(size) == F.col(full))).alias("exact"),
        F.avg(size).alias("mean"),
        F.sum(size).alias("encoded"),
        F.sum(full).alias("raw"),
    )
    stored = F.when(F.col("exact"), F.col("encoded")).otherwise(F.col("mean") * F.col("present_chunks")).cast("bigint")
    share = F.try_divide(F.col("encoded"), F.col("raw"))
    return rows.select(
        *keys,
        "present_chunks",
        F.round(F.col("present_chunks") / grid, 6).alias("present_fraction"),
        stored.alias("stored_bytes"),
        F.round(F.try_divide(F.col("raw"), F.col("encoded")), 6).alias("compression_ratio"),
        (F.greatest(F.lit(0.0), 1 - share) * stored).cast("bigint").alias("recoverable_bytes"),
        F.when(F.col("exact"), "exact").otherwise("estimated").alias("basis"),
    )


def census_totals(rows: DataFrame, root: str) -> DataFrame:
    """Sums by root and over all (null root), with the sorted kinds of basis."""
    return rows.rollup(root).agg(
        F.count("*").alias("levels"),
        F.sum("present_chunks").alias("present_chunks"),
        F.sum("stored_bytes").alias("stored_bytes"),
        F.sum("recoverable_bytes").alias("recoverable_bytes"),
        F.array_join(F.array_sort(F.collect_set("basis")), "+").alias("basis"),
    )
