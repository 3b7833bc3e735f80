"""Evidence relations derived from the given tables, so that programs run on data of any size.

Each order is a pyramid and each of its lines a level; faults come from remainders of keys. The
same relations are written in SQL in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and line number (their pair is not unique in lineitem).

    Lines are dealt and sorted by root once; windows over a root and joins on it find them so.
    """
    root = F.concat(F.lit("root/"), F.col("l_orderkey").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select(root.alias("root"), (F.col("l_linenumber") - 1).alias("idx"), "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_returnflag")
    return (
        rows.repartition("root")
        .groupBy("root", "idx", "l_orderkey", "l_linenumber")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("q"),
            F.min("l_partkey").alias("pk"),
            F.min("l_suppkey").alias("sk"),
            F.min("l_returnflag").alias("rf"),
        )
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level headers of the pyramids, as a header scan would leave them."""
    own = W.partitionBy("root").orderBy("idx")
    pk, sk, n = F.col("pk"), F.col("sk"), F.col("l_linenumber")
    rows = lines(spark, sf_dir).withColumns({"b": F.first("q").over(own), "s0": F.first("l_linenumber").over(own)})
    extra = F.when(n == F.col("s0"), 0).otherwise(pk % 3)
    size = lambda k: F.greatest(F.lit(1), F.floor(F.lit(k) * F.col("b") * F.col("s0") / n)) + extra
    # columns of their own: what the function applied to a shape needs is not compiled
    rows = rows.withColumns({"d8": size(8), "d16": size(16), "chunk": (1 + pk % 64) * F.when(sk % 7 == 0, 16).otherwise(1), "scale": F.when(pk % 13 == 0, 1.0).otherwise(n.cast("double"))})
    shape = F.when(pk % 101 == 0, F.array(F.lit(0).cast("bigint"), "d16", "d16")).when(pk % 53 == 0, F.array("d16", "d16")).otherwise(F.array("d8", "d16", "d16"))
    chunk, scale = F.col("chunk"), F.col("scale")
    present = pk % 17 != 0
    transform = lambda kind, size: F.struct(F.lit(kind).alias("kind"), size.cast("int").alias("len"))
    scales = F.array_repeat(transform("scale", F.when(pk % 61 == 0, 2).when(pk % 67 != 0, 3)), F.when(pk % 43 == 0, 0).when(pk % 47 == 0, 2).otherwise(1))
    moves = F.array_repeat(transform("translation", F.lit(2)), F.when(pk % 59 == 0, 1).otherwise(0))
    return rows.select(
        "root",
        "idx",
        F.col("idx").cast("string").alias("path"),
        present.alias("present"),
        F.when(present | (pk % 3 == 1), "PRESENT").when(pk % 3 == 0, "UNKNOWN").otherwise("ABSENT").alias("state"),
        F.when(~present & (pk % 3 == 1), "METADATA_UNREADABLE").when(~present & (pk % 3 == 0), "SERVER_ERROR").alias("reason"),
        F.when(present, shape).alias("shape"),
        F.when(present, F.transform(shape, lambda _: chunk)).alias("chunks"),
        F.when(F.col("rf") == "A", "|u1").when(F.col("rf") == "N", "<u2").otherwise("<f4").alias("dtype"),
        F.when(pk % 29 != 0, "0").alias("fill_value"),
        F.when(sk % 4 == 0, "none").when(sk % 4 == 1, "zlib:l1").otherwise("blosc:lz4:l5").alias("compressor_id"),
        F.when(pk % 31 == 0, "/").otherwise(".").alias("separator"),
        F.when(pk % 37 != 0, F.array(scale, scale, scale)).alias("declared_scale"),
        F.when(sk % 19 == 0, False).when(sk % 23 != 0, True).alias("has_chunks"),
        F.when(sk % 19 == 0, "ABSENT").when(sk % 23 == 0, "UNKNOWN").otherwise("PRESENT").alias("chunk_state"),
        F.when(F.col("l_orderkey") % 2 == 0, 3).otherwise(2).alias("zarr_format"),
        F.when(pk % 41 != 0, F.array(F.lit("z"), F.lit("y"), F.lit("x"))).alias("dimension_names"),
        F.when(F.col("l_orderkey") % 14 == 7, F.array().cast("array<struct<kind:string,len:int>>")).otherwise(F.concat(scales, moves)).alias("transforms"),
    )


def pyramids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root documents of the pyramids."""
    k = F.col("o_orderkey")
    m = k % 40
    names = F.when(k % 11 == 0, F.array(F.lit("y"), F.lit("x"))).when(k % 11 == 1, F.array(F.lit("z"), F.lit("y"), F.lit("y"))).when(k % 11 == 2, F.array(F.lit("z"))).otherwise(F.array(F.lit("z"), F.lit("y"), F.lit("x")))
    kind = F.when(k % 13 == 0, F.lit(None).cast("string"))
    types = F.transform(names, lambda _, i: kind.when((k % 13 == 1) & (i == 1), "time").when(k % 13 != 0, "space"))
    unit = lambda i: F.when((k % 5 == 0) & ~((k % 15 == 0) & (i == 0)), F.when(k % 10 == 0, "nanometer").otherwise("micrometer"))
    units = F.transform(names, lambda _, i: unit(i))
    versions = {1: "0.4", 2: "0.5", 3: "0.6", 4: "0.10", 5: "junk", 6: "0.3"}
    version = F.lit(None).cast("string")
    for r, v in versions.items():
        version = F.when(k % 7 == r, v).otherwise(version)
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("root/"), k.cast("string")).alias("root"),
        F.when(m == 0, "UNKNOWN").when(m.isin(5, 6), "ABSENT").otherwise("PRESENT").alias("state"),
        F.when(m == 0, "SERVER_ERROR").when(m == 1, "METADATA_UNREADABLE").when(k % 80 == 7, "AUDIT_ERROR").alias("reason"),
        (m >= 10).alias("has_multiscales"),
        (m >= 8).alias("is_group"),
        (m >= 9).alias("multiscales_key"),
        F.when(m == 2, "array").when(m == 3, "headerless_chunks").when(m == 4, "container").when(m == 5, "absent").when(m == 6, "empty").otherwise("unknown").alias("node_kind"),
        version.alias("version"),
        (k % 14 != 7).alias("has_transforms"),
        names.alias("axes"),
        types.alias("axis_types"),
        units.alias("axis_units"),
        F.get(F.array_compact(units), F.lit(0)).alias("unit"),
        F.when(k % 9 == 0, "unknown").alias("marker"),
        F.when(k % 21 == 0, F.filter(F.sequence(F.lit(1), F.lit(3)), lambda j: (k + j) % 3 != 0)).otherwise(F.array().cast("array<int>")).alias("dirs_beyond"),
    )
