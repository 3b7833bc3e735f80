"""Sharding by rendezvous hashing of stable record keys, with DataFrame functions only.

Each shard scores a key with ``-weight / ln(u)``, where u in (0, 1) comes from the first 52 bits of
MD5 over key and shard; the highest score wins, the lower shard number on ties. A shard that joins
only takes keys into itself, and shares follow the weights. The key alone decides, so equal texts
under different keys may part and rows with one key stay together.

Slots number the rows of each shard without gaps. No task sees a whole shard: rows are dealt to
buckets inside it, numbered there, and moved on by the counts of the buckets before, a table of
``shards * buckets`` rows at most. The bucket comes from the key and, so that one hot key doesn't
fill a bucket, from where the row lies in the input.

Defined cases: null text has size 1 and the CRC-32 of nothing (0); a null key is a key of its own;
repeated rows get slots of their own; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Buckets of each shard; their counts are what is broadcast.
BUCKETS = 64


def unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) that key and shard decide."""
    digits = F.substring(F.md5(F.concat_ws("|", key, F.lit(str(shard))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the position of its weight."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct((F.lit(-float(w)) / F.log(unit(key, i))).alias("score"), F.lit(-i).alias("rank")) for i, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return -best.getField("rank")


def assigned(rows: DataFrame, key_col: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """``rows`` with ``shard`` and, if ``grown`` weights are given, ``grown_shard``."""
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("\0null"))
    rows = rows.withColumn("shard", rendezvous(key, weights))
    return rows.withColumn("grown_shard", rendezvous(key, grown)) if grown else rows


def slotted(rows: DataFrame, order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` (with ``shard``) with ``slot``: 0, 1, ... in each shard."""
    # stored, as the rows' places in the input must be the same for counting and numbering
    dealt = common.stored(rows.withColumn("bucket", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(buckets)).cast("int")))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("shard", "bucket").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(F.broadcast(before), ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("own")).drop("bucket", "own", "before")


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``: a row for each row of ``docs``."""
    weights = list(weights or [1.0] * n_shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = slotted(assigned(rows, "doc_id", weights, [*weights, sum(weights) / len(weights)]), ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
