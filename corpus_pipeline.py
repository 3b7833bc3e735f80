"""A corpus pipeline of training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again for the next one. All but the last return the columns of ``documents``.

1. Quality classifier: documents whose text is unlike the trusted text of their language go.
2. SimHash near-duplicates: one document of each group stays. Five-word shingles; candidates
   differ in at most 32 bits of 128 (and 15 of the first 64), where documents with a similarity of
   0.8 differ in 19 on average; what joins two candidates is an exact similarity of 0.8 or more.
3. Benchmark decontamination: documents that hold a benchmark item go.
4. Secret scan: secrets are replaced by a mark in the text.
5. SentencePiece: token ids of each text, and whether decoding gives the text again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, decontamination, kneser_ney, secret_scan, sentencepiece_bpe, simhash_dedup
from plumbline.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.Classifier(docs, common.table(spark, sf_dir, "labels")).kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs, shingle=5, radius=15, blocks=8, confirm=32, node_rows=100_000, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sentencepiece_bpe.encode_checked(docs, tokenizer_path("piece_bpe_32k.model"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("tokenize", tokenize),
]

#: The stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
