"""From documents to token ids: toxic documents go, of linked near copies one stays, documents with benchmark passages go,
personal data are replaced, and what is left is encoded. Each stage works on all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last returns ids. Nulls,
repeated rows, empty tables and extra columns are as the operators define them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._shared import drop_tables_of, materialize, scratch
from tidemill.llm.bpe import encode_documents
from tidemill.llm.decontam import drop_leaking
from tidemill.llm.jaccard_join import one_per_component
from tidemill.llm.pii import redacted
from tidemill.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the ordinal model rejects; it is fitted on labelled rows of the documents table."""
    train = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_toxic(docs, train, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the row with the smallest doc_id; of rows that repeat it, one."""
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window that matches a benchmark item."""
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of their kind; n_chars follows."""
    text = redacted(F.coalesce("text", F.lit("")))
    changed = docs.withColumn("text", F.when(F.col("text").isNotNull(), text))
    return changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: No SQL expresses the fitted model or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table; each other stage is written to the shared folder and read again, and
    then its own tables and its predecessor's are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if i:
            drop_tables_of(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
