"""From raw documents to token ids: five stages, each one operator over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's
docs.  All but the last return the columns of ``documents``.  A stage's own tables go when the next stage begins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, neardup, pieces, pii, quality, store

ORACLE_SQL = None  # SQL can't express hashed regression or piece-wise encoding


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go."""
    with store.owned(spark, "pipeline"):
        return quality.select(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, with all its different texts."""
    with store.owned(spark, "pipeline"):
        return neardup.survivors(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    with store.owned(spark, "pipeline"):
        return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data and secrets in their texts are replaced by their kind."""
    with store.owned(spark, "pipeline"):
        return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    with store.owned(spark, "pipeline"):
        return pieces.encode(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("PII", redact_pii),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a table in the shared folder between each two, which goes once it was read."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{store.shared_dir(spark)}/textloom/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            store.delete(spark, f"{at}/{i - 1}")
    return docs
