"""A corpus pipeline: classify quality, drop near copies, drop benchmark leaks, redact secrets, encode.

Every stage takes documents with any further columns, whatever their names, and gives them back; the last one
gives ids and texts. Nulls: a null text counts as empty; rows with a null or repeated id are documents of
their own in every stage, and equal rows are copies of one document. Very long texts are read whole. An empty
table goes through as an empty table; without labels or benchmark items nothing is dropped for them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointmill.functions.tables import shared_dir
from pointmill.llm import decontaminate, jaccard, pieces, quality_rank, queries, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts at or above its cut."""
    return quality_rank.accepted(docs, quality_rank.fit(docs, queries.table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the first by (doc_id, digest of the text), null ids last."""
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no verbatim window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the decoded text of every document."""
    return pieces.encode(docs, queries.piece_model())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The classifier is fitted and the near copies are found by hashing: not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage's result is written and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
