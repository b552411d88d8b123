"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Quality rejects go, one document of each near-duplicate group stays, documents that hold benchmark items
go, personal data is replaced in the texts, and the rest is encoded as SentencePiece ids. All but the last
stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash_dedup, pii, quality_classifier, sentencepieces
from tidemark.llm.common import discard, materialize, scope
from tidemark.llm.queries import model_path
from tidemark.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5."""
    return quality_classifier.keep(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates, and all others."""
    return minhash_dedup.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and telling terms replaced in their texts."""
    return pii.sanitise(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, parity, round_trip) of all documents."""
    return sentencepieces.encode(docs, sentencepieces.read_model(model_path()))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("encoding", encoding),
]

#: Models, sketches and graph searches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for itself, and its predecessor's table, go once its own
    table is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope() as made:
            after = materialize(stage(spark, docs, sf_dir), "pipeline")
            made[:] = [df for df in made if df is not after]
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
