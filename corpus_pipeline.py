"""A corpus preparation pipeline of five training-data operators.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next stage's
``docs``.  All stages but the last return the columns of ``documents``; ``n_chars``
follows the text where a stage changes it.

For every stage: further columns of ``docs`` may have any name and are left out;
null and repeated doc_ids are rows like any others; a null text counts as an empty
one and stays null; repeated rows stay repeated, but for near-duplicates; an empty
table gives an empty one of the same columns.

This module stands at the top of the repository and is of no use without
``pagemill.llm``, whose operators it chains.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import components, decontaminate, line_dedup, quality, sentencepieces, simhash_dedup, tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY = 0.3  # documents that score less go

# No SQL for run()'s rows: the classifier, fingerprints and pieces cannot be
# expressed in it; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever else the table has."""
    return tables.named(docs, *COLUMNS).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, unchanged; rows of equal texts fare alike, and without labels all are accepted."""
    docs = _documents(docs)
    return quality.accepted(docs, quality.model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that at least ten documents hold; each row counts as a document."""
    return line_dedup.rewritten(_documents(docs), min_docs=10, min_chars=1)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: of the smallest doc_id (a null one is the largest), of ties that with the smallest hash."""
    return simhash_dedup.first_rows(_documents(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, unchanged; with an empty benchmark all of them."""
    return decontaminate.clean(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every document, and whether decoding them gives back the text (a null text has none)."""
    return sentencepieces.encoded_exactly(_documents(docs), sentencepieces.Vocabulary.load())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what lies between is kept in the shared folder."""
    folder = f"{components.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
