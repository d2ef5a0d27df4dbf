"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, fingerprints, line_dedup, quality, secrets, sentencepieces, simhash_dedup, suffix_dedup, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), texts=False)
    return out.drop("kept_text", "spans")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("error")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.drop("item_ids", "hit_spans")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(_table(spark, sf_dir, "documents"), sentencepieces.Vocabulary.load())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).drop("kept_text")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 7 SQL can express."""
    made = fingerprints.edited(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 8 SQL can express."""
    return op8(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it is deleted with this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {"op1_suffix_array_dedup": op1, "op2_warc": op2, "op3_benchmark_decontamination": op3, "op4_toxicity": op4, "op5_sentencepiece": op5, "op6_line_dedup": op6, "op7_document_fingerprints": op7, "op8_secret_scans": op8, "op9_quality_classifier": op9, "op10_simhash_near_dedup": op10, "pipeline": pipeline, "edited_texts": edited_texts, "secret_base_spans": secret_base_spans}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": suffix_dedup.ORACLE_SQL, "op2_warc": warc.ORACLE_SQL, "op3_benchmark_decontamination": decontaminate.ORACLE_SQL, "op6_line_dedup": line_dedup.ORACLE_SQL, "edited_texts": fingerprints.EDITED_SQL, "secret_base_spans": secrets.BASE_SQL}
