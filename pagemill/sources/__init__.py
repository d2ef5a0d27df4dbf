"""Readers of pages and writers of Markdown over Spark's own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """page_id (a hash of the path), url (the path) and html: a row per file."""
    files = spark.read.text(path, wholetext=True).withColumn("url", F.col("_metadata.file_path"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))


def read_pages(spark: SparkSession, path: str, format: str = "parquet", html: str = "html", url: str | None = "url", key: str | None = "page_id") -> DataFrame:
    """A table of pages in any format, with the usual names; a missing key is a hash of the html."""
    df = spark.read.format(format).load(path)
    return df.select((F.col(key) if key else F.xxhash64(html)).alias("page_id"), (F.col(url) if url else F.lit(None).cast("string")).alias("url"), F.col(html).alias("html"))


def write_markdown(converted: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """All columns as a table, or the Markdown alone as text, a row after the other."""
    if format == "text":
        converted = converted.select("markdown")
    converted.write.mode(mode).format(format).save(path)
