"""Conversion of streams of pages: row by row, append mode, no state unless repeats are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.convert import to_markdown
from pagemill.options import DEFAULTS, Options


def convert_stream(pages: DataFrame, options: Options = DEFAULTS, column: str = "html", time: str | None = None, delay: str = "10 minutes", key: str = "url") -> DataFrame:
    """Add ``markdown``; with a time column, rows that repeat a key within the delay are dropped."""
    if time is not None:
        pages = pages.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return pages.withColumn("markdown", to_markdown(column, options))


def write_stream(converted: DataFrame, path: str, checkpoint: str, format: str = "parquet", **trigger: object) -> StreamingQuery:
    """Start writing; by default all that is there now, and then stop."""
    return converted.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
