"""Columns by place, so that further columns of a table may have any name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def named(df: DataFrame, *wanted: str) -> DataFrame:
    """``df`` with the columns ``wanted`` under these names and every other one as other0, other1 and so on.

    Of names that differ only in case, or are repeated, the first equal one is taken.
    """
    place = {}
    for name in wanted:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name}")
        place[same[0]] = name
    return df.toDF(*(place.get(i, f"other{i}") for i in range(len(df.columns))))


def others(df: DataFrame) -> list[str]:
    """The names that named() gave to the columns that were not wanted."""
    return [c for c in df.columns if c.startswith("other")]
