"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket string, fp long, hits string, `row` int"


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Rows with the columns of documents and others whose names the operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), 1, "b", 2, "h", 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n)]


def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages and lines, long, short, empty and null texts, ties and a null id."""
    passage = " ".join(words(1, 40))
    long = " ".join(words(2, 3000))
    rows: list[tuple[int | None, str | None]] = [(i, " ".join(words(100 + i, 30 + i)) + ".\nCommon Line\n" + " ".join(words(200 + i, 5))) for i in range(24)]
    rows += [(40 + i, f"{' '.join(words(300 + i, 8))} {passage} {' '.join(words(400 + i, 9))}") for i in range(5)]
    rows += [(50, long), (51, long[:9000] + " X " + long[9003:]), (52, long)]
    rows += [(60, None), (61, ""), (62, "short"), (63, "x" * 400), (64, "é" * 120), (65, "x" * 300), (None, passage), (None, None)]
    rows += [(70, "tie " + passage), (70, "tie " + passage), (71, "  common line \n\n\n"), (72, "\n")]
    return rows
