"""Conversion of columns of HTML: one Arrow-batched function per batch, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import text as X
from pagemill.functions.text import entity, plain
from pagemill.operators import html_tree, writer
from pagemill.options import DEFAULTS, Options


def to_markdown(html: Column | str, options: Options = DEFAULTS) -> Column:
    """The Markdown of a column of HTML; a fault in one fails the task."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda h: writer.convert(h, options), na_action="ignore")

    return run(html)


def try_to_markdown(html: Column | str, options: Options = DEFAULTS) -> Column:
    """struct<markdown, error>: a fault gives null and its text."""

    @F.pandas_udf("markdown string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for h in s:
                try:
                    rows.append((None if h is None else writer.convert(h, options), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["markdown", "error"], dtype=object)

    return run(html)


def to_markdown_with(html: Column | str, options: Column | str) -> Column:
    """Like to_markdown, with a map<string,string> of options in each row."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict[tuple, Options] = {}
        for h, o in batches:
            out = []
            for source, given in zip(h, o, strict=True):
                key = tuple(sorted(dict(given if given is not None else {}).items()))
                if key not in made:
                    if len(made) > 1000:
                        made.clear()
                    made[key] = Options.from_names(dict(key))
                out.append(writer.convert(source, made[key]))
            yield pd.Series(out, dtype=object)

    return run(html, options)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly where a table has fewer partitions than the session has slots, as one small file has.

    Conversion is much dearer than moving a page; a table with enough partitions is left as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def convert(pages: DataFrame, options: Options = DEFAULTS, column: str = "html", output: str = "markdown") -> DataFrame:
    return (pages if pages.isStreaming else spread(pages)).withColumn(output, to_markdown(column, options))


EVENT = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()), T.StructField("depth", T.IntegerType())])


def _events(html: str | None, unicode_snob: bool) -> list[dict]:
    out, depth = [], 0
    value = lambda pieces: "".join(entity(s, unicode_snob) if e else plain(s) for s, e in pieces).replace(X.NBSP, " ")
    for pos, (kind, tag, more) in enumerate(html_tree.events(html_tree.parse(html)) if html else []):
        depth -= kind == "end"
        out.append({"pos": pos, "kind": kind, "tag": tag or None, "attrs": {k: value(v) for k, v in more.items()} if kind == "start" else None, "text": value(more) if kind == "text" else None, "depth": depth})
        depth += kind == "start"
    return out


def html_events(html: Column | str, unicode_snob: bool = True) -> Column:
    """array<struct>: the tree of each text in document order."""

    @F.udf(T.ArrayType(EVENT), useArrow=True)
    def run(h: str | None) -> list[dict] | None:
        return None if h is None else _events(h, unicode_snob)

    return run(html)


def events(pages: DataFrame, column: str = "html") -> DataFrame:
    """A row per event of each page."""
    return spread(pages.select("page_id", column)).select("page_id", F.explode(html_events(column)).alias("e")).select("page_id", "e.*")


def wrap(text: Column | str, width: int = 75, line_break: str = "\n", cut: bool = False) -> Column:
    """Word wrap by user-perceived characters, lines joined by ``line_break``; with ``cut`` long words are cut."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: line_break.join(X.wrap(t, width, cut)), na_action="ignore")

    return run(text)


def align_tables(text: Column | str, margin: int = 1, mark: str = X.TABLE_MARK) -> Column:
    """Align the table lines between marks in each text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: X.align_tables(t, margin, mark), na_action="ignore")

    return run(text)
