"""Removal of repeated byte strings by literal prefix doubling: Spark sorts pairs of ranks.

This is operator 1 as it is named: every position is a row (document, place, rank of
its first L bytes).  Spark sorts the pairs (rank at p, rank at p + L) over all
documents, equal pairs get one new rank, and positions whose pair is unique leave.
L doubles until it would pass the length wanted; then the second rank starts earlier
and overlaps.  Ranks are exact: the first ones are those of the bytes themselves.

It moves every position in every round, many times the text (README.md has figures),
so the query of operator 1 uses suffix_dedup.py, which gives the same rows; this
module is the measure that its results and its cost are held against.

Ties and edges as in suffix_dedup.py: equal doc_ids never remove from each other; a
null text is empty, a null doc_id the largest.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import components, tables

START = 8  # bytes of the first ranks
LAST = (1 << 63) - 1
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _numbered(keys: DataFrame, names: list[str]) -> DataFrame:
    """Distinct keys with their place in the sorted order of all (``number``): sorted by ranges, numbered range by range."""
    spread = keys.repartitionByRange(*names).sortWithinPartitions(*names).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")).checkpoint()
    sizes = sorted(spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = keys.sparkSession.createDataFrame(before, "part int, before long")
    return spread.join(F.broadcast(starts), "part").select(*names, (F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))


def _reranked(rows: DataFrame, names: list[str]) -> DataFrame:
    """row, id, pos, rank: the rank of each row's key among all keys; rows whose key one document alone has leave."""
    groups = rows.groupBy(*names).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(*names)
    return rows.join(_numbered(groups, names), names).select("row", "id", "pos", F.col("number").alias("rank")).checkpoint()


def dedup_by_ranks(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, as suffix_dedup.dedup_substrings gives them."""
    if length < START:
        raise ValueError(f"length must be at least {START}")
    components.shared_folder(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = tables.named(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), text.alias("b")).checkpoint()
    fits = rows.where(F.octet_length("b") >= length)
    at = fits.select("row", "id", "b", F.explode(F.expr(f"sequence(1, octet_length(b) - {START - 1})")).alias("pos"))
    ranks, have = _reranked(at.select("row", "id", "pos", F.substring("b", F.col("pos"), F.lit(START)).alias("bytes")), ["bytes"]), START
    while have < length:
        step = min(have, length - have)
        then = ranks.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("then"))
        ranks, have = _reranked(ranks.join(then, ["row", "pos"]), ["rank", "then"]), have + step
    first = ranks.groupBy("rank").agg(F.min("id").alias("first"))
    gone = ranks.join(first, "rank").where("first < id").groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, b, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "b", "gone")), strict=True):
                kept, end, spans, left = bytearray(), 0, 0, 0
                for p in places or ():
                    if p - 1 > end or not spans:
                        kept += b[end : p - 1]
                        spans, left = spans + 1, left + length
                    else:
                        left += p - 1 + length - end
                    end = p - 1 + length
                kept += b[end:]
                out.append((doc_id, len(b), left, spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.join(gone, "row", "left").select("doc_id", "b", "gone").mapInArrow(cut, SCHEMA)
