"""Rounds of messages between blocks of documents and buckets of keys.

An operator that must compare every position or line of a corpus with all
others would, as plain rows, shuffle the corpus many times over.  Here documents
are dealt once into *blocks* (the exchange is the same sub-plan in every round,
so Spark reuses it), a block removes its own duplicates first and sends each
*bucket* of the key space one packed message, and the bucket answers each block
with one bit or byte per key in the order sent.  A key that a third of all
documents hold therefore reaches its bucket once per block, not once per row.

Blocks and buckets grow in number with the input, never in size.  Everything is
a function of the rows, so a lost executor costs only a recomputed partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK_BYTES = 8 << 20
MESSAGE = "block int, bucket int, kind int, payload binary"
ECHO = -1  # bucket of a message that a block sends to itself
_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])

Messages = list[tuple[int, int, bytes]]  # (bucket, kind, payload)


def count_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` of text each, from one narrow aggregate."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(16, -(-int(total) // block_bytes))


def in_blocks(docs: DataFrame, n: int, extra: list[str] | None = None) -> DataFrame:
    """block, doc_id, text (null as empty); with ``extra``, also was_null and those columns.

    The block is a hash of doc_id and text, so rows with null or repeated ids spread.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"), F.lit(7))
    more = [F.col("text").isNull().alias("was_null"), *(F.col(c) for c in extra)] if extra is not None else []
    return docs.select(F.pmod(key, F.lit(n)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(doc ids with null as the largest long, whether null, texts as bytes)."""
    ids = table.column("doc_id").combine_chunks()
    none = np.asarray(ids.is_null())
    values = np.asarray(ids.fill_null(np.iinfo(np.int64).max), dtype=np.int64)
    return values, none, table.column("text").combine_chunks().cast(pa.large_binary()).to_pylist()


def inbox(table: pa.Table) -> dict[int, dict[int, bytes]]:
    """kind -> bucket -> payload, of the messages that a block has received."""
    out: dict[int, dict[int, bytes]] = {}
    for bucket, kind, payload in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
        out.setdefault(kind, {})[bucket] = payload
    return out


def _packed(block: int, messages: Messages) -> pa.Table:
    cols = list(zip(*messages, strict=True)) if messages else [(), (), ()]
    return pa.table([pa.array([block] * len(cols[0]), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], schema=_ARROW)


def send(blocks: DataFrame, received: DataFrame | None, fn: Callable[[pa.Table, dict], Messages]) -> DataFrame:
    """fn(documents of a block, its inbox) gives that block's messages."""
    if received is None:
        def first(docs: pa.Table) -> pa.Table:
            return _packed(docs.column("block")[0].as_py(), fn(docs, {}))

        return blocks.groupBy("block").applyInArrow(first, MESSAGE)

    def later(docs: pa.Table, messages: pa.Table) -> pa.Table:
        return _packed(docs.column("block")[0].as_py(), fn(docs, inbox(messages))) if docs.num_rows else _packed(0, [])

    return blocks.groupBy("block").cogroup(received.groupBy("block")).applyInArrow(later, MESSAGE)


def answer(messages: DataFrame, fn: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """fn(payloads of a bucket, one per block) gives one answer for each, in order.

    Messages to ECHO come back as they were sent; their key spreads by block.
    """

    def at(table: pa.Table) -> pa.Table:
        buckets = table.column("bucket").to_pylist()
        if buckets[0] == ECHO:
            return table.select(["block", "bucket", "kind", "payload"])
        order = np.argsort(np.asarray(table.column("block")), kind="stable")
        table = table.take(pa.array(order))
        got = fn(table.column("payload").to_pylist())
        return pa.table([table.column("block"), table.column("bucket"), table.column("kind"), pa.array(got, pa.binary())], schema=_ARROW)

    spread = F.when(F.col("bucket") == ECHO, F.col("block")).otherwise(F.lit(0))
    return messages.withColumn("lane", spread).groupBy("bucket", "lane").applyInArrow(at, MESSAGE)


def finish(blocks: DataFrame, received: DataFrame, fn: Callable[[pa.Table, dict], pa.Table], schema: str | StructType) -> DataFrame:
    def last(docs: pa.Table, messages: pa.Table) -> pa.Table:
        return fn(docs, inbox(messages))  # every message answers a block that has documents

    return blocks.groupBy("block").cogroup(received.groupBy("block")).applyInArrow(last, schema)


def split_sorted(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of each run in an array of sorted bucket numbers."""
    if len(buckets):
        edges = np.flatnonzero(np.diff(buckets)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)], strict=True):
            yield int(buckets[a]), slice(a, b)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the high half of a 64-bit hash: a sorted hash array is sorted by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)


def echo(got: dict) -> Messages:
    """All answers so far, sent by a block to itself for the rounds to come."""
    parts = [np.array([k, b, len(p)], "<i8").tobytes() + p for k, by in got.items() for b, p in by.items()]
    return [(ECHO, 0, b"".join(parts))]


def unecho(got: dict) -> dict:
    out = {k: dict(v) for k, v in got.items() if k}
    blob, at = got.get(0, {}).get(ECHO, b""), 0
    while at < len(blob):
        kind, bucket, size = np.frombuffer(blob, "<i8", 3, at).tolist()
        out.setdefault(kind, {})[bucket] = blob[at + 24 : at + 24 + size]
        at += 24 + size
    return out
