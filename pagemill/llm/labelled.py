"""Bounded samples of labelled texts, for the classifiers that are trained here.

The bounds are parameters of sample(): ``per_class`` texts of each label, and
``most_chars`` characters of a text that may be in the sample; longer texts are
scored like all others, but not learnt from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import components, tables

FOLDS = 5
SAMPLE = 3000  # texts of each label, at most
SAMPLE_CHARS = 16_000  # of a text that may be in the sample, at most
SPARE = 2  # ids that are looked up for each text wanted, as some have no text or a long one


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod FOLDS; rows where it is 0 are held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def _known(labels: DataFrame, label: str) -> DataFrame:
    rows = tables.named(labels, "doc_id", label)
    return rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> tuple[list[bytes], list[int]]:
    """Texts and labels of up to ``per_class`` rows of each label that are not held out.

    Ids are chosen from ``labels`` in the order of a hash, then texts are read in one
    scan.  Of rows that repeat a doc_id the text with the smallest hash counts, of
    repeated labels the largest, so the sample is the same in every run and does not
    depend on partitions.
    """
    components.shared_folder(docs.sparkSession)
    known = _known(labels, label).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(SPARE * per_class).collect()]
    if not chosen:
        return [], []
    ids = docs.sparkSession.createDataFrame([(int(r.doc_id), r.y) for r in chosen], "doc_id long, y int")  # 2 * SPARE * per_class rows
    rows = tables.named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.where(F.length("text") <= most_chars).join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).checkpoint()  # 2 * SPARE * per_class rows at most
    there = sorted((r.place, r.doc_id, r.y) for r in one.select("doc_id", "y", F.xxhash64("doc_id", F.lit(3)).alias("place")).collect())
    taken = [(i, y) for y in (0, 1) for i in [i for _, i, of in there if of == y][:per_class]]
    if not taken:
        return [], []
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, y int")
    got = one.join(F.broadcast(wanted), ["doc_id", "y"]).select("doc_id", "y", "least.text").collect()
    got.sort(key=lambda r: r.doc_id)
    return [r.text.encode() for r in got], [r.y for r in got]


def share(labels: DataFrame, label: str) -> float | None:
    """The share of label 1 among the labelled rows that are not held out."""
    return _known(labels, label).agg(F.avg(F.col(label).cast("double"))).first()[0]
