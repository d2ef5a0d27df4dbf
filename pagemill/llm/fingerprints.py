"""Operator 7: document fingerprints by SimHash, in DataFrame operations only.

Each term (a run of letters and digits, lower-cased) votes with its XXH64 on the
signed bits of the fingerprint, weighted by its length (at most ``HEAVY``; 1 up to
``SHORT``), since short words are in every text.  Votes are summed in lanes: four 16-bit counters
share a long, so 16 sums per term do for 64 bits; a text is summed in chunks of
``CHUNK`` terms so that no lane overflows, and the chunks' lanes are widened to
32 bits before they are added up.  A bit is set where over half of the weight
votes for it.

``neighbours`` finds fingerprints within a Hamming radius by permuted block
tables: the bits are cut into radius + 3 blocks, of which any two fingerprints
within the radius share at least three; for each choice of three blocks there is
one table, keyed by their bits, and each key is looked up exactly.  A pair counts
in the first table it meets in.

``edited`` pairs each text with its edited text: documents in descending doc_id,
the last floor(n/2) code points replaced by the first as many of the next
document's.  Documents are dealt by ranges of doc_id (``RANGE`` ids), ordered
within them, and the ends of the ranges are linked through the ranges' own order,
level by level, so no task ever sees more than a range.  Ranges that null or repeated
ids make long are cut into parts, down to rows of one id and one hash.

Edges: a null text is empty; texts without terms have fingerprint zero; a null
doc_id counts as the largest; rows that tie in doc_id are ordered by a hash of
their text; of a single row the next is the row itself.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagemill.llm import components, tables

SHORT, HEAVY, CHUNK = 3, 12, 2048
RANGE = 256
HOT = 16 * RANGE  # rows of a range, beyond which it is cut into parts
SENT = 100_000  # such ranges that are sent to all tasks, at most; 9 bytes each
QUERIES = 20  # every row whose doc_id is divisible by it asks for its neighbours
_SPREAD, _LANES = 0x200040008001, 0x0001000100010001
_PAIR = 0x0000FFFF0000FFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def votes(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and ``fp``; ``terms`` has the keys, pos, h and w."""
    lanes = [F.sum((F.shiftright("h", 4 * j).bitwiseAND(_long(15)) * _long(_SPREAD)).bitwiseAND(_long(_LANES)) * F.col("w")).alias(f"s{j}") for j in range(16)]
    chunks = terms.groupBy(*keys, (F.col("pos") / CHUNK).cast("int").alias("chunk")).agg(*lanes, F.sum("w").alias("w"))
    wide = []
    for j in range(16):
        wide += [F.sum(F.col(f"s{j}").bitwiseAND(_long(_PAIR))).alias(f"e{j}"), F.sum(F.shiftrightunsigned(f"s{j}", 16).bitwiseAND(_long(_PAIR))).alias(f"o{j}")]
    total = chunks.groupBy(*keys).agg(*wide, F.sum("w").alias("w"))
    bits = None
    for b in range(64):
        lane = F.col(f"{'eo'[b % 4 % 2]}{b // 4}")
        count = F.shiftrightunsigned(lane, 32 * (b % 4 // 2)).bitwiseAND(_long(0xFFFFFFFF))
        bit = F.when(count * 2 > F.col("w"), F.shiftleft(_long(1), b)).otherwise(_long(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return total.select(*keys, bits.alias("fp"))


def _terms(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def fingerprints(rows: DataFrame, keys: list[str], texts: str = "texts") -> DataFrame:
    """keys, which, fp: of each text of the array column ``texts``; keys identify a row.

    If rows are partitioned by some of the keys, nothing is shuffled.
    """
    each = rows.select(*keys, F.posexplode(texts).alias("which", "text"))
    terms = each.select(*keys, "which", F.posexplode(_terms(F.col("text"))).alias("pos", "term"))
    size = F.length("term")  # an empty term, as each text without terms has, weighs nothing
    weight = F.when(size == 0, 0).when(size <= SHORT, 1).otherwise(F.least(size, F.lit(HEAVY)))
    weighed = terms.select(*keys, "which", "pos", F.xxhash64("term").alias("h"), weight.cast("long").alias("w"))
    return votes(weighed, [*keys, "which"])


def _below(groups: DataFrame) -> DataFrame:
    """g, next: each distinct g with the next smaller one (null for the smallest)."""
    n = groups.count()
    if n <= RANGE:
        return groups.select("g", F.lead("g").over(W.orderBy(F.desc("g"))).alias("next"))
    up = groups.withColumn("up", F.shiftright("g", RANGE.bit_length() - 1))
    within = up.select("g", "up", F.lead("g").over(W.partitionBy("up").orderBy(F.desc("g"))).alias("lead"))
    heads = up.groupBy("up").agg(F.max("g").alias("head"))
    order = _below(heads.select(F.col("up").alias("g"))).join(heads.select(F.col("up").alias("next"), "head"), "next").select(F.col("g").alias("up"), "head")
    return within.join(order, "up", "left").select("g", F.coalesce("lead", "head").alias("next"))


def _parted(rows: DataFrame) -> DataFrame:
    """Rows with their range ``g`` and, in ranges of more than ``HOT`` rows, a part of it (``sub``, 0 elsewhere).

    Parts go by doc_id and then by the hash of the text, in the order of the rows, so
    that null or repeated ids do not make one long range.
    """
    hot = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("g", F.lit(True).alias("hot")).checkpoint()
    few = hot.count()
    if not few:
        return rows.withColumn("sub", F.lit(0))
    of_id = _long(RANGE - 1) - F.col("doc_id").bitwiseAND(_long(RANGE - 1))
    place = F.coalesce(of_id, _long(-1)) * 64 + F.shiftright("tie", 58) + 32  # null ids come before the largest
    marked = rows.join(F.broadcast(hot) if few <= SENT else hot.hint("merge"), "g", "left")
    return marked.withColumn("sub", F.when(F.col("hot"), place).otherwise(_long(0)).cast("int")).drop("hot")


def edited(docs: DataFrame) -> DataFrame:
    """Each row with its place (g, sub, rn), its text, the next row's key and its edited text."""
    rows = tables.named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("g", F.shiftright(F.coalesce("doc_id", _long((1 << 63) - 1)), RANGE.bit_length() - 1))
    rows = _parted(rows)
    order = W.partitionBy("g", "sub").orderBy(F.desc_nulls_first("doc_id"), "tie")
    # What follows reads this twice with the same columns, so that its exchange is made once.
    lead = [F.lead(c).over(order).alias(f"then_{c}") for c in ("text", "doc_id", "tie")]
    placed = rows.select("g", "sub", F.row_number().over(order).alias("rn"), "doc_id", "tie", "text", *lead, F.lead(F.lit(1)).over(order).isNull().alias("ends"), F.lag(F.lit(1)).over(order).isNull().alias("opens"))
    parts = rows.select("g", "sub").distinct().checkpoint()
    groups = parts.groupBy("g").agg(F.min("sub").alias("first")).checkpoint()
    ends = groups.agg(F.min("g").alias("low"), F.max("g").alias("high")).first()
    below = _below(groups.select("g")).select("g", F.coalesce("next", F.lit(ends.high)).alias("next"))  # after the last, the first
    below = below.join(groups.select(F.col("g").alias("next"), "first"), "next")
    within = parts.select("g", "sub", F.lead("sub").over(W.partitionBy("g").orderBy("sub")).alias("lead"))  # 64 * (RANGE + 1) parts at most
    after = within.join(below, "g").select("g", "sub", F.when(F.col("lead").isNull(), F.col("next")).otherwise(F.col("g")).alias("next"), F.coalesce("lead", "first").alias("next_sub"))
    heads = placed.where("opens").select(F.col("g").alias("next"), F.col("sub").alias("next_sub"), *(F.col(c).alias(f"head_{c}") for c in ("text", "doc_id", "tie")))
    both = placed.join(after.join(heads, ["next", "next_sub"]).drop("next", "next_sub"), ["g", "sub"])
    then = {c: F.when(F.col("ends"), F.col(f"head_{c}")).otherwise(F.col(f"then_{c}")) for c in ("text", "doc_id", "tie")}
    n = F.length("text")
    half = F.shiftright(n, 1)
    made = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(then["text"], F.lit(1), half))
    return both.select("g", "sub", "rn", "doc_id", "tie", then["doc_id"].alias("next_id"), then["tie"].alias("next_tie"), "text", made.alias("edited"))


def _keys(fp: Column, radius: int) -> list[Column]:
    """The table keys of a fingerprint: each choice of three blocks, in order."""
    n = radius + 3
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    out = []
    for choice in combinations(range(n), 3):
        mask = 0
        for i in choice:
            mask |= signed[i]
        out.append(fp.bitwiseAND(_long(mask)))
    return out


def neighbours(queries: DataFrame, stored: DataFrame, radius: int = 3) -> DataFrame:
    """query, the columns of stored, distance: all stored fingerprints within ``radius`` of each query.

    Both have distinct longs in column ``fp``.
    """
    left = queries.select(F.col("fp").alias("query"), F.posexplode(F.array(*_keys(F.col("fp"), radius))).alias("t", "key"))
    right = stored.select("*", F.posexplode(F.array(*_keys(F.col("fp"), radius))).alias("t", "key"))
    same = [a == b for a, b in zip(_keys(F.col("query"), radius), _keys(F.col("fp"), radius), strict=True)]
    first = F.coalesce(*(F.when(s, F.lit(i)) for i, s in enumerate(same)))
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    met = (left.t == right.t) & (left.key == right.key) & (distance <= radius) & (first == left.t)
    # Without the hint the size of the queries is guessed from before they are multiplied by the tables.
    return left.hint("merge").join(right, met).select("query", *stored.columns, distance.alias("distance"))


def compare(docs: DataFrame, radius: int = 3, every: int = QUERIES) -> DataFrame:
    """Fingerprints of each text and its edited text, their likeness, that to the next text, and counts of near documents.

    ``near_docs``: of rows whose doc_id is divisible by ``every``, the number of
    other rows within the radius; null for the others.
    """
    components.shared_folder(docs.sparkSession)
    pairs = edited(docs)
    facts = pairs.select("g", "sub", "rn", "doc_id", "tie", "next_id", "next_tie", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array("text", "edited").alias("texts"))
    keys = facts.columns[:-1]
    fps = fingerprints(facts, keys)
    known = fps.groupBy(keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp")).drop("g", "sub", "rn").checkpoint()
    after = known.groupBy(F.col("doc_id").alias("after_id"), F.col("tie").alias("next_tie")).agg(F.min("fp").alias("nfp"))
    count = known.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    asked = known.where(F.col("doc_id") % every == 0).select("fp").distinct()
    near = neighbours(asked, count, radius).groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("near_docs"))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    like = lambda a, b: 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64.0
    whole = known.join(after, (known.next_tie == after.next_tie) & known.next_id.eqNullSafe(after.after_id)).join(near, "fp", "left")
    return whole.select("doc_id", "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("efp").alias("edited_fingerprint"), like("fp", "efp").cast("double").alias("near_edited"), like("fp", "nfp").cast("double").alias("near_next"), F.when(F.col("doc_id") % every == 0, F.col("near_docs")).alias("near_docs"))


# What of the edited texts needs no fingerprint; doc_ids are unique.
EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, lead(t) OVER (ORDER BY doc_id DESC) AS after FROM d),
z AS (SELECT doc_id, t, coalesce(after, (SELECT arg_max(t, doc_id) FROM d)) AS after FROM n)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(after, 1, length(t) // 2)) AS edited_sha256 FROM z
"""
