"""Operator 8: secrets in texts, by fixed patterns and by character Markov models.

Base spans: assignments, access keys and hexadecimal runs, leftmost and not
overlapping per kind; matches that are too short are dropped after matching.

The method adds spans of kind ``markov``: strings of key characters whose
log-likelihood ratio under two character bigram models (random strings against
ordinary identifiers) is at least ``THRESHOLD`` per character.  Base spans are cut
out of each run of key characters.  A run that is strange as a whole is one span;
of any other, and of what is left beside base spans, the segments with the largest
sums are found, so a key in a path or an assignment stands out.  Both models
are bigram counts: the identifiers are the words of every document, each counted
once in it, except for base matches; random strings are the values of base matches
and strings drawn from the usual alphabets of keys with a fixed seed.

One scan counts, one scores every whole text; only counts are shuffled.  Places are
code points, ends exclusive.  A null or empty text has no spans.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import tables, words

KINDS = ("assign", "access", "hex", "markov")
RANDOM = 4000  # strings drawn
MIN_CHARS, THRESHOLD = 16, 1.0
DROP = 16.0  # a fall of the sum that ends a segment
# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is maximal, so this is the filtered [0-9a-f]+
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ALPHABETS = ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_")
_JOINTS = "/_+-"
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _bigrams(samples: Iterable[str]) -> np.ndarray:
    """How often each character follows another; each string starts after a zero."""
    c = np.frombuffer(b"".join(b"\0" + s.encode("ascii", "replace") for s in samples), np.uint8) & 127
    follows = c[1:] != 0
    return np.bincount(c[:-1][follows].astype(np.int64) * 128 + c[1:][follows], minlength=128 * 128)


class Markov:
    """Log-likelihood ratio of a string: random against ordinary, by counts of character bigrams."""

    def __init__(self, strange: np.ndarray, ordinary: np.ndarray):
        self.ratio = self._logs(strange) - self._logs(ordinary)

    @staticmethod
    def _codes(s: str) -> np.ndarray:
        return np.frombuffer(b"\0" + s.encode("ascii", "replace"), np.uint8) & 127

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        n = counts.reshape(128, 128) + 0.05
        return np.log(n / n.sum(axis=1, keepdims=True))

    def ratios(self, s: str) -> np.ndarray:
        """What each character adds."""
        c = self._codes(s)
        return self.ratio[c[:-1], c[1:]]

    def per_character(self, s: str) -> float:
        return float(self.ratios(s).mean()) if s else 0.0


def counted(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of the base matches and of the distinct identifiers of each text."""
    strange: list[str] = []
    every: list[str] = []
    for t in texts:
        spans = base_spans(t)
        strange += [t[a:b] for _, a, b in spans]
        left, at = [], 0
        for a, b in sorted((a, b) for _, a, b in spans):
            left.append(t[at : max(a, at)])
            at = max(at, b)
        t = " ".join([*left, t[at:]])
        # Words as they stand, joined as in identifiers, and runs of digits such as dates and numbers.
        found = [w for w in _WORD.findall(t) if not (len(w) >= MIN_CHARS and any(c.isdigit() for c in w) and any(c.isalpha() for c in w))]
        ordinary = set(found)
        triples = list(zip(found[::7], found[3::7], found[5::7], strict=False))
        ordinary.update("_".join(x) for x in triples)
        ordinary.update("_".join(x).upper() for x in triples)
        ordinary.update("/".join(x).lower() for x in triples)
        ordinary.update("-".join(x).lower() for x in triples)
        ordinary.update(f"{a.lower()}{b.capitalize()}{c.capitalize()}" for a, b, c in triples)
        every += ordinary
    return _bigrams(strange), _bigrams(every)


def model_of(strange: np.ndarray, ordinary: np.ndarray) -> Markov:
    """The models of counts and of strings that are drawn: at least half of what is random, a tenth of what is ordinary."""
    draw = random.Random(11)
    keys = _bigrams("".join(draw.choices(ALPHABETS[i % len(ALPHABETS)], k=draw.randint(16, 48))) for i in range(RANDOM))
    plain = []
    for _ in range(RANDOM // 2):  # plain numbers and dates are ordinary too
        plain.append("".join(draw.choices(string.digits, k=draw.randint(2, 20))))
        plain.append(f"{draw.randint(1970, 2039)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}T{draw.randint(0, 23):02}-{draw.randint(0, 59):02}-{draw.randint(0, 59):02}")
    numbers = _bigrams(plain)
    return Markov(keys + strange * min(1, keys.sum() / max(1, strange.sum())), ordinary + numbers * max(1, ordinary.sum() / (10 * numbers.sum())))


def train(texts: list[str]) -> Markov:
    return model_of(*counted(texts))


def corpus_model(rows: DataFrame) -> Markov:
    """The model of the column ``text`` of all rows: sums of at most 2 * 128 * 128 counts a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * 128 * 128, np.int64)
        for batch in words.small(batches, 64):
            total += np.concatenate(counted(batch.column("text").to_pylist()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bigram", "n"])

    total = np.zeros(2 * 128 * 128)
    for r in rows.select("text").mapInArrow(run, "bigram long, n long").groupBy("bigram").agg(F.sum("n").alias("n")).collect():
        total[r.bigram] = r.n
    return model_of(*np.split(total, 2))


def _word(text: str, i: int) -> tuple[int, int]:
    """The ends of the run of letters and digits around a place, or of that character alone."""
    a, b = i, i + 1
    if text[i].isalnum():
        while a > 0 and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
    return a, b


def _segments(ratio: np.ndarray, text: str) -> list[tuple[int, int]]:
    """Places of the strange segments of a piece, in one pass.

    A segment ends where the sum of what its characters are over the threshold has
    fallen by ``DROP`` from its best or to zero; no later segment starts before that
    place, as every sum up to it is negative.  At either end a segment takes the rest
    of a word that it holds half of, and leaves a word that it holds less of, if what
    comes out is still strange.
    """
    found = []
    start, total, best, end = 0, 0.0, 0.0, 0
    for i, x in enumerate([*(ratio - THRESHOLD).tolist(), -np.inf]):
        total += x
        if total > best:
            best, end = total, i + 1
        elif total <= 0 or best - total > DROP:
            if best > 0:
                found.append((start, end))
            start, total, best = i + 1, 0.0, 0.0
    out: list[tuple[int, int]] = []
    for a, b in found:
        (x, x_end), (y_start, y) = _word(text, a), _word(text, b - 1)
        if 2 * (min(b, x_end) - a) < x_end - x:
            x = x_end
        if 2 * (b - max(a, y_start)) < y - y_start:
            y = y_start
        if x >= y:
            x, y = a, b
        while y < len(text) and text[y] == "=":
            y += 1
        if ratio[x:y].mean() >= THRESHOLD:
            a, b = x, y
        a += b - a - len(text[a:b].lstrip(_JOINTS + "="))
        b = a + len(text[a:b].rstrip(_JOINTS))
        if out and a < out[-1][1]:
            a = out.pop()[0]
        if b - a >= MIN_CHARS:
            out.append((a, b))
    return out


def _pieces(a: int, b: int, base: list[Span]) -> Iterator[tuple[int, int]]:
    """What base spans leave of a run."""
    for x, y in sorted((x, y) for _, x, y in base if x < b and a < y):
        if a < x:
            yield a, x
        a = max(a, y)
    if a < b:
        yield a, b


def added_spans(text: str, base: list[Span], model: Markov) -> list[Span]:
    out = []
    for m in _RUN.finditer(text):
        for a, b in _pieces(*m.span(), base):
            if b - a < MIN_CHARS:
                continue
            ratio = model.ratios(text[a:b])
            if (a, b) == m.span() and ratio.mean() >= THRESHOLD:
                out.append(("markov", a, b))
            else:
                out += [("markov", a + x, a + y) for x, y in _segments(ratio, text[a:b])]
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_markov", pa.int64())])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, their digest, all spans, and the number added."""
    rows = tables.named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    model = corpus_model(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches):
            out = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = base_spans(t)
                more = added_spans(t, base, model)
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                out.append((i, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    return rows.mapInArrow(run, SCHEMA)


def _cased(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Leftmost matches and, between them, single characters make up a text; their lengths give the places.
_SQL_ASSIGN = rf"""({"|".join(_cased(w) for w in ("password", "passwd", "secret", "token"))}|{_cased("api")}_?{_cased("key")})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_kind(number: int, kind: str, pattern: str, keep: str) -> str:
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, z - length(p) AS a, z, p FROM (
  SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM (
    SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}|(?s:.)') AS ps FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {keep}"""


BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_sql_kind(0, "assign", _SQL_ASSIGN, f"length(regexp_extract(p, '{_SQL_ASSIGN}', 2)) >= {ASSIGN_LEAST}")}
UNION ALL {_sql_kind(1, "access", "AKIA[A-Z0-9]+", f"starts_with(p, 'AKIA') AND length(p) >= {ACCESS_LEAST}")}
UNION ALL {_sql_kind(2, "hex", "[0-9a-f]+", "regexp_matches(p, '^[0-9a-f]{16,}$')")}),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS l FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
