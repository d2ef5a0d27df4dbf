"""Operator 4: toxicity by compression distance.

Two zstandard dictionaries are trained apart (``zstandard.train_dictionary``) on a
bounded sample of labelled rows that are not held out (labelled.py): one on ordinary
text, one on toxic text.  A text's windows (``WINDOW`` words) are compressed with the
ordinary dictionary alone and with the toxic one before it; by how many bytes the
toxic dictionary makes a window shorter is its gain.

Most of a toxic text is ordinary, so the toxic dictionary is trained in rounds on
witnesses: at first on whole toxic texts, then on the window of each that gained the
most, and from round ``NARROW`` on those words of its three best windows without which
they would not have gained.  Gains are always measured across halves of the sample,
the dictionaries of one half on the texts of the other, and from round ``AGREED`` on
those words stay that gained in both.

Counts and shares of windows over and under each gain, the largest gains, their mean
and spread are weighed by a logistic calibration, fitted across the same halves; the
final dictionaries use the whole sample.

Every window of every whole text is scored, in one scan without a shuffle; the
model (two dictionaries of at most ``ORDINARY`` and ``TOXIC`` bytes, and the
weights) has a fixed size.  What is in a dictionary is the trainer's choice: frequent
segments of what it is given.

Edges: a null or empty text has one empty window without gain; without labelled
rows of both classes every score is 0 (or 1 if all labels are 1).  Of a class with
too little text for the trainer the dictionary is that text itself.  Repeated rows
are scored alike; of rows that repeat a doc_id one text is in the sample
(labelled.py).  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest as hash_of

from pagemill.llm import labelled, quality

WINDOW, WITNESS = 16, 6  # words of a window when scoring, and when the toxic dictionary is trained
ORDINARY, TOXIC = 512 << 10, 8 << 10  # bytes of the dictionaries, at most
SPARE = (8, 1)  # bytes of sample that each byte of either dictionary needs
ROUNDS, NARROW, AGREED = 7, 3, 6  # of training on witnesses: windows at first, then words, then words that gain in both halves
LEAST = 4  # bytes that a witness gains
SHINGLE = 5
GAINS = np.arange(1, 12)
TOP = 4
_PRIME = (1 << 61) - 1
_MINIMA = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PARAMETERS = {"window_log": 20, "hash_log": 18, "chain_log": 18, "search_log": 6, "min_match": 6, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}


def windows(text: str, size: int) -> list[bytes]:
    """Runs of ``size`` words in lower case, a space on either side; one empty window of an empty text."""
    w = text.lower().encode().split()
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)] or [b""]


def trained(samples: list[bytes], most: int, segment: int, spare: int) -> bytes:
    """A dictionary of at most ``most`` bytes, made of segments that are frequent in the samples."""
    size = min(most, sum(map(len, samples)) // spare)
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, f=20, split_point=1.0, accel=1).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text
        return b" ".join(samples)[:most]


def ordinary_dictionary(texts: list[str]) -> bytes:
    return trained([t.lower().encode() for t in texts], ORDINARY, 32, SPARE[0])


def toxic_dictionary(samples: list[bytes]) -> bytes:
    return trained(samples, TOXIC, 48, SPARE[1])


class Gains:
    """Compares windows under the two dictionaries; compressors are made where it is used."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents, self.pair = (ordinary, toxic), None

    def __getstate__(self):
        return {"contents": self.contents, "pair": None}

    def _compressors(self):
        if self.pair is None:
            ordinary, toxic = self.contents
            parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
            self.pair = []
            for content in (ordinary, ordinary + toxic):  # what is nearest to the window is cheapest to refer to
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                if len(content) >= 8:
                    d.precompute_compress(compression_params=parameters)
                self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress)
        return self.pair

    def of(self, found: list[bytes]) -> np.ndarray:
        """The gain of each window."""
        ordinary, toxic = self._compressors()
        return np.array([len(ordinary(x)) - len(toxic(x)) for x in found])

    def features(self, text: str) -> np.ndarray:
        g = self.of(windows(text, WINDOW))
        over, under = (g[None, :] >= GAINS[:, None]).sum(axis=1), (g[None, :] <= -GAINS[:, None]).sum(axis=1)
        top = np.sort(g)[::-1][:TOP]
        top = np.append(top, np.full(TOP - len(top), g.min()))
        return np.concatenate([np.log1p(over), over / len(g), np.log1p(under), under / len(g), top, [g.mean(), g.std(), np.log1p(len(g))]])


class Model:
    def __init__(self, gains: Gains, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.gains, self.mean, self.scale, self.weights, self.bias = gains, mean, scale, weights, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.gains.features(t.decode()) for t in texts]).reshape(len(texts), len(self.mean))
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def _distinct(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """One of each group of near copies: copies would make their own words look typical.

    Two texts of a class are copies if two of three minima over their 5-word shingles
    are equal, so a shared passage alone seldom makes copies of them.
    """
    seen, out = set(), ([], [])
    for t, y in zip(texts, labels, strict=True):
        w = t.split()
        found = [hash_of(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))]
        least = [min((h * m) % _PRIME for h in found) for m in _MINIMA]
        keys = {(y, i, least[i], least[i - 1]) for i in range(3)}
        if not keys & seen:
            out[0].append(t)
            out[1].append(y)
        seen |= keys
    return out


def _fresh(texts: list[str], labels: list[int]) -> list[str]:
    """Toxic texts without the passages of ``SHINGLE`` words that an earlier one holds: else these would be learnt as toxic."""
    seen: set[int] = set()
    out = []
    for t, y in zip(texts, labels, strict=True):
        if not y:
            out.append(t)
            continue
        w = t.split()
        found = [hash_of(" ".join(w[i : i + SHINGLE]).encode()) for i in range(len(w) - SHINGLE + 1)]
        known = {i + k for i, x in enumerate(found) if x in seen for k in range(SHINGLE)}
        seen.update(found)
        out.append(" ".join(x for i, x in enumerate(w) if i not in known))
    return out


def _gainers(gains: Gains, window: bytes) -> list[bytes]:
    """The words of a window that its gain comes from: without one of these the gain falls by ``LEAST`` or more."""
    w = window.split()
    rest = [b" " + b" ".join(w[:i] + w[i + 1 :]) + b" " for i in range(len(w))]
    fall = gains.of([window])[0] - gains.of(rest)
    return [b" " + w[i] + b" " for i in np.flatnonzero(fall >= LEAST).tolist()]


def _dictionaries(texts: list[str], labels: list[int], half: np.ndarray) -> list[Gains]:
    """The dictionaries of either half, and of both (the last)."""
    texts = _fresh(texts, labels)
    parts = [np.flatnonzero(half == 0), np.flatnonzero(half == 1), np.arange(len(half))]
    ordinary = [ordinary_dictionary([texts[i] for i in part if not labels[i]]) for part in parts]
    samples = {i: [texts[i].lower().encode()] for i in range(len(texts)) if labels[i]}
    cut = {i: windows(texts[i], WITNESS) for i in samples}
    made = lambda h: Gains(ordinary[h], toxic_dictionary([x for i in parts[h] if i in samples for x in samples[i]]))
    for r in range(ROUNDS):
        halves = [made(0), made(1)]
        for i, found in cut.items():
            other = halves[1 - int(half[i])]
            gain = other.of(found)
            best = [found[j] for j in np.argsort(-gain, kind="stable")[: (1 if r < NARROW else 3)].tolist() if gain[j] >= LEAST]
            samples[i] = best if r < NARROW else [x for window in best for x in _gainers(other, window)]
        if r >= AGREED:
            agreed = set.intersection(*({x for i in samples if half[i] == h for x in samples[i]} for h in (0, 1)))
            samples = {i: [x for x in found if x in agreed] for i, found in samples.items()}
    return [made(0), made(1), made(2)]


def fit(texts: list[str], labels: list[int], natural: float | None = None) -> Model | Constant:
    """``natural``: the share of toxic rows among all labelled ones, if the sample's is another."""
    texts, labels = _distinct(texts, labels)
    y = np.array(labels, float)
    few = min(y.sum(), (1 - y).sum())
    if few < 1:
        return Constant(float(len(y) > 0 and y.mean() > 0.5))
    half = np.where(y == 1, np.cumsum(y), np.cumsum(1 - y)).astype(int) % 2  # either half has both classes
    *halves, whole = _dictionaries(texts, labels, half)
    x = np.array([halves[1 - h].features(t) for t, h in zip(texts, half.tolist(), strict=True)])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = (x - mean) / scale
    share = y.mean() if natural is None else min(max(natural, 0.01), 0.99)
    prior = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, b, ridge = np.zeros(x.shape[1]), 0.0, 1e-3 * max(1, 8 / few)
    for _ in range(3000):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * prior
        w -= 0.5 * (x.T @ e / len(y) + ridge * w)
        b -= 0.5 * e.mean()
    return Model(whole, mean, scale, w, float(b))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted, of every row of documents."""
    texts, known = labelled.sample(docs, labels, "toxic")
    model = fit([t.decode() for t in texts], known, labelled.share(labels, "toxic"))
    return quality.scored(docs, model.score, threshold)
