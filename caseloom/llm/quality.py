"""A quality classifier by Bradley-Terry pairwise ranking.

Each text has a vector of counts and ratios over the whole of it, each ratio in
one of a few bins.  From labelled rows, pairs of a preferred (1) and another (0)
document are drawn; logistic loss on the difference of their features gives
weights, so a document's strength is the weighted sum of its features and
P(a preferred to b) = sigmoid(strength a - strength b).  The strength below
which lies the share of 0-labelled rows is the threshold; strengths are mapped
to (0, 1) so that it falls on `cut`.

The fit sees at most TRAIN_ROWS labels, chosen by a hash of the id, with at most
twice as many rows (of repeated ids those whose texts' hashes are least), and
PAIRS pairs; it runs on the driver and its size doesn't grow with the input.
Scoring is one pass without a shuffle.

Cases: a null text counts as empty and gets a score like any other; labels that
are null or without a document are left out; repeated rows and labels count
each; equal scores stay equal, and one on the threshold counts as kept; without rows of both labels every score is 0.5; empty tables give empty
results; other columns are kept where a column is added, else ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the fit.
TRAIN_ROWS, PAIRS = 20_000, 100_000
BINS = 10

#: Byte classes whose shares are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"#$%&*@^~", b"|<>{}[]=_\\/+", b"'\"`;:()-")
_MEMBER = np.zeros((256, len(CLASSES) + 1))
for _i, _c in enumerate(CLASSES):
    _MEMBER[list(_c), _i] = 1
_MEMBER[128:, -1] = 1
N_FEATURES = _MEMBER.shape[1] + 13


def features(text: str) -> list[float]:
    """The feature vector of a whole text."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _MEMBER / max(1, len(raw))).tolist()
    words = text.split()
    n = max(1, len(words))
    kinds = len(set(words))
    lines = text.split("\n")
    lead = sum(map(str.isalnum, words))
    upper = sum(map(str.isupper, words))
    title = sum(map(str.istitle, words))
    same = sum(map(eq, words, words[1:]))
    again = sum(map(eq, words, words[2:]))
    return shares + [
        math.log1p(len(words)),
        len(raw) / n,
        kinds / n,
        math.log1p(kinds) / math.log1p(n),
        same / n,
        again / n,
        upper / n,
        title / n,
        lead / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(words) / len(lines)),
        max(map(len, words), default=0) ** 0.5,
        sum(map(len, lines)) / max(1, len(text)),
    ]


def _one_by_one(column: pa.Array) -> Iterator[str | None]:
    """The texts, of which no more than one is copied from the column at a time."""
    return (t.as_py() for t in column)


def matrix(texts: Iterable[str | None]) -> np.ndarray:
    rows = [features(t or "") for t in texts]
    return np.array(rows, np.float64).reshape(len(rows), N_FEATURES)


@dataclass(frozen=True)
class Ranking:
    """A fitted model: bin edges and weights of each feature, and the map from strength to score."""

    edges: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for j in range(x.shape[1]):
            total += self.weights[j, np.searchsorted(self.edges[j], x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        z = np.clip(self.slope * (self.strength(x) - self.threshold) + math.log(self.cut / (1 - self.cut)), -30, 30)
        return 1 / (1 + np.exp(-z))

    def column(self, text: str | Column = "text") -> Column:
        """The score of a text column."""
        model = self

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(model.score(matrix(_one_by_one(texts))))

        return score(text)


def fit(x: np.ndarray, label: np.ndarray, cut: float = 0.3, pairs: int = PAIRS, rounds: int = 400, ridge: float = 1e-4, seed: int = 7) -> Ranking:
    """The model of feature rows x with labels 0 and 1; a function of the rows, whatever their order."""
    order = np.lexsort((*x.T, label))
    x, label = x[order], label[order]
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros((N_FEATURES, 1)), np.zeros((N_FEATURES, 2)), 0.0, 1.0, cut)
    edges = np.stack([_edges(x[:, j], x[bad, j]) for j in range(N_FEATURES)])
    width = edges.shape[1] + 1
    place = np.stack([np.searchsorted(edges[j], x[:, j], "right") for j in range(N_FEATURES)], axis=1) + np.arange(N_FEATURES) * width
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, m, v = np.zeros(N_FEATURES * width), np.zeros(N_FEATURES * width), np.zeros(N_FEATURES * width)
    for t in range(1, rounds + 1):
        s = w[place].sum(axis=1)
        miss = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        pull = np.bincount(a, miss, len(x)) - np.bincount(b, miss, len(x))
        grad = np.bincount(place.ravel(), np.repeat(pull, N_FEATURES), len(w)) / pairs - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w += 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    # a bin that no training row is in gets what its neighbours suggest
    seen = np.bincount(place.ravel(), minlength=len(w)).reshape(N_FEATURES, width) > 0
    w = np.stack([np.interp(np.arange(width), np.flatnonzero(full), row[full]) for row, full in zip(w.reshape(N_FEATURES, width), seen)]).ravel()
    ranked = np.sort(w[place].sum(axis=1))
    low = len(bad)
    threshold = float((ranked[low - 1] + ranked[low]) / 2) if low < len(ranked) else float(ranked[-1])
    s, slope = w[place].sum(axis=1) - threshold, 1.0
    offset = math.log(cut / (1 - cut))
    for _ in range(30):  # the slope that makes scores probabilities
        p = 1 / (1 + np.exp(-np.clip(slope * s + offset, -30, 30)))
        g, h = float(((label - p) * s).sum()) - 1e-3 * slope, float((p * (1 - p) * s * s).sum()) + 1e-3
        slope = min(max(slope + max(-1.0, min(1.0, g / h)), 0.1), 8.0)
    return Ranking(edges, w.reshape(N_FEATURES, width), threshold, slope, cut)


def _edges(all_rows: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Bin edges at quantiles of all rows and of those labelled 0."""
    return np.sort(np.concatenate([np.quantile(all_rows, np.arange(1, BINS) / BINS), np.quantile(bad, np.arange(1, 6) / 6)]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3, rows: int = TRAIN_ROWS) -> Ranking:
    """The model learnt from at most `rows` labelled rows that aren't held out."""
    known = labels.where(F.col(label_col).isin(0, 1)).where(~held_out(id_col)).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
    # at most `rows` rows of two numbers, so its size is bounded
    chosen = known.orderBy(F.xxhash64("key", F.lit(1)), "key", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))

    @F.arrow_udf("array<double>")
    def row(column: pa.Array) -> pa.Array:
        return pa.array(list(matrix(_one_by_one(column))), pa.list_(pa.float64()))

    # repeated ids can give more rows than labels: those of least hash are taken, so reruns agree; equal hashes are equal texts
    known = texts.join(F.broadcast(chosen), "key").select("label", F.xxhash64("text").alias("h"), row("text").alias("x"))
    got = known.orderBy("h", "label").limit(2 * rows).collect()
    x = np.array([r.x for r in got], np.float64).reshape(len(got), N_FEATURES)
    return fit(x, np.array([r.label for r in got], np.int64), cut)
