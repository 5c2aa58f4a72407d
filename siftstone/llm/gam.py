"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few style features (lengths, shares of capitals, digits, symbols,
repeated words and lines). Features are cut into quantile bins; cyclic boosting fits one shallow tree after
another to each feature in turn at a low rate, so that the trees of a feature add up to one
lookup table; then the strongest pairs of features get two-dimensional tables the same
way. A score is the sum of the looked-up values, through the logistic function: one vectorised bin addition per
table for a whole batch.

The model learns from at most max_train labelled rows (a documented bound; the rows
with the smallest hash of their id). Nothing but the text enters a score.

Edge cases: null and empty texts get the score of all-zero features; a null label is no label; of
repeated labels of an id the largest counts; without labelled rows every score is
0.5; with one class only, the share of that class decides; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, extended, tidy

FEATURES = (
    "log_bytes", "word_bytes", "upper", "digits", "symbols", "bars", "exclamations", "periods", "commas",
    "line_words", "distinct", "top_word", "repeated_lines", "repeated_bytes", "non_ascii", "longest_word", "other_marks",
)
_SYMBOLS = np.array([ord(c) for c in "#$%&*@^~_+=<>{}[]\\"])
_OTHER = np.array([ord(c) for c in "\"'()-/:;?`"])


def features(text: bytes) -> list[float]:
    """Style features of a UTF-8 text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    count = Counter(text.split())
    n_words = max(1, count.total())
    lines = text.split(b"\n")
    kept = set(lines)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    return [
        float(np.log1p(n)),
        n / n_words,
        upper / max(1, upper + lower),
        hist[48:58].sum() / n,
        hist[_SYMBOLS].sum() / n_words,
        hist[124] / n_words,
        hist[33] / n_words,
        hist[46] / n_words,
        hist[44] / n_words,
        n_words / len(lines),
        len(count) / n_words,
        max(count.values(), default=0) / n_words,
        1 - len(kept) / len(lines),
        1 - (sum(map(len, kept)) + len(kept)) / (n + 1),
        hist[128:].sum() / n,
        float(max(map(len, count), default=0)),
        hist[_OTHER].sum() / n_words,
    ]


def _tree(g: np.ndarray, h: np.ndarray, depth: int, smooth: float, least: float) -> np.ndarray:
    """Leaf values by bin of a greedy tree over ordered bins with gradient and curvature sums."""
    value = np.full(len(g), g.sum() / (h.sum() + smooth))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - g.sum() ** 2 / (h.sum() + smooth)
        gain[(hl < least) | (hr < least)] = 0
        k = int(np.argmax(gain))
        if gain[k] > 1e-9:
            value[: k + 1] = _tree(g[: k + 1], h[: k + 1], depth - 1, smooth, least)
            value[k + 1 :] = _tree(g[k + 1 :], h[k + 1 :], depth - 1, smooth, least)
    return value


def _cut_gain(g: np.ndarray, h: np.ndarray, smooth: float, least: float) -> float:
    """Largest gain of one cut through a row of sums."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - g.sum() ** 2 / (h.sum() + smooth)
    return max(0.0, float(np.max(gain, initial=0.0, where=(hl >= least) & (hr >= least))))


def _tree2(g: np.ndarray, h: np.ndarray, smooth: float, least: float) -> np.ndarray:
    """Leaf values of a two-level tree over a table of two features: one cut across one of them, then one across the
    other on each side. The first cut is judged with its best second cuts, as a pure interaction gains nothing at first."""
    value = np.full(g.shape, g.sum() / (h.sum() + smooth))
    best = (1e-9, 0, 0)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, len(gg)):
            sides = [(gg[:k].sum(0), hh[:k].sum(0)), (gg[k:].sum(0), hh[k:].sum(0))]
            if min(x[1].sum() for x in sides) < least:
                continue
            gain = sum(a.sum() ** 2 / (b.sum() + smooth) + _cut_gain(a, b, smooth, least) for a, b in sides)
            gain -= g.sum() ** 2 / (h.sum() + smooth)
            if gain > best[0]:
                best = (float(gain), axis, k)
    if best[2]:
        _, axis, k = best
        out, gg, hh = (value, g, h) if axis == 0 else (value.T, g.T, h.T)
        out[:k] = _tree(gg[:k].sum(0), hh[:k].sum(0), 1, smooth, least)
        out[k:] = _tree(gg[k:].sum(0), hh[k:].sum(0), 1, smooth, least)
    return value


class Gam:
    """Additive lookup tables over binned features and pairs of features."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1):
        self.n_bins, self.n_pair_bins, self.rounds, self.pair_rounds = bins, pair_bins, rounds, pair_rounds
        self.n_pairs, self.rate = pairs, rate
        self.intercept = 0.0
        self.edges: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        n = len(y)
        if not n:
            return self
        share = (y.sum() + 1) / (n + 2)
        self.intercept = float(np.log(share / (1 - share)))
        self.edges = [self._cuts(c, self.n_bins) for c in x.T]
        self.pair_edges = [self._cuts(c, self.n_pair_bins) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if len(np.unique(y)) < 2:
            return self
        b = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        z = np.full(n, self.intercept)
        smooth, least = 1.0, max(1.0, 0.0005 * n)
        p = 1 / (1 + np.exp(-z))
        for _ in range(self.rounds):
            for j, t in enumerate(self.tables):
                if len(t) == 1:
                    continue
                g = np.bincount(b[j], y - p, len(t))
                h = np.bincount(b[j], p * (1 - p), len(t))
                step = self.rate * _tree(g, h, 2, smooth, least / 4)
                t += step
                z += step[b[j]]
                p = 1 / (1 + np.exp(-z))
        for t, c in zip(self.tables, b, strict=True):  # centred, so that a table is a feature's own effect
            mean = float(t[c].mean())
            t -= mean
            self.intercept += mean
        c = [np.searchsorted(e, col, "right") for e, col in zip(self.pair_edges, x.T, strict=True)]
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            shape = (len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)
            cell = c[i] * shape[1] + c[j]
            g, h = np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1])
            gains.append((float((g**2 / (h + smooth)).sum()), i, j, shape))
        chosen = sorted(gains, key=lambda v: (-v[0], v[1], v[2]))[: self.n_pairs]
        self.pairs = [(i, j, np.zeros(shape)) for _, i, j, shape in chosen]
        for _ in range(self.pair_rounds):
            for i, j, t in self.pairs:
                cell = c[i] * t.shape[1] + c[j]
                g = np.bincount(cell, y - p, t.size).reshape(t.shape)
                h = np.bincount(cell, p * (1 - p), t.size).reshape(t.shape)
                step = self.rate * _tree2(g, h, smooth, least / 4)
                t += step
                z += step.ravel()[cell]
                p = 1 / (1 + np.exp(-z))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for e, t, col in zip(self.edges, self.tables, x.T, strict=bool(self.edges)):
            z += t[np.searchsorted(e, col, "right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def fold_of(row_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in no fold (-1)."""
    return F.coalesce(F.crc32(row_id.cast("string")) % folds, F.lit(-1))


def bounded_labels(
    labels: DataFrame, target: str, folds: int, held_out: int, max_train: int, id_col: str = "doc_id", positives: float | None = None
) -> DataFrame:
    """At most max_train labelled ids outside the held-out fold: doc_id, y. Small enough to broadcast.

    With positives, at most that share of max_train has label 1 and at most the rest label 0.
    """
    known = (
        labels.filter(F.col(target).isNotNull() & F.col(id_col).isNotNull() & (fold_of(F.col(id_col), folds) != held_out))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(target).cast("int")).alias("__y"))
    )
    parts = [known]
    if positives is not None:
        parts = [known.filter("__y > 0"), known.filter("__y <= 0")]
    sizes = [max_train] if positives is None else [int(max_train * positives), max_train - int(max_train * positives)]
    chosen = [p.orderBy(F.xxhash64("__id"), "__id").limit(n) for p, n in zip(parts, sizes, strict=True)]
    return chosen[0] if len(chosen) == 1 else chosen[0].union(chosen[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    target: str = "quality",
    folds: int = 5,
    held_out: int = 0,
    max_train: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Gam:
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["y", "k", "x"])

    known = bounded_labels(labels, target, folds, held_out, max_train)
    rows = (
        docs.join(F.broadcast(known), docs[id_col] == known["__id"])
        .select(F.col("__y").alias("y"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("k"))
        .mapInArrow(tidy(run), "y int, k long, x array<double>")
        .orderBy("k", "x")  # repeated ids may give more rows than labels: the same ones are kept in every run
        .limit(max_train)
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, width)
    order = np.lexsort(x.T[::-1])  # rows arrive in no fixed order; sums are made in this one
    return Gam().fit(x[order], rows["y"].to_numpy(np.float64)[order])


def score(
    docs: DataFrame,
    model: Gam,
    threshold: float = 0.3,
    keep: list[str] | None = None,
    text_col: str = "text",
    score_col: str = "score",
    predicted_col: str = "predicted",
) -> DataFrame:
    """The kept columns (all by default) with score_col and predicted_col, which replace columns of these names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (score_col, predicted_col)]
    kept = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text"))
    schema = extended(docs, keep, f"`{score_col}` double, `{predicted_col}` int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in as_bytes(batch.column(len(keep)))]).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                schema.names,
            )

    return kept.mapInArrow(tidy(run), schema)
