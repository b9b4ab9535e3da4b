"""Operator 9: a quality classifier of histogram gradient-boosted trees.

``statistics`` turns every whole text into ``FEATURES`` numbers; neither
labels nor any other column enter.  ``train`` fits boosted trees to the
logistic loss on histograms of at most ``BINS`` bins a feature.  A forest is
kept as flat arrays of complete trees, and ``Forest.scores`` walks all trees
of all rows level by level with numpy.

Training uses a bounded sample: of the labelled rows allowed, the
``max_rows`` (default 20,000) with the smallest hash of doc_id.  Statistics
and scores cover every row.

A null or empty text has statistics of zeros and is scored like any other.  A
null label is no label.  Without labels, or with one class only, every score
is the smoothed share of label 1 (0.5 without labels).  Rows that repeat a
doc_id are scored by their own text; a doc_id labelled more than once gives
one training row for each.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import map_batches, saved, text_of

BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
L2, MIN_ROWS = 1.0, 10
MAX_ROWS = 20_000
CUT = 0.3

_ASCII = np.arange(256)
_CLASSES = np.stack([
    (_ASCII >= 0x41) & (_ASCII <= 0x5A), (_ASCII >= 0x61) & (_ASCII <= 0x7A), (_ASCII >= 0x30) & (_ASCII <= 0x39),
    _ASCII >= 0x80, _ASCII == 0x20, _ASCII == 0x0A, np.isin(_ASCII, list(b".,;:")), np.isin(_ASCII, list(b"!?")),
    np.isin(_ASCII, list(b"#$%&*@~^+=_\\")), np.isin(_ASCII, list(b"|/<>{}[]()")), np.isin(_ASCII, list(b"'\"`-")),
], 1).astype(np.float64)
FEATURES = 11 + 15


def _features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n_docs, n_bytes = len(offs) - 1, np.diff(offs)
    doc_of_byte = np.repeat(np.arange(n_docs), n_bytes)
    hist = np.bincount(doc_of_byte * 256 + buf, minlength=n_docs * 256).reshape(n_docs, 256)
    per = hist @ _CLASSES / np.maximum(n_bytes, 1)[:, None]

    w = W.split_words(buf, offs, W.SPACE_WORDS)
    h, length, n_words = w.hashes(), w.end - w.start, w.counts()
    some = np.maximum(n_words, 1)
    sums = lambda x: np.add.reduceat(np.append(x, 0), np.minimum(w.first[:-1], len(x))) * (n_words > 0) \
        if len(x) else np.zeros(n_docs)
    last = buf[w.end - 1] if len(length) else buf[:0]
    begin = buf[w.start] if len(length) else buf[:0]
    upper = (begin >= 0x41) & (begin <= 0x5A)
    ends_word = np.isin(last, np.frombuffer(b".,;:!?", np.uint8))
    ends_odd = np.isin(last, np.frombuffer(b"#$%&*@~^|", np.uint8))
    mean = sums(length.astype(np.float64)) / some
    spread = np.sqrt(np.maximum(sums(length.astype(np.float64) ** 2) / some - mean ** 2, 0))

    distinct, top, lines, new_lines, pairs = (np.zeros(n_docs) for _ in range(5))
    newline = np.flatnonzero(buf == 0x0A)
    line = np.searchsorted(newline, w.start) if len(length) else newline[:0]
    for d in range(n_docs):
        a, b = w.first[d], w.first[d + 1]
        if a == b:
            continue
        s = np.sort(h[a:b])
        edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
        distinct[d], top[d] = len(edge) - 1, np.diff(edge).max()
        of = line[a:b]
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(b - a) - np.repeat(at, np.diff(np.r_[at, b - a]))
        of_line = np.add.reduceat(W.combine(h[a:b], place.astype(W.U64)), at)
        lines[d], new_lines[d] = len(at), len(np.unique(of_line))
        two = W.combine(h[a:b - 1], h[a + 1:b])
        pairs[d] = len(np.unique(two)) / max(len(two), 1)
    lines = np.maximum(lines, 1)
    rest = np.stack([
        np.log1p(n_words), np.log1p(n_bytes), mean, spread, distinct / some, top / some, np.log1p(lines),
        n_words / lines, new_lines / lines, pairs, sums(upper.astype(np.float64)) / some,
        sums(ends_word.astype(np.float64)) / some, sums(ends_odd.astype(np.float64)) / some,
        sums((length <= 2).astype(np.float64)) / some, sums((length >= 15).astype(np.float64)) / some], 1)
    return np.concatenate([per, rest], 1)


def _statistics(batch: pa.RecordBatch):
    for row, buf, offs in W.chunks(batch.column(1)):
        x = _features(buf, offs)
        yield {"doc_id": batch.column(0).slice(row, len(x)),
               "x": W.lists(x.astype(np.float32).ravel(), np.arange(len(x) + 1) * FEATURES, pa.float32())}


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every row's whole text."""
    return map_batches(text_of(docs), _statistics, "doc_id long, x array<float>")


@dataclass
class Forest:
    """Complete trees of one depth, laid end to end; node i's children are 2i + 1 and 2i + 2."""

    base: float
    depth: int
    feature: np.ndarray    # (trees, 2^depth - 1); -1: always left
    threshold: np.ndarray  # (trees, 2^depth - 1); right if the value is above
    value: np.ndarray      # (trees, 2^depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((f[node] >= 0) & (x[rows, f[node]] > t[node]))
            margin += v[node - (2 ** self.depth - 1)]
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Second-order boosting of complete trees on histograms."""
    p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    inner = 2 ** DEPTH - 1
    if not 0 < y.sum() < len(y):
        return Forest(base, DEPTH, np.full((0, inner), -1), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)  # bin > b iff x > edges[b]
    flat = binned + np.arange(m)[None, :] * BINS
    usable = np.arange(BINS)[None, :] < np.array([len(e) for e in edges])[:, None]
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, w = p - y, p * (1 - p)
        feature, threshold, node = np.full(inner, -1), np.zeros(inner), np.zeros(n, np.int64)
        for level in range(DEPTH):
            lo, width = 2 ** level - 1, 2 ** level
            key = ((node - lo)[:, None] * (m * BINS) + flat).ravel()
            shape = (width, m, BINS)
            sum_of = lambda v: np.bincount(key, np.repeat(v, m), width * m * BINS).reshape(shape).cumsum(2)  # noqa: B023,E731
            G, H, C = sum_of(g), sum_of(w), sum_of(np.ones(n))
            Gt, Ht, Ct = G[:, :, -1:], H[:, :, -1:], C[:, :, -1:]
            gain = G ** 2 / (H + L2) + (Gt - G) ** 2 / (Ht - H + L2) - Gt ** 2 / (Ht + L2)
            gain[(C < MIN_ROWS) | (Ct - C < MIN_ROWS) | ~usable[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                j, b = divmod(int(best[i]), BINS)
                if gain[i, j, b] > 1e-9:
                    feature[lo + i], threshold[lo + i] = j, edges[j][b]
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (x[np.arange(n), f] > threshold[node]))
        leaf = node - inner
        G, H = np.bincount(leaf, g, inner + 1), np.bincount(leaf, w, inner + 1)
        value = -RATE * G / (H + L2)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, DEPTH, np.array(features), np.array(thresholds), np.array(values))


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """A forest from ``labels(doc_id, quality)`` and the statistics of those rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")) \
        .where("doc_id IS NOT NULL AND y IN (0, 1)")
    sample = (stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(max_rows)
              .select("x", "y").toArrow())
    x = np.asarray(sample.column("x").combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, FEATURES)
    return train(x, sample.column("y").to_numpy().astype(np.float64))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, score`` of every row of ``statistics``."""
    def run(batch: pa.RecordBatch):
        x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
        yield {"doc_id": batch.column(0), "score": pa.array(forest.scores(x))}
    return map_batches(stats, run, "doc_id long, score double")


def passing(docs: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``text`` scores ``cut`` or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offs in W.chunks(batch.column(at)):
                x = _features(buf, offs).astype(np.float32).astype(np.float64)
                yield batch.slice(row, len(x)).filter(pa.array(forest.scores(x) >= cut))

    return docs.mapInArrow(run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: those of rows that are not held out."""
    return labels.where(~held_out())


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id,
    text)``; labels of held-out rows are not used."""
    stats = saved(statistics(docs), "statistics")
    forest = fit(stats, learnable(labels), max_rows)
    return score(stats, forest).select("doc_id", held_out().alias("held_out"), "score",
                                       (F.col("score") >= cut).cast("int").alias("predicted"))
