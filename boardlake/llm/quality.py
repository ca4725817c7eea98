"""Operator 1, quality classifier: a regularised quadratic discriminant.

Every whole text becomes a vector of transformed document statistics (logs of counts, square
roots of ratios).  The labelled rows give, per class, the count, the sum and the sum of outer
products (sums over all of them, no sample); the class covariance is shrunk towards a diagonal,
its Cholesky factor is computed once on the driver (a 14 x 14 matrix) and cached in the model.  A score
is the logistic of the difference of the two Mahalanobis log densities plus the log prior odds.

Defined results: a null text is an empty text (all statistics 0); an empty text gets a score
like any other; a null id has no label and is not held out; repeated rows give one result row
each; an empty table gives no rows; with a class that has no labelled row every score is the
share of label 1 (0.5 without labels).  Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import id_crc, map_batches, one_label, saved

FEATURES = ("log_words", "mean_word", "symbols", "marks", "upper", "digits", "distinct_words", "distinct_trigrams",
            "same_as_before", "top_word", "repeated_lines", "log_line", "log_sentence", "beyond_ascii")
#: Share of the class covariance replaced by its diagonal, and the floor of a variance.
SHRINKAGE, FLOOR = 0.2, 1e-3
#: Words (or lines) by which ratios of short texts are drawn to a usual value.
PSEUDO = 20
#: The fold of crc32(doc_id) that training leaves out.
FOLD, HELD_OUT = 3, 1
#: Rows that a task handles at a time.
ROWS = 512

_IN = lambda chars: np.isin(np.arange(256), list(chars.encode()))
_SYMBOL, _MARK, _STOP = _IN("#*$%&|<>{}[]~^=_\\"), _IN("!?"), _IN(".!?")
_UPPER, _LOWER, _DIGIT = _IN("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _IN("abcdefghijklmnopqrstuvwxyz"), _IN("0123456789")
_HIGH, _BREAK = np.arange(256) >= 128, np.arange(256) == 10


def _per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(c[rows]).astype(float)


def _distinct_share(g: np.ndarray, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values over values of each row (1 without any), and the share of the commonest."""
    total = np.bincount(r, minlength=n).astype(float)
    off = np.searchsorted(r, np.arange(n + 1))
    s = g.copy()
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        if j - i > 1:
            s[i:j].sort()
    share, top = np.ones(n), np.zeros(n)
    if len(s):
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(first)
        run = np.diff(np.append(at, len(s)))
        some = total > 0
        share[some] = np.bincount(r[at], minlength=n)[some] / total[some]
        best = np.zeros(n)
        np.maximum.at(best, r[at], run)
        top[some] = best[some] / total[some]
    return share, top


def statistics(col: pa.Array) -> np.ndarray:
    """The transformed statistics of every text, one row each."""
    parts = [np.zeros((0, len(FEATURES)))]
    for w in wh.words_of(col, wh.SPACE_WORDS, lower=False):
        n, d, rows = len(w.counts), w.data, w.row_bytes
        words = w.counts.astype(float)
        some = np.maximum(words, 5)
        row = np.repeat(np.arange(n), w.counts)
        letters_up, letters_low = _per_row(_UPPER[d], rows), _per_row(_LOWER[d], rows)
        letters = letters_up + letters_low
        size = np.maximum(np.diff(rows), 1).astype(float)
        distinct, top = _distinct_share(w.hashes, row, n)
        tri, tri_row = wh.ngrams(w, 3)
        distinct3, _ = _distinct_share(tri, tri_row, n)
        same = np.zeros(n)
        if len(row) > 1:
            eq = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
            same = np.bincount(row[1:][eq], minlength=n).astype(float)
        line = wh.SAME.astype(bool)
        line[:] = True
        line[10] = False
        lw = wh._slice(0, d, rows, line)
        l_row = np.repeat(np.arange(n), lw.counts)
        l_share, _ = _distinct_share(lw.hashes, l_row, n)
        lines = np.maximum(lw.counts, 1).astype(float)
        stops = _per_row(_STOP[d], rows)
        # ratios of few words or lines say little: each is drawn to a usual value by pseudo counts
        x = np.column_stack([
            np.log1p(words),
            np.log1p((np.bincount(row, weights=(w.ends - w.starts), minlength=n) + 6 * PSEUDO) / (words + PSEUDO)),
            np.sqrt(_per_row(_SYMBOL[d], rows) / some),
            np.sqrt(_per_row(_MARK[d], rows) / (words + PSEUDO)),
            np.sqrt((letters_up + PSEUDO / 5) / (letters + 5 * PSEUDO)),
            np.sqrt(_per_row(_DIGIT[d], rows) / (size + 5 * PSEUDO)),
            np.sqrt((1 - distinct) * words / (words + PSEUDO)),
            np.sqrt((1 - distinct3) * words / (words + PSEUDO)),
            np.sqrt(same / (words + PSEUDO)),
            np.sqrt(top * words / (words + PSEUDO)),
            np.sqrt((1 - l_share) * lines / (lines + PSEUDO)),
            np.log1p((words + PSEUDO) / (lines + 1)),
            np.log1p((words + PSEUDO) / (stops + 1)),
            np.sqrt(_per_row(_HIGH[d], rows) / (size + 5 * PSEUDO)),
        ])
        parts.append(x)
    return np.concatenate(parts)


@dataclass
class Model:
    """Per class (0, 1): mean, inverse of the Cholesky factor, log determinant; log prior odds of class 1."""

    mean: list
    inv_factor: list
    log_det: list
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * ld
                   for m, f, ld in zip(self.mean, self.inv_factor, self.log_det)]
        z = np.clip(density[1] - density[0] + self.log_odds, -500, 500)
        return 1 / (1 + np.exp(-z))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = statistics(b.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat], ["doc_id", "features"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(slim, run, "doc_id long, features array<double>")


def labelled(features: DataFrame, labels: DataFrame, label: str = "quality", fold: int = FOLD, held_out: int = HELD_OUT) -> DataFrame:
    """(label, features) of the labelled rows outside the held-out fold."""
    return (features.where(id_crc(F.col("doc_id")) % fold != held_out)
            .join(one_label(labels, label), "doc_id").select("label", "features"))


def training_features(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of the rows outside the held-out fold, joined by sorting: with labels that are broadcast instead, statistics
    and moments are one stage, each task of which keeps two Python workers, and these live on through the stages that follow."""
    return feature_rows(docs.where(id_crc(F.col("doc_id")) % FOLD != HELD_OUT)).hint("merge")


def fit(features: DataFrame, labels: DataFrame, label: str = "quality", fold: int = FOLD, held_out: int = HELD_OUT) -> Model:
    """Class moments over every labelled row outside the held-out fold, as Spark sums."""
    d = len(FEATURES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    train = labelled(features, labels, label, fold, held_out)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            y = b.column("label").to_numpy(zero_copy_only=False)
            x = b.column("features").flatten().to_numpy().reshape(-1, d)
            for k in np.unique(y):
                v = x[y == k]
                t = total.setdefault(int(k), [0, np.zeros(d), np.zeros((d, d))])
                t[0] += len(v)
                t[1] += v.sum(0)
                t[2] += v.T @ v
        for k, (n, s, q) in total.items():
            flat = np.concatenate([[n], s, [q[i, j] for i, j in upper]])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)],
                                             ["label", "at", "value"])

    sums = map_batches(train, moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    got: dict[int, np.ndarray] = {}
    for r in sums.collect():  # two classes x 120 numbers
        got.setdefault(r["label"], np.zeros(1 + d + len(upper)))[r["at"]] = r["value"]
    n = [got[k][0] if k in got else 0.0 for k in (0, 1)]
    if min(n) < 2:
        share = n[1] / sum(n) if sum(n) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model([], [], [], float(np.log(share / (1 - share))))
    mean, factor, log_det = [], [], []
    for k in (0, 1):
        m = got[k][1:1 + d] / n[k]
        c = np.zeros((d, d))
        for (i, j), v in zip(upper, got[k][1 + d:]):
            c[i, j] = c[j, i] = v / n[k] - m[i] * m[j]
        c = (1 - SHRINKAGE) * c + SHRINKAGE * np.diag(np.diag(c)) + FLOOR * np.eye(d)
        low = np.linalg.cholesky(c)
        mean.append(m)
        factor.append(np.linalg.solve(low, np.eye(d)))
        log_det.append(2 * float(np.log(np.diag(low)).sum()))
    return Model(mean, factor, log_det, float(np.log(n[1] / n[0])))


def score_rows(features: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from feature rows, with the model's cached factors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return map_batches(features, run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = FOLD, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.  The features are read from one checkpoint
    of narrow rows, so the texts are read once."""
    features = saved(feature_rows(docs))
    out = score_rows(features, fit(features, labels, label, fold, held_out))
    return out.select("doc_id", (id_crc(F.col("doc_id")) % fold == held_out).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (all their columns) that the classifier does not reject.  Rows of the held-out fold
    are left out before their statistics are computed for training."""
    model = fit(training_features(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield b.filter(pa.array(model.score(statistics(b.column("text"))) >= 0.5))

    return map_batches(docs, run, docs.schema)
