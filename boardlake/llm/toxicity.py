"""Operator 7, toxicity by multiple-instance learning.

A document is a bag of sentences (ended by . ! ? or a line feed).  A sentence's score is a logistic
of the sum of weights of its words' features (the word, and its first ``PREFIXES`` bytes, hashed), and 0
without any feature that has a weight; a document's is the noisy-or of its sentences and a small leak, 1 - (1 - leak) prod(1 - p).  Weights are trained through the
noisy-or from document labels alone.  The trained sentence scores then locate the offending
sentences (``offending_sentences``).

Training takes a bounded sample: the ``SAMPLE`` labelled rows of each class outside the held-out
fold with the smallest hash of their id, without texts of over ``SAMPLE_CHARS`` characters.  Only features that
occur in several sampled documents of label 1, and much more often there, get a weight; the
model is two arrays of ``2 ** FEATURE_BITS`` numbers at most.  Scoring reads every whole text.

Defined results: a null or empty text has no sentence; a document's score then is the leak; a null id
has no label and is not held out; contradicting labels of an id are left out; repeated rows give one result row each; without labels of
both classes no feature has a weight and every score is the leak; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import id_crc, one_label

FEATURE_BITS = 20
PREFIXES = (4, 5, 6, 7, 8, 10)
SAMPLE, SAMPLE_CHARS = 2500, 20_000
#: Least documents of label 1 with a feature, and how much more often it must be there.
LEAST, LIFT = 3, 8.0
STEPS, RATE, DECAY = 300, 0.1, 2e-5
SENTENCE_BIAS = -6.0
_END = np.isin(np.arange(256), list(b".!?"))


@dataclass
class Bags:
    """Feature slots of every word of a slice, and the sentences they stand in."""

    words: wh.Words
    slots: np.ndarray  # words x features
    sentence: np.ndarray  # of every word, rising
    row: np.ndarray  # of every sentence
    first: np.ndarray  # first word of every sentence, and the end


def bags(col: pa.Array) -> Iterator[Bags]:
    """Words are runs of letters and digits, so marks within a word hide nothing from its neighbours."""
    for w in wh.words_of(col, wh.ALNUM_WORDS):
        n = len(w.hashes)
        slots = np.empty((n, 1 + len(PREFIXES)), np.int64)
        slots[:, 0] = (w.hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        size = w.ends - w.starts
        for i, k in enumerate(PREFIXES):
            h = wh.prefix_hashes(w, k)
            s = (wh.mix(h, 50 + k) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
            slots[:, 1 + i] = np.where(size >= k, s, -1)
        row = np.repeat(np.arange(len(w.counts)), w.counts)
        new = np.ones(n, bool)
        if n > 1:
            stop = np.concatenate([[0], np.cumsum(_END[w.data] | (w.data == 10))])
            new[1:] = (row[1:] != row[:-1]) | (stop[w.starts[1:]] > stop[w.ends[:-1]])
        first = np.flatnonzero(new)
        yield Bags(w, slots, np.cumsum(new) - 1, row[first], np.append(first, n))


@dataclass
class Model:
    """Weights by slot (float32; 0: no feature), the sentence bias and the document bias."""

    weights: np.ndarray
    bias: float
    leak: float

    def sentences(self, b: Bags) -> np.ndarray:
        """Score of every sentence."""
        per_word = np.where(b.slots >= 0, self.weights[np.maximum(b.slots, 0)], 0).sum(1)
        z = np.bincount(b.sentence, weights=per_word, minlength=len(b.row)) + self.bias
        told = np.bincount(b.sentence, weights=(self.weights[np.maximum(b.slots, 0)] != 0).any(1), minlength=len(b.row)) > 0
        return np.where(told, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0)

    def documents(self, b: Bags, p: np.ndarray) -> np.ndarray:
        """Noisy-or over each row's sentences, with the leak."""
        none = np.bincount(b.row, weights=np.log1p(-np.minimum(p, 1 - 1e-15)), minlength=len(b.words.counts))
        return 1 - (1 - self.leak) * np.exp(none)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, held_out: int = 0) -> Model:
    """Train on the bounded sample of labelled rows."""
    sample = one_label(labels, label).where(id_crc(F.col("doc_id")) % fold != held_out)
    parts = [sample.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    rows = parts[0].unionAll(parts[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= SAMPLE_CHARS)
    # one text an id, so the bound on ids is one on what reaches the driver
    one = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first"))
    got = one.select("doc_id", "label", F.col("first.text").alias("text")).toArrow().sort_by("doc_id").combine_chunks()
    return train(got.column("text"), got.column("label").to_numpy())


def train(texts, y: np.ndarray) -> Model:
    size = 1 << FEATURE_BITS
    empty = Model(np.zeros(size, np.float32), SENTENCE_BIAS, 1e-4)
    if not len(y) or y.min() == y.max():
        return empty
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    in_docs = np.zeros((2, size), np.int64)
    for b in bags(texts):
        row = np.repeat(np.arange(len(b.words.counts)), b.words.counts) + b.words.first
        pairs = np.unique((row[:, None] * size + b.slots)[b.slots >= 0], sorted=True) if len(row) else np.zeros(0, np.int64)
        np.add.at(in_docs, (y[pairs // size], pairs % size), 1)
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    lift = (in_docs[1] / n1) / ((in_docs[0] + 0.5) / n0)
    use = (in_docs[1] >= LEAST) & (lift >= LIFT)
    number = np.full(size, -1)
    number[use] = np.arange(use.sum())
    if not use.any():
        return empty
    f_parts, s_parts, r_parts, base = [], [], [], 0
    for b in bags(texts):
        f = np.where(b.slots >= 0, number[np.maximum(b.slots, 0)], -1)
        w, c = np.nonzero(f >= 0)
        f_parts.append(f[w, c])
        s_parts.append(b.sentence[w] + base)
        r_parts.append(b.row + b.words.first)
        base += len(b.row)
    f, s, r = (np.concatenate(x) for x in (f_parts, s_parts, r_parts))
    # a sentence without any feature says nothing: the leak stands for all of these
    n_docs, active = len(y), np.unique(s, sorted=True) if len(s) else np.zeros(0, np.int64)
    s, r = np.searchsorted(active, s), r[active]
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    theta = np.append(np.ones(int(use.sum())), SENTENCE_BIAS)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    leak = 1e-4
    for step in range(1, STEPS + 1):
        z = np.bincount(s, weights=theta[f], minlength=len(r)) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.log1p(-leak) + np.bincount(r, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs)
        q = np.exp(none)  # no sentence is toxic
        # loss: -log(1 - q) for label 1, -log q for label 0; d none / d z = -p
        d_none = np.where(y == 1, weight * q / np.maximum(1 - q, 1e-9), -weight)
        dz = -(d_none[r] * p)
        grad = np.append(np.bincount(f, weights=dz[s], minlength=len(theta) - 1), dz.sum())
        grad[:-1] += DECAY * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad ** 2
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        theta[-1] = min(theta[-1], -4.0)
    weights = np.zeros(size, np.float32)
    weights[use] = theta[:-1]
    return Model(weights, float(theta[-1]), leak)


def _scored(docs: DataFrame, model: Model, schema: str, make) -> DataFrame:
    weights = docs.sparkSession.sparkContext.broadcast(model.weights.tobytes())
    bias, leak = model.bias, model.leak

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(np.frombuffer(weights.value, np.float32), bias, leak)
        for batch in batches:
            for b in bags(batch.column("text")):
                p = m.sentences(b)
                yield make(batch.slice(b.words.first, len(b.words.counts)), b, p, m)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending (sentences scored 0.5 or more) of every row."""
    def make(batch, b: Bags, p: np.ndarray, m: Model) -> pa.RecordBatch:
        bad = np.bincount(b.row[p >= 0.5], minlength=len(b.words.counts))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.documents(b, p)), pa.array(bad.astype(np.int64))], ["doc_id", "score", "n_offending"])

    out = _scored(docs, fit(docs, labels, label, fold, held_out), "doc_id long, score double, n_offending long", make)
    return out.select("doc_id", (F.col("doc_id").isNotNull() & (id_crc(F.col("doc_id")) % fold == held_out)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points, from its first to its last word), score, sentence of every
    sentence that scores ``least`` or more."""
    def make(batch, b: Bags, p: np.ndarray, m: Model) -> pa.RecordBatch:
        at = np.flatnonzero(p >= least)
        w, ids = b.words, batch.column("doc_id")
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        s, e = w.starts[b.first[:-1][at]], w.ends[b.first[1:][at] - 1]
        row = b.row[at]
        base = chars[w.row_bytes[row]]
        texts = batch.column("text").to_pylist()
        cs, ce = chars[s] - base, chars[e] - base
        sentences = [texts[r][i:j] for r, i, j in zip(row.tolist(), cs.tolist(), ce.tolist())]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(cs), pa.array(ce), pa.array(p[at]), pa.array(sentences, pa.string())],
                                          ["doc_id", "start", "end", "score", "sentence"])

    return _scored(docs, model, "doc_id long, start long, end long, score double, sentence string", make)
