"""Operators 1 and 7 against plain versions, and the keys of operators 2, 6 and 8 where rows repeat."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boardlake.llm import decontam, mixing, ngram_join, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_statistics(text):
    text = text or ""
    data, words = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text)
    n, size, pseudo = len(words), max(len(text.encode()), 1), 20
    count = lambda chars: sum(text.count(c) for c in chars)
    distinct = lambda x: len(set(x)) / len(x) if x else 1.0
    upper, lower = (sum(a <= b <= z for b in data) for a, z in ((65, 90), (97, 122)))
    lines = [x for x in text.split("\n") if x]
    n_lines = max(len(lines), 1)
    top = max(collections.Counter(words).values()) / n if n else 0.0
    tri = list(zip(words, words[1:], words[2:]))
    return [math.log1p(n), math.log1p((sum(len(w.encode()) for w in words) + 6 * pseudo) / (n + pseudo)),
            math.sqrt(count("#*$%&|<>{}[]~^=_\\") / max(n, 5)), math.sqrt(count("!?") / (n + pseudo)),
            math.sqrt((upper + pseudo / 5) / (upper + lower + 5 * pseudo)), math.sqrt(sum(48 <= b <= 57 for b in data) / (size + 5 * pseudo)),
            math.sqrt((1 - distinct(words)) * n / (n + pseudo)), math.sqrt((1 - distinct(tri)) * n / (n + pseudo)),
            math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / (n + pseudo)), math.sqrt(top * n / (n + pseudo)),
            math.sqrt((1 - distinct(lines)) * n_lines / (n_lines + pseudo)), math.log1p((n + pseudo) / (n_lines + 1)),
            math.log1p((n + pseudo) / (count(".!?") + 1)), math.sqrt(sum(b >= 128 for b in data) / (size + 5 * pseudo))]


def test_quality_like_plain_version(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    x = np.array([plain_statistics(t) for _, t in rows])
    got = quality.statistics(pa.array([t for _, t in rows], pa.string()))
    assert np.allclose(got, x, atol=1e-9)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    y = np.array([known.get(i, -1) if zlib.crc32(str(i).encode()) % 3 != 1 else -1 for i, _ in rows])
    z = np.full(len(x), math.log((y == 1).sum() / (y == 0).sum()))
    for k, sign in ((0, -1), (1, 1)):
        v = x[y == k]
        c = np.cov(v.T, bias=True)
        c = 0.8 * c + 0.2 * np.diag(np.diag(c)) + 1e-3 * np.eye(14)
        d = x - v.mean(0)
        z += sign * (-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    want = {i: 1 / (1 + math.exp(-min(max(s, -500), 500))) for (i, _), s in zip(rows, z)}
    scores = quality.quality_scores(docs, labels).collect()
    assert len(scores) == len(rows)
    for r in scores:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_toxicity_scores_like_noisy_or(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    slots = {}

    def weights_of(word):
        if word not in slots:
            b = next(iter(toxicity.bags(pa.array([word]))))
            slots[word] = [float(model.weights[s]) for s in b.slots[0] if s >= 0]
        return slots[word]

    want = {}
    for r in docs.select("doc_id", "text").collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        sentences, last = [], None
        for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text):
            if last is None or re.search(r"[.!?\n]", text[last:m.start()]):
                sentences.append([])
            sentences[-1].append(m[0])
            last = m.end()
        none = 1 - model.leak
        for s in sentences:
            w = [x for word in s for x in weights_of(word)]
            if any(w):
                none *= 1 - 1 / (1 + math.exp(-min(max(sum(w) + model.bias, -60), 60)))
        want[r["doc_id"]] = 1 - none
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(want) and sum(v >= 0.5 for v in want.values()) > 0
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-5, r["doc_id"]


def test_repeated_rows_are_verified_once(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(i, text + f" x{i}", "en", "a", 0) for i in (1, 2) for _ in range(60)] + [(2, "another text of two", "en", "a", 0), (3, "others stand here alone", "en", "a", 0), (None, text, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.similar_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, None)}
    found = ngram_join.texts_of(docs, docs.select(F.col("doc_id").alias("id")).distinct()).collect()
    assert collections.Counter(r["id"] for r in found) == {1: 1, 2: 2, 3: 1}


def test_null_ids_are_spread_over_buckets(spark):
    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    hashes = mixing.measured(rows).select("mx_hash")
    assert hashes.distinct().count() == 2000
    per = hashes.groupBy((F.col("mx_hash") % 20).alias("b")).count().collect()
    assert len(per) == 20 and max(r["count"] for r in per) < 200
    plan = mixing.copies(mixing.measured(rows), 2000)
    # two words each, one source of 4,000 words; the target is 150 percent of them
    assert abs(plan.agg(F.sum(F.col("mx_copies") * F.col("mx_size"))).first()[0] - 6000) <= 2


def test_clean_documents_with_a_window_of_many_items(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"a{i} " + (shared if i % 2 else "") + f" b{i} clean words", "en", "a", 0) for i in range(40)], DOCS)
    items = spark.createDataFrame([(i, shared + f" tail{i}") for i in range(50)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.clean_documents(docs, items).collect()) == list(range(0, 40, 2))
    n = {r["doc_id"]: r["n_items"] for r in decontam.contamination(docs, items).collect()}
    assert n == {i: 50 if i % 2 else 0 for i in range(40)}
