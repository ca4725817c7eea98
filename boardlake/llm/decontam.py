"""Operator 8, benchmark decontamination by winnowing.

Words are lower-cased runs of digits, letters a-z and all that is not ASCII.  Every ``K``-gram is
hashed; of each ``W`` consecutive k-grams the smallest hash (the last one of equals) is kept as a
fingerprint.  A shared span of ``K + W - 1`` = ``SPAN`` words holds a whole window of k-grams, both sides keep the same
one there, so every shared span of that length shares a fingerprint.  Fingerprints of the
documents are joined with those of the items; hits are extended to the spans of ``SPAN`` words
around them and joined once more on the whole span, which makes the result exact.

An item of fewer words, but not none, is one window; its length is looked up at every place of
the documents (there are at most ``SPAN`` - 1 such lengths).  Before the first join a bit table of
``2 ** SLOT_BITS`` hash slots of the items' fingerprints, which is that size whatever the
benchmark's, drops the places that can't match; it is all that is broadcast.

Defined results: null and empty texts have no words and are clean; an item without words occurs
nowhere; items that repeat an id are one item; an item without id counts as a hit but isn't listed; repeated
document rows give one result row each; empty tables give no rows, or only clean ones.  Columns
beyond ``doc_id`` / ``item_id`` and ``text`` are not read, and kept by ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import map_batches, saved

SPAN, K, W = 10, 5, 6
SLOT_BITS = 22

_CAND = pa.struct([("h", pa.int64()), ("spans", pa.list_(pa.struct([("w", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])))])
_BASE = "doc_id long, dc_key long, n_words long, cands array<struct<h: long, spans: array<struct<w: long, s: int, n: int>>>>"


def span_hashes(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each start, as ``wordhash.ngrams`` makes them."""
    g = h[starts].copy()
    for j in range(1, k):
        g = g * np.uint64(0xA0761D6478BD642F) + h[starts + j]
    return wh.mix(g, k)


def winnow(w: wh.Words) -> np.ndarray:
    """Positions (in all words) of the kept k-grams."""
    n = len(w.hashes) - K + 1
    if n < W:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    g = span_hashes(w.hashes, np.arange(n), K)
    m = n - W + 1
    best, at = g[:m].copy(), np.arange(m)
    for j in range(1, W):
        later = g[j:j + m] <= best
        best = np.where(later, g[j:j + m], best)
        at[later] = np.flatnonzero(later) + j
    ok = row[:m] == row[SPAN - 1:]
    kept = np.zeros(n, bool)
    kept[at[ok]] = True
    return np.flatnonzero(kept)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, kind ('f': fingerprint, 'w': window), n (words), h of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item_id")
            for w in wh.words_of(b.column("text"), wh.ALNUM_WORDS):
                row = np.repeat(np.arange(len(w.counts)), w.counts)
                at = winnow(w)
                full, full_row = wh.ngrams(w, SPAN)
                parts = [("f", SPAN, span_hashes(w.hashes, at, K) if len(at) else at.astype(np.uint64), row[at]), ("w", SPAN, full, full_row)]
                off = w.offsets
                for n in range(1, SPAN):
                    r = np.flatnonzero(w.counts == n)
                    if len(r):
                        h = span_hashes(w.hashes, off[:-1][r], n)
                        parts += [("f", n, h, r), ("w", n, h, r)]
                for kind, n, h, r in parts:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + w.first)), pa.array([kind] * len(h), pa.string()),
                                                      pa.array(np.full(len(h), n, np.int32)), pa.array(_long(h))], ["item_id", "kind", "n", "h"])

    return map_batches(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), run, "item_id string, kind string, n int, h long").distinct()


def candidates(docs: DataFrame, bits, lengths: list[int]) -> DataFrame:
    """One row for every document: its key, words, and the places whose fingerprint's slot is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        shift = np.uint64(64 - SLOT_BITS)
        for b in batches:
            for w in wh.words_of(b.column("text"), wh.ALNUM_WORDS):
                off, n_rows = w.offsets, len(w.counts)
                row = np.repeat(np.arange(n_rows), w.counts)
                h_parts, r_parts, spans = [], [], []
                at = winnow(w)
                if SPAN in lengths and len(at):
                    h = span_hashes(w.hashes, at, K)
                    hit = table[h >> shift]
                    at, h = at[hit], h[hit]
                    r = row[at]
                    h_parts.append(h)
                    r_parts.append(r)
                    starts = at[:, None] + np.arange(1 - W, 1)[None, :]
                    ok = (starts >= off[r][:, None]) & (starts + SPAN <= off[r + 1][:, None])
                    which, _ = np.nonzero(ok)
                    s = starts[ok]
                    spans.append((which, span_hashes(w.hashes, s, SPAN) if len(s) else s.astype(np.uint64), s - off[row[s]] if len(s) else s, np.full(len(s), SPAN)))
                base = sum(map(len, h_parts))
                for n in lengths:
                    if n == SPAN or len(w.hashes) < n:
                        continue
                    s = np.arange(len(w.hashes) - n + 1)
                    s = s[row[:len(s)] == row[n - 1:]]
                    h = span_hashes(w.hashes, s, n)
                    hit = table[h >> shift]
                    s, h = s[hit], h[hit]
                    h_parts.append(h)
                    r_parts.append(row[s])
                    spans.append((base + np.arange(len(s)), h, s - off[row[s]], np.full(len(s), n)))
                    base += len(s)
                h = np.concatenate([*h_parts, np.zeros(0, np.uint64)])
                r = np.concatenate([*r_parts, np.zeros(0, np.int64)]).astype(np.int64)
                of, sw, ss, sn = (np.concatenate([x[i] for x in spans] or [np.zeros(0, np.int64)]) for i in range(4))
                n_spans = np.bincount(of.astype(np.int64), minlength=len(h))
                order = np.argsort(of, kind="stable")
                span = pa.StructArray.from_arrays([pa.array(_long(sw.astype(np.uint64))[order]), pa.array(ss[order].astype(np.int32)), pa.array(sn[order].astype(np.int32))], ["w", "s", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), span)
                cand = pa.StructArray.from_arrays([pa.array(_long(h)), lists], ["h", "spans"])
                order = np.argsort(r, kind="stable")
                per = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n_rows))]).astype(np.int32)
                cand = pa.ListArray.from_arrays(pa.array(per), cand.take(pa.array(order)))
                part = b.slice(w.first, n_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("dc_key"), pa.array(w.counts.astype(np.int64)), cand],
                                                 ["doc_id", "dc_key", "n_words", "cands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("dc_key"), "text")
    return map_batches(slim, run, _BASE)


def row_key(docs: DataFrame):
    """Key of a row by its id and text: rows that agree in both share every result.  64 bits: that any two of 10^9 different rows share a key
    has odds of about 1 in 37, of 5 x 10^9 about even; such rows would share their hits."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def spans_near(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, dc_key, n_words of every row; dc_key, h, s, n of every span around a shared fingerprint; item_id, h, n of every window)."""
    spark = docs.sparkSession
    windows = saved(item_windows(items))
    prints = windows.where("kind = 'f'").select("h").distinct()
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # 1 .. SPAN
    bitmap = np.zeros(1 << SLOT_BITS, bool)
    slots = prints.select(F.shiftrightunsigned("h", 64 - SLOT_BITS).cast("int").alias("slot")).distinct()
    bitmap[slots.toPandas()["slot"].to_numpy(dtype=np.int64)] = True  # at most 2 ** SLOT_BITS
    bits = spark.sparkContext.broadcast(np.packbits(bitmap).tobytes())
    base = saved(candidates(docs, bits, lengths))
    places = base.where(F.size("cands") > 0).select("dc_key", F.explode("cands").alias("c")).select("dc_key", "c.h", "c.spans")
    extended = (places.join(prints, "h", "left_semi").select("dc_key", F.explode("spans").alias("x"))
                .select("dc_key", F.col("x.w").alias("h"), F.col("x.s").alias("s"), F.col("x.n").alias("n")).distinct())
    return base.drop("cands"), extended, windows.where("kind = 'w'").select("item_id", "n", "h")


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, dc_key, n_words of every row; dc_key, s, n, item_id of every place where a window occurs)."""
    base, extended, windows = spans_near(docs, items)
    return base, extended.join(windows, ["h", "n"]).select("dc_key", "s", "n", "item_id")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    base, found = hits(docs, items)
    per = found.groupBy("dc_key").agg(F.sort_array(F.collect_set(F.struct("s", "n"))).alias("spans"),
                                      F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.expr("""aggregate(spans, named_struct('upto', 0, 'total', 0L), (a, x) -> named_struct(
        'upto', greatest(a.upto, x.s + x.n), 'total', a.total + greatest(0, x.s + x.n - greatest(a.upto, x.s))), a -> a.total)""")
    per = per.select("dc_key", covered.alias("hit"), F.size("items").cast("long").alias("items_n"), F.concat_ws(",", "items").alias("listed"))
    out = base.join(per, "dc_key", "left")
    return out.select("doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items_n", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows (all their columns) in which no item's window occurs.  Which items it is of does not matter here, so a window that many
    items share meets each document once."""
    _, extended, windows = spans_near(docs, items)
    bad = extended.join(windows, ["h", "n"], "left_semi").select("dc_key").distinct()
    whole = docs.select(row_key(docs).alias("dc_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("dc_doc"))
    return whole.join(bad, "dc_key", "left_anti").select("dc_doc.*")


ORACLE = r"""
with d as (
  select row_number() over () as k, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id::varchar as item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (
  select k, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
m as (select dw.k, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
c as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from (select distinct k, i, n from m)) group by k),
t as (select k, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct k, item_id from m where item_id is not null) group by k)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(t.n_items, 0)::bigint as n_items,
       sha256(coalesce(t.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (k) left join t using (k)
"""
