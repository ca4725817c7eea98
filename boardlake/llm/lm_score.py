"""Operator 10, language-model scores by stupid backoff, computed relationally.

Counts come from the whole corpus: every n-gram of words (white-space separated, A-Z
lower-cased) up to ``ORDER`` in every document.  The table of counts is partitioned by hash of
the n-gram.  Documents are dealt into chunks; a chunk explodes its n-grams, sends each distinct one
once to its partition with its count there, and the join of the partition's sums with what was asked comes
back to the chunk, where they are summed per document.  A chunk and a partition are of bounded size,
and a frequent n-gram is one row for every chunk at most, so no key is hot.

An n-gram of two words or more counts as seen from ``MIN_COUNT`` occurrences on.  A word's score is that of the longest
seen n-gram that ends with it: ln(count / count of its context), plus ln ``ALPHA`` for every order
backed off from; a single word's context is all words.  Since an n-gram is seen only if both
n-grams one word shorter within it are, longer n-grams are asked for only where those are.
N-grams travel as sorted 56-bit hashes in binary rows.

Scores are sums of millionths (rounded per word), so they don't depend on the order of summing.

Defined results: a null or empty text has 0 words, score 0 and a null mean; repeated rows are counted and scored each;
a null id is kept; an empty table gives no rows.  Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh

ORDER, MIN_COUNT, ALPHA = 3, 2, 0.4
#: Characters of a chunk, and of the corpus for every partition of the counts; most partitions.
CHUNK_CHARS, PARTITION_CHARS, MOST_PARTITIONS = 8 << 20, 6 << 20, 200_000
#: Rows that travel: n-grams asked for (``order`` 2: and shorter) with a chunk's counts, or, without ``grams``, the answer with the totals.
_ROWS = "bucket int, chunk long, order int, grams binary, counts binary"
_KEEP = np.uint64(0xFFFFFFFFFFFFFF00)


def _planes(x: np.ndarray, first: int) -> bytes:
    """The bytes of little-endian integers plane by plane (from byte ``first`` on): like bytes stand together."""
    return x.view(np.uint8).reshape(len(x), -1)[:, first:].T.tobytes()


def _unplaned(data: bytes, width: int, first: int, kind: str) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(width - first, -1)
    out = np.zeros((rows.shape[1], width), np.uint8)
    out[:, first:] = rows.T
    return out.reshape(-1).view(kind)


def _packed(counts: np.ndarray) -> bytes:
    """Counts, most of them small: planes of bytes, entropy-coded (Spark's own shuffle codec has no entropy stage)."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(counts, 0))


def _unpacked(data: bytes) -> np.ndarray:
    return _unplaned(zstandard.ZstdDecompressor().decompress(data), 8, 0, "<i8")


class _Chunk:
    """Word hashes of a chunk's texts, their places within the rows, and its n-grams by order."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        col = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        parts = list(wh.words_of(col)) if len(col) else []
        self.words = np.concatenate([np.zeros(0, np.uint64), *[p.hashes for p in parts]])
        self.counts = np.concatenate([np.zeros(0, np.int64), *[p.counts for p in parts]])
        ends = np.cumsum(self.counts)
        self.place = np.arange(len(self.words)) - np.repeat(ends - self.counts, self.counts)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the last words, hashes) of the n-grams."""
        at = np.flatnonzero(self.place >= n - 1)
        g = self.words[at - (n - 1)].copy()
        for j in range(n - 2, -1, -1):
            g = g * np.uint64(0xA0761D6478BD642F) + self.words[at - j]
        return at, wh.mix(g, 200 + n) & _KEEP


def _seen(chunk: _Chunk, totals: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last places, hashes, distinct hashes ascending, their counts) of the n-grams that may be seen."""
    at, g = chunk.grams(n)
    if n >= 3:
        before = totals[n - 1] >= MIN_COUNT  # by place of the last word; both n-grams one word shorter
        ok = before[at] & before[at - 1]
        at, g = at[ok], g[ok]
    return at, g, *wh.distinct_sorted(g)


def _answers(table: pa.Table) -> dict[int, np.ndarray]:
    """By round, the totals in ascending order of the hashes asked for in it."""
    found: dict[int, list] = {}
    for o, b, t in zip(table["order"].to_pylist(), table["bucket"].to_pylist(), table["counts"].to_pylist()):
        found.setdefault(o, []).append((b, t))
    return {o: np.concatenate([_unpacked(t) for _, t in sorted(x, key=lambda r: r[0])]) for o, x in found.items()}


def _short(chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes ascending of the words and bigrams, and last the 0-gram, the context of single words; their counts."""
    g, c = wh.distinct_sorted(np.concatenate([chunk.grams(1)[1], chunk.grams(2)[1]]))
    return np.append(g, _KEEP), np.append(c, len(chunk.words))


def _totals(chunk: _Chunk, answers: dict[int, np.ndarray], upto: int) -> dict[int, np.ndarray]:
    """By order, the corpus count of the n-gram that ends at every word (0: not asked for)."""
    every, _ = _short(chunk)
    out: dict[int, np.ndarray] = {}
    for n in range(upto + 1):
        if n == 0:
            out[0] = np.full(len(chunk.words), answers[2][-1])
            continue
        at, g, keys, _ = (*chunk.grams(n), every, None) if n < 3 else _seen(chunk, out, n)
        totals = answers.get(max(n, 2), np.zeros(0, np.int64))
        if len(keys) != len(totals):
            raise ValueError("counts do not match the n-grams asked for")
        out[n] = np.zeros(len(chunk.words), np.int64)
        if len(g):
            out[n][at] = totals[np.searchsorted(keys, g)]
    return out


def _ask(n: int, buckets: int):
    """Rows that ask for the n-grams of order ``n`` (2: and all shorter ones) of a chunk."""
    def run(chunk_id: int, chunk: _Chunk, answers: dict[int, np.ndarray]) -> pa.Table:
        if n == 2:
            g, c = _short(chunk)
        else:
            _, _, g, c = _seen(chunk, _totals(chunk, answers, n - 1), n)
        bucket = (g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        c = c.astype("<i8")
        return pa.table({"bucket": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), chunk_id)),
                         "order": pa.array(np.full(len(some), n, np.int32)), "grams": pa.array([_planes(g[cut[b]:cut[b + 1]], 1) for b in some], pa.binary()),
                         "counts": pa.array([_packed(c[cut[b]:cut[b + 1]]) for b in some], pa.binary())})

    return run


def _count(table: pa.Table) -> pa.Table:
    """The answers to the rows of a partition that ask; answers to earlier rounds pass."""
    done = table.filter(table["grams"].is_null())
    table = table.filter(table["grams"].is_valid())
    if not table.num_rows:
        return done
    grams = [_unplaned(x, 8, 1, "<u8") for x in table["grams"].to_pylist()]
    flat = np.concatenate(grams)
    counts = np.concatenate([_unpacked(x) for x in table["counts"].to_pylist()])
    order = np.argsort(flat)
    s = flat[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    totals = np.empty(len(flat), "<i8")
    totals[order] = sums[np.cumsum(new) - 1]
    ends = np.cumsum([len(g) for g in grams])
    answers = pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "order": table["order"], "grams": pa.nulls(len(grams), pa.binary()),
                        "counts": pa.array([_packed(totals[e - len(g):e]) for g, e in zip(grams, ends)], pa.binary())})
    return pa.concat_tables([done.cast(answers.schema), answers])


def _score(order: int):
    def run(docs: pa.Table, chunk: _Chunk, answers: dict[int, np.ndarray]) -> pa.Table:
        totals = _totals(chunk, answers, order)
        log = np.zeros(len(chunk.words))
        used = np.zeros(len(chunk.words), np.int64)
        most = np.minimum(order, chunk.place + 1)
        for n in range(order, 0, -1):
            here = (used == 0) & (n <= most) & ((totals[n] >= MIN_COUNT) if n > 1 else True)
            at = np.flatnonzero(here)
            context = totals[n - 1][at - 1] if n > 1 else totals[0][at]
            log[at] = np.log(totals[n][at] / context) + (most[at] - n) * np.log(ALPHA)
            used[at] = n
        micros = np.rint(log * 1e6).astype(np.int64)
        rows = len(chunk.counts)
        ends = np.concatenate([[0], np.cumsum(chunk.counts)])
        per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends]).astype(np.int64)
        score, words = per(micros), chunk.counts.astype(np.int64)
        mean = pa.array(score / 1e6 / np.maximum(words, 1), mask=words == 0)
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(words), "n_backed_off": pa.array(per(used < most)),
                         "score_micros": pa.array(score), "mean_log": mean}) if rows else _EMPTY

    return run


_RESULT = "doc_id long, n_words long, n_backed_off long, score_micros long, mean_log double"
_EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_backed_off": pa.array([], pa.int64()),
                   "score_micros": pa.array([], pa.int64()), "mean_log": pa.array([], pa.float64())})


def _first(ask):
    return lambda docs: ask(docs["chunk"][0].as_py(), _Chunk(docs["text"]), {})


def _next(ask):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        asked = ask(docs["chunk"][0].as_py(), _Chunk(docs["text"]), _answers(answers))
        return pa.concat_tables([answers.select(asked.column_names).cast(asked.schema), asked])

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_backed_off (words scored below the longest order), score_micros, mean_log of every row."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    chunks = -(-chars // CHUNK_CHARS) or 1
    buckets = min(-(-chars // PARTITION_CHARS) or 1, MOST_PARTITIONS)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(chunks)).alias("chunk"))

    # one chain of shuffles: answers pass through the later rounds, so nothing is computed twice
    answered = dealt.groupBy("chunk").applyInArrow(_first(_ask(2, buckets)), _ROWS).groupBy("bucket").applyInArrow(_count, _ROWS)
    for n in range(3, order + 1):
        asked = dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_next(_ask(n, buckets)), _ROWS)
        answered = asked.groupBy("bucket").applyInArrow(_count, _ROWS)
    score = _score(order)
    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        lambda left, right: score(left, _Chunk(left["text"]), _answers(right)), _RESULT)


ORACLE = r"""
with d as (
  select row_number() over () as k, doc_id,
         regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') as w
  from documents),
p as (
  select k, i, w[i] as w1, case when i > 1 then w[i - 1] || ' ' || w[i] end as w2, case when i > 2 then w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] end as w3,
         case when i > 1 then w[i - 1] end as x1, case when i > 2 then w[i - 2] || ' ' || w[i - 1] end as x2
  from (select k, w, unnest(range(1, len(w) + 1)) as i from d)),
c1 as (select w1 as g, count(*) as n from p group by 1),
c2 as (select w2 as g, count(*) as n from p where w2 is not null group by 1),
c3 as (select w3 as g, count(*) as n from p where w3 is not null group by 1),
s as (
  select p.k, least(p.i, 3) as most, case when c3.n >= 2 then 3 when c2.n >= 2 then 2 else 1 end as used,
         case when c3.n >= 2 then ln(c3.n::double / b2.n) when c2.n >= 2 then ln(c2.n::double / b1.n)
              else ln(c1.n::double / (select count(*) from p)) end as l
  from p join c1 on p.w1 = c1.g left join c2 on p.w2 = c2.g left join c3 on p.w3 = c3.g left join c1 b1 on p.x1 = b1.g left join c2 b2 on p.x2 = b2.g),
t as (
  select k, count(*) filter (used < most) as n_backed_off, sum(round((l + (most - used) * ln(0.4)) * 1e6)::bigint)::bigint as score_micros
  from s group by k)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(t.n_backed_off, 0)::bigint as n_backed_off, coalesce(t.score_micros, 0)::bigint as score_micros,
       case when len(d.w) > 0 then t.score_micros / 1e6::double / len(d.w) end as mean_log
from d left join t using (k)
"""
