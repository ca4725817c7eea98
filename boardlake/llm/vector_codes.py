"""Operator 13, vector code compression: product codes found by slicing and intersecting bitmasks.

Vectors are cut into equal parts; each part position has a codebook of up to 256 entries, fitted over all
vectors by rounds of assignment and averaging.  To find a part's nearest entry exactly, every dimension of
the codebook is sorted and carries prefix masks: after j sorted coordinates, the set of their entries as 256 bits (four
uint64).  With radius r, the entries whose coordinate lies in [x - r, x + r] are the XOR of two prefix masks; the AND over
the dimensions leaves the candidates.  An entry within Euclidean distance r is within r in every dimension, so
a best candidate at distance r or less is the nearest entry of all, ties included.  The initial radius is the median
distance between an entry and its next one; where no candidate lies within it, the radius becomes the best
candidate's distance (or doubles, without candidates) and the part is sliced again.  Only candidates' distances are computed.

Spark deals the vectors; a task keeps one block of rows and at most parts x 256 sums, which are summed by
(part, entry, component) and come to the driver as parts x 256 x (width + 1) numbers a round.

Parameters: ``parts``, ``entries`` (at most 256), ``rounds``, ``scale``, ``dims`` (None: the commonest length that ``parts``
divides, of equally common ones the largest).

Defined results: a row whose vector is null, empty, of another length than ``dims`` or with a null, NaN or infinite component is left out;
rows that repeat count each and give one result row each; the first codebooks are the rows with the smallest
ids (equal ids by components, null ids last); fewer rows than ``entries`` give smaller codebooks; an unused entry
stays; null labels count as one label; an empty table gives no rows.  Integers are held within +-2^27; a sum of errors beyond
64 bits is given as the largest long.  Columns beyond ``vec_id``, ``embedding`` and ``label`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import LARGEST, finite
from .common import giving_back, saved, smallest

#: Rows that a task searches at a time.
BLOCK = 4096
_U = np.uint64


class Codebook:
    """One part's entries with the sorted coordinates and prefix masks of every dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.zeros((n, 4), _U)
        bits[np.arange(n), np.arange(n) >> 6] = _U(1) << (np.arange(n) & 63).astype(_U)
        self.prefix = [np.concatenate([np.zeros((1, 4), _U), np.bitwise_or.accumulate(bits[order[:, j]], axis=0)]) for j in range(width)]
        self.all = np.bitwise_or.reduce(bits, axis=0)
        gaps = [np.delete(((entries - e) ** 2).sum(1), i).min() for i, e in enumerate(entries)] if n > 1 else [1]
        self.radius = max(1, int(np.sqrt(np.median(gaps))))

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For every row of x, the 256-bit set of entries within its radius in each dimension."""
        found = np.tile(self.all, (len(x), 1))
        for j, prefix in enumerate(self.prefix):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            found &= prefix[high] ^ prefix[low]
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row of x, ties to the lower index."""
        index, distance = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        open_rows, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(open_rows):
            part = x[open_rows]
            masks = self.candidates(part, radius)
            best, at = np.full(len(part), np.iinfo(np.int64).max), np.zeros(len(part), np.int64)
            for e, entry in enumerate(self.entries):
                rows = np.flatnonzero(masks[:, e >> 6] & (_U(1) << _U(e & 63)))
                if len(rows):
                    d = part[rows] - entry
                    d = np.einsum("ij,ij->i", d, d)
                    less = d < best[rows]
                    best[rows[less]], at[rows[less]] = d[less], e
            done = best <= radius * radius
            index[open_rows[done]], distance[open_rows[done]] = at[done], best[done]
            wider = np.where(best < np.iinfo(np.int64).max, np.ceil(np.sqrt(best.astype(float))).astype(np.int64) + 1, 2 * radius)
            open_rows, radius = open_rows[~done], wider[~done]
        return index, distance


def _integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    return np.floor(np.clip(x * scale, -LARGEST, LARGEST)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            yield b, _integers(b.column("embedding"), dims, scale)


def next_codebooks(kept: DataFrame, books: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """One round over all vectors: (parts, entries, width) with every used entry at the floor of its parts' mean."""
    parts, n, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        sums = np.zeros((parts, n, width + 1), np.int64)
        for _, x in _blocks(batches, dims, scale):
            for p, book in enumerate(found):
                v = x[:, p * width:(p + 1) * width]
                index, _ = book.nearest(v)
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                sums[p, used, :width] += np.add.reduceat(v[order], first, axis=0)
                sums[p, used, width] += np.bincount(index, minlength=n)[used]
        at = np.flatnonzero(np.repeat(sums[:, :, width:] > 0, width + 1, axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at])], ["at", "value"])

    out, total = books.copy(), np.zeros(parts * n * (width + 1), object)
    for r in kept.select("embedding").mapInArrow(giving_back(run), "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    total = total.reshape(parts, n, width + 1)
    for p, e in zip(*np.nonzero(total[:, :, width])):
        out[p, e] = [int(s) // int(total[p, e, width]) for s in total[p, e, :width]]
    return out


def _commonest(vectors: DataFrame, parts: int) -> int:
    sizes = vectors.where(finite(F.col("embedding"))).groupBy(F.size("embedding").alias("dims")).count().where((F.col("dims") > 0) & (F.col("dims") % parts == 0))
    top = sizes.orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return top[0]["dims"] if top else parts


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, dims: int | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    dims = dims or _commonest(slim, parts)
    width = dims // parts
    kept = slim.where(finite(F.col("embedding"), dims))
    seeds = [r["embedding"] for r in smallest(kept.select("embedding", "vec_id"), entries, F.asc_nulls_last("vec_id"), "embedding")]
    if not seeds:
        return kept.where("false").selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    first = _integers(pa.array(seeds, pa.list_(pa.float64())), dims, scale)
    books = np.stack([first[:, p * width:(p + 1) * width] for p in range(parts)])
    for _ in range(rounds):
        books = next_codebooks(kept, books, dims, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        for b, x in _blocks(batches, dims, scale):
            hits = [book.nearest(x[:, p * width:(p + 1) * width]) for p, book in enumerate(found)]
            codes = np.stack([i for i, _ in hits], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(d for _, d in hits))],
                                             ["vec_id", "label", "code", "error"])

    rows = saved(kept.mapInArrow(giving_back(run), "vec_id long, label long, code string, error long"))
    by_label = rows.groupBy(F.col("label").alias("of_label")).agg(F.coalesce(F.try_sum("error"), F.lit((1 << 63) - 1)).alias("label_error"))
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return (rows.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64) -> str:
    width = dims // parts
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"""cut AS MATERIALIZED (SELECT rid, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM kept, range({parts}) AS t(p))""",
             f"""c0 AS MATERIALIZED (SELECT p, e, v AS c FROM cut JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept) USING (rid) WHERE e < {entries})"""]

    def assigned(name: str, of: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT rid, cut.p, any_value(v) AS v, min(struct_pack(d := CAST(list_sum(list_transform(range(1, {width + 1}),
    lambda j: (v[j] - c[j]) * (v[j] - c[j]))) AS BIGINT), e := e)) AS a FROM cut JOIN {of} ON {of}.p = cut.p GROUP BY rid, cut.p)"""

    for r in range(rounds):
        steps += [assigned(f"a{r}", f"c{r}"),
                  f"""s{r} AS MATERIALIZED (SELECT p, a.e AS e, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {width + 1}) AS t(j) GROUP BY ALL)""",
                  f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.e, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN
    (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{r} GROUP BY p, e) m ON m.p = c{r}.p AND m.e = c{r}.e)"""]
    steps.append(assigned("z", f"c{rounds}"))
    steps.append(f"codes AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', CAST(a.e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM z GROUP BY rid)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM kept JOIN codes USING (rid)"""


ORACLE = _oracle()
