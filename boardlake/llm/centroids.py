"""Operator 11, centroid clustering: k-means over integer vectors, in Spark expressions only.

Every component x becomes the integer floor(scale * x).  A round is one scan: ``zip_with`` and
``aggregate`` give the inner product with each of the literal centroid arrays, and with it the integer
squared distance |c|^2 - 2 x.c (+ |x|^2, the same for all centroids); ``array_min`` of structs
(distance, number) chooses the cluster, ties to the smaller number; generated column sums per cluster
(partial sums in every task) give the next centroids, as exact floors of sum / count.  What comes to the
driver is k x (components + 1) sums a round, whatever the table's size; no vector is shuffled.

Parameters: ``k``, ``rounds``, ``dims``, ``scale``, ``seed``.  The first centroids are the k kept rows with the smallest
sha256 of ``seed:vec_id``; equal hashes go by the vector's components, a null id comes last.

Defined results: a row whose vector is null, has another number of components than ``dims`` or holds a null, NaN
or infinite component is left out; rows that repeat (whole or by id) count each and give one result row each; fewer than k kept
rows give fewer centroids; an empty centroid stays where it is; an empty table gives no rows.  Integers are held
within +-2^27, so that 64 squared differences fit in 64 bits; a sum of distances beyond 64 bits is given as
the largest long.  Columns beyond ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, smallest

LARGEST = 1 << 27
_LONG = (1 << 63) - 1


def finite(vector: Column, dims: int | None = None) -> Column:
    """Whether the vector has no null, NaN or infinite component (and ``dims`` components); null counts as no."""
    ok = F.forall(vector, lambda x: F.abs(x.cast("double")) < F.lit(float("inf")))
    return ok & (F.size(vector) == dims) if dims is not None else ok


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, held within the exact range."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))


def _literal(centroids: list[list[int]]) -> Column:
    """The centroids as one constant array of structs (n: |c|^2, c: components)."""
    rows = (f"named_struct('n', {sum(x * x for x in c)}L, 'c', array({', '.join(f'{x}L' for x in c)}))" for c in centroids)
    return F.expr(f"array({', '.join(rows)})")


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """struct(d: squared distance less |x|^2, i: number) of the nearest centroid."""
    def one(c: Column, i: Column) -> Column:
        dot = F.aggregate(F.zip_with(vector, c["c"], lambda a, b: a * b), F.lit(0).cast("long"), lambda s, p: s + p)
        return F.struct((c["n"] - 2 * dot).alias("d"), i.alias("i"))

    return F.array_min(F.transform(_literal(centroids), one))


def kept_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    x = F.col("embedding")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(finite(x, dims)).select("vec_id", integers(x, scale).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in smallest(kept, k, rank.asc_nulls_last(), "v")]


def next_centroids(kept: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """One round: every vector to its nearest centroid, every centroid to the floor of its vectors' mean."""
    assigned = kept.select("v", nearest(F.col("v"), centroids)["i"].alias("cluster"))
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(dims)])
    out = list(centroids)
    for r in sums.collect():  # at most k rows
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dims)]
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row."""
    kept = kept_vectors(vectors, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return kept.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids, dims)
    squares = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0).cast("long"), lambda s, p: s + p)
    found = kept.select("vec_id", nearest(F.col("v"), centroids).alias("at"), squares.alias("xx"))
    rows = saved(found.select("vec_id", F.col("at")["i"].alias("cluster"), (F.col("at")["d"] + F.col("xx")).alias("distance")))
    total = {r["cluster"]: r["total"] for r in rows.groupBy("cluster").agg(F.coalesce(F.try_sum("distance"), F.lit(_LONG)).alias("total")).collect()}
    of = F.expr(f"array({', '.join(f'{total.get(i, 0)}L' for i in range(len(centroids)))})")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sha = F.expr("array('" + "', '".join(digests) + "')")
    return rows.select("vec_id", "cluster", "distance", of[F.col("cluster")].alias("cluster_inertia"),
                       F.lit(min(sum(total.values()), _LONG)).cast("long").alias("inertia"), sha[F.col("cluster")].alias("centroid_sha256"))


def _oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cid, v AS c
  FROM (SELECT v, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h, v LIMIT {k}))"""]

    def assigned(name: str, of: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := CAST(list_sum(list_transform(range(1, {dims + 1}),
    lambda j: (v[j] - c[j]) * (v[j] - c[j]))) AS BIGINT), i := cid)) AS a FROM kept CROSS JOIN {of} GROUP BY rid)"""

    for r in range(rounds):
        steps += [assigned(f"a{r}", f"c{r}"),
                  f"""s{r} AS MATERIALIZED (SELECT a.i AS cid, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) AS t(j) GROUP BY ALL)""",
                  f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.cid, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN
    (SELECT cid, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{r} GROUP BY cid) m ON m.cid = c{r}.cid)"""]
    steps.append(assigned("z", f"c{rounds}"))
    return "WITH " + ",\n".join(steps) + f"""
SELECT z.vec_id, z.a.i AS cluster, z.a.d AS distance, CAST(sum(z.a.d) OVER (PARTITION BY z.a.i) AS BIGINT) AS cluster_inertia,
  CAST(sum(z.a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM z JOIN c{rounds} c ON c.cid = z.a.i"""


ORACLE = _oracle()
