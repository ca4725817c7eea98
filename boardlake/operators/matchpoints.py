"""Matchpoints.

Plan shape.  Matchpoints of a row depend only on how many results of the same board
scored less / the same.  So every operator here first aggregates the results to a score
frequency table ``(k..., score) -> n`` (partial aggregation happens map-side, so a board
with millions of tables still ships one row per distinct score), runs the window over
that small table, and joins the answer back on ``(k..., score)``.  A window partition
therefore holds one board's *distinct* scores -- bounded by the finite set of bridge
scores -- never one board's rows.  The join back is a plain equi-join: AQE turns it into
a broadcast when the frequency table is small at run time and splits skewed partitions
of the result side otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_key, not_broadcast


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def _running(freq: DataFrame, k: list[str], value: str, n: str = "n") -> tuple[Column, Column, Column]:
    """(less, equal, total) counts of non-null values per key, over the frequency table."""
    w = Window.partitionBy(*k).orderBy(F.col(value).asc_nulls_last())
    nn = F.when(F.col(value).isNotNull(), F.col(n)).otherwise(F.lit(0))
    incl = F.sum(nn).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    eq = F.sum(nn).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    total = F.sum(nn).over(Window.partitionBy(*k))
    return incl - eq, eq, total


def score_frequency(df: DataFrame, k, score: str, n: str = "n") -> DataFrame:
    """(k..., score) -> number of results; null scores form their own group."""
    return df.groupBy(*_keys(k), score).agg(F.count(F.lit(1)).alias(n))


def matchpoints(
    df: DataFrame,
    k: Sequence[str] = ("session_id", "board"),
    score_ns: str = "score_ns",
    score_ew: str = "score_ew",
) -> DataFrame:
    """mp_top, mp_ns, mp_ew, pct_ns, pct_ew for every result row.

    mp = (results beaten) + (ties - 1) / 2 over the board, i.e. average rank - 1; null
    scores get null matchpoints and do not count towards the top.  pct = mp / top, null
    for a lone result.
    """
    k = _keys(k)
    freq = by_key(df.groupBy(*k, score_ns, score_ew).agg(F.count(F.lit(1)).alias("_n")), *k)
    mp = frequency_matchpoints(freq, k, score_ns, score_ew).drop("_n")
    cond = [df[c].eqNullSafe(mp[c]) for c in k + [score_ns, score_ew]]
    out = df.join(mp, cond, "left").select(df["*"], mp["mp_top"], mp["mp_ns"], mp["mp_ew"])
    return percentages(out)


def frequency_matchpoints(freq: DataFrame, k, score_ns: str = "score_ns", score_ew: str = "score_ew", n: str = "_n") -> DataFrame:
    """W1, W2 of the rows of a frequency table (k..., score_ns, score_ew, n, other columns), partitioned by ``k``: with mp_top, mp_ns, mp_ew."""
    k = _keys(k)
    columns = freq.columns
    less_ns, eq_ns, total = _running(freq, k, score_ns, n)
    freq = freq.withColumns({"_less_ns": less_ns, "_eq_ns": eq_ns, "_total": total})
    less_ew, eq_ew, _ = _running(freq, k, score_ew, n)
    freq = freq.withColumns({"_less_ew": less_ew, "_eq_ew": eq_ew})
    return freq.select(
        *columns,
        (F.col("_total") - 1).cast("long").alias("mp_top"),
        F.when(F.col(score_ns).isNotNull(), F.col("_less_ns") + (F.col("_eq_ns") - 1) / 2.0).alias("mp_ns"),
        F.when(F.col(score_ew).isNotNull(), F.col("_less_ew") + (F.col("_eq_ew") - 1) / 2.0).alias("mp_ew"),
    )


def board_scores(df: DataFrame, k, score_ns: str = "score_ns", score_ew: str = "score_ew") -> DataFrame:
    """One row a board: ``k``, mp_top and ``_scores``, a list of (ns, ew, mp_ns, mp_ew) of its distinct scores.

    For results that also meet their board's other facts: all of a board's facts lie on one row, and the results, a
    query's widest rows, are shuffled once, by board.  The list is bounded by the finite set of bridge scores.
    """
    k = _keys(k)
    freq = by_key(df.groupBy(*k, score_ns, score_ew).agg(F.count(F.lit(1)).alias("_n")), *k)
    return list_scores(frequency_matchpoints(freq, k, score_ns, score_ew), k, score_ns, score_ew)


def list_scores(freq: DataFrame, k, score_ns: str = "score_ns", score_ew: str = "score_ew", *more: Column) -> DataFrame:
    """The rows of ``frequency_matchpoints`` as one row a board (see ``board_scores``), with ``more`` aggregates."""
    one = F.struct(F.col(score_ns).alias("ns"), F.col(score_ew).alias("ew"), "mp_ns", "mp_ew")
    return freq.groupBy(*_keys(k)).agg(F.max("mp_top").alias("mp_top"), F.collect_list(one).alias("_scores"), *more)


def listed_matchpoints(df: DataFrame, score_ns: str = "score_ns", score_ew: str = "score_ew", scores: str = "_scores") -> DataFrame:
    """W1, W2 for results joined with ``board_scores``: mp_ns, mp_ew beside the board's mp_top (``percentages`` follow from these)."""
    mine = F.filter(scores, lambda x: x["ns"].eqNullSafe(F.col(score_ns)) & x["ew"].eqNullSafe(F.col(score_ew)))
    out = df.withColumn("_mine", F.get(mine, F.lit(0))).withColumns({"mp_ns": F.col("_mine.mp_ns"), "mp_ew": F.col("_mine.mp_ew")})
    return out.drop("_mine", scores)


def percentages(df: DataFrame, top: str = "mp_top") -> DataFrame:
    """pct = mp / top (null when top is 0)."""
    return df.withColumns({
        "pct_ns": F.try_divide(F.col("mp_ns"), F.col(top).cast("double")),
        "pct_ew": F.try_divide(F.col("mp_ew"), F.col(top).cast("double")),
    })


def matchpoints_by_value(df: DataFrame, k, value: str, prefix: str = "", buckets: int = 64) -> DataFrame:
    """W1-W3 on any table: top, average-rank matchpoints and percentage of ``value`` within ``k``.

    For any numeric value, including continuous ones where one hot key can own a large
    share of all distinct values, the rank is computed in two levels: each key's value
    range is cut into ``buckets`` equal-width buckets; a window over the (at most
    ``buckets``) bucket totals of a key gives the count below each bucket, and a window over
    the distinct values of one (key, bucket) gives the count below within it.  A hot key is
    therefore spread over up to ``buckets`` window partitions; every step before is a
    partial aggregate.
    """
    k = _keys(k)
    freq = score_frequency(df, k, value, "_n")
    v = F.col(value).cast("double")
    stats = freq.filter(F.col(value).isNotNull()).groupBy(*k).agg(
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.sum("_n").alias("_tot"))
    f = freq.join(stats, on=k, how="left")
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
    nn = f.filter(F.col(value).isNotNull()).withColumn("_b", b.cast("int"))
    bc = nn.groupBy(*k, "_b").agg(F.sum("_n").alias("_bn"))
    wb = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bc = bc.withColumn("_below_bucket", F.coalesce(F.sum("_bn").over(wb), F.lit(0)))
    nn = nn.join(bc.select(*k, "_b", "_below_bucket"), on=k + ["_b"], how="inner")
    wv = Window.partitionBy(*k, "_b").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    less = F.col("_below_bucket") + F.coalesce(F.sum("_n").over(wv), F.lit(0))
    mp_nn = nn.select(*k, value, (F.col("_tot") - 1).cast("long").alias(f"{prefix}mp_top"),
                      (less + (F.col("_n") - 1) / 2.0).alias(f"{prefix}mp"))
    mp_null = f.filter(F.col(value).isNull()).select(
        *k, value, (F.coalesce(F.col("_tot"), F.lit(0)) - 1).cast("long").alias(f"{prefix}mp_top"),
        F.lit(None).cast("double").alias(f"{prefix}mp"))
    mp = mp_nn.unionByName(mp_null)
    cond = [df[c].eqNullSafe(mp[c]) for c in k + [value]]
    out = df.join(mp, cond, "left").select(df["*"], mp[f"{prefix}mp_top"], mp[f"{prefix}mp"])
    return out.withColumn(f"{prefix}pct", F.try_divide(F.col(f"{prefix}mp"), F.col(f"{prefix}mp_top").cast("double")))


def matchpoints_from_frequency(freq: DataFrame, k, score: str = "score", count: str = "n") -> DataFrame:
    """From (k, score, count) rows: beaten, matchpoints and percentage of each score.

    mps = results beaten + (count - 1) / 2; pct = mps / (n - 1), or mps itself when the
    board has a single result.  The EW view is the same with the order reversed.
    """
    k = _keys(k)
    w = Window.partitionBy(*k).orderBy(F.col(score).asc())
    below = F.coalesce(F.sum(count).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.col(count)
    total = F.sum(count).over(Window.partitionBy(*k))
    out = by_key(freq, *k).withColumns({"_below": below, "_total": total})
    mps_ns = F.col("_below") + (F.col(count) - 1) / 2.0
    mps_ew = (F.col("_total") - F.col("_below") - F.col(count)) + (F.col(count) - 1) / 2.0
    top = F.col("_total") - 1
    return out.select(
        *k, score, count,
        F.col("_below").cast("long").alias("beaten"),
        mps_ns.alias("mp_ns"),
        mps_ew.alias("mp_ew"),
        F.when(top == 0, mps_ns).otherwise(mps_ns / top).alias("pct_ns"),
        F.when(top == 0, mps_ew).otherwise(mps_ew / top).alias("pct_ew"),
    )


def expand_frequency(df: DataFrame, count: str = "n") -> DataFrame:
    """A10: repeat each (score, count) row count times."""
    return df.withColumn("_rep", F.explode(F.array_repeat(F.lit(1), F.col(count).cast("int")))).drop("_rep")


def hypothetical_matchpoints(
    scores: DataFrame,
    candidates: DataFrame,
    k,
    score: str = "score",
    value: str = "value",
    fill_null: bool = True,
) -> DataFrame:
    """For every candidate value v of a board: (#scores < v) + 0.5 * (#scores == v).

    The board's real scores are compared with each candidate (null scores count as 0 when
    ``fill_null``, but the top is that of W1: results with a score less one).  A board
    without any score has null matchpoints and a null top.  Union of the score frequency table and the
    board's distinct candidate values, one range-frame window, answer joined back to the
    candidate rows: n log n, never all pairs.
    """
    k = _keys(k)
    s = F.coalesce(F.col(score), F.lit(0)) if fill_null else F.col(score)
    freq = scores.select(*k, s.cast("double").alias("_v"), F.col(score).alias("_s")).groupBy(*k, "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_s").alias("_real"))
    freq = freq.filter(F.col("_v").isNotNull())
    cand = candidates.select(*k, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    u = freq.withColumn("_cand", F.lit(False)).unionByName(cand.withColumns({"_n": F.lit(0).cast("long"), "_real": F.lit(0).cast("long"), "_cand": F.lit(True)}))
    u = by_key(u, *k)
    w = Window.partitionBy(*k).orderBy("_v")
    incl = F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    eq = F.sum("_n").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    real = F.sum("_real").over(Window.partitionBy(*k))
    top = F.when(real > 0, real - 1)
    res = (
        u.withColumns({"_incl": incl, "_eq": eq, "_top": top})
        .filter(F.col("_cand"))
        .select(*k, "_v", F.when(F.col("_top").isNotNull(), (F.col("_incl") - F.col("_eq")) + F.col("_eq") / 2.0).alias("mp"), F.col("_top").cast("long").alias("mp_top"))
    )
    c = candidates.withColumn("_v", F.col(value).cast("double"))
    return c.join(not_broadcast(res), on=k + ["_v"], how="left").drop("_v")


def reference_pct(df: DataFrame, mp: str = "mp", top: str = "mp_top", out: str = "pct") -> DataFrame:
    """Matchpoints of a reference score as a share of top + 1 (the new score counts as a table)."""
    return df.withColumn(out, F.try_divide(F.col(mp), (F.col(top) + 1).cast("double")))


def mp_pct_from_new_score(mp: Column | str, value: Column | str, top: Column | str) -> Column:
    """(MP + [MP > value] + [MP = value] / 2) / (top + 1), kept as the reference writes it."""
    m = F.col(mp) if isinstance(mp, str) else mp
    v = F.col(value) if isinstance(value, str) else value
    t = F.col(top) if isinstance(top, str) else top
    return F.try_divide(m + (m > v).cast("int") + (m == v).cast("int") / 2.0, (t + 1).cast("double"))


def max_pct(df: DataFrame, mp: str, top: str, out: str) -> DataFrame:
    """A side's best matchpoints as a share of the board's top (null for a top of 0)."""
    return df.withColumn(out, F.when(F.col(top) > 0, F.col(mp) / F.col(top).cast("double")))


def max_by_side(df: DataFrame, row_key, side: str, value: str, out: str) -> DataFrame:
    """Per row and side, the maximum of a long table's value."""
    return df.groupBy(*_keys(row_key), side).agg(F.max(value).alias(out))


def board_references(scores: DataFrame, refs: DataFrame, k, spec: dict[str, tuple[str, str, bool]], listed: tuple[str, str] | None = None) -> DataFrame:
    """W4, W5, W7 of values that are fixed for a board (par, a side's best double-dummy score or expected value): one row per
    row of ``refs`` with its columns, ``mp_top``, and ``mp_<name>`` and ``pct_<name>`` (a share of top + 1) for each name.

    ``spec`` gives each name its column in ``refs``, the score column it competes with and whether a null score counts as 0
    (W4) or as a result that beats nobody and is not beaten (par, W5).  A side's largest matchpoints over many candidates are those of
    its largest candidate, so the candidates need only be folded to their maximum before.  A board without any score has
    nulls; equal rows of ``refs`` are one row, for which each result counts as often as they come.  Results are folded to distinct scores
    before the join, so a hot board ships one row per score and task, and compared with the references on the board's own row.
    With ``listed``, the score columns of both sides, the rows also have the board's ``board_scores`` (``_scores``, and its top as ``_top``),
    for the results that join them.
    """
    k = _keys(k)
    used = list(dict.fromkeys([*(listed or ()), *(s for _, s, _ in spec.values())]))
    freq = by_key(scores.groupBy(*k, *used).agg(F.count(F.lit(1)).alias("_n")), *k)
    values = [c for c in refs.columns if c not in k]
    rows = F.collect_list(F.struct(*used, "_n")).alias("_freq")
    kept = ["_top", "_scores"] if listed else []
    boards = list_scores(frequency_matchpoints(freq, k, *listed), k, *listed, rows).withColumnRenamed("mp_top", "_top") if listed else freq.groupBy(*k).agg(rows)
    j = not_broadcast(refs.groupBy(*k, *values).agg(F.count(F.lit(1)).alias("_times"))).join(not_broadcast(boards), on=k, how="left")
    total = lambda start, n: F.aggregate("_freq", start, lambda a, x: a + n(x))

    def beaten(ref: str, score: str, null_is_zero: bool):
        def n(x):
            s = F.coalesce(x[score], F.lit(0)) if null_is_zero else x[score]
            return F.when(F.col(ref) > s, x["_n"] * 1.0).when(F.col(ref) == s, x["_n"] / 2.0).otherwise(F.lit(0.0))

        return total(F.lit(0.0), n) * F.col("_times")

    real = total(F.lit(0).cast("long"), lambda x: F.when(x[used[0]].isNotNull(), x["_n"]).otherwise(F.lit(0).cast("long")))
    out = j.withColumns({"_real": F.nullif(real, F.lit(0)) * F.col("_times"), **{f"_mp_{n}": beaten(*s) for n, s in spec.items()}})
    mp = {f"mp_{n}": F.when(F.col("_real").isNotNull() & F.col(spec[n][0]).isNotNull(), F.col(f"_mp_{n}")) for n in spec}
    out = out.withColumns({"mp_top": (F.col("_real") - 1).cast("long"), **mp})
    return out.select(*k, *values, "mp_top", *mp, *[F.try_divide(F.col(f"mp_{n}"), F.col("_real").cast("double")).alias(f"pct_{n}") for n in spec], *kept)


def matchpoints_asof(new: DataFrame, freq: DataFrame, k, score: str = "score", count: str = "n", new_score: str = "new_score") -> DataFrame:
    """Matchpoint share a new score would get against a board's score frequencies.

    Exact score on the board -> its existing matchpoint share; otherwise the number of
    results beaten by the next higher score / results (the new pair not counted); above all
    scores -> 1.0; unknown board -> null.  As-of lookup by a window over the union of the
    frequency rows and the new scores (no per-pair comparison).
    """
    k = _keys(k)
    f = matchpoints_from_frequency(freq, k, score, count)
    f = f.select(*k, F.col(score).cast("double").alias("_v"), F.col("pct_ns").alias("_pct"), "beaten",
                 F.lit(False).alias("_new"))
    total = freq.groupBy(*k).agg(F.sum(count).alias("_tot"))
    q = new.select(*k, F.col(new_score).cast("double").alias("_v")).distinct()
    q = q.select(*k, "_v", F.lit(None).cast("double").alias("_pct"), F.lit(None).cast("long").alias("beaten"), F.lit(True).alias("_new"))
    u = by_key(f.unionByName(q), *k)
    # order: by value, real rows before new ones at equal value, so the lookup sees an exact hit
    w_after = Window.partitionBy(*k).orderBy(F.col("_v").asc(), F.col("_new").asc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w_exact = Window.partitionBy(*k, "_v")
    u = u.withColumns({
        "_exact_pct": F.max(F.when(~F.col("_new"), F.col("_pct"))).over(w_exact),
        "_next_beaten": F.first(F.when(~F.col("_new") , F.col("beaten")), ignorenulls=True).over(w_after),
    })
    ans = u.filter(F.col("_new")).join(not_broadcast(total), on=k, how="inner")
    ans = ans.select(
        *k, "_v",
        F.when(F.col("_exact_pct").isNotNull(), F.col("_exact_pct"))
        .when(F.col("_next_beaten").isNull(), F.lit(1.0))
        .otherwise(F.col("_next_beaten") / F.col("_tot").cast("double")).alias("asof_pct"),
    )
    c = new.withColumn("_v", F.col(new_score).cast("double"))
    return c.join(not_broadcast(ans), on=k + ["_v"], how="left").drop("_v")


def add_scores(freq: DataFrame, new: DataFrame, k, score: str = "score", count: str = "n") -> DataFrame:
    """Frequency table after more results arrive, with matchpoints recomputed."""
    k = _keys(k)
    inc = new.groupBy(*k, score).agg(F.count(F.lit(1)).alias(count))
    merged = freq.select(*k, score, count).unionByName(inc).groupBy(*k, score).agg(F.sum(count).alias(count))
    return matchpoints_from_frequency(merged, k, score, count)
