"""Summaries and the user-facing SQL surface (A11-A15, A17, K1-K6, U1, U2, Q1-Q4; A16 is in predict).

``query`` registers a frame as the temp view ``self`` and hands the statement to
``spark.sql``; a statement without a FROM gets ``FROM self`` put in front (Spark parses
``FROM v SELECT ...``).  Spark's own parser and optimizer do the rest.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import exact_quantiles

QUANTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, cols, by=None, digits: int = 6) -> DataFrame:
    """Count, nulls, mean, std, min, quartiles and max per column (per group when ``by``).

    The columns are unpivoted, so one scan and one aggregate serve all of them; the quartiles are exact, by counts of
    ranges of values (``ranks``) instead of a buffer of a group's values.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("_null"), F.col(c).cast("double").alias("x")) for c in cols])
    rows = df.select(*by, F.inline(entries))
    keys = [*by, "column"]
    base = rows.groupBy(*keys).agg(
        F.count("x").alias("count"), F.sum(F.col("_null").cast("long")).alias("nulls"), F.round(F.avg("x"), digits).alias("mean"),
        F.round(F.stddev_samp("x"), digits).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    found = exact_quantiles(rows, keys, QUANTILES).groupBy(*[F.col(c).alias(f"_q_{c}") for c in keys]).agg(
        *[F.round(F.max(F.when(F.col("q") == q, F.col("value"))), digits).alias(f"q{int(q * 100)}") for q in QUANTILES])
    same = [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in keys]
    out = base.join(found, same, "left")
    return out.select(*by, "count", "nulls", "mean", "std", "min", *[f"q{int(q * 100)}" for q in QUANTILES], "max", "column")


def summarize(df: DataFrame, cols=None, rsd: float = 0.02, accuracy: int = 10_000, digits: int = 6) -> DataFrame:
    """Q4: one row per column, of any type: column_name, column_type, count, null_percentage, min, max, approx_unique, avg, std, q25, q50, q75.

    One scan: the columns are unpivoted into (name, text, number) and aggregated with mergeable sketches.  ``approx_unique`` has a
    relative standard error of ``rsd``; a quartile's rank is off by at most rows / ``accuracy`` (both are Spark's sketches); all else is exact.
    min and max are texts, of numbers by number; columns that are not numbers have no mean or quartiles.
    """
    cols = list(cols or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    is_number = {c: isinstance(kinds[c], T.NumericType) for c in cols}

    def entry(i, c):
        number = F.col(f"`{c}`").cast("double") if is_number[c] else F.lit(None).cast("double")
        text = F.col(f"`{c}`") if isinstance(kinds[c], T.StringType) else F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{c}`").cast("string")
        return F.struct(F.lit(i).alias("_i"), F.when(F.col(f"`{c}`").isNotNull(), text).alias("_text"), number.alias("_x"))

    rows = df.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(cols)])))
    agg = rows.groupBy("_i").agg(
        F.count("*").alias("_n"), F.count("_text").alias("count"), F.approx_count_distinct("_text", rsd).alias("approx_unique"),
        F.min("_text").alias("_t0"), F.max("_text").alias("_t1"), F.min_by("_text", "_x").alias("_x0"), F.max_by("_text", "_x").alias("_x1"),
        F.round(F.avg("_x"), digits).alias("avg"), F.round(F.stddev_samp("_x"), digits).alias("std"),
        F.percentile_approx("_x", F.array(*[F.lit(q) for q in QUANTILES]), accuracy).alias("_q"))
    named = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(i), F.struct(F.lit(c).alias("name"), F.lit(kinds[c].simpleString()).alias("kind"), F.lit(is_number[c]).alias("number")))])
    about = F.element_at(named, F.col("_i"))
    pick = lambda x, t: F.when(about["number"], F.col(x)).otherwise(F.col(t))
    return agg.select(about["name"].alias("column_name"), about["kind"].alias("column_type"), "count",
                      F.round((F.col("_n") - F.col("count")) / F.col("_n") * 100, digits).alias("null_percentage"), pick("_x0", "_t0").alias("min"), pick("_x1", "_t1").alias("max"),
                      "approx_unique", "avg", "std", *[F.get("_q", F.lit(j)).alias(f"q{int(q * 100)}") for j, q in enumerate(QUANTILES)])


def compare_sides(df: DataFrame, col: str, by=None) -> DataFrame:
    """Sum of a difference column and how often it is positive / negative, per group."""
    by = [by] if isinstance(by, str) else list(by or [])
    return df.groupBy(*by).agg(
        F.sum(col).alias(f"{col}_sum"),
        F.sum((F.col(col) > 0).cast("long")).alias(f"{col}_gt0"),
        F.sum((F.col(col) < 0).cast("long")).alias(f"{col}_lt0"),
    )


def counts(df: DataFrame, by, distinct_col: str | None = None) -> DataFrame:
    """Group counts (and a distinct count)."""
    by = [by] if isinstance(by, str) else list(by)
    aggs = [F.count(F.lit(1)).alias("n")]
    if distinct_col:
        aggs.append(F.countDistinct(distinct_col).alias(f"distinct_{distinct_col}"))
    return df.groupBy(*by).agg(*aggs)


def score_lists(df: DataFrame, k, score: str) -> DataFrame:
    """A board's scores as a sorted list of (score, count) pairs.

    Built from the score frequency table, so the list holds one entry per *distinct* score
    (bounded by the finite set of bridge scores) however many tables played the board;
    ``matchpoints.expand_frequency`` gives the repeated form when really needed.
    """
    k = [k] if isinstance(k, str) else list(k)
    freq = df.groupBy(*k, score).agg(F.count(F.lit(1)).alias("n"))
    return freq.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct(F.col(score).alias("score"), "n"))).alias("scores"))


def dedupe(df: DataFrame, cols) -> DataFrame:
    """A17."""
    return df.dropDuplicates(list(cols))


def top(df: DataFrame, col: str, n: int = 1, by=None) -> DataFrame:
    """K2/K6: the n rows with the largest ``col`` (per group when ``by``); ties go by the other columns in order."""
    from pyspark.sql import Window

    ties = [F.col(c) for c in df.columns if c != col]
    if not by:
        return df.orderBy(F.col(col).desc(), *ties).limit(n)
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(F.col(col).desc(), *ties)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def report_slice(df: DataFrame, rows: int = 30, cols: int = 11, digits: int = 2) -> DataFrame:
    """K5: first rows x columns with doubles rounded for display."""
    sel = []
    for f in df.schema.fields[:cols]:
        c = F.col(f.name)
        sel.append(F.round(c, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else c)
    return df.select(*sel).limit(rows)


def sample_rows(df: DataFrame, n: int, seed: int, k) -> DataFrame:
    """K4: a reproducible sample of n rows: the n smallest hashes of (key, seed)."""
    k = [k] if isinstance(k, str) else list(k)
    return df.withColumn("_h", F.xxhash64(*[F.col(c) for c in k], F.lit(seed))).orderBy("_h", *k).limit(n).drop("_h")


_FROM = re.compile(r"\bfrom\s", re.IGNORECASE)


def query(df: DataFrame, sql: str, view: str = "self") -> DataFrame:
    """Q1: run user SQL against the frame registered as ``self``; add FROM self when absent."""
    df.createOrReplaceTempView(view)
    stmt = sql if _FROM.search(sql) else f"FROM {view} {sql}"
    return df.sparkSession.sql(stmt)


def expand_macros(sql: str, values: dict[str, str | None]) -> str:
    """Q2: replace {Player_Direction}-style macros; a macro with no value is left as is."""
    out = sql
    for k, v in values.items():
        if v is not None:
            out = out.replace("{" + k + "}", v)
    return out


def run_report(df: DataFrame, spec: list[tuple[str, list[str]]], macros: dict | None = None) -> dict[str, list[DataFrame]]:
    """Q3: named prompts, each a list of statements, to lazy frames."""
    return {name: [query(df, expand_macros(s, macros or {})) for s in stmts] for name, stmts in spec}


def split_frequency(df: DataFrame, col: str) -> DataFrame:
    """A list of (score, count, mp_ns, mp_ew) structs -> parallel lists and top = total count - 1."""
    c = F.col(col)
    return df.withColumns({
        "scores": F.transform(c, lambda x: x["score"]),
        "counts": F.transform(c, lambda x: x["n"]),
        "top": F.aggregate(F.transform(c, lambda x: x["n"]), F.lit(0).cast("long"), lambda a, b: a + b) - 1,
    })


def join_by_row_key(dfs, k) -> DataFrame:
    """Frames of equal height put side by side on a row key (Spark has no positional concat)."""
    k = [k] if isinstance(k, str) else list(k)
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, on=k, how="inner")
    return out


def union_all(dfs) -> DataFrame:
    """Vertical concat with missing columns null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def common_type(types: list[T.DataType]) -> T.DataType:
    """The type that values of all ``types`` keep their meaning in: equal types stay, integers become the widest one, numbers with a
    fraction double, dates with timestamps timestamps; all else becomes text.  Null types follow the others."""
    kinds = [t for t in types if not isinstance(t, T.NullType)]
    if all(t == kinds[0] for t in kinds[1:]):
        return kinds[0] if kinds else T.NullType()
    whole = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if all(type(t) in whole for t in kinds):
        return max(kinds, key=lambda t: whole.index(type(t)))
    if all(isinstance(t, T.NumericType) for t in kinds):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType)) for t in kinds):
        return T.TimestampType()
    return T.StringType()


def union_relaxed(dfs) -> DataFrame:
    """Vertical concat by name; missing columns are null, columns of different types are cast to their common type."""
    names = list(dict.fromkeys(c for d in dfs for c in d.columns))
    to = {c: common_type([d.schema[c].dataType for d in dfs if c in d.columns]) for c in names}
    cast = lambda d, c: F.col(f"`{c}`").cast(to[c]).alias(c) if c in d.columns else F.lit(None).cast(to[c]).alias(c)
    return union_all([d.select(*[cast(d, c) for c in names]) for d in dfs])


def compare_teams(df: DataFrame, cols, is_a, by=None) -> DataFrame:
    """A13 for two teams: per difference column the rows 'all', 'A', 'B' and 'A-B' with its sum and how often it is positive / negative.

    ``is_a`` is a condition; rows where it is null count in 'all' only.  One scan and one aggregate.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    teams = {"all": F.lit(True), "A": is_a, "B": ~is_a}
    aggs = []
    for i, c in enumerate(cols):
        for t, cond in teams.items():
            aggs += [F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias(f"_{i}_{t}_sum"),
                     F.count(F.when(cond & (F.col(c) > 0), 1)).alias(f"_{i}_{t}_gt0"), F.count(F.when(cond & (F.col(c) < 0), 1)).alias(f"_{i}_{t}_lt0")]
    what = ("sum", "gt0", "lt0")
    value = lambda i, t, w: F.col(f"_{i}_{t}_{w}") if t != "A-B" else F.col(f"_{i}_A_{w}") - F.col(f"_{i}_B_{w}")
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("team"), *[value(i, t, w).alias(w) for w in what])
                     for i, c in enumerate(cols) for t in (*teams, "A-B")])
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))
