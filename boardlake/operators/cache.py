"""Derived-value cache maintenance and key-set operators.

All are joins or aggregates on keys: no driver-side loops and no collected key lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def cache_upsert(cache: DataFrame, new: DataFrame, k) -> DataFrame:
    """Non-null new values overwrite cached ones by key; unseen keys are appended.

    Columns missing on either side come out null; the result has the union of columns.
    One full outer join on the key (both sides shuffle once on the key).  A column whose types differ raises ValueError
    (read from the schemas; a null type fits any).
    """
    k = _keys(k)
    for c in cache.columns:
        kinds = [t.schema[c].dataType.simpleString() for t in (cache, new) if c in t.columns]
        if len(set(kinds) - {"void"}) > 1:
            raise ValueError(f"column {c} is {kinds[0]} in the cache and {kinds[1]} in the new rows")
    cols = list(dict.fromkeys([c for c in cache.columns if c not in k] + [c for c in new.columns if c not in k]))
    o = cache.select(*k, *[F.col(c).alias(f"_o_{c}") if c in cache.columns else F.lit(None).alias(f"_o_{c}") for c in cols])
    n = new.select(*k, *[F.col(c).alias(f"_n_{c}") if c in new.columns else F.lit(None).alias(f"_n_{c}") for c in cols],
                   F.lit(True).alias("_in_new"))
    o = o.withColumn("_in_old", F.lit(True))
    j = o.join(n, on=k, how="full_outer")
    return j.select(
        *k,
        *[F.coalesce(F.col(f"_n_{c}"), F.col(f"_o_{c}")).alias(c) for c in cols],
        F.when(F.col("_in_old").isNull(), F.lit("added"))
        .when(F.col("_in_new").isNull(), F.lit("kept"))
        .otherwise(F.lit("updated")).alias("upsert_action"),
    )


def upsert_counts(upserted: DataFrame) -> DataFrame:
    """Number of rows replaced / added / kept."""
    return upserted.groupBy("upsert_action").agg(F.count(F.lit(1)).alias("n"))


def work_list(keys: DataFrame, cache: DataFrame, k, null_cols, limit: int | None = None) -> DataFrame:
    """Keys that still need work: absent from the cache, or present with a null value.

    ``limit`` caps the list deterministically (by key order) when a caller wants batches.
    """
    k = _keys(k)
    missing = keys.select(*k).join(cache.select(*k), on=k, how="left_anti")
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in null_cols])
    nulls = keys.select(*k).join(cache.filter(has_null).select(*k), on=k, how="left_semi")
    out = missing.withColumn("reason", F.lit("missing")).unionByName(nulls.withColumn("reason", F.lit("null_value")))
    if limit is not None:
        out = out.orderBy(*k).limit(limit)
    return out


def upsert_newer_wins(old: DataFrame, new: DataFrame | None, k, order_cols) -> DataFrame:
    """Per key keep the row with the newest ``order_cols`` (e.g. updated_at, created_at).

    Rows of ``old`` and ``new`` are unioned and reduced per key with ``max(struct(order...,
    payload...))``: a partial aggregate, so a key with very many versions is folded on each
    task before the shuffle (a window would put all of a hot key's rows in one task).  Only
    strictly newer rows replace old ones: on a tie the old row stays.  Ties within one side go to
    the larger payload, deterministically.
    """
    k = _keys(k)
    order_cols = _keys(order_cols)
    u = old.withColumn("_is_old", F.lit(True))
    if new is not None:
        u = u.unionByName(new.withColumn("_is_old", F.lit(False)), allowMissingColumns=True)
    payload = [c for c in u.columns if c not in k and c not in order_cols and c != "_is_old"]
    best = u.groupBy(*k).agg(F.max(F.struct(*order_cols, "_is_old", *payload)).alias("_b"))
    return best.select(*k, *[F.col(f"_b.{c}").alias(c) for c in order_cols + payload])


def only_unprocessed(inputs: DataFrame, manifest: DataFrame, k, types_col: str | None = None, types=None) -> DataFrame:
    """Inputs with no entry in the manifest of done work (optionally of some types only)."""
    k = _keys(k)
    df = inputs
    if types_col and types:
        df = df.filter(F.col(types_col).isin(list(types)))
    return df.join(manifest.select(*k).distinct(), on=k, how="left_anti")


def key_diff(a: DataFrame, b: DataFrame, k) -> DataFrame:
    """Keys of a that are not in b."""
    k = _keys(k)
    return a.select(*k).distinct().join(b.select(*k), on=k, how="left_anti")


def key_common(a: DataFrame, b: DataFrame, k) -> DataFrame:
    k = _keys(k)
    return a.select(*k).distinct().join(b.select(*k), on=k, how="left_semi")


def key_union(a: DataFrame, b: DataFrame, k) -> DataFrame:
    k = _keys(k)
    return a.select(*k).unionByName(b.select(*k)).distinct()


def missing_names(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """U4: names present on one side only, with the side that has them."""
    left = a.select(F.col(col).alias("name")).distinct().exceptAll(b.select(F.col(col).alias("name")).distinct())
    right = b.select(F.col(col).alias("name")).distinct().exceptAll(a.select(F.col(col).alias("name")).distinct())
    return left.withColumn("only_in", F.lit("left")).unionByName(right.withColumn("only_in", F.lit("right")))


def attach_derived(results: DataFrame, derived: DataFrame, k=("pbn", "dealer", "vul")) -> DataFrame:
    """Results with their deal's derived values (inner equi-join on the deal key)."""
    return results.join(derived, on=list(k), how="inner")


def attach_rankings(results: DataFrame, rankings: DataFrame, pair_col: str = "pair_id",
                    ns_col: str = "pair_id_ns", ew_col: str = "pair_id_ew") -> DataFrame:
    """Left-join a pair ranking table twice (NS and EW); names split on '&' into two players."""
    r = rankings.withColumn("_players", F.split(F.col("names"), r"\s*&\s*")) if "names" in rankings.columns else rankings
    out = results
    for side, col in (("ns", ns_col), ("ew", ew_col)):
        rs = r.select(*[F.col(c).alias(f"{c}_{side}") for c in r.columns])
        out = out.join(rs, out[col] == rs[f"{pair_col}_{side}"], "left").drop(f"{pair_col}_{side}")
    return out


def attach_players(df: DataFrame, players: DataFrame, section: str = "section", seats=None,
                   id_col: str = "player_id", name_col: str = "player_name") -> DataFrame:
    """``<id>_<seat>`` and ``<name>_<seat>`` for each seat, looked up by (section, seat, pair number).

    ``players`` has section, orientation (a seat), pair_no, id and name; ``df`` has the section and one
    pair number column per seat (``seats`` maps seat to column; by default NS and EW pair numbers).
    """
    seats = seats or {"N": "pair_no_ns", "S": "pair_no_ns", "E": "pair_no_ew", "W": "pair_no_ew"}
    out = df
    for seat, pair in seats.items():
        p = players.filter(F.col("orientation") == seat).select(
            F.col(section).alias("_section"), F.col("pair_no").alias("_pair"),
            F.col(id_col).alias(f"{id_col}_{seat}"), F.col(name_col).alias(f"{name_col}_{seat}"))
        out = out.join(p, (F.col(section) == F.col("_section")) & (F.col(pair) == F.col("_pair")), "left").drop("_section", "_pair")
    return out
