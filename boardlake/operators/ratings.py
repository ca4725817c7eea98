"""Player ratings (W8) and declarer-side result columns.

Ratings are means over a player id.  A popular player can own a large share of all rows,
so the mean is a ``groupBy`` (partial aggregation folds a hot id to one row per task
before the shuffle) joined back on the id -- AQE broadcasts the small summary or splits a
skewed join partition -- rather than a window that would put all of a hot id's rows in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, not_broadcast

#: Keys among which rows without an id are dealt.
NO_ID = 1 << 16
#: Stands for unknown tricks in a list of double-dummy rows; no 32-bit number.
NO_TRICKS = 1 << 40


def rating_summary(df: DataFrame, value: str, id_col: str, out: str) -> DataFrame:
    """Per id: mean of ``value`` (booleans count as 0/1) and the number of rows rated."""
    v = F.col(value).cast("double")
    return df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg(v).alias(out), F.count(v).alias(f"{out}_n"))


def ratings(df: DataFrame, value: str, id_col: str, out: str) -> DataFrame:
    """Attach ``out`` = mean of ``value`` over all rows of the same ``id_col``."""
    s = rating_summary(df, value, id_col, out).select(id_col, out)
    return df.join(s, on=id_col, how="left")


def ratings_many(df: DataFrame, specs) -> DataFrame:
    """W8 for several (value, id column, output) triples in one pass over the rows (texts or numbers as ids).

    One scan unpivots the roles and one aggregate by id averages each role's values (a hot id is folded to a row a
    task); its result, one row an id, is read by the join of every role.  Rows without an id meet no join.
    """
    roles = F.array(*[F.struct(F.lit(i).alias("_role"), F.col(id_col).alias("_id"), F.col(value).cast("double").alias("_value"))
                      for i, (value, id_col, _) in enumerate(specs)])
    long = df.select(F.inline(roles)).filter(F.col("_id").isNotNull())
    means = long.groupBy("_id").agg(*[F.avg(F.when(F.col("_role") == i, F.col("_value"))).alias(f"_mean{i}") for i in range(len(specs))])
    means = cut_lineage(means)  # otherwise every role's join evaluates the results again
    salt = F.concat(F.lit("no id "), (F.monotonically_increasing_id() % NO_ID).cast("string"))
    out = df
    for i, (_, id_col, name) in enumerate(specs):
        one = means.select(F.col("_id").alias("_key"), F.col(f"_mean{i}").alias(name)).where(F.col(name).isNotNull())
        # a null id becomes one of many keys that no id has
        out = out.withColumn("_key", F.coalesce(F.col(id_col).cast("string"), salt)).join(one.withColumn("_key", F.col("_key").cast("string")), "_key", "left").drop("_key")
    return out


def _contract_code() -> Column:
    """A number for declarer and strain: 0 to 19, null for other letters."""
    seat, strain = F.instr(F.lit("NESW"), F.col("declarer")) - 1, F.instr(F.lit("CDHSN"), F.col("strain")) - 1
    return F.when((F.length("declarer") == 1) & (F.length("strain") == 1) & (seat >= 0) & (strain >= 0), seat * 5 + strain)


def with_trick_lists(boards: DataFrame, dd: DataFrame, key: str = "deal_id") -> DataFrame:
    """``boards`` with ``_dd``, a list of its deal's double-dummy rows (tricks x 32 + the code of seat and strain), null without any.

    ``dd`` has key, declarer, strain, tricks (one row per seat and strain: 20 a deal, folded before they travel).
    """
    tricks = F.coalesce(F.col("tricks").cast("int").cast("long"), F.lit(NO_TRICKS))
    lists = dd.withColumn("_at", _contract_code()).where(F.col("_at").isNotNull()).groupBy(key).agg(F.collect_list(tricks * 32 + F.col("_at")).alias("_dd"))
    return boards.join(not_broadcast(lists), key, "left")


def with_declarer_columns(results: DataFrame) -> DataFrame:
    """Double-dummy tricks and score of the contract played (undoubled when it makes,
    penalty doubled when it fails, whatever was bid), and differences.

    ``results`` has declarer, strain, level, dbl, vul_declarer, tricks, score_declarer and its board's ``_dd`` (``with_trick_lists``);
    a deal that lists a seat and strain more than once gives a row for each.
    """
    from ..functions import scoring

    mine = F.transform(F.filter("_dd", lambda x: F.pmod(x, F.lit(32)) == F.col("_at")), lambda x: F.nullif(F.shiftright(x, 5), F.lit(NO_TRICKS)).cast("int"))
    j = results.withColumn("_at", _contract_code()).withColumn("dd_tricks", F.explode_outer(mine)).drop("_at", "_dd")
    dd_score = scoring.score_sets_doubled(F.col("level"), F.col("strain"), F.col("vul_declarer"), F.col("dd_tricks"))
    return j.withColumns({
        "dd_score_declarer": dd_score,
        "tricks_dd_diff": (F.col("tricks") - F.col("dd_tricks")).cast("int"),
        "score_dd_diff": (F.col("score_declarer") - dd_score).cast("int"),
        "defender_ge_dd": F.col("score_declarer") <= dd_score,
    })


def with_par_columns(j: DataFrame, ev_max: str | None = None) -> DataFrame:
    """The board's par score as seen by NS and by the declarer, score less par, whether the defenders held the
    declarer to par or less, and (with ``ev_max``, a column of the declarer's best expected value) score less that.

    The results have ``par_ns`` from their board.  PASS and unknown declarers have no declarer columns.
    """
    mine = F.when(F.col("declarer_pair") == "NS", F.col("par_ns")).when(F.col("declarer_pair") == "EW", -F.col("par_ns"))
    cols = {"par_declarer": mine.cast("int"), "score_par_diff_ns": (F.col("score_ns") - F.col("par_ns")).cast("int"),
            "score_par_diff_declarer": (F.col("score_declarer") - mine).cast("int"), "defender_ge_par": F.col("score_declarer") <= mine}
    if ev_max:
        cols["score_ev_max_diff"] = F.col("score_declarer") - F.col(ev_max)
    return j.withColumns(cols)
