"""Trick distributions, expected values and best contracts (A1-A7) in long form.

The reference keeps 560 probability columns and 280 EV columns (plus 3,920 temporaries)
per row; here every value is a row keyed by (deal, pair, declarer, strain[, level, vul]),
so each step is a plain aggregate or a join with the fixed-size score table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.vocab import STRAINS_HIGH_FIRST
from ..session import by_key, not_broadcast

def pair_names() -> F.Column:
    return F.array(F.lit("NS"), F.lit("EW"))


def trick_counts(samples: DataFrame, k=("deal_id", "fixed_pair", "seat", "strain"), tricks: str = "tricks",
                 lo: int = 0, hi: int = 13) -> DataFrame:
    """A1 (wide): per group ``k`` the number of samples and one count per trick value lo..hi.

    One aggregate with a fixed-size buffer (one conditional count per trick value); map-side
    partial aggregation means a group with many samples still ships one row per task.
    """
    k = list(k)
    counts = [F.sum(F.when(F.col(tricks) == t, F.lit(1)).otherwise(F.lit(0))).cast("long").alias(f"n{t}") for t in range(lo, hi + 1)]
    return samples.groupBy(*k).agg(F.count(F.lit(1)).alias("trials"), *counts)


def trick_distribution(samples: DataFrame, k=("deal_id", "fixed_pair", "seat", "strain"), tricks: str = "tricks",
                       lo: int = 0, hi: int = 13) -> DataFrame:
    """A1: share of samples taking each number of tricks lo..hi, per group ``k`` (0.0 where none)."""
    k = list(k)
    g = trick_counts(samples, k, tricks, lo, hi)
    arr = F.array(*[F.struct(F.lit(t).alias("tricks"), F.col(f"n{t}").alias("n")) for t in range(lo, hi + 1)])
    out = g.select(*k, "trials", F.inline(arr))
    return out.withColumn("prob", F.col("n") / F.col("trials").cast("double"))


def name_codes(df: DataFrame) -> DataFrame:
    """Letters for the fixture's integer codes: pair NS/EW, declarer NESW, strain CDHSN."""
    return df.withColumns({
        "pair": F.element_at(pair_names(), F.col("fixed_pair") + 1),
        "declarer": F.substring(F.lit("NESW"), F.col("seat") + 1, 1),
        "strain": F.substring(F.lit("CDHSN"), F.col("strain") + 1, 1),
    })


def named_distribution(dist: DataFrame) -> DataFrame:
    d = name_codes(dist)
    return d.select(
        "deal_id", "pair", "declarer", "strain",
        F.col("tricks").cast("int").alias("tricks"),
        F.col("n").cast("long").alias("n"),
        F.col("trials").cast("long").alias("trials"),
        "prob",
    )


def ev_score_table(spark: SparkSession) -> DataFrame:
    """(strain, tricks, level, vul) -> declarer score with sets doubled: 980 rows, fixed size."""
    t = scoring.score_table(spark).filter(
        ((F.col("tricks") - 6 - F.col("level") >= 0) & (F.col("dbl") == ""))
        | ((F.col("tricks") - 6 - F.col("level") < 0) & (F.col("dbl") == "X"))
    )
    return t.select("strain", "tricks", "level", "vul", "score")


def _ev_score_literal(spark: SparkSession) -> list[int]:
    """The 980 EV scores in (strain CDHSN, level, vul, tricks) order; a fixed-size table, so
    bringing it to the driver to become a literal is bounded."""
    rows = ev_score_table(spark).collect()
    by = {(r.strain, r.level, bool(r.vul), r.tricks): r.score for r in rows}
    return [by[(s, lv, v, t)] for s in "CDHSN" for lv in range(1, 8) for v in (False, True) for t in range(14)]


def first_score(strain: Column, level: Column, vul: Column) -> Column:
    """Place of a contract's first score (of 0 tricks) in the list of EV scores, from 0."""
    return ((F.instr(F.lit("CDHSN"), strain) - 1) * 7 + (level - 1)) * 28 + vul.cast("int") * 14


def ev_numerator(spark: SparkSession, first: Column | None = None) -> Column:
    """Sum of n_t x score_t of a contract (``first_score``, else the column _first) over the counts n0..n13 on its row: a dot product with a
    literal copy of the score table."""
    lit_scores = F.array(*[F.lit(x) for x in _ev_score_literal(spark)])
    base = F.col("_first") if first is None else first
    num = None
    for t in range(14):
        term = F.col(f"n{t}") * F.element_at(lit_scores, base + (t + 1))
        num = term if num is None else num + term
    return num


def with_played_ev(results: DataFrame, samples: DataFrame, key: str = "deal_id", out: str = "ev_played") -> DataFrame:
    """A1, A4: every result with the EV of the contract it played (null without samples of its declarer and strain).

    ``results`` has key, declarer, declarer_pair, strain, level, vul_declarer (null counts as not vulnerable); ``samples`` the integer
    codes.  The join meets one row of counts a (deal, pair, seat, strain) and the dot product is evaluated on the result's own row, so
    no row of another level or vulnerability is ever made.
    """
    counts = trick_counts(samples, (key, "fixed_pair", "seat", "strain")).filter(F.col("fixed_pair") == F.col("seat") % 2)
    counts = counts.withColumnsRenamed({"fixed_pair": "_pair", "seat": "_seat", "strain": "_strain"})
    codes = {"_pair": F.when(F.col("declarer_pair") == "NS", 0).when(F.col("declarer_pair") == "EW", 1),
             "_seat": F.instr(F.lit("NESW"), F.col("declarer")) - 1, "_strain": F.instr(F.lit("CDHSN"), F.col("strain")) - 1}
    results = results.withColumn("_first", first_score(F.col("strain"), F.col("level"), F.coalesce(F.col("vul_declarer"), F.lit(False))))
    j = results.withColumns(codes).join(not_broadcast(counts), [key, *codes], "left")
    return j.withColumn(out, ev_numerator(results.sparkSession) / F.col("trials").cast("double")).drop(*codes, "_first", "trials", *[f"n{t}" for t in range(14)])


def expected_values(counts: DataFrame, key: str = "deal_id", keep_numerator: bool = False) -> DataFrame:
    """A4: EV of every own-side declarer, strain, level and vulnerability (long form).

    ``counts`` is the wide output of ``trick_counts`` with letter codes (key, pair,
    declarer, strain, trials, n0..n13).  EV = sum over tricks of prob x score (made
    contracts undoubled, sets doubled), computed as sum(n_t x score_t) / trials so the value
    is exact.  Each counts row yields its 14 (level, vul) rows and each EV is a 14-term dot
    product with a literal score array (the score table is fixed-size): no join and no
    shuffle after the counts.
    """
    own = counts.filter(F.col("pair").contains(F.col("declarer")))
    combos = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(v).alias("vul_b")) for lv in range(1, 8) for v in (False, True)])
    e = own.select(key, "pair", "declarer", "strain", "trials", *[f"n{t}" for t in range(14)], F.inline(combos))
    num = ev_numerator(counts.sparkSession, first_score(F.col("strain"), F.col("level"), F.col("vul_b")))
    cols = [
        key, "pair", "declarer", "strain", F.col("level").cast("int").alias("level"),
        F.when(F.col("vul_b"), F.lit("V")).otherwise(F.lit("NV")).alias("vul"),
        (num / F.col("trials").cast("double")).alias("ev"),
    ]
    if keep_numerator:
        cols += [num.cast("long").alias("ev_num"), F.col("trials")]
    return e.select(*cols)


def _column_order() -> F.Column:
    """Tie order of the reference's EV columns: pair NS first, declarer in pair order, SHDCN, level 1-7."""
    pair_i = F.when(F.col("pair") == "NS", F.lit(0)).otherwise(F.lit(1))
    decl_i = F.when(F.col("declarer").isin("N", "E"), F.lit(0)).otherwise(F.lit(1))
    strain_i = F.instr(F.lit(STRAINS_HIGH_FIRST), F.col("strain")) - 1
    return pair_i * 1000 + decl_i * 100 + strain_i * 10 + F.col("level")


def ev_name(prefix: str = "EV") -> F.Column:
    return F.concat_ws("_", F.lit(prefix), "pair", "declarer", "strain", F.col("level").cast("string"), "vul")


def best_contracts(ev: DataFrame, key: str = "deal_id") -> DataFrame:
    """A5: max EV and the arg-max contract at four grouping levels, per vulnerability.

    ``ev`` is ``expected_values(..., keep_numerator=True)``.  Levels: per pair, declarer and
    strain; per pair and declarer; per pair; all contracts.  Ties go to the first contract
    in the reference's column order (pair NS first, declarer in pair order, SHDCN, level
    1-7).  Plan: the best level of each (pair, declarer, strain) comes from a hash aggregate
    of one packed long, numerator x 8 + (7 - level) -- exact, because all levels of a group
    share its trial count, and the lower level wins ties; partial aggregation folds the 7
    levels before the shuffle.  The survivors -- 20 per deal and vulnerability, a fixed
    number, so no deal can be hot -- are hash-partitioned by deal once, three windows mark
    the declarer, pair and overall winners (the best of a coarser group is the best of its
    finer winners) reusing that partitioning, and one ``inline`` emits every level's rows.
    """
    packed = F.col("ev_num") * 8 + (7 - F.col("level"))
    g = ev.groupBy(key, "vul", "pair", "declarer", "strain").agg(F.max(packed).alias("_p"), F.max("trials").alias("_t"))
    lvl = (7 - F.pmod(F.col("_p"), F.lit(8))).cast("int")
    s = g.select(key, "vul", "pair", "declarer", "strain", lvl.alias("level"),
                 (((F.col("_p") - (7 - lvl)) / 8) / F.col("_t").cast("double")).alias("ev"))
    s = by_key(s.withColumn("_ord", _column_order()), key)
    order = [F.col("ev").desc(), F.col("_ord").asc()]
    flags = {}
    for name, keys in (("_is_declarer", ["pair", "declarer"]), ("_is_pair", ["pair"]), ("_is_all", [])):
        flags[name] = F.row_number().over(Window.partitionBy(key, "vul", *keys).orderBy(*order)) == 1
    s = s.withColumns(flags).withColumn("_name", ev_name())
    none = F.lit(None).cast("string")

    def level(tag: str, pair, declarer, strain, cond):
        return F.when(cond, F.struct(F.lit(tag).alias("grouping"), pair.alias("pair"), declarer.alias("declarer"),
                                     strain.alias("strain"), F.col("ev").alias("ev_max"), F.col("_name").alias("ev_max_col")))

    rows = F.filter(F.array(
        level("strain", F.col("pair"), F.col("declarer"), F.col("strain"), F.lit(True)),
        level("declarer", F.col("pair"), F.col("declarer"), none, F.col("_is_declarer")),
        level("pair", F.col("pair"), none, none, F.col("_is_pair")),
        level("all", none, none, none, F.col("_is_all")),
    ), lambda x: x.isNotNull())
    return s.select(key, "vul", F.inline(rows))


def pick_by_vul(best: DataFrame, boards: DataFrame, key: str = "deal_id") -> DataFrame:
    """Each pair's best EV under the board's actual vulnerability, and the overall best.

    ``best`` is the pair-level output of ``best_contracts``; ``boards`` has key, vul_ns, vul_ew.
    Overall: the larger of the two sides' maxima, NS on ties; name 'EV_Max_NS' / 'EV_Max_EW'.
    """
    pairs = best.filter(F.col("grouping") == "pair").select(key, "vul", "pair", "ev_max", "ev_max_col")
    b = boards.select(key, *[c for c in boards.columns if c != key])
    j = pairs.join(not_broadcast(b), on=key, how="inner").filter(
        F.col("vul") == F.when(F.when(F.col("pair") == "NS", F.col("vul_ns")).otherwise(F.col("vul_ew")), F.lit("V")).otherwise(F.lit("NV"))
    )
    keep = [c for c in b.columns if c not in (key, "vul_ns", "vul_ew")]
    w = j.groupBy(key, *keep).agg(
        F.max(F.when(F.col("pair") == "NS", F.col("ev_max"))).alias("ev_max_ns"),
        F.max(F.when(F.col("pair") == "NS", F.col("ev_max_col"))).alias("ev_max_col_ns"),
        F.max(F.when(F.col("pair") == "EW", F.col("ev_max"))).alias("ev_max_ew"),
        F.max(F.when(F.col("pair") == "EW", F.col("ev_max_col"))).alias("ev_max_col_ew"),
    )
    return w.withColumns({
        "ev_max": F.greatest("ev_max_ns", "ev_max_ew"),
        "ev_max_col": F.when(F.col("ev_max_ns") >= F.col("ev_max_ew"), F.lit("EV_Max_NS")).otherwise(F.lit("EV_Max_EW")),
    })


def pair_max(dd: DataFrame, key: str = "deal_id") -> DataFrame:
    """Double-dummy tricks of a pair in a strain = max of its two seats."""
    return dd.groupBy(key, "pair", "strain").agg(F.max("tricks").cast("int").alias("dd_tricks"))


def total_tricks(lengths: DataFrame, dd_pairs: DataFrame, key: str = "deal_id") -> DataFrame:
    """Law of total tricks.

    ``lengths``: (key, pair, longest_suit, longest_len) -- the pair's first longest suit in
    SHDC order; ``dd_pairs``: (key, pair, strain, dd_tricks).  Per pair: the suit's length
    and the pair's DD tricks in it; per deal: sums over both pairs and length - tricks.
    """
    lengths, dd_pairs = not_broadcast(lengths), not_broadcast(dd_pairs)
    j = lengths.join(dd_pairs, on=[lengths[key] == dd_pairs[key], lengths["pair"] == dd_pairs["pair"],
                                   lengths["longest_suit"] == dd_pairs["strain"]], how="inner")
    per_pair = j.select(lengths[key].alias(key), lengths["pair"].alias("pair"), "longest_suit", "longest_len", "dd_tricks")
    w = Window.partitionBy(key)
    return per_pair.withColumns({
        "lott_sl": F.sum("longest_len").over(w).cast("int"),
        "lott_dd": F.sum("dd_tricks").over(w).cast("int"),
    }).withColumn("lott_diff", (F.col("lott_sl") - F.col("lott_dd")).cast("int"))


def to_wide(dist: DataFrame, key: str = "deal_id", prefix: str = "Probs") -> DataFrame:
    """A2 (opt-in): the long distribution as the reference's 560 wide columns
    ``{prefix}_{pair}_{declarer}_{strain}_{tricks}`` plus the trial count, via a pivot over an
    explicit value list (so the column set does not depend on the data)."""
    names = [f"{prefix}_{p}_{d}_{s}_{t}" for p in ("NS", "EW") for d in "NESW" for s in "SHDCN" for t in range(14)]
    d = dist.withColumn("_name", F.concat_ws("_", F.lit(prefix), "pair", "declarer", "strain", F.col("tricks").cast("string")))
    wide = d.groupBy(key).pivot("_name", names).agg(F.first("prob"))
    trials = dist.groupBy(key).agg(F.max("trials").alias(f"{prefix}_Trials"))
    return wide.join(trials, key)


def compare_tables(a: DataFrame, b: DataFrame, k, cols) -> DataFrame:
    """Rows whose values differ between two keyed tables (or that exist on one side only)."""
    k = [k] if isinstance(k, str) else list(k)
    x = a.select(*k, *[F.col(c).alias(f"a_{c}") for c in cols])
    y = b.select(*k, *[F.col(c).alias(f"b_{c}") for c in cols])
    j = x.join(y, on=k, how="full_outer")
    diff = None
    for c in cols:
        d = ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        diff = d if diff is None else diff | d
    return j.filter(diff)


def canonical_par(contracts: Column) -> Column:
    """A list of par contracts (level, strain, dbl, declarer, overs) in a form that equal lists share: in order, with the tricks
    (level + overs) in place of the level, since one table gives the least level with overtricks where another gives the highest."""
    return F.sort_array(F.transform(contracts, lambda c: F.struct(c["strain"].alias("strain"), c["dbl"].alias("dbl"), c["declarer"].alias("declarer"),
                                                                   (c["level"] + c["overs"]).alias("tricks"))))


def compare_pars(a: DataFrame, b: DataFrame, k, score: str = "par_ns", contracts: str = "par_contracts") -> DataFrame:
    """Every key of two tables of par results with how they compare: 'same', 'score', 'contracts' (as multisets), or the only table
    that has the key ('a', 'b')."""
    k = [k] if isinstance(k, str) else list(k)
    x, y = (t.select(*k, F.struct(F.col(score).alias("score"), canonical_par(F.col(contracts)).alias("list")).alias(n)) for t, n in ((a, "_a"), (b, "_b")))
    j = x.join(y, k, "full_outer")
    verdict = (F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b").when(~F.col("_a.score").eqNullSafe(F.col("_b.score")), "score")
               .when(~F.col("_a.list").eqNullSafe(F.col("_b.list")), "contracts").otherwise("same"))
    return j.select(*k, verdict.alias("par_compare"))
