"""Duplicate-bridge contract scoring as Spark Column expressions.

``score`` is a pure expression (inlined by whole-stage codegen, no lookup join).
``score_table`` crosses small ``range``s into the full 2,940-row table for broadcast joins
(its size is fixed by the game: 7 levels x 5 strains x 14 tricks x 2 vul x 3 doubles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values of the scoring rules ----------------------------------------------
TRICK_VALUE_MINOR = 20        # C, D per level
TRICK_VALUE_MAJOR_NT = 30     # H, S, N per level
NT_FIRST_TRICK_EXTRA = 10
GAME_THRESHOLD = 100
GAME_BONUS = (300, 500)       # not vul, vul
PARTSCORE_BONUS = 50
SMALL_SLAM_BONUS = (500, 750)
GRAND_SLAM_BONUS = (1000, 1500)
INSULT_BONUS = (0, 50, 100)   # '', X, XX
UNDOUBLED_UNDERTRICK = (50, 100)
# doubled, not vul: 100, 300, 500 then 300 more each; vul: 200 then 300 more each
DOUBLED_OVERTRICK = (100, 200)
# ---------------------------------------------------------------------------------------


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def double_multiplier(dbl: Column) -> Column:
    """'' -> 1, 'X' -> 2, 'XX' -> 4."""
    return F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), F.length(dbl) + 1)


def contract_points(level: Column, strain: Column, dbl: Column) -> Column:
    per_trick = F.when(strain.isin("C", "D"), F.lit(TRICK_VALUE_MINOR)).otherwise(F.lit(TRICK_VALUE_MAJOR_NT))
    nt_extra = (strain == "N").cast("int") * NT_FIRST_TRICK_EXTRA
    return (per_trick * level + nt_extra) * double_multiplier(dbl)


def score(level, strain, dbl, vul, result) -> Column:
    """Declarer-relative score of a contract.

    level 1..7, strain one of CDHSN, dbl '' / 'X' / 'XX', vul boolean (declarer side
    vulnerable), result = tricks - 6 - level.  Null in any input gives null.  Written as
    flat arithmetic (vul and the double marker as 0/1/2 factors) so the expression stays
    small enough for whole-stage code generation.
    """
    level, strain, dbl, vul, result = (_c(x) for x in (level, strain, dbl, vul, result))
    dbl = F.coalesce(dbl, F.lit(""))
    v = vul.cast("int")                     # 0 / 1
    nd = F.length(dbl)                      # 0 / 1 / 2 doubles
    minor = strain.isin("C", "D")
    pts = contract_points(level, strain, dbl)
    game = F.when(pts >= GAME_THRESHOLD, GAME_BONUS[0] + (GAME_BONUS[1] - GAME_BONUS[0]) * v).otherwise(F.lit(PARTSCORE_BONUS))
    slam = (
        F.when(level == 6, SMALL_SLAM_BONUS[0] + (SMALL_SLAM_BONUS[1] - SMALL_SLAM_BONUS[0]) * v)
        .when(level == 7, GRAND_SLAM_BONUS[0] + (GRAND_SLAM_BONUS[1] - GRAND_SLAM_BONUS[0]) * v)
        .otherwise(F.lit(0))
    )
    insult = nd * INSULT_BONUS[1]
    over_each = F.when(nd == 0, F.when(minor, F.lit(TRICK_VALUE_MINOR)).otherwise(F.lit(TRICK_VALUE_MAJOR_NT))).otherwise(
        (DOUBLED_OVERTRICK[0] + (DOUBLED_OVERTRICK[1] - DOUBLED_OVERTRICK[0]) * v) * nd
    )
    made = pts + game + slam + insult + result * over_each
    n = -result
    # doubled sets: not vul 100, 300, 500 then 300 more each; vul 200 then 300 more each
    doubled_down = F.when(vul, n * 300 - 100).otherwise(n * 300 - 400 + 100 * F.greatest(F.lit(0), 3 - n))
    down = F.when(nd == 0, n * (UNDOUBLED_UNDERTRICK[0] + (UNDOUBLED_UNDERTRICK[1] - UNDOUBLED_UNDERTRICK[0]) * v)).otherwise(
        doubled_down * nd
    )
    return F.when(result >= 0, made).otherwise(-down).cast("int")


def score_sets_doubled(level, strain, vul, tricks) -> Column:
    """Score used for expected values: made contracts undoubled, sets always doubled."""
    level, strain, vul, tricks = (_c(x) for x in (level, strain, vul, tricks))
    result = tricks - 6 - level
    n = -result
    doubled_down = F.when(vul, n * 300 - 100).otherwise(n * 300 - 400 + 100 * F.greatest(F.lit(0), 3 - n))
    # null strains and vulnerabilities stay null on both sides
    return F.when(result >= 0, score(level, strain, F.lit(""), vul, result)).when(strain.isNotNull() & vul.isNotNull(), -doubled_down).cast("int")


def score_array(level, strain, dbl, vul, double_sets: bool = False) -> Column:
    """Array of 14 declarer scores for 0..13 tricks taken."""
    level, strain, dbl, vul = (_c(x) for x in (level, strain, dbl, vul))

    def one(t: Column) -> Column:
        result = t - 6 - level
        d = F.when(result < 0, F.lit("X")).otherwise(dbl) if double_sets else dbl
        return score(level, strain, d, vul, result)

    return F.transform(F.sequence(F.lit(0), F.lit(13)), one)


def score_table(spark: SparkSession) -> DataFrame:
    """(level, strain, tricks, vul, dbl) -> score: 2,940 rows, fixed by the rules."""
    levels = spark.range(1, 8).select(F.col("id").cast("int").alias("level"))
    strains = spark.range(0, 5).select(F.substring(F.lit("CDHSN"), (F.col("id") + 1).cast("int"), 1).alias("strain"))
    tricks = spark.range(0, 14).select(F.col("id").cast("int").alias("tricks"))
    vuls = spark.range(0, 2).select((F.col("id") == 1).alias("vul"))
    dbls = spark.range(0, 3).select(F.element_at(F.array(F.lit(""), F.lit("X"), F.lit("XX")), (F.col("id") + 1).cast("int")).alias("dbl"))
    grid = levels.crossJoin(strains).crossJoin(tricks).crossJoin(vuls).crossJoin(dbls)
    return grid.withColumn("score", score("level", "strain", "dbl", "vul", F.col("tricks") - 6 - F.col("level")))


def score_table_wide(table: DataFrame) -> DataFrame:
    """A3: one row per tricks taken, one column per contract (sets doubled), '_NV'/'_V' variants."""
    t = table.filter(
        ((F.col("tricks") - 6 - F.col("level") >= 0) & (F.col("dbl") == ""))
        | ((F.col("tricks") - 6 - F.col("level") < 0) & (F.col("dbl") == "X"))
    )
    t = t.withColumn(
        "name",
        F.concat(F.lit("Score_"), F.col("level").cast("string"), F.col("strain"),
                 F.when(F.col("vul"), F.lit("_V")).otherwise(F.lit("_NV"))),
    )
    names = [f"Score_{lv}{s}_{v}" for s in "SHDCN" for lv in range(1, 8) for v in ("NV", "V")]
    return t.groupBy("tricks").pivot("name", names).agg(F.first("score")).orderBy("tricks")
