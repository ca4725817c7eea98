"""Order statistics and dense ranks of columns that no single task could hold.

``select_ranks`` finds the values at given ranks of every group exactly.  Equal values of a group become one row with their
count, and these are dealt to ranges of ``FEW`` values in order of group and value; the ranges' counts, added up (one row a range and
group), tell which range holds a rank, and only within such ranges counts are added up value by value.  The table is read once, whatever
the number of ranks; a window holds ``FEW`` values or a group's ranges, and a value that repeats without end is one row.

``dense_codes`` numbers distinct values in order: a range partitioning, counts of the partitions added up (one
row a partition), and the position within the partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Distinct values of a range, which are ranked in one task.
FEW = 10_000


def _same(keys: list[str], prefix: str):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))


def select_ranks(rows: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """(keys..., r, value, below) for every target (keys..., r): the value at 0-based rank r of the group's ``x``, and how many
    values are smaller.  ``rows`` has the keys and a double ``x``; null values take no part; a rank beyond the group's size is left out.
    """
    counted = rows.where(F.col("x").isNotNull()).groupBy(*keys, "x").agg(F.count("*").alias("_count"))
    ranged = counted.repartitionByRange(*keys, "x").sortWithinPartitions(*keys, "x")
    placed = cut_lineage(ranged.select(*keys, "x", "_count", F.monotonically_increasing_id().alias("_id")))  # partition number and position, kept as they are
    block = F.shiftleft(F.shiftright("_id", 33), 33) + F.floor(F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) / FEW)
    placed = placed.select(*keys, "x", "_count", block.alias("_part"))
    sizes = placed.groupBy("_part", *keys).agg(F.sum("_count").alias("_size"))  # a row for every FEW values, at most one more a group
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), "_size")
    wanted = targets.select(*keys, "r").distinct().join(spans, _same(keys, "_t_") & (F.col("r") >= F.col("_start")) & (F.col("r") < F.col("_start") + F.col("_size")))
    wanted = cut_lineage(wanted.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_part").alias("_t_part"), "r", "_start"))
    here = _same(keys, "_t_") & (F.col("_part") == F.col("_t_part"))
    within = Window.partitionBy("_part", *keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.join(wanted, here, "left_semi").withColumn("_below", F.coalesce(F.sum("_count").over(within), F.lit(0)))
    at = F.col("r") - F.col("_start") - F.col("_below")
    found = near.join(wanted, here).where((at >= 0) & (at < F.col("_count")))
    return found.select(*keys, "r", F.col("x").alias("value"), (F.col("_start") + F.col("_below")).alias("below"))


def exact_quantiles(rows: DataFrame, keys: list[str], quantiles) -> DataFrame:
    """(keys..., q, value): the continuous quantiles of each group's ``x`` (between two values in proportion)."""
    quantiles = [float(q) for q in quantiles]
    n = rows.where(F.col("x").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    want = n.select(*keys, F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("q"), "_n")
    place = (F.col("_n") - 1) * F.col("q")
    want = cut_lineage(want.select(*keys, "q", F.floor(place).alias("r_low"), F.ceil(place).alias("r_high"), (place - F.floor(place)).alias("part")))
    targets = want.select(*keys, F.col("r_low").alias("r")).unionByName(want.select(*keys, F.col("r_high").alias("r")))
    values = cut_lineage(select_ranks(rows, keys, targets))
    for side in ("low", "high"):
        of = values.select(*[F.col(k).alias(f"_v_{k}") for k in keys], F.col("r").alias("_r"), F.col("value").alias(side))
        want = want.join(of, _same(keys, "_v_") & (F.col(f"r_{side}") == F.col("_r"))).drop("_r", *[f"_v_{k}" for k in keys])
    return want.select(*keys, "q", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))


def dense_codes(values: DataFrame, col: str = "value", out: str = "code") -> DataFrame:
    """(value, code): the distinct values numbered from 0 in their order, without a window over all of them."""
    ranged = values.select(col).distinct().repartitionByRange(F.col(col)).sortWithinPartitions(col)
    placed = cut_lineage(ranged.select(col, F.monotonically_increasing_id().alias("_id")))  # partition number and position, kept as they are
    placed = placed.select(col, F.shiftright("_id", 33).alias("_part"), (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("_pos"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").select(col, (F.col("_start") + F.col("_pos")).alias(out))
