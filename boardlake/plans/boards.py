"""Board-level building blocks shared by queries and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contracts, deals


def with_board_facts(df: DataFrame, board: str = "board") -> DataFrame:
    """Dealer, vulnerability and the two side flags from the board number (only if absent)."""
    out = df
    if "dealer" not in df.columns:
        out = out.withColumn("dealer", deals.dealer_of(board))
    if "vul" not in df.columns:
        out = out.withColumn("vul", deals.vul_of(board))
    return out.withColumns({"vul_ns": deals.vul_ns("vul"), "vul_ew": deals.vul_ew("vul")})


def scored_results(results: DataFrame) -> DataFrame:
    """C1, C2, C6, C7, C9 on a results table: contract parts, result and signed scores."""
    df = results.withColumn("contract", contracts.normalise_contract(F.col("contract")))
    df = with_board_facts(df)
    return contracts.with_scores(df)
