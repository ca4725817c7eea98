"""Hand features of deals (P5-P15) in long form: one row per (deal, direction).

All four hands and both pairs are evaluated on the deal's own row with plain column
expressions (16 suit holdings split out of the deal string), then the four hands become
rows with ``inline``.  No shuffle, no Python, and whole-stage code generation covers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import deals as D
from ..functions.vocab import DIRECTIONS, SUITS

# fixed values: suit quality and stopper rules on (suit length sl, suit HCP hcp)
SUIT_QUALITY_RULES = {
    "biddable": "sl >= 5 or (sl = 4 and hcp >= 3)",
    "rebiddable": "sl >= 6 or (sl = 5 and hcp >= 3)",
    "twice_rebiddable": "sl >= 7 or (sl = 6 and hcp >= 3)",
    "strong_rebiddable": "sl >= 6 and hcp >= 9",
    "solid": "hcp >= 9",
    "at_best_partial_stop_in": "sl + hcp < 4",
    "partial_stop_in": "sl + hcp >= 4",
    "likely_stop_in": "sl + hcp >= 5",
    "stop_in": "hcp >= 4 or sl + hcp >= 6",
    "at_best_stop_in": "sl + hcp >= 7",
    "two_stops_in": "sl + hcp >= 8",
}


def _suit_col(d: str, s: str) -> str:
    return f"_s_{d}_{s}"


def with_suit_holdings(df: DataFrame, pbn: str = "pbn") -> DataFrame:
    """P5: the 16 suit holdings of a deal as columns ``_s_{direction}_{suit}``."""
    hands = D.hands_of(pbn)
    cols = {}
    for i, d in enumerate(DIRECTIONS):
        suits = D.suits_of_hand(F.element_at(hands, i + 1))
        for j, s in enumerate(SUITS):
            cols[_suit_col(d, s)] = F.element_at(suits, j + 1)
    return df.withColumns(cols)


def with_suit_values(df: DataFrame) -> DataFrame:
    """Per-suit length, HCP and quick tricks as columns, so later sums only reference them."""
    cols = {}
    for d in DIRECTIONS:
        for s in SUITS:
            c = F.col(_suit_col(d, s))
            cols[f"_sl_{d}_{s}"] = F.length(c).cast("int")
            cols[f"_hcp_{d}_{s}"] = D.suit_hcp(c)
            cols[f"_qt_{d}_{s}"] = D.suit_quick_tricks(c)
    return df.withColumns(cols)


def _v(kind: str, d: str, s: str) -> Column:
    return F.col(f"_{kind}_{d}_{s}")


def _hand_struct(d: str) -> Column:
    sl = {s: _v("sl", d, s) for s in SUITS}
    hcp = {s: _v("hcp", d, s) for s in SUITS}
    qt = {s: _v("qt", d, s) for s in SUITS}
    dp = {s: D.distribution_points(sl[s]) for s in SUITS}
    hcp_t = hcp["S"] + hcp["H"] + hcp["D"] + hcp["C"]
    dp_t = dp["S"] + dp["H"] + dp["D"] + dp["C"]
    ml = F.sort_array(F.array(*[F.struct(sl[s].alias("len"), F.lit(i).alias("idx")) for i, s in enumerate("CDHS")]), asc=False)
    shape_ml = F.concat_ws("-", *[F.element_at(ml, k)["len"].cast("string") for k in range(1, 5)])
    p = "NS" if d in "NS" else "EW"
    fields = [
        F.lit(d).alias("direction"),
        F.lit(p).alias("pair"),
        F.concat_ws(".", *[F.col(_suit_col(d, s)) for s in SUITS]).alias("hand"),
        *[sl[s].alias(f"sl_{s.lower()}") for s in SUITS],
        *[hcp[s].alias(f"hcp_{s.lower()}") for s in SUITS],
        hcp_t.cast("int").alias("hcp"),
        *[qt[s].alias(f"qt_{s.lower()}") for s in SUITS],
        (qt["S"] + qt["H"] + qt["D"] + qt["C"]).alias("qt"),
        *[dp[s].alias(f"dp_{s.lower()}") for s in SUITS],
        dp_t.cast("int").alias("dp"),
        (hcp_t + dp_t).cast("int").alias("total_points"),
        F.concat_ws("-", *[sl[s].cast("string") for s in "CDHS"]).alias("shape_cdhs"),
        shape_ml.alias("shape_ml"),
        F.concat_ws("-", *[F.element_at(ml, k)["idx"].cast("string") for k in range(1, 5)]).alias("shape_ml_idx"),
        D.is_balanced(shape_ml, sl["C"], sl["D"]).alias("balanced"),
    ]
    fields += [F.col(f"_{p}_{k}").alias(f"pair_{k}") for k in ("hcp", "dp", "total_points", "qt", "longest_suit", "longest_len")]
    return F.struct(*fields)


def with_pair_values(df: DataFrame) -> DataFrame:
    """P9, P12, P13 for both pairs: summed HCP, distribution points, quick tricks and longest suit."""
    cols: dict[str, Column] = {}
    for p in ("NS", "EW"):
        sl = {s: _v("sl", p[0], s) + _v("sl", p[1], s) for s in SUITS}
        hcp = sum((_v("hcp", x, s) for x in p for s in SUITS), F.lit(0))
        dp = sum((D.distribution_points(_v("sl", x, s)) for x in p for s in SUITS), F.lit(0))
        qt = sum((_v("qt", x, s) for x in p for s in SUITS), F.lit(0.0))
        mx = F.greatest(*sl.values())
        # First longest suit in S, H, D, C order
        longest = F.when(sl["S"] == mx, F.lit("S")).when(sl["H"] == mx, F.lit("H")).when(sl["D"] == mx, F.lit("D")).otherwise(F.lit("C"))
        cols.update({
            f"_{p}_hcp": hcp.cast("int"), f"_{p}_dp": dp.cast("int"), f"_{p}_total_points": (hcp + dp).cast("int"),
            f"_{p}_qt": qt, f"_{p}_longest_suit": longest, f"_{p}_longest_len": mx.cast("int"),
        })
    return df.withColumns(cols)


def hand_features(deals: DataFrame, key: str = "deal_id", pbn: str = "pbn") -> DataFrame:
    """One row per (deal, direction) with lengths, points, shape, pair totals."""
    wide = with_pair_values(with_suit_values(with_suit_holdings(deals.select(key, pbn), pbn)))
    hands = F.array(*[_hand_struct(d) for d in DIRECTIONS])
    return wide.select(key, F.inline(hands))


def hand_quality(deals: DataFrame, key: str = "deal_id", pbn: str = "pbn", rules: dict[str, str] | None = None) -> DataFrame:
    """One row per (deal, direction, suit) with suit quality and stopper flags.

    ``rules`` maps a flag name to a SQL predicate over ``sl`` (suit length) and ``hcp``.
    """
    rules = rules or SUIT_QUALITY_RULES
    wide = with_suit_holdings(deals.select(key, pbn), pbn)
    rows = []
    for d in DIRECTIONS:
        for s in SUITS:
            c = F.col(_suit_col(d, s))
            rows.append(F.struct(F.lit(d).alias("direction"), F.lit(s).alias("suit"),
                                 F.length(c).cast("int").alias("sl"), D.suit_hcp(c).alias("hcp")))
    long = wide.select(key, F.inline(F.array(*rows)))
    return long.withColumns({name: F.expr(pred) for name, pred in rules.items()})


def card_flags(deals: DataFrame, key: str = "deal_id", pbn: str = "pbn") -> DataFrame:
    """208 boolean columns ``C_{direction}{suit}{rank}`` (wide; opt-in)."""
    wide = with_suit_holdings(deals.select(key, pbn), pbn)
    cols = [F.col(key)]
    for d in DIRECTIONS:
        for s in SUITS:
            for r in "AKQJT98765432":
                cols.append(F.col(_suit_col(d, s)).contains(r).alias(f"C_{d}{s}{r}"))
    return wide.select(*cols)


def cards_long(deals: DataFrame, key: str = "deal_id", pbn: str = "pbn", keep: tuple[str, ...] = ()) -> DataFrame:
    """P6 in long form: one row per (deal, direction, suit, rank) held; ``keep`` columns ride along."""
    wide = with_suit_holdings(deals.select(key, pbn, *keep), pbn)
    rows = [F.struct(F.lit(d).alias("direction"), F.lit(s).alias("suit"), F.col(_suit_col(d, s)).alias("holding"))
            for d in DIRECTIONS for s in SUITS]
    long = wide.select(key, *keep, F.inline(F.array(*rows)))
    return long.select(key, *keep, "direction", "suit", F.explode(F.split(F.col("holding"), "")).alias("rank")).filter(F.col("rank") != "")
