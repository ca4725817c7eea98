"""Registered hand-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import deals as D
from ..operators import hands as H
from ..sources import fixtures
from .oracle import with_fixtures
from .registry import register


def sql_hcp(x: str) -> str:
    return "cast(" + " + ".join(f"(length({x}) - length(replace({x}, '{r}', ''))) * {v}" for r, v in
                                (("A", 4), ("K", 3), ("Q", 2), ("J", 1))) + " as int)"


def sql_qt(x: str) -> str:
    return (f"cast(case when starts_with({x}, 'AK') then 2.0 when starts_with({x}, 'AQ') then 1.5 when starts_with({x}, 'A') then 1.0 "
            f"when starts_with({x}, 'KQ') then 1.0 when starts_with({x}, 'K') then 0.5 else 0.0 end as double)")


def sql_dp(n: str) -> str:
    return f"(case {n} when 0 then 3 when 1 then 2 when 2 then 1 else 0 end)"


HAND_CTES = """h0 as (
  select deal_id, substr('NESW', i + 1, 1) direction, case when i % 2 = 0 then 'NS' else 'EW' end pair,
    string_split(string_split(substr(pbn, 3), ' ')[i + 1], '.') sp
  from deals, range(0, 4) t(i)),
h1 as (select deal_id, direction, pair, sp[1] s_s, sp[2] s_h, sp[3] s_d, sp[4] s_c from h0),
h2 as (select *, """ + ", ".join(
    [f"cast(length(s_{s}) as int) sl_{s}" for s in "shdc"]
    + [f"{sql_hcp('s_' + s)} hcp_{s}" for s in "shdc"]
    + [f"{sql_qt('s_' + s)} qt_{s}" for s in "shdc"]
) + " from h1),\nh3 as (select *, " + ", ".join(
    [f"{sql_dp('sl_' + s)} dp_{s}" for s in "shdc"]
    + ["list_reverse_sort([{'len': sl_c, 'idx': 0}, {'len': sl_d, 'idx': 1}, {'len': sl_h, 'idx': 2}, {'len': sl_s, 'idx': 3}]) ml"]
) + " from h2)"


HF_CTES = HAND_CTES + """,
h4 as (select *, hcp_s + hcp_h + hcp_d + hcp_c hcp, qt_s + qt_h + qt_d + qt_c qt, dp_s + dp_h + dp_d + dp_c dp,
    array_to_string(list_transform(ml, lambda x: cast(x.len as varchar)), '-') shape_ml
  from h3),
h5 as (select *,
    sum(hcp) over w pair_hcp, sum(dp) over w pair_dp, sum(qt) over w pair_qt,
    sum(sl_s) over w psl_s, sum(sl_h) over w psl_h, sum(sl_d) over w psl_d, sum(sl_c) over w psl_c
  from h4 window w as (partition by deal_id, pair))"""
HF_BODY = """select deal_id, direction, pair, s_s || '.' || s_h || '.' || s_d || '.' || s_c hand,
  sl_s, sl_h, sl_d, sl_c, hcp_s, hcp_h, hcp_d, hcp_c, cast(hcp as int) hcp, qt_s, qt_h, qt_d, qt_c, qt,
  cast(dp_s as int) dp_s, cast(dp_h as int) dp_h, cast(dp_d as int) dp_d, cast(dp_c as int) dp_c, cast(dp as int) dp,
  cast(hcp + dp as int) total_points,
  concat_ws('-', sl_c, sl_d, sl_h, sl_s) shape_cdhs, shape_ml,
  array_to_string(list_transform(ml, lambda x: cast(x.idx as varchar)), '-') shape_ml_idx,
  shape_ml in ('4-3-3-3', '4-4-3-2') or (shape_ml in ('5-3-3-2', '5-4-2-2') and (sl_c = 5 or sl_d = 5)) balanced,
  cast(pair_hcp as int) pair_hcp, cast(pair_dp as int) pair_dp, cast(pair_hcp + pair_dp as int) pair_total_points, pair_qt,
  case greatest(psl_s, psl_h, psl_d, psl_c) when psl_s then 'S' when psl_h then 'H' when psl_d then 'D' else 'C' end pair_longest_suit,
  cast(greatest(psl_s, psl_h, psl_d, psl_c) as int) pair_longest_len
from h5"""


@register("hand_features", "P5,P7,P8,P9,P10,P11,P12,P13,P15", with_fixtures(["deals"], HF_CTES, HF_BODY))
def q_hand_features(spark, sf_dir):
    """Lengths, HCP, quick tricks, distribution points, shape, balance and pair totals of every hand."""
    return H.hand_features(fixtures.deals(spark, sf_dir))


QUALITY_SQL_RULES = {name: pred for name, pred in H.SUIT_QUALITY_RULES.items()}


@register(
    "hand_quality",
    "P14",
    with_fixtures(
        ["deals"],
        """h0 as (
  select deal_id, substr('NESW', i + 1, 1) direction, j, string_split(string_split(substr(pbn, 3), ' ')[i + 1], '.')[j + 1] x
  from deals, range(0, 4) t(i), range(0, 4) u(j)),
h1 as (select deal_id, direction, substr('SHDC', j + 1, 1) suit, cast(length(x) as int) sl, """ + sql_hcp("x") + " hcp from h0)",
        "select deal_id, direction, suit, sl, hcp, " + ", ".join(f"({p}) as {n}" for n, p in QUALITY_SQL_RULES.items()) + " from h1",
    ),
)
def q_hand_quality(spark, sf_dir):
    """Suit quality and stopper flags of every suit of every hand."""
    return H.hand_quality(fixtures.deals(spark, sf_dir))


@register(
    "deal_cards",
    "P5,P6,P18",
    with_fixtures(
        ["deals"],
        """c0 as (
  select deal_id, substr('NESW', i + 1, 1) direction, substr('SHDC', j + 1, 1) suit,
    string_split(string_split(substr(pbn, 3), ' ')[i + 1], '.')[j + 1] x
  from deals, range(0, 4) t(i), range(0, 4) u(j)),
c1 as (select deal_id, direction, suit, unnest(string_split(x, '')) rank from c0 where x <> '')""",
        """select deal_id, direction, suit, rank, cast(strpos('AKQJT98765432', rank) as int) rank_order,
  count(*) over (partition by deal_id) = 52 and count(distinct suit || rank) over (partition by deal_id) = 52 valid_deal
from c1""",
    ),
)
def q_deal_cards(spark, sf_dir):
    """Every card of every deal as a row, with the deck check of the deal."""
    d = fixtures.deals(spark, sf_dir).withColumn("valid_deal", D.is_valid_deal("pbn"))
    cards = H.cards_long(d, keep=("valid_deal",))
    return cards.select(
        "deal_id", "direction", "suit", "rank",
        (F.instr(F.lit("AKQJT98765432"), F.col("rank"))).cast("int").alias("rank_order"),
        "valid_deal",
    )
