"""Registered feed queries (Q6, S13 by header, J3, K2, F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures
from .feed import feed_pairs, process_feed
from .oracle import sql_scored_results, with_fixtures
from .queries_results import SEATS_SQL
from .queries_sd import EV_CTE, dd_named
from .registry import register

PAIRS_SQL = """pairs as (
  select cast(s_suppkey as bigint) page_id, side direction, p pair_number,
    side || p || 'a of ' || s_suppkey player_1, side || p || 'b of ' || s_suppkey player_2,
    ((p * 13 + s_suppkey * 7 + k) % 400) / 2.0 match_points, ((p * 377 + s_suppkey * 101 + k) % 6000 + 2000) / 100.0 score_percent,
    'c' || (s_suppkey % 7) club, cast(s_suppkey as varchar) event
  from supplier, range(1, 13) t(p), (values ('NS', 0), ('EW', 1)) u(side, k)),
placed as (select *, cast(row_number() over (partition by page_id, direction order by score_percent desc, pair_number) as int) as position from pairs)"""


@register(
    "feed_pairs",
    "S13,S21",
    "with " + PAIRS_SQL + """ select page_id, club, event, direction, position, cast(pair_number as int) pair_number, player_1, player_2,
  cast(match_points as double) match_points, cast(score_percent as double) score_percent from placed""",
)
def q_feed_pairs(spark, sf_dir):
    """Every pair listed on the sessions' result pages, cells found by each page's own header."""
    return feed_pairs(fixtures.feed_pages(spark, sf_dir)).select(
        "page_id", "club", "event", "direction", "position", "pair_number", "player_1", "player_2", "match_points", "score_percent")


FEED_COLS = ["session_id", "board", "l_orderkey", "l_linenumber", "l_partkey", "contract", "score_ns", "pct_ns", "declarer_id", "ev_played", "club", "event",
             "pair_direction", "player_id", "partner_id", "boards_i_played", "boards_i_declared", "boards_partner_declared", "boards_opponent_declared"]


@register(
    "feed_pipeline",
    "Q6,S13,J3,Q5,K2,F2",
    with_fixtures(
        ["board_results", "boards", "dd_tricks", "sd_samples"],
        PAIRS_SQL + """,
named as (select r.* exclude (player_n, player_e, player_s, player_w), l_partkey % 12 + 1 pair_no_ns, l_orderkey % 13 + 1 pair_no_ew,
    ns.player_1 player_n, ns.player_2 player_s, ew.player_1 player_e, ew.player_2 player_w
  from board_results r
  left join pairs ns on ns.page_id = r.session_id and ns.direction = 'NS' and ns.pair_number = l_partkey % 12 + 1
  left join pairs ew on ew.page_id = r.session_id and ew.direction = 'EW' and ew.pair_number = l_orderkey % 13 + 1),
""" + sql_scored_results("named") + ",\n" + SEATS_SQL + ",\n" + EV_CTE + """,
mm as (select *,
    count(score_ns) over (partition by session_id, board) - 1 as mp_top,
    case when score_ns is not null then (rank() over (partition by session_id, board order by score_ns asc nulls last) - 1)
         + (count(*) over (partition by session_id, board, score_ns) - 1) / 2.0 end as mp_ns
  from decl),
best as (select * from placed qualify row_number() over (partition by page_id order by score_percent desc, direction desc, position) = 1),
seen as (select mm.*, best.club, best.event, best.direction pair_direction, best.player_1 player_id, best.player_2 partner_id,
    case when best.direction = 'NS' then pair_no_ns else pair_no_ew end = best.pair_number mine
  from mm left join best on best.page_id = mm.session_id)""",
        """select m.session_id, m.board, m.l_orderkey, m.l_linenumber, m.l_partkey, m.contract, m.score_ns, m.mp_ns / nullif(m.mp_top, 0) pct_ns,
  m.declarer_id, ev.ev ev_played, m.club, m.event, m.pair_direction, m.player_id, m.partner_id, mine boards_i_played,
  coalesce(mine and declarer_id = player_id, false) boards_i_declared, coalesce(mine and declarer_id = partner_id, false) boards_partner_declared,
  mine and contract <> 'PASS' and declarer_pair <> pair_direction boards_opponent_declared
from seen m left join ev on ev.deal_id = m.deal_id and ev.pair = m.declarer_pair and ev.declarer = m.declarer
  and ev.strain = m.strain and ev.level = m.level and ev.vul = case when m.vul_declarer then 'V' else 'NV' end""",
    ),
)
def q_feed_pipeline(spark, sf_dir):
    """Result pages and results to enriched results with the perspective of each session's best pair."""
    results = fixtures.board_results(spark, sf_dir, by_rows=False).drop("player_n", "player_e", "player_s", "player_w")
    results = results.withColumns({"pair_no_ns": F.col("l_partkey") % 12 + 1, "pair_no_ew": F.col("l_orderkey") % 13 + 1})
    out = process_feed(fixtures.feed_pages(spark, sf_dir), results, fixtures.boards(spark, sf_dir), dd_named(spark, sf_dir), fixtures.sd_samples(spark, sf_dir))
    return out.select(*FEED_COLS)
