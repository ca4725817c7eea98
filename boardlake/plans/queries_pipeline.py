"""Registered end-to-end enrichment query (Q5)."""

from __future__ import annotations

from ..sources import fixtures
from .oracle import sql_scored_results, with_fixtures
from .pipeline import enrich, with_players
from .queries_results import SEATS_SQL
from .queries_sd import EV_CTE, dd_named
from .registry import register

COLS = ["session_id", "board", "l_orderkey", "l_linenumber", "l_partkey", "contract", "score_ns", "mp_ns", "pct_ns",
        "declarer_id", "on_lead_id", "dd_tricks", "tricks_dd_diff", "ev_played"]


@register(
    "enrich_results",
    "Q5,C1-C13,W1-W3,J2,A1,A4",
    with_fixtures(
        ["board_results", "boards", "dd_tricks", "sd_samples"],
        sql_scored_results() + ",\n" + SEATS_SQL + ",\n" + EV_CTE + """,
mm as (select *,
    count(score_ns) over (partition by session_id, board) - 1 as mp_top,
    case when score_ns is not null then (rank() over (partition by session_id, board order by score_ns asc nulls last) - 1)
         + (count(*) over (partition by session_id, board, score_ns) - 1) / 2.0 end as mp_ns
  from decl)""",
        """select m.session_id, m.board, m.l_orderkey, m.l_linenumber, m.l_partkey, m.contract, m.score_ns,
  cast(m.mp_ns as double) mp_ns, m.mp_ns / nullif(m.mp_top, 0) pct_ns, m.declarer_id, m.on_lead_id, m.dd_tricks,
  m.tricks_dd_diff, ev.ev ev_played
from mm m left join ev on ev.deal_id = m.deal_id and ev.pair = m.declarer_pair and ev.declarer = m.declarer
  and ev.strain = m.strain and ev.level = m.level and ev.vul = case when m.vul_declarer then 'V' else 'NV' end""",
    ),
)
def q_enrich_results(spark, sf_dir):
    """Every table result enriched end to end: score, matchpoints, seats, DD tricks and EV of the contract played."""
    out = enrich(with_players(fixtures.board_results(spark, sf_dir, by_rows=False)), fixtures.boards(spark, sf_dir), dd_named(spark, sf_dir),
                 fixtures.sd_samples(spark, sf_dir))
    return out.select(*COLS)
