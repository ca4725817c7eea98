"""Registered query: results against their board's par, best double-dummy and best expected score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matchpoints as mp
from ..session import not_broadcast, own_shuffle
from ..sources import fixtures
from .boards import scored_results
from .oracle import sql_scored_results, with_fixtures
from .queries_mp import _dd_candidates, dd_cand_cte
from .queries_sd import EV_CTE, q_ev_by_vul
from .registry import register


def _beaten(score: str, value: str) -> str:
    return f"cast(sum(case when {score} < {value} then 1.0 when {score} = {value} then 0.5 else 0.0 end) as double)"


def _new_score_pct(mp_col: str, value: str) -> str:
    return f"({mp_col} + case when {mp_col} > {value} then 1 else 0 end + case when {mp_col} = {value} then 0.5 else 0 end) / (mp_top + 1)"


@register(
    "mp_references",
    "W4,W5,W6,W7",
    with_fixtures(
        ["board_results", "dd_tricks", "boards", "sd_samples", "par_scores"],
        sql_scored_results() + ",\n" + dd_cand_cte() + ",\n" + EV_CTE + f""",
hd as (select c.session_id, c.board, c.declarer, count(s.score_ns) n, {_beaten('coalesce(s.score_ns, 0)', 'c.dd_score_ns')} mp_ns,
    {_beaten('coalesce(s.score_ew, 0)', '-c.dd_score_ns')} mp_ew
  from dd_cand c join scored s on s.session_id = c.session_id and s.board = c.board group by c.session_id, c.board, c.declarer, c.strain, c.level),
ddm as (select session_id, board, max(case when declarer in ('N', 'S') and n > 0 then mp_ns end) mp_dd_max_ns,
    max(case when declarer in ('E', 'W') and n > 0 then mp_ew end) mp_dd_max_ew from hd group by session_id, board),
bv as (select session_id, board, deal_id, ((board-1)//4 + (board-1)%4) % 4 in (1, 3) vul_ns, ((board-1)//4 + (board-1)%4) % 4 in (2, 3) vul_ew from boards),
ec as (select b.session_id, b.board, e.pair, e.declarer, e.strain, e.level, e.ev from ev e join bv b using (deal_id)
  where (e.vul = 'V') = case when e.pair = 'NS' then b.vul_ns else b.vul_ew end),
he as (select c.session_id, c.board, c.pair, c.ev, count(s.score_ns) n,
    {_beaten("coalesce(case when c.pair = 'NS' then s.score_ns else s.score_ew end, 0)", 'c.ev')} mp
  from ec c join scored s on s.session_id = c.session_id and s.board = c.board
  group by c.session_id, c.board, c.pair, c.declarer, c.strain, c.level, c.ev),
evm as (select session_id, board, max(ev) filter (where pair = 'NS') ev_max_ns, max(ev) filter (where pair = 'EW') ev_max_ew,
    max(mp) filter (where pair = 'NS' and n > 0) mp_ev_max_ns, max(mp) filter (where pair = 'EW' and n > 0) mp_ev_max_ew from he group by session_id, board),
hp as (select b.session_id, b.board, count(s.score_ns) n, {_beaten('s.score_ns', 'p.par_ns')} mp_par_ns, {_beaten('s.score_ew', '-p.par_ns')} mp_par_ew
  from boards b join par_scores p using (deal_id) join scored s on s.session_id = b.session_id and s.board = b.board group by b.session_id, b.board),
m as (select session_id, board, l_orderkey, l_linenumber, l_partkey, count(score_ns) over (partition by session_id, board) - 1 mp_top,
    case when score_ns is not null then rank() over (partition by session_id, board order by score_ns asc nulls last) - 1
         + (count(*) over (partition by session_id, board, score_ns) - 1) / 2.0 end mp_ns,
    case when score_ew is not null then rank() over (partition by session_id, board order by score_ew asc nulls last) - 1
         + (count(*) over (partition by session_id, board, score_ew) - 1) / 2.0 end mp_ew from scored),
a as (select m.*, mp_ns / nullif(mp_top, 0) pct_ns, mp_ew / nullif(mp_top, 0) pct_ew,
    case when n > 0 then mp_par_ns end mp_par_ns, case when n > 0 then mp_par_ew end mp_par_ew, mp_dd_max_ns, mp_dd_max_ew, mp_ev_max_ns, mp_ev_max_ew,
    mp_dd_max_ns / nullif(mp_top, 0) dd_pct_max_ns, mp_dd_max_ew / nullif(mp_top, 0) dd_pct_max_ew,
    {_new_score_pct('mp_ev_max_ns', 'ev_max_ns')} ev_pct_max_ns, {_new_score_pct('mp_ev_max_ew', 'ev_max_ew')} ev_pct_max_ew
  from m join hp using (session_id, board) join ddm using (session_id, board) join evm using (session_id, board))""",
        """select session_id, board, l_orderkey, l_linenumber, l_partkey, mp_par_ns, mp_par_ew, mp_par_ns / (mp_top + 1) pct_par_ns, mp_par_ew / (mp_top + 1) pct_par_ew,
  mp_dd_max_ns, mp_dd_max_ew, mp_ev_max_ns, mp_ev_max_ew, dd_pct_max_ns, dd_pct_max_ew, ev_pct_max_ns, ev_pct_max_ew,
  pct_ns - dd_pct_max_ns dd_pct_max_diff_ns, pct_ew - dd_pct_max_ew dd_pct_max_diff_ew,
  dd_pct_max_ns - ev_pct_max_ns dd_ev_pct_max_diff_ns, dd_pct_max_ew - ev_pct_max_ew dd_ev_pct_max_diff_ew from a""",
    ),
)
def q_mp_references(spark, sf_dir):
    """Every result with its board's matchpoints for par, the best double-dummy and the best expected score of both sides,
    their percentages, and the differences of actual, double-dummy and expected percentages."""
    board = ["session_id", "board"]
    res = scored_results(fixtures.board_results(spark, sf_dir, by_rows=False))
    cand = _dd_candidates(spark, sf_dir)
    side = F.col("declarer").isin("N", "S")
    dd = cand.groupBy(*board).agg(F.max(F.when(side, F.col("dd_score_ns"))).alias("dd_max_ns"), F.max(F.when(~side, -F.col("dd_score_ns"))).alias("dd_max_ew"))
    ev = q_ev_by_vul(spark, sf_dir).select("deal_id", *board, "ev_max_ns", "ev_max_ew")
    refs = ev.join(not_broadcast(fixtures.par_scores(spark, sf_dir)), "deal_id").withColumn("par_ew", -F.col("par_ns")).drop("deal_id").join(not_broadcast(dd), board)
    spec = {f"{name}_{p}": (f"{name}_{p}", f"score_{p}", name != "par") for name in ("par", "dd_max", "ev_max") for p in ("ns", "ew")}
    at = mp.board_references(res, refs, board, spec, ("score_ns", "score_ew"))
    for p in ("ns", "ew"):
        at = mp.max_pct(at, f"mp_dd_max_{p}", "mp_top", f"dd_pct_max_{p}")
        at = at.withColumn(f"ev_pct_max_{p}", mp.mp_pct_from_new_score(f"mp_ev_max_{p}", f"ev_max_{p}", "mp_top"))
    facts = own_shuffle(at.drop("mp_top", "dd_max_ns", "dd_max_ew", "ev_max_ns", "ev_max_ew", "par_ns", "par_ew"), *board)
    own = res.select(*board, "l_orderkey", "l_linenumber", "l_partkey", "score_ns", "score_ew").join(not_broadcast(facts), board)
    out = mp.percentages(mp.listed_matchpoints(own), "_top")
    diffs = {f"dd_pct_max_diff_{p}": F.col(f"pct_{p}") - F.col(f"dd_pct_max_{p}") for p in ("ns", "ew")}
    diffs |= {f"dd_ev_pct_max_diff_{p}": F.col(f"dd_pct_max_{p}") - F.col(f"ev_pct_max_{p}") for p in ("ns", "ew")}
    return out.withColumns(diffs).select(
        *board, "l_orderkey", "l_linenumber", "l_partkey", *[f"{m}_{p}" for m in ("mp_par", "pct_par", "mp_dd_max", "mp_ev_max", "dd_pct_max", "ev_pct_max") for p in ("ns", "ew")], *diffs)
