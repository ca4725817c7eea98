"""Registered queries: best double-dummy matchpoints per side (W5-W7), makeable contracts (C14), table comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import contracts, scoring
from ..operators import matchpoints as mp
from ..operators import singledummy as SD
from ..sources import fixtures
from .boards import scored_results
from .oracle import sql_score, sql_scored_results, with_fixtures
from .queries_mp import _dd_candidates, dd_cand_cte
from .queries_sd import DD_NAMED_CTE, DIST_CTE, dd_named
from .registry import register


@register(
    "mp_dd_max",
    "W4,W7",
    with_fixtures(
        ["board_results", "dd_tricks", "boards"],
        sql_scored_results() + ",\n" + dd_cand_cte() + """,
h as (select c.session_id, c.board, c.declarer, count(s.score_ns) n,
    sum(case when c.declarer in ('N', 'S') then
          (case when coalesce(s.score_ns, 0) < c.dd_score_ns then 1.0 when coalesce(s.score_ns, 0) = c.dd_score_ns then 0.5 else 0.0 end)
        else (case when coalesce(s.score_ew, 0) < -c.dd_score_ns then 1.0 when coalesce(s.score_ew, 0) = -c.dd_score_ns then 0.5 else 0.0 end) end) mp
  from dd_cand c left join scored s on s.session_id = c.session_id and s.board = c.board
  group by c.session_id, c.board, c.declarer, c.strain, c.level)""",
        """select session_id, board,
  cast(max(case when declarer in ('N', 'S') and n > 0 then mp end) as double) mp_dd_max_ns,
  cast(max(case when declarer in ('E', 'W') and n > 0 then mp end) as double) mp_dd_max_ew,
  case when max(n) > 1 then max(case when declarer in ('N', 'S') then mp end) / (max(n) - 1) end dd_pct_max_ns,
  case when max(n) > 1 then max(case when declarer in ('E', 'W') then mp end) / (max(n) - 1) end dd_pct_max_ew
from h group by session_id, board""",
    ),
)
def q_mp_dd_max(spark, sf_dir):
    """Per board and side: the best matchpoints any double-dummy contract of that side would earn
    against the side's real scores, and its share of the board's top."""
    res = scored_results(fixtures.board_results(spark, sf_dir))
    cand = _dd_candidates(spark, sf_dir)
    ns = mp.hypothetical_matchpoints(res, cand.filter(F.col("declarer").isin("N", "S")), ["session_id", "board"],
                                     score="score_ns", value="dd_score_ns")
    ew = mp.hypothetical_matchpoints(res, cand.filter(F.col("declarer").isin("E", "W")).withColumn("v_ew", -F.col("dd_score_ns")),
                                     ["session_id", "board"], score="score_ew", value="v_ew")
    both = ns.withColumn("side", F.lit("NS")).unionByName(ew.drop("v_ew").withColumn("side", F.lit("EW")))
    # the top rides along with the largest matchpoints (all candidates of a side share it), so candidates are compared once
    best = mp.max_by_side(both.withColumn("_mp", F.struct("mp", "mp_top")), ["session_id", "board"], "side", "_mp", "_max")
    top = F.max("_max.mp_top").over(Window.partitionBy("session_id", "board"))  # at most two rows
    best = best.select("session_id", "board", "side", F.col("_max.mp").alias("mp_max"), top.alias("mp_top"))
    best = mp.max_pct(best, "mp_max", "mp_top", "pct_max")
    return best.groupBy("session_id", "board").agg(
        F.max(F.when(F.col("side") == "NS", F.col("mp_max"))).alias("mp_dd_max_ns"),
        F.max(F.when(F.col("side") == "EW", F.col("mp_max"))).alias("mp_dd_max_ew"),
        F.max(F.when(F.col("side") == "NS", F.col("pct_max"))).alias("dd_pct_max_ns"),
        F.max(F.when(F.col("side") == "EW", F.col("pct_max"))).alias("dd_pct_max_ew"),
    )


@register(
    "dd_contracts",
    "C14,C4,C7",
    with_fixtures(["dd_tricks"], DD_NAMED_CTE, """select deal_id, declarer, strain, tricks,
  case when tricks >= 7 then cast(tricks - 6 as int) end level,
  case when tricks >= 7 then cast(tricks - 6 as varchar) || strain end bid,
  case when tricks < 7 then 'Pass' when tricks - 6 = 7 then 'GSlam' when tricks - 6 = 6 then 'SSlam'
       when strain = 'N' and tricks - 6 >= 3 then 'Game' when strain in ('H', 'S') and tricks - 6 >= 4 then 'Game'
       when strain in ('C', 'D') and tricks - 6 >= 5 then 'Game' else 'Partial' end bid_type,
  case when tricks >= 7 then """ + sql_score("(tricks - 6)", "strain", "''", "false", "0") + """ end score_nv,
  case when tricks >= 7 then """ + sql_score("(tricks - 6)", "strain", "''", "true", "0") + """ end score_v
from ddn"""),
)
def q_dd_contracts(spark, sf_dir):
    """The highest contract each seat makes in each strain double dummy, its type and its score both vulnerabilities."""
    d = dd_named(spark, sf_dir)
    lv = F.when(F.col("tricks") >= 7, (F.col("tricks") - 6).cast("int"))
    return d.select(
        "deal_id", "declarer", "strain", "tricks", lv.alias("level"),
        F.when(lv.isNotNull(), F.concat(lv.cast("string"), F.col("strain"))).alias("bid"),
        contracts.contract_type(lv, F.col("strain")).alias("bid_type"),
        F.when(lv.isNotNull(), scoring.score(lv, F.col("strain"), F.lit(""), F.lit(False), F.lit(0))).alias("score_nv"),
        F.when(lv.isNotNull(), scoring.score(lv, F.col("strain"), F.lit(""), F.lit(True), F.lit(0))).alias("score_v"),
    )


@register(
    "dd_vs_sd",
    "J12,A1,A7",
    with_fixtures(["dd_tricks", "sd_samples"], DIST_CTE + ",\n" + DD_NAMED_CTE + """,
m as (select deal_id, pair, declarer, strain, arg_max(tricks, n * 100 - tricks) sd_mode from dist group by all),
own as (select * from m where contains(pair, declarer))""", """select coalesce(a.deal_id, b.deal_id) deal_id, coalesce(a.declarer, b.declarer) declarer,
  coalesce(a.strain, b.strain) strain, a.tricks a_tricks, b.sd_mode b_tricks
from ddn a full outer join own b on a.deal_id = b.deal_id and a.declarer = b.declarer and a.strain = b.strain
where a.tricks is distinct from b.sd_mode"""),
)
def q_dd_vs_sd(spark, sf_dir):
    """Seats and strains where the double-dummy tricks differ from the most frequent single-dummy
    sample count of the declarer's own side (lowest count on ties)."""
    dist = SD.named_distribution(SD.trick_distribution(fixtures.sd_samples(spark, sf_dir)))
    mode = dist.filter(F.col("pair").contains(F.col("declarer"))).groupBy("deal_id", "declarer", "strain").agg(
        F.max_by("tricks", F.col("n") * 100 - F.col("tricks")).alias("tricks"))
    dd = dd_named(spark, sf_dir).select("deal_id", "declarer", "strain", "tricks")
    out = SD.compare_tables(dd, mode, ["deal_id", "declarer", "strain"], ["tricks"])
    return out.select("deal_id", "declarer", "strain", F.col("a_tricks"), F.col("b_tricks"))
