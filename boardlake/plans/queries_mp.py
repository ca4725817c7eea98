"""Registered matchpoint queries (flagship and the W/A/J matchpoint family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contracts, scoring
from ..operators import matchpoints as mp
from ..session import not_broadcast, read_table
from ..sources import fixtures
from .boards import scored_results
from .oracle import sql_scored_results, with_fixtures
from .registry import register

MP_BOARD_COLS = [
    "session_id", "board", "l_orderkey", "l_linenumber", "contract", "tricks", "dealer", "vul", "declarer",
    "level", "strain", "dbl", "result", "score_ns", "score_ew", "mp_top", "mp_ns", "mp_ew", "pct_ns", "pct_ew",
]


def mp_board_df(spark, sf_dir):
    res = scored_results(fixtures.board_results(spark, sf_dir))
    return mp.matchpoints(res, ["session_id", "board"]).select(*MP_BOARD_COLS)


MP_BOARD_SQL = with_fixtures(
    ["board_results"],
    sql_scored_results()
    + """,
m as (
  select *,
    count(score_ns) over (partition by session_id, board) - 1 as mp_top,
    case when score_ns is not null then (rank() over (partition by session_id, board order by score_ns asc nulls last) - 1)
         + (count(*) over (partition by session_id, board, score_ns) - 1) / 2.0 end as mp_ns,
    case when score_ew is not null then (rank() over (partition by session_id, board order by score_ew asc nulls last) - 1)
         + (count(*) over (partition by session_id, board, score_ew) - 1) / 2.0 end as mp_ew
  from scored)""",
    """select session_id, board, l_orderkey, l_linenumber, contract, tricks, dealer, vul, declarer, level, strain, dbl, result,
  score_ns, score_ew, cast(mp_top as bigint) mp_top, cast(mp_ns as double) mp_ns, cast(mp_ew as double) mp_ew,
  mp_ns / nullif(mp_top, 0) pct_ns, mp_ew / nullif(mp_top, 0) pct_ew
from m""",
)


@register("mp_board", "C1,C2,C6,C7,C9,P2,P3,P4,W1,W2,W3", MP_BOARD_SQL)
def q_mp_board(spark, sf_dir):
    """Matchpoints and percentages of every table result (flagship)."""
    return mp_board_df(spark, sf_dir)


@register(
    "mp_by_value",
    "W1,W2,W3 (generic key/value)",
    """select o_orderkey, o_custkey, o_totalprice,
  cast(count(o_totalprice) over (partition by o_custkey) - 1 as bigint) mp_top,
  cast(case when o_totalprice is not null then (rank() over (partition by o_custkey order by o_totalprice asc nulls last) - 1)
     + (count(*) over (partition by o_custkey, o_totalprice) - 1) / 2.0 end as double) mp,
  (case when o_totalprice is not null then (rank() over (partition by o_custkey order by o_totalprice asc nulls last) - 1)
     + (count(*) over (partition by o_custkey, o_totalprice) - 1) / 2.0 end) / nullif(count(o_totalprice) over (partition by o_custkey) - 1, 0) pct
from orders""",
)
def q_mp_by_value(spark, sf_dir):
    """Matchpoint ranking of order prices within each customer (operators on any key/value)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return mp.matchpoints_by_value(o, ["o_custkey"], "o_totalprice").select(
        "o_orderkey", "o_custkey", "o_totalprice", "mp_top", "mp", "pct")


def _freq_df(spark, sf_dir):
    res = scored_results(fixtures.board_results(spark, sf_dir))
    return mp.score_frequency(res.filter(F.col("score_ns").isNotNull()), ["session_id", "board"], "score_ns", "n")


FREQ_CTE = sql_scored_results() + """,
freq as (select session_id, board, score_ns, count(*) n from scored where score_ns is not null group by all)"""
FREQ_MP_BODY = """select session_id, board, score_ns, n,
  cast(coalesce(sum(n) over (partition by session_id, board order by score_ns rows between unbounded preceding and 1 preceding), 0) as bigint) beaten,
  coalesce(sum(n) over (partition by session_id, board order by score_ns rows between unbounded preceding and 1 preceding), 0) + (n - 1) / 2.0 mp_ns,
  coalesce(sum(n) over (partition by session_id, board order by score_ns rows between 1 following and unbounded following), 0) + (n - 1) / 2.0 mp_ew,
  case when sum(n) over (partition by session_id, board) = 1 then (n - 1) / 2.0
       else (coalesce(sum(n) over (partition by session_id, board order by score_ns rows between unbounded preceding and 1 preceding), 0) + (n - 1) / 2.0)
            / (sum(n) over (partition by session_id, board) - 1) end pct_ns,
  case when sum(n) over (partition by session_id, board) = 1 then (n - 1) / 2.0
       else (coalesce(sum(n) over (partition by session_id, board order by score_ns rows between 1 following and unbounded following), 0) + (n - 1) / 2.0)
            / (sum(n) over (partition by session_id, board) - 1) end pct_ew
from freq"""


@register(
    "mp_frequency",
    "A9,A14",
    with_fixtures(["board_results"], FREQ_CTE, FREQ_MP_BODY),

)
def q_mp_frequency(spark, sf_dir):
    """Score frequency table of every board with matchpoints from frequencies."""
    f = _freq_df(spark, sf_dir)
    out = mp.matchpoints_from_frequency(f, ["session_id", "board"], "score_ns", "n")
    return out.select("session_id", "board", "score_ns", "n", "beaten", "mp_ns", "mp_ew", "pct_ns", "pct_ew")


def _dd_candidates(spark, sf_dir):
    """Double-dummy score of every (board, declarer, strain, level), sets penalty doubled, NS sign."""
    b = fixtures.boards(spark, sf_dir)
    dd = fixtures.dd_tricks(spark, sf_dir)
    from .boards import with_board_facts

    bf = with_board_facts(b)
    c = dd.join(not_broadcast(bf), "deal_id").withColumns({
        "declarer": F.substring(F.lit("NESW"), F.col("seat") + 1, 1),
        "strain_c": F.substring(F.lit("CDHSN"), F.col("strain") + 1, 1),
    })
    c = c.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(7))))
    side_ns = F.col("seat") % 2 == 0
    vul = F.when(side_ns, F.col("vul_ns")).otherwise(F.col("vul_ew"))
    s = scoring.score_sets_doubled(F.col("level"), F.col("strain_c"), vul, F.col("tricks"))
    return c.select(
        "session_id", "board", "declarer", F.col("strain_c").alias("strain"), F.col("level").cast("int").alias("level"),
        F.col("tricks").alias("dd_tricks"),
        F.when(side_ns, s).otherwise(-s).cast("int").alias("dd_score_ns"),
    )


DD_CAND_CTE = """dd_cand0 as (
  select b.session_id, b.board, substr('NESW', d.seat + 1, 1) declarer, substr('CDHSN', d.strain + 1, 1) strain,
    cast(l.level as int) level, d.tricks dd_tricks, d.seat,
    case ((b.board-1)//4 + (b.board-1)%4) % 4 when 0 then 'None' when 1 then 'N_S' when 2 then 'E_W' else 'Both' end vul
  from dd_tricks d join boards b using (deal_id), range(1,8) l(level)),
dd_cand1 as (select *, case when seat % 2 = 0 then vul in ('N_S','Both') else vul in ('E_W','Both') end vd,
    cast(dd_tricks - 6 - level as int) res from dd_cand0),
dd_cand as (select session_id, board, declarer, strain, level, dd_tricks,
    cast(case when seat % 2 = 0 then 1 else -1 end * """ + "{score}" + """ as int) dd_score_ns from dd_cand1)"""


def dd_cand_cte() -> str:
    from .oracle import sql_score

    return DD_CAND_CTE.replace("{score}", sql_score("level", "strain", "(case when res < 0 then 'X' else '' end)", "vd", "res"))


@register(
    "mp_hypothetical",
    "W4,W5,C7",
    with_fixtures(
        ["board_results", "dd_tricks", "boards"],
        sql_scored_results() + ",\n" + dd_cand_cte(),
        """select c.session_id, c.board, c.declarer, c.strain, c.level, c.dd_tricks, c.dd_score_ns,
  cast(case when count(s.score_ns) > 0 then 1.0 end * sum(case when coalesce(s.score_ns, 0) < c.dd_score_ns then 1.0 when coalesce(s.score_ns, 0) = c.dd_score_ns then 0.5 else 0.0 end) as double) mp,
  case when count(s.score_ns) > 0 then cast(count(s.score_ns) - 1 as bigint) end mp_top,
  case when count(s.score_ns) > 0 then sum(case when coalesce(s.score_ns, 0) < c.dd_score_ns then 1.0 when coalesce(s.score_ns, 0) = c.dd_score_ns then 0.5 else 0.0 end) / count(s.score_ns) end pct
from dd_cand c left join scored s on s.session_id = c.session_id and s.board = c.board
group by c.session_id, c.board, c.declarer, c.strain, c.level, c.dd_tricks, c.dd_score_ns""",
    ),
)
def q_mp_hypothetical(spark, sf_dir):
    """Matchpoints of every double-dummy contract score against the board's real NS scores."""
    res = scored_results(fixtures.board_results(spark, sf_dir))
    cand = _dd_candidates(spark, sf_dir)
    out = mp.hypothetical_matchpoints(res, cand, ["session_id", "board"], score="score_ns", value="dd_score_ns")
    out = mp.reference_pct(out, "mp", "mp_top", "pct")
    return out.select("session_id", "board", "declarer", "strain", "level", "dd_tricks", "dd_score_ns", "mp", "mp_top", "pct")


@register(
    "mp_missing",
    "J9,J10,A9",
    with_fixtures(
        ["board_results", "dd_tricks", "boards"],
        FREQ_CTE + ",\n" + dd_cand_cte() + """,
fm as (select session_id, board, score_ns, n,
    coalesce(sum(n) over (partition by session_id, board order by score_ns rows between unbounded preceding and 1 preceding), 0) beaten,
    sum(n) over (partition by session_id, board) tot from freq),
fp as (select *, case when tot = 1 then (n - 1) / 2.0 else (beaten + (n - 1) / 2.0) / (tot - 1) end pct from fm),
tots as (select distinct session_id, board, tot from fm),
c as (select d.session_id, d.board, d.declarer, d.strain, d.level, d.dd_score_ns, t.tot,
    (select f.pct from fp f where f.session_id = d.session_id and f.board = d.board and f.score_ns = d.dd_score_ns) exact_pct,
    (select min(f.score_ns) from fp f where f.session_id = d.session_id and f.board = d.board and f.score_ns > d.dd_score_ns) next_score
  from dd_cand d left join tots t on t.session_id = d.session_id and t.board = d.board)""",
        """select c.session_id, c.board, c.declarer, c.strain, c.level, c.dd_score_ns,
  case when c.tot is null then null when c.exact_pct is not null then c.exact_pct when c.next_score is null then 1.0
       else (select f.beaten from fp f where f.session_id = c.session_id and f.board = c.board and f.score_ns = c.next_score) / c.tot end asof_pct
from c""",
    ),
)
def q_mp_missing(spark, sf_dir):
    """Matchpoint share each double-dummy contract score would get on its board (as-of lookup in the score frequencies)."""
    freq = _freq_df(spark, sf_dir)
    cand = _dd_candidates(spark, sf_dir).select("session_id", "board", "declarer", "strain", "level", "dd_score_ns")
    return mp.matchpoints_asof(cand, freq, ["session_id", "board"], score="score_ns", count="n", new_score="dd_score_ns")
