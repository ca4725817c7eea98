"""Registered single-dummy / double-dummy queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import contracts
from ..operators import hands as H
from ..operators import singledummy as SD
from ..sources import fixtures
from .boards import with_board_facts
from .oracle import sql_score, with_fixtures
from .registry import register

DIST_CTE = """sd0 as (select deal_id, fixed_pair, seat, strain, tricks, count(*) n from sd_samples group by all),
sdt as (select deal_id, fixed_pair, seat, strain, count(*) trials from sd_samples group by all),
dist as (
  select g.deal_id, case g.fixed_pair when 0 then 'NS' else 'EW' end pair, substr('NESW', g.seat + 1, 1) declarer,
    substr('CDHSN', g.strain + 1, 1) strain, cast(x.tricks as int) tricks, cast(coalesce(sd0.n, 0) as bigint) n,
    cast(g.trials as bigint) trials, coalesce(sd0.n, 0) / g.trials prob
  from sdt g cross join range(0, 14) x(tricks)
  left join sd0 on sd0.deal_id = g.deal_id and sd0.fixed_pair = g.fixed_pair and sd0.seat = g.seat
    and sd0.strain = g.strain and sd0.tricks = x.tricks)"""

EV_TABLE_CTE = """evt0 as (select substr('CDHSN', cast(s + 1 as int), 1) strain, cast(t as int) tricks, cast(l as int) level, v = 1 vul
  from range(0, 5) a(s), range(0, 14) b(t), range(1, 8) c(l), range(0, 2) d(v)),
evt as (select strain, tricks, level, vul, """ + sql_score(
    "level", "strain", "(case when tricks - 6 - level < 0 then 'X' else '' end)", "vul", "(tricks - 6 - level)") + """ score from evt0)"""

EV_CTE = DIST_CTE + ",\n" + EV_TABLE_CTE + """,
ev as (select deal_id, pair, declarer, strain, level, case when vul then 'V' else 'NV' end vul,
    sum(n * score) / max(trials) ev
  from dist join evt using (strain, tricks) where n > 0 and contains(pair, declarer) group by all)"""

BEST_CTE = EV_CTE + """,
e as (select *, concat_ws('_', 'EV', pair, declarer, strain, cast(level as varchar), vul) name,
    (case when pair = 'NS' then 0 else 1 end) * 1000 + (case when declarer in ('N', 'E') then 0 else 1 end) * 100
    + (strpos('SHDCN', strain) - 1) * 10 + level ord from ev),
best as (select deal_id, vul,
    case grouping(pair, declarer, strain) when 7 then 'all' when 3 then 'pair' when 1 then 'declarer' else 'strain' end grouping,
    pair, declarer, strain, max(ev) ev_max, first(name order by ev desc, ord asc) ev_max_col
  from e group by grouping sets ((deal_id, vul), (deal_id, vul, pair), (deal_id, vul, pair, declarer), (deal_id, vul, pair, declarer, strain)))"""


def dist_df(spark, sf_dir):
    return SD.named_distribution(SD.trick_distribution(fixtures.sd_samples(spark, sf_dir)))


def evs_df(spark, sf_dir):
    # counted by letters, so that what is grouped by them later is not shuffled again
    counts = SD.trick_counts(SD.name_codes(fixtures.sd_samples(spark, sf_dir)), ("deal_id", "pair", "declarer", "strain"))
    return SD.expected_values(counts, keep_numerator=True)


def ev_df(spark, sf_dir):
    counts = SD.name_codes(SD.trick_counts(fixtures.sd_samples(spark, sf_dir)))
    return SD.expected_values(counts)


@register("sd_distribution", "A1", with_fixtures(["sd_samples"], DIST_CTE, "select * from dist"))
def q_sd_distribution(spark, sf_dir):
    """Trick-count distribution of every (deal, fixed pair, declarer, strain) from the samples."""
    return dist_df(spark, sf_dir)


@register("ev_contracts", "A4,J8,C7", with_fixtures(["sd_samples"], EV_CTE, "select * from ev"))
def q_ev_contracts(spark, sf_dir):
    """Expected value of every own-side contract (declarer, strain, level, vulnerability)."""
    return ev_df(spark, sf_dir)


@register("best_contract", "A5", with_fixtures(["sd_samples"], BEST_CTE, "select * from best"))
def q_best_contract(spark, sf_dir):
    """Best expected value and its contract at four grouping levels, per vulnerability."""
    return SD.best_contracts(evs_df(spark, sf_dir))


@register(
    "ev_by_vul",
    "A6,P3,P4",
    with_fixtures(
        ["sd_samples", "boards"],
        BEST_CTE + """,
bv as (select session_id, board, deal_id,
    ((board-1)//4 + (board-1)%4) % 4 in (1, 3) vul_ns, ((board-1)//4 + (board-1)%4) % 4 in (2, 3) vul_ew from boards),
pv as (select b.session_id, b.board, b.deal_id, p.pair, p.ev_max, p.ev_max_col
  from best p join bv b using (deal_id)
  where p.grouping = 'pair' and p.vul = case when (case when p.pair = 'NS' then b.vul_ns else b.vul_ew end) then 'V' else 'NV' end),
w as (select deal_id, session_id, board,
    max(ev_max) filter (where pair = 'NS') ev_max_ns, max(ev_max_col) filter (where pair = 'NS') ev_max_col_ns,
    max(ev_max) filter (where pair = 'EW') ev_max_ew, max(ev_max_col) filter (where pair = 'EW') ev_max_col_ew
  from pv group by all)""",
        """select *, greatest(ev_max_ns, ev_max_ew) ev_max,
  case when ev_max_ns >= ev_max_ew then 'EV_Max_NS' else 'EV_Max_EW' end ev_max_col from w""",
    ),
)
def q_ev_by_vul(spark, sf_dir):
    """Each pair's best expected value under the board's real vulnerability, and the overall best."""
    best = SD.best_contracts(evs_df(spark, sf_dir))
    b = with_board_facts(fixtures.boards(spark, sf_dir)).select("deal_id", "session_id", "board", "vul_ns", "vul_ew")
    return SD.pick_by_vul(best, b).select(
        "deal_id", "session_id", "board", "ev_max_ns", "ev_max_col_ns", "ev_max_ew", "ev_max_col_ew", "ev_max", "ev_max_col")


def dd_named(spark, sf_dir):
    dd = fixtures.dd_tricks(spark, sf_dir)
    return dd.select(
        "deal_id",
        F.substring(F.lit("NESW"), F.col("seat") + 1, 1).alias("declarer"),
        F.when(F.col("seat") % 2 == 0, F.lit("NS")).otherwise(F.lit("EW")).alias("pair"),
        F.substring(F.lit("CDHSN"), F.col("strain") + 1, 1).alias("strain"),
        "tricks",
    )


DD_NAMED_CTE = """ddn as (select deal_id, substr('NESW', seat + 1, 1) declarer, case when seat % 2 = 0 then 'NS' else 'EW' end pair,
    substr('CDHSN', strain + 1, 1) strain, tricks from dd_tricks)"""


@register(
    "dd_pairs",
    "A7",
    with_fixtures(["dd_tricks"], DD_NAMED_CTE, "select deal_id, pair, strain, cast(max(tricks) as int) dd_tricks from ddn group by all"),
)
def q_dd_pairs(spark, sf_dir):
    """Double-dummy tricks of each pair in each strain (the better of its two seats)."""
    return SD.pair_max(dd_named(spark, sf_dir))


CT_SQL = """case when tricks < 7 then 'Pass' when tricks = 11 and strain in ('C','D') then 'Game'
  when tricks in (10, 11) and strain in ('H','S') then 'Game' when tricks in (9, 10, 11) and strain = 'N' then 'Game'
  when tricks = 12 then 'SSlam' when tricks = 13 then 'GSlam' else 'Partial' end"""


@register(
    "contract_types",
    "C5,C4",
    with_fixtures(
        ["dd_tricks"],
        DD_NAMED_CTE + ",\nct as (select *, " + CT_SQL + " ct from ddn)",
        """select deal_id, declarer, pair, strain, tricks, ct,
  """ + ",\n  ".join(
            f"bool_or(ct = '{t}') over (partition by deal_id, pair, strain) pair_{t.lower()}" for t in ("Pass", "Game", "SSlam", "GSlam", "Partial")
        ) + ",\n  (case when strain in ('C', 'D') then 5 when strain in ('H', 'S') then 4 else 3 end) game_level,"
        + """
  case when tricks >= 7 then (case when tricks - 6 = 7 then 'GSlam' when tricks - 6 = 6 then 'SSlam'
    when strain = 'N' and tricks - 6 >= 3 then 'Game' when strain in ('H', 'S') and tricks - 6 >= 4 then 'Game'
    when strain in ('C', 'D') and tricks - 6 >= 5 then 'Game' else 'Partial' end) else 'Pass' end max_bid_type
from ct""",
    ),
)
def q_contract_types(spark, sf_dir):
    """Contract type reachable by every seat in every strain, pair-level flags, and bid type of the top makeable level."""
    d = dd_named(spark, sf_dir).withColumn("ct", contracts.tricks_type("tricks", "strain"))
    w = Window.partitionBy("deal_id", "pair", "strain")
    flags = {f"pair_{t.lower()}": F.max((F.col("ct") == t).cast("int")).over(w) == 1 for t in ("Pass", "Game", "SSlam", "GSlam", "Partial")}
    top_level = F.when(F.col("tricks") >= 7, F.col("tricks") - 6)
    return d.withColumns(flags).withColumns({
        "game_level": F.when(F.col("strain").isin("C", "D"), F.lit(5)).when(F.col("strain").isin("H", "S"), F.lit(4)).otherwise(F.lit(3)),
        "max_bid_type": contracts.contract_type(top_level, F.col("strain")),
    })


@register(
    "lott",
    "A8,P9,P13,A7",
    with_fixtures(
        ["deals", "dd_tricks"],
        """h0 as (select deal_id, i, string_split(string_split(substr(pbn, 3), ' ')[i + 1], '.') sp from deals, range(0, 4) t(i)),
pl as (select deal_id, case when i % 2 = 0 then 'NS' else 'EW' end pair,
    sum(length(sp[1])) l_s, sum(length(sp[2])) l_h, sum(length(sp[3])) l_d, sum(length(sp[4])) l_c from h0 group by all),
lp as (select deal_id, pair, case greatest(l_s, l_h, l_d, l_c) when l_s then 'S' when l_h then 'H' when l_d then 'D' else 'C' end longest_suit,
    cast(greatest(l_s, l_h, l_d, l_c) as int) longest_len from pl),
""" + DD_NAMED_CTE + """,
dp as (select deal_id, pair, strain, cast(max(tricks) as int) dd_tricks from ddn group by all),
pp as (select lp.deal_id, lp.pair, longest_suit, longest_len, dd_tricks from lp join dp
    on lp.deal_id = dp.deal_id and lp.pair = dp.pair and lp.longest_suit = dp.strain)""",
        """select *, cast(sum(longest_len) over (partition by deal_id) as int) lott_sl, cast(sum(dd_tricks) over (partition by deal_id) as int) lott_dd,
  cast(sum(longest_len) over (partition by deal_id) - sum(dd_tricks) over (partition by deal_id) as int) lott_diff from pp""",
    ),
)
def q_lott(spark, sf_dir):
    """Law of total tricks: each pair's longest suit, its DD tricks there, and the deal's sums and difference."""
    hf = H.hand_features(fixtures.deals(spark, sf_dir)).filter(F.col("direction").isin("N", "E"))
    lengths = hf.select("deal_id", "pair", F.col("pair_longest_suit").alias("longest_suit"), F.col("pair_longest_len").alias("longest_len"))
    return SD.total_tricks(lengths, SD.pair_max(dd_named(spark, sf_dir)))


@register(
    "par_compare",
    "J12",
    with_fixtures(["par_scores"], "",
        """select deal_id, case when deal_id % 13 = 4 then 'a' when deal_id % 11 = 3 then 'b' when deal_id % 7 = 2 then 'score' when deal_id % 9 = 5 then 'contracts' else 'same' end par_compare
from par_scores where not (deal_id % 13 = 4 and deal_id % 11 = 3)"""),
)
def q_par_compare(spark, sf_dir):
    """Par results of two tables that write the same contracts differently, compared."""
    return SD.compare_pars(fixtures.par_lists(spark, sf_dir), fixtures.par_lists(spark, sf_dir, other=True), "deal_id")
