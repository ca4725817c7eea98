"""Registered result-level queries: ratings, declarer columns, score lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contracts, scoring
from ..operators import ratings as R
from ..session import not_broadcast
from ..sources import fixtures
from .boards import scored_results
from .oracle import sql_score, sql_scored_results, with_fixtures
from .pipeline import with_players
from .queries_sd import DD_NAMED_CTE, dd_named
from .registry import register


def attach_deals(results, boards, k=("session_id", "board")):
    """Results joined to their board's deal on (session, board)."""
    return results.join(not_broadcast(boards), on=list(k), how="inner")


def declarer_df(spark, sf_dir, par=None):
    """Results with seats, ids and double-dummy columns (and ``par_ns`` of the table ``par``); everything of a deal is gathered on its board's
    row, so that results are shuffled once, and what a result's own row gives is evaluated after."""
    boards = fixtures.boards(spark, sf_dir)
    if par is not None:
        boards = boards.join(not_broadcast(par.select("deal_id", "par_ns")), "deal_id", "left")
    res = attach_deals(with_players(fixtures.board_results(spark, sf_dir, by_rows=False)), R.with_trick_lists(boards, dd_named(spark, sf_dir)))
    return contracts.with_trick_flags(R.with_declarer_columns(scored_results(res)), "result", "tricks")


SEATS_SQL = """seats as (select s.*, b.deal_id,
    case declarer when 'N' then 'E' when 'E' then 'S' when 'S' then 'W' when 'W' then 'N' end seat_on_lead,
    case declarer when 'N' then 'S' when 'E' then 'W' when 'S' then 'N' when 'W' then 'E' end seat_dummy,
    case declarer when 'N' then 'W' when 'E' then 'N' when 'S' then 'E' when 'W' then 'S' end seat_not_on_lead
  from scored s join boards b using (session_id, board)),
ids as (select *,
    case declarer when 'N' then player_n when 'E' then player_e when 'S' then player_s when 'W' then player_w end declarer_id,
    case seat_on_lead when 'N' then player_n when 'E' then player_e when 'S' then player_s when 'W' then player_w end on_lead_id,
    case seat_dummy when 'N' then player_n when 'E' then player_e when 'S' then player_s when 'W' then player_w end dummy_id,
    case seat_not_on_lead when 'N' then player_n when 'E' then player_e when 'S' then player_s when 'W' then player_w end not_on_lead_id
  from seats),
""" + DD_NAMED_CTE + """,
dj as (select i.*, d.tricks dd_tricks from ids i left join ddn d on i.deal_id = d.deal_id and i.declarer = d.declarer and i.strain = d.strain),
dk as (select *, """ + sql_score("level", "strain", "(case when dd_tricks - 6 - level < 0 then 'X' else '' end)", "vul_declarer", "(dd_tricks - 6 - level)") + """ dd_score_declarer from dj),
decl as (select *, cast(tricks - dd_tricks as int) tricks_dd_diff, cast(score_declarer - dd_score_declarer as int) score_dd_diff,
    score_declarer <= dd_score_declarer defender_ge_dd, result > 0 over_tricks, result = 0 just_made, result < 0 under_tricks from dk)"""

DECL_SQL = with_fixtures(["board_results", "boards", "dd_tricks"], sql_scored_results() + ",\n" + SEATS_SQL, "{body}")


@register(
    "declarer_columns",
    "C2,C3,C11,C12,C13,J2,P25",
    DECL_SQL.replace("{body}", """select session_id, board, l_orderkey, l_linenumber, contract, declarer, seat_on_lead, seat_dummy,
  seat_not_on_lead, declarer_id, on_lead_id, dummy_id, not_on_lead_id, dd_tricks, dd_score_declarer, tricks_dd_diff,
  score_dd_diff, defender_ge_dd, over_tricks, just_made, under_tricks from decl"""),
)
def q_declarer_columns(spark, sf_dir):
    """Seats and player ids around the declarer, DD tricks and score of the contract, and the differences."""
    return declarer_df(spark, sf_dir).select(
        "session_id", "board", "l_orderkey", "l_linenumber", "contract", "declarer", "seat_on_lead", "seat_dummy",
        "seat_not_on_lead", "declarer_id", "on_lead_id", "dummy_id", "not_on_lead_id", "dd_tricks", "dd_score_declarer",
        "tricks_dd_diff", "score_dd_diff", "defender_ge_dd", "over_tricks", "just_made", "under_tricks")


@register(
    "ratings",
    "W8,C3,C11,C13",
    with_fixtures(["board_results", "boards", "dd_tricks", "par_scores"], sql_scored_results() + ",\n" + SEATS_SQL + """,
par as (select d.*, case when declarer_pair = 'NS' then par_ns when declarer_pair = 'EW' then -par_ns end par_declarer,
    score_ns - par_ns score_par_diff_ns from decl d left join par_scores using (deal_id)),
rated as (select *, score_declarer <= par_declarer defender_ge_par from par)""", """
select session_id, board, l_orderkey, l_linenumber, declarer_id, on_lead_id, not_on_lead_id, tricks_dd_diff, score_par_diff_ns, defender_ge_par,
  case when declarer_id is not null then avg(tricks_dd_diff) over (partition by declarer_id) end declarer_rating,
  case when on_lead_id is not null then avg(cast(defender_ge_par as double)) over (partition by on_lead_id) end on_lead_rating,
  case when not_on_lead_id is not null then avg(cast(defender_ge_par as double)) over (partition by not_on_lead_id) end not_on_lead_rating
from rated"""),
)
def q_ratings(spark, sf_dir):
    """Declarer rating (mean tricks over double dummy) and defender ratings (mean of holding the
    declarer to par or less) per player, on every result row."""
    d = R.with_par_columns(declarer_df(spark, sf_dir, fixtures.par_scores(spark, sf_dir))).select(
        "session_id", "board", "l_orderkey", "l_linenumber", "declarer_id", "on_lead_id", "not_on_lead_id",
        "tricks_dd_diff", "score_par_diff_ns", "defender_ge_par")
    return R.ratings_many(d, [("tricks_dd_diff", "declarer_id", "declarer_rating"),
                              ("defender_ge_par", "on_lead_id", "on_lead_rating"),
                              ("defender_ge_par", "not_on_lead_id", "not_on_lead_rating")])


def lookup_score(df, table):
    """Score from the fixed 2,940-row score table (broadcast; its size is fixed by the rules), 0 if absent."""
    t = F.broadcast(table.select("level", "strain", "tricks", F.col("vul").alias("vul_declarer"), "dbl",
                                 F.col("score").alias("score_lookup")))
    return df.join(t, on=["level", "strain", "tricks", "vul_declarer", "dbl"], how="left").withColumn(
        "score_lookup", F.coalesce(F.col("score_lookup"), F.lit(0)))


@register(
    "score_check",
    "J7,C7,C10,C8",
    with_fixtures(
        ["board_results"],
        sql_scored_results(),
        """select session_id, board, l_orderkey, l_linenumber, contract, tricks,
  coalesce(""" + sql_score("level", "strain", "dbl", "vul_declarer", "(tricks - 6 - level)") + """, 0) score_lookup,
  coalesce(score_declarer, 0) score_rule,
  coalesce(""" + sql_score("level", "strain", "dbl", "vul_declarer", "(tricks - 6 - level)") + """, 0) = coalesce(score_declarer, 0) same,
  case when level is not null then array_to_string(list_transform(range(0, 14), lambda t: """
        + sql_score("level", "strain", "dbl", "vul_declarer", "(cast(t as int) - 6 - level)") + """), ',') end score_array
from scored""",
    ),
)
def q_score_check(spark, sf_dir):
    """Score of every result by table lookup and by rule, whether they agree, and the contract's 14-trick score array."""
    res = scored_results(fixtures.board_results(spark, sf_dir))
    j = lookup_score(res, scoring.score_table(spark))
    arr = scoring.score_array("level", "strain", "dbl", "vul_declarer")
    return j.select(
        "session_id", "board", "l_orderkey", "l_linenumber", "contract", "tricks", "score_lookup",
        F.coalesce(F.col("score_declarer"), F.lit(0)).alias("score_rule"),
        (F.col("score_lookup") == F.coalesce(F.col("score_declarer"), F.lit(0))).alias("same"),
        F.when(F.col("level").isNotNull(), F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")).alias("score_array"),
    )
