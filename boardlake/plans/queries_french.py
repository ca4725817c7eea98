"""Registered queries of the French feeds (C17, P21, F5, A10, A11): feeds that Spark writes from the results, read back.

The oracles never see a feed: they state the answer from the raw results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codings as CD
from ..functions import contracts
from ..functions import deals as D
from ..functions.vocab import map_literal
from ..operators import matchpoints as mp
from ..session import by_key, not_broadcast, own_shuffle
from ..sources import fixtures
from ..sources import french as FR
from .boards import scored_results, with_board_facts
from .oracle import sql_scored_results, with_fixtures
from .registry import register

LETTERS = {"S": "P", "H": "C", "D": "K", "C": "T", "N": "SA"}
VULS = {"None": "Personne", "N_S": "NS", "E_W": "EO", "Both": "Tous"}


def _results(spark, sf_dir, by_rows=True):
    return scored_results(fixtures.board_results(spark, sf_dir, by_rows))


def section_feed(spark, sf_dir):
    """(tables, deals, roster) of a section feed: section = session; the home pair sits North-South in even sessions."""
    res = _results(spark, sf_dir, by_rows=False)
    passed = F.col("contract") == "PASS"
    gained = lambda c: F.when(passed, F.lit("Passe")).when(F.col(c) > 0, F.col(c).cast("string")).otherwise(F.lit(""))
    even = F.col("session_id") % 2 == 0
    contract = F.when(passed, F.lit("Passe")).otherwise(F.concat(F.col("level").cast("string"), F.element_at(map_literal(LETTERS), F.col("strain")), F.lower("dbl")))
    tables = res.select(
        F.concat(F.lit("S"), "session_id").alias("section"), F.col("board").cast("string").alias("board"), contract.alias("contract"),
        F.when(F.col("declarer") == "W", "O").otherwise(F.col("declarer")).alias("declarant"),
        F.when(passed, F.lit("=")).otherwise(contracts.result_text(F.col("result"))).alias("result"),
        F.when(even, gained("score_ns")).otherwise(gained("score_ew")).alias("score_eo"),
        F.when(even, gained("score_ew")).otherwise(gained("score_ns")).alias("score_ns"),
        (F.col("l_partkey") % 14 + 1).alias("team_ns_id"), (F.col("l_orderkey") % 14 + 1).alias("team_eo_id"), "l_orderkey", "l_linenumber")
    b = with_board_facts(fixtures.boards(spark, sf_dir)).where("board % 16 <> 5").join(not_broadcast(fixtures.deals(spark, sf_dir)), "deal_id")
    french = F.replace(F.translate("pbn", "KQJ", "RDV"), F.lit("T"), F.lit("10"))
    b = b.withColumn("_hands", F.transform(F.split(F.substr(french, F.lit(3)), " "), lambda h: F.split(h, r"\.", -1)))
    cards = [F.get(F.get("_hands", F.lit(i)), F.lit(j)).alias(f"deal_{w}Card{s.title()}") for i, w in enumerate(FR.SEAT_WORDS.values()) for j, s in enumerate(FR.SUIT_WORDS)]
    sides = F.when(even, F.lit("NS")).otherwise(F.lit("EO")), F.when(even, F.lit("EO")).otherwise(F.lit("NS"))
    entry = lambda opp, number: F.struct(sides[0].alias("teams_players_position"), opp.alias("teams_opponents_position"), number.cast("string").alias("tournament_team_section_table_number"))
    number = F.col("session_id") % 13 + 1
    # four rows a board; some boards also have a row of a pair that played nobody
    entries = F.concat(F.array_repeat(entry(sides[1], number), 4), F.when(F.col("board") % 8 == 0, F.array(entry(sides[0], number + 1))).otherwise(F.array()))
    deals = b.select(F.concat(F.lit("S"), "session_id").alias("tournament_team_section_name"), F.col("board").cast("string").alias("deal_dealNumber"),
                     F.when(F.col("dealer") == "W", "O").otherwise(F.col("dealer")).alias("deal_dealer"), F.element_at(map_literal(VULS), F.col("vul")).alias("deal_vulnerability"),
                     *cards, F.inline(entries))
    s = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("s"))
    roster = s.select("s", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("p")).select(
        F.concat(F.lit("S"), "s").alias("team_section_name"), F.col("p").cast("string").alias("team_table_number"),
        F.explode(F.expr("flatten(transform(array('NS', 'EO'), o -> transform(array(1, 2, 2), i -> named_struct('o', o, 'i', i))))")).alias("x"), "s", "p")
    roster = roster.select("team_section_name", "team_table_number", F.col("x.o").alias("team_orientation"), F.col("x.i").alias("team_players_position"),
                           (F.col("s") * 1000 + F.col("p") * 10 + F.col("x.i") + F.when(F.col("x.o") == "EO", 5).otherwise(0)).alias("team_players_id"),
                           F.concat(F.lit("f"), "p").alias("team_players_firstname"), F.concat_ws("", "x.o", "x.i").alias("team_players_lastname"))
    return tables, deals, roster


SECTION_COLS = ["section", "board", "l_orderkey", "l_linenumber", "pbn", "dealer", "vul", "pair_direction", "pair_number", "contract", "result", "score_ns", "score_ew",
                "pair_number_ns", "pair_number_ew", *[f"player_{w}_{d}" for w in ("id", "name") for d in "nsew"], "mp_top", "mp_ns", "mp_ew", "pct_ns", "pct_ew"]


def _mp_sql(side: str) -> str:
    part = "partition by session_id, board"
    return (f"case when score_{side} is not null then rank() over ({part} order by score_{side} nulls last) - 1 "
            f"+ (count(*) over ({part}, score_{side}) - 1) / 2.0 end")


MP_SQL = f"""mp0 as (select *, cast(count(score_ns) over (partition by session_id, board) - 1 as bigint) mp_top,
  cast({_mp_sql('ns')} as double) mp_ns, cast({_mp_sql('ew')} as double) mp_ew from kept)"""


def _player_sql(what: str, seat: str) -> str:
    side, place = ("ns", "ew")[seat in "ew"], 1 if seat in "ne" else 2
    known = f"pair_number_{side} <= 13"
    if what == "id":
        return f"case when {known} then cast(session_id * 1000 + pair_number_{side} * 10 + {place} + {5 if side == 'ew' else 0} as varchar) end player_id_{seat}"
    return f"case when {known} then 'f' || pair_number_{side} || ' {'EO' if side == 'ew' else 'NS'}{place}' end player_name_{seat}"


@register(
    "french_sections",
    "C17,F5,J2,J6,P21,W1,W2",
    with_fixtures(["board_results", "boards", "deals"], sql_scored_results() + """,
kept as (select s.* replace (case when s.contract = 'PASS' then 0 else s.result end as result), d.pbn, cast(l_partkey % 14 + 1 as int) pair_number_ns,
    cast(l_orderkey % 14 + 1 as int) pair_number_ew
  from scored s join boards b using (session_id, board) join deals d using (deal_id) where board % 16 <> 5),
""" + MP_SQL, """select 'S' || session_id section, board, l_orderkey, l_linenumber, pbn, dealer, vul, case when session_id % 2 = 0 then 'NS' else 'EW' end pair_direction,
  cast(session_id % 13 + 1 as int) pair_number, contract, cast(result as int) result, score_ns, score_ew, pair_number_ns, pair_number_ew,
  """ + ",\n  ".join(_player_sql(w, d) for w in ("id", "name") for d in "nsew") + """,
  mp_top, mp_ns, mp_ew, mp_ns / nullif(mp_top, 0) pct_ns, mp_ew / nullif(mp_top, 0) pct_ew from mp0"""),
)
def q_french_sections(spark, sf_dir):
    """Every table of the sections' listings as a canonical result with its deal, players and matchpoints."""
    return FR.canonical_french(*section_feed(spark, sf_dir)).select(*SECTION_COLS)


def with_score_texts(df):
    passed, adjusted = F.col("contract") == "PASS", F.col("score_ns").isNull()
    text = lambda side, given: F.when(adjusted, F.lit(given)).when(passed, F.lit("PASS")).when(F.col(f"score_{side}") > 0, F.col(f"score_{side}").cast("string")).otherwise(F.lit(""))
    return df.withColumns({"nsScore": text("ns", "60%"), "ewScore": text("ew", "40%")})


def with_notes(df):
    note = lambda side, given: F.when(F.col("score_ns").isNull(), F.lit(given)).otherwise(F.expr(f"cast(mp_{side} * 2 as bigint) * 100 div nullif(2 * mp_top, 0)")).cast("double")
    return df.withColumns({"nsNote": note("ns", 60), "ewNote": note("ew", 40)})


def lineup_results(spark, sf_dir):
    """Results with the score texts and notes that a lineup feed writes."""
    return with_notes(with_score_texts(mp.matchpoints(_results(spark, sf_dir))))


def board_frequencies(rows):
    """(session_id, board, board_frequencies) of the score texts, sorted."""
    f = rows.groupBy("session_id", "board", "nsScore", "nsNote", "ewScore", "ewNote").agg(F.count(F.lit(1)).alias("count"))
    return f.groupBy("session_id", "board").agg(F.sort_array(F.collect_list(F.struct("nsScore", "nsNote", "ewScore", "ewNote", "count"))).alias("board_frequencies"))


def listed_frequencies(res):
    """``board_frequencies`` of results, from their distinct scores: (session_id, board, board_frequencies)."""
    k = ["session_id", "board"]
    kinds = res.withColumn("contract", F.when(F.col("contract") == "PASS", F.col("contract")))  # what the texts depend on
    kinds = by_key(kinds.groupBy(*k, "contract", "score_ns", "score_ew").agg(F.count(F.lit(1)).alias("_n")), *k)
    rows = with_notes(with_score_texts(mp.frequency_matchpoints(kinds, k)))
    one = F.struct("nsScore", "nsNote", "ewScore", "ewNote", F.col("_n").alias("count"))
    return rows.groupBy(*k).agg(F.sort_array(F.collect_list(one)).alias("board_frequencies"))


def lineup_feed(spark, sf_dir):
    """Rows of a lineup feed: a board's frequencies, its deal as given from East on odd boards, and the players at the table.

    A row's notes are those of its texts in its board's frequencies, so the results meet their board's row once and are shuffled once.
    """
    k = ["session_id", "board"]
    b = fixtures.boards(spark, sf_dir).join(not_broadcast(fixtures.deals(spark, sf_dir)), "deal_id")
    b = own_shuffle(listed_frequencies(_results(spark, sf_dir, by_rows=False)).join(not_broadcast(b), k), *k)
    rows = with_score_texts(scored_results(fixtures.board_results(spark, sf_dir, by_rows=False).join(not_broadcast(b), k)))
    mine = F.filter("board_frequencies", lambda x: (x["nsScore"] == F.col("nsScore")) & (x["ewScore"] == F.col("ewScore")))
    rows = rows.withColumn("_mine", F.get(mine, F.lit(0))).withColumns({c: F.col(f"_mine.{c}") for c in ("nsNote", "ewNote")})
    home = F.when(F.col("l_linenumber") == 7, "").when(F.col("l_linenumber") % 2 == 1, "NS").otherwise("EW")
    away = F.when(home == "EW", "NS").otherwise("EW")
    lineup = {"home": (home, "l_partkey"), "away": (away, "l_orderkey")}
    bid = F.concat(F.col("level").cast("string"), F.when(F.col("strain") == "N", "NT").otherwise(F.col("strain")), "dbl")
    return rows.select(
        F.col("session_id").alias("group_id"), F.col("deal_id").alias("board_id"), F.col("board").alias("boardNumber"), "board_frequencies",
        F.when(F.col("board") % 2 == 1, CD.rotate_deal(F.col("pbn"), "E")).otherwise(F.col("pbn")).alias("board_deal"),
        F.when(F.col("contract") == "PASS", "PASS").otherwise(bid).alias("contract"), "declarer", contracts.result_text(F.col("result")).alias("result"),
        "nsScore", "ewScore", "nsNote", "ewNote",
        *[c for d, w in FR.SEAT_WORDS.items() for c in (F.concat(F.lit(f"{d}first"), "l_linenumber").alias(f"lineup_{w}Player_firstName"), F.lit(f"{d}last").alias(f"lineup_{w}Player_lastName"),
          F.col(f"player_{d.lower()}").alias(f"lineup_{w}Player_ffbId"))],
        *[c for t, (o, n) in lineup.items() for c in (F.concat(F.lit("S"), "session_id").alias(f"lineup_segment_game_{t}Team_section"), o.alias(f"lineup_segment_game_{t}Team_orientation"),
          (F.col(n) % 14 + 1).cast("string").alias(f"lineup_segment_game_{t}Team_startTableNumber"))])


LINEUP_SQL = """kept as (select * from scored), """ + MP_SQL + """,
lr as (select *, case when score_ns is null then 60 else cast(mp_ns * 2 as bigint) * 100 // nullif(2 * mp_top, 0) end ns_note,
    case when score_ns is null then 40 else cast(mp_ew * 2 as bigint) * 100 // nullif(2 * mp_top, 0) end ew_note,
    count(*) over (partition by session_id, board) - 1 n_top from mp0)"""


@register(
    "french_lineup",
    "C17,P2,P3,P19,J2",
    with_fixtures(["board_results", "boards", "deals"], sql_scored_results() + ",\n" + LINEUP_SQL, """select session_id group_id, deal_id board_id, board, dealer, vul, pbn, contract, result, score_ns, score_ew,
  ns_note / 100.0::double pct_ns, ew_note / 100.0::double pct_ew, """ + ", ".join(f"'{d}first' || l_linenumber || ' {d}last' player_name_{d.lower()}, player_{d.lower()} player_id_{d.lower()}" for d in "NESW") + """,
  'S' || session_id section, false sections_differ,
  case when l_linenumber = 7 then null when l_linenumber % 2 = 1 then cast(l_partkey % 14 + 1 as int) else cast(l_orderkey % 14 + 1 as int) end pair_number_ns,
  case when l_linenumber = 7 or l_linenumber % 2 = 1 then cast(l_orderkey % 14 + 1 as int) else cast(l_partkey % 14 + 1 as int) end pair_number_ew,
  cast(n_top as bigint) mp_top, cast(cast(ns_note as decimal(9,2)) / 100 * n_top as decimal(18,2))::double mp_ns, cast(cast(ew_note as decimal(9,2)) / 100 * n_top as decimal(18,2))::double mp_ew
from lr join boards using (session_id, board) join deals using (deal_id)"""),
)
def q_french_lineup(spark, sf_dir):
    """Every row of the sessions' lineup feed as a canonical result."""
    out = FR.canonical_french_lineup(lineup_feed(spark, sf_dir))
    return out.drop(*[c for c in out.columns if "_list" in c])


@register(
    "french_frequencies",
    "A10,A11",
    with_fixtures(["board_results"], sql_scored_results() + ",\n" + LINEUP_SQL + """,
tx as (select *, case when score_ns is null then '60%' when contract = 'PASS' then 'PASS' when score_ns > 0 then cast(score_ns as varchar) else '' end ns_text,
    case when score_ns is null then '40%' when contract = 'PASS' then 'PASS' when score_ew > 0 then cast(score_ew as varchar) else '' end ew_text from lr),
fr as (select session_id, board, ns_text, ns_note, ew_text, ew_note, score_ns, count(*) n from tx group by all)""",
        """select session_id, board, cast(sum(n) - 1 as bigint) mp_top, string_agg(ns_text, ',' order by ns_text, ns_note nulls first, ew_text) scores_list_ns,
  string_agg(ew_text, ',' order by ns_text, ns_note nulls first, ew_text) scores_list_ew,
  string_agg(coalesce(cast(ns_note as varchar), '-'), ',' order by ns_text, ns_note nulls first, ew_text) pcts_list_ns,
  string_agg(coalesce(cast(ew_note as varchar), '-'), ',' order by ns_text, ns_note nulls first, ew_text) pcts_list_ew,
  string_agg(cast(n as varchar), ',' order by ns_text, ns_note nulls first, ew_text) score_freq_list,
  string_agg(rtrim(repeat(coalesce(cast(score_ns as varchar), 'adjusted') || ',', cast(n as int)), ','), ',' order by ns_text, ns_note nulls first, ew_text) expanded
from fr group by session_id, board"""),
)
def q_french_frequencies(spark, sf_dir):
    """Every board's frequency list as parallel lists, and the scores of all its tables in their order."""
    df = board_frequencies(lineup_results(spark, sf_dir))
    df = df.withColumns({**FR.frequency_lists(), "expanded": FR.expanded_scores()})
    joined = lambda c, kind: F.array_join(F.transform(c, lambda x: x.cast(kind).cast("string")), ",", "adjusted" if c == "expanded" else "-").alias(c)
    return df.select("session_id", "board", "mp_top", joined("scores_list_ns", "string"), joined("scores_list_ew", "string"), joined("pcts_list_ns", "int"),
                     joined("pcts_list_ew", "int"), joined("score_freq_list", "int"), joined("expanded", "int"))
