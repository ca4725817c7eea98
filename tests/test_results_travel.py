"""How often result rows travel: everything that belongs to a board, a page or a played contract meets them in one join each."""

import random
import re

import pytest
from pyspark.sql import functions as F

from boardlake.operators import matchpoints as mp
from boardlake.operators import ratings as R
from boardlake.operators import singledummy as SD
from boardlake.plans import queries_french as QF
from boardlake.plans.feed import best_pairs, page_facts
from boardlake.plans.queries import all_queries
from boardlake.session import own_shuffle
from boardlake.sources import french as FR


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three suppliers, one of them twice, and the lineitems of a few boards, some with repeated scores, passes and unknown suppliers."""
    root = tmp_path_factory.mktemp("tables")
    rng = random.Random(5)
    items = [(rng.choice([31, 31, 32, 63, 64, 90]), rng.choice([97, 89, 1, 2, 200, 201]), rng.choice([1, 2, 3, 4, None]), rng.randint(1, 7), float(rng.randint(1, 50))) for _ in range(300)]
    lineitem = spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").withColumn("l_shipdate", F.date_add(F.lit("2024-01-01"), F.col("l_linenumber")))
    lineitem.write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (2,), (3,)], "s_suppkey long").write.parquet(f"{root}/supplier.parquet")
    return str(root)


def shuffles(df, column: str) -> int:
    """Shuffles by key that carry ``column``, with small tables joined as large ones are."""
    conf, jvm = df.sparkSession.conf, df.sparkSession._jvm
    was = conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    return sum(f"{column}#" in x for x in re.findall(r"\) Exchange\nInput \[\d+\]: (.*)\nArguments: hashpartitioning", plan))


@pytest.mark.parametrize("name, most", [("feed_pipeline", 3), ("enrich_results", 2), ("french_sections", 2), ("french_lineup", 1), ("ratings", 4), ("mp_references", 1)])
def test_results_are_shuffled_once_a_join(spark, tables, name, most):
    assert shuffles(all_queries()[name].build(spark, tables), "l_linenumber") == most


def test_listed_matchpoints_are_matchpoints(spark):
    rng = random.Random(8)
    rows = [(b, i, s, None if s is None else -s) for i, (b, s) in enumerate((rng.choice([1, 2, 3, None]), rng.choice([None, -50, 0, 110])) for _ in range(60))] + [(9, 99, 420, -420)]
    df = spark.createDataFrame(rows, "b int, i int, score_ns int, score_ew int")
    names = ["i", "mp_top", "mp_ns", "mp_ew", "pct_ns", "pct_ew"]
    want = {tuple(r) for r in mp.matchpoints(df, "b").where("b is not null").select(names).collect()}
    listed = own_shuffle(mp.board_scores(df, "b"), "b")
    assert {tuple(r) for r in mp.percentages(mp.listed_matchpoints(df.join(listed, "b"))).select(names).collect()} == want
    assert len(want) == sum(r[0] is not None for r in rows)


def test_equal_references_count_together_and_keep_the_scores(spark):
    df = spark.createDataFrame([(1, 50, -50), (1, 50, -50), (1, None, None), (1, 110, -110), (None, 10, -10)], "b int, score_ns int, score_ew int")
    refs = spark.createDataFrame([(1, 100), (1, 100), (1, 110), (2, 0), (None, 0)], "b int, par int")
    out = mp.board_references(df, refs, "b", {"par": ("par", "score_ns", False)}, ("score_ns", "score_ew"))
    got = {(r.b, r.par): (r.mp_top, r.mp_par, r["_top"], None if r["_scores"] is None else sorted((x.ns, x.mp_ns, x.mp_ew) for x in r["_scores"] if x.ns)) for r in out.collect()}
    scores = [(50, 0.5, 1.5), (110, 2.0, 0.0)]
    assert got == {(1, 100): (5, 4.0, 2, scores), (1, 110): (2, 2.5, 2, scores), (2, 0): (None, None, None, None), (None, 0): (None, None, None, None)}


def test_trick_lists_give_a_row_for_each_row(spark):
    dd = spark.createDataFrame([(1, "N", "S", 10), (1, "N", "S", 7), (1, "E", "N", None), (1, "E", "N", 0), (1, "Q", "S", 3), (1, None, "S", 4), (2, "W", "C", 13), (None, "N", "S", 5)],
                               "deal_id int, declarer string, strain string, tricks int")
    boards = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None)], "board int, deal_id int")
    rows = [(i, b, d, s) for i, (b, d, s) in enumerate([(1, "N", "S"), (1, "E", "N"), (1, "S", "S"), (1, None, None), (2, "W", "C"), (3, "N", "S"), (4, "N", "S")])]
    df = spark.createDataFrame(rows, "i int, board int, declarer string, strain string").withColumns(
        {"level": F.lit(4), "dbl": F.lit(""), "vul_declarer": F.lit(False), "tricks": F.lit(9), "score_declarer": F.lit(-50)})
    out = R.with_declarer_columns(df.join(R.with_trick_lists(boards, dd), "board"))
    got = sorted(((r.i, r.dd_tricks, r.tricks_dd_diff) for r in out.collect()), key=str)
    assert got == sorted([(0, 10, -1), (0, 7, 2), (1, None, None), (1, 0, 9), (2, None, None), (3, None, None), (4, 13, -4), (5, None, None), (6, None, None)], key=str)
    plain = df.join(boards, "board").join(dd.withColumnRenamed("tricks", "dd_tricks"), ["deal_id", "declarer", "strain"], "left")
    assert got == sorted(((r.i, r.dd_tricks, None if r.dd_tricks is None else 9 - r.dd_tricks) for r in plain.collect()), key=str)


def test_played_ev_is_the_ev_of_all_contracts(spark):
    rng = random.Random(2)
    samples = spark.createDataFrame([(d, p, s, t, rng.choice([None, *range(14)])) for d in (1, 2) for p in (0, 1) for s in range(4) for t in range(5) for _ in range(rng.randint(0, 4))],
                                    "deal_id long, fixed_pair int, seat int, strain int, tricks int")
    every = {(r.deal_id, r.declarer, r.strain, r.level, r.vul): r.ev for r in SD.expected_values(SD.name_codes(SD.trick_counts(samples))).collect()}
    rows = [(d, s, t, lv, v) for d in (1, 2, 3, None) for s in (*"NESW", None) for t in "CDHSN" for lv in (1, 4, 7) for v in (True, False, None)]
    df = spark.createDataFrame(rows, "deal_id long, declarer string, strain string, level int, vul_declarer boolean").withColumn(
        "declarer_pair", F.when(F.col("declarer").isin("N", "S"), "NS").when(F.col("declarer").isin("E", "W"), "EW"))
    out = SD.with_played_ev(df, samples)
    assert out.columns == [*df.columns, "ev_played"]
    got = {(r.deal_id, r.declarer, r.strain, r.level, r.vul_declarer): r.ev_played for r in out.collect()}
    assert got == {(d, s, t, lv, v): every.get((d, s, t, lv, "V" if v else "NV")) for d, s, t, lv, v in rows} and any(x is not None for x in got.values())


def test_page_facts_hold_the_best_and_all_pairs(spark):
    rows = [(1, "c", "e", "NS", 2, 4, "A", "B", 10.0, 50.0), (1, "c", "e", "NS", 1, 4, "C", "D", 11.0, 55.0), (1, "c", "e", "EW", 1, 4, "E", "F", 1.0, 55.0), (2, None, None, "EW", 1, 1, "G", None, 1.0, 1.0)]
    pairs = spark.createDataFrame(rows, "page_id long, club string, event string, direction string, position int, pair_number int, player_1 string, player_2 string, match_points double, score_percent double")
    got = {r.page_id: (tuple(r["_best"]), len(r["_pairs"])) for r in page_facts(pairs).collect()}
    assert got == {r.page_id: (tuple(r)[1:], {1: 3, 2: 1}[r.page_id]) for r in best_pairs(pairs).collect()} and got[1][0][4] == "C"


@pytest.mark.parametrize("k", [["section", "board"], ["board"], ["declared"]])
def test_french_tables_of_twice_listed_boards(spark, k):
    rng = random.Random(4)
    rows = [(rng.choice("AB"), rng.choice("12"), "4P", "N", "=", *rng.choice([("420", ""), ("", "50"), ("60%", "40%"), ("450", "")]), "1", "1", rng.choice([None, 1, 2])) for _ in range(40)]
    tables = spark.createDataFrame(rows, "section string, board string, contract string, declarant string, result string, score_eo string, score_ns string, team_ns_id string, team_eo_id string, declared int")
    words = [f"deal_{d}Card{s}" for d in ("north", "east", "south", "west") for s in ("Spade", "Heart", "Diamond", "Club")]
    boards = [("A", "1", "O", "Tous", "NS", "EO", "1"), ("A", "1", "O", "Tous", "NS", "EO", "2"), ("A", "2", "O", "Tous", "EO", "NS", "1"), ("B", "1", "O", "Tous", "NS", "EO", "1")]
    deals = spark.createDataFrame([(*b, *["A"] * 16) for b in boards], "tournament_team_section_name string, deal_dealNumber string, deal_dealer string, deal_vulnerability string, teams_players_position string, "
                                  "teams_opponents_position string, tournament_team_section_table_number string, " + ", ".join(f"{c} string" for c in words))
    roster = spark.createDataFrame([("A", "NS", "1", 1, 7, "f", "l"), ("A", "NS", "1", 1, 8, "g", "m"), (None, "NS", "1", 1, 9, "h", "n")],
                                   "team_section_name string, team_orientation string, team_table_number string, team_players_position int, team_players_id long, team_players_firstname string, team_players_lastname string")
    out = FR.canonical_french(tables, deals, roster, k)
    scores = ["mp_top", "mp_ns", "mp_ew", "pct_ns", "pct_ew"]
    again = mp.matchpoints(out.drop(*scores), k)
    assert sorted(map(str, out.select(again.columns).collect())) == sorted(map(str, again.collect()))
    times = {("A", "1"): 2, ("A", "2"): 1, ("B", "1"): 1}
    assert out.count() == sum(times.get(r[:2], 0) for r in rows)  # pair 1 and pair 2 are listed for the first board
    assert {(r.section, r.player_id_n, r.player_name_n, r.player_id_e) for r in out.collect()} == {("A", "8", "g m", None), ("B", None, None, None)}


def test_listed_frequencies_are_those_of_all_rows(spark, tables):
    want = sorted(map(str, QF.board_frequencies(QF.lineup_results(spark, tables)).collect()))
    assert sorted(map(str, QF.listed_frequencies(QF._results(spark, tables)).collect())) == want and any("count=2" in r for r in want)
