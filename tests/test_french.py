"""French feeds (C17) on hand-written rows: odd texts, unplayed rows, unknown players, adjusted scores."""

from pyspark.sql import functions as F

from boardlake.functions import codings as CD
from boardlake.sources import french as FR

CARDS = [f"deal_{d}Card{s}" for d in ("north", "east", "south", "west") for s in ("Spade", "Heart", "Diamond", "Club")]
HANDS = ["ARDV", "1098", "765", "432", "1098", "ARDV", "432", "765", "765", "432", "ARDV", "1098", "432", "765", "098", "ARDV"]
PBN = "N:AKQJ.T98.765.432 T98.AKQJ.432.765 765.432.AKQJ.T98 432.765.T98.AKQJ"


def test_french_texts(spark):
    rows = [("3SAx", "O", "3NXW"), ("4 Pxx", "N", "4SXXN"), ("1C", "E", "1HE"), ("passe", None, "PASS"), ("PASS", "N", "PASS"), ("2Z", "N", None), ("3K", "Q", None), ("", "N", None), (None, "N", None)]
    got = spark.createDataFrame(rows, "c string, d string, want string").select(FR.french_contract(F.col("c"), F.col("d")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    rows = [("+2", 2), ("-1", -1), ("=", 0), ("", 0), ("+", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want int").select(FR.feed_result(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    rows = [("120", "", 120), ("", "50", -50), ("Passe", "Passe", 0), (None, "PASS", 0), ("60%", "40%", None), (None, None, None), ("", "", None)]
    got = spark.createDataFrame(rows, "a string, b string, want int").select(FR.feed_score(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    dates = spark.createDataFrame([("5 mars 2024",), ("1 Août 1999",), ("31 février 2024",), ("x",), (None,)], "t string").select(CD.french_date(F.col("t")).cast("string").alias("d")).collect()
    assert [r.d for r in dates] == ["2024-03-05", "1999-08-01", None, None, None]


def test_section_feed(spark):
    tables = spark.createDataFrame([
        ("A", "1", "4P", "N", "=", "420", "", "1", "1"), ("A", "1", "3SA", "O", "-1", "50", "", "2", "2"), ("A", "1", "Passe", None, "=", "PASSE", "PASSE", "9", "1"),
        ("A", "2", "1T", "S", "+1", "", "90", "1", "2"), ("A", "3", "1T", "S", "+1", "90", "", "1", "2")],
        "section string, board string, contract string, declarant string, result string, score_eo string, score_ns string, team_ns_id string, team_eo_id string")
    deal = lambda board, own, opp, pair: ("A", board, "O", "Tous", own, opp, pair, *HANDS)
    deals = spark.createDataFrame([deal("1", "NS", "EO", "1")] * 4 + [deal("2", "EO", "NS", "2")] * 4 + [deal("3", "NS", "NS", "1")],
                                  "tournament_team_section_name string, deal_dealNumber string, deal_dealer string, deal_vulnerability string, teams_players_position string, "
                                  "teams_opponents_position string, tournament_team_section_table_number string, " + ", ".join(f"{c} string" for c in CARDS))
    roster = spark.createDataFrame([("A", o, n, p, 100 * n + 10 * p + (o == "EO"), "f", f"{o}{n}{p}") for o in ("NS", "EO") for n in (1, 2) for p in (1, 2)],
                                   "team_section_name string, team_orientation string, team_table_number int, team_players_position int, team_players_id long, team_players_firstname string, team_players_lastname string")
    out = FR.canonical_french(tables, deals, roster)
    got = {(r.board, r.contract): r for r in out.collect()}
    assert set(got) == {(1, "4SN"), (1, "3NW"), (1, "PASS"), (2, "1CS")}  # board 3 was not played
    assert {r.pbn for r in got.values()} == {PBN} and {(r.dealer, r.vul) for r in got.values()} == {("W", "Both")}
    a = got[1, "4SN"]
    assert (a.result, a.score_ns, a.score_ew, a.mp_top, a.mp_ns, a.mp_ew, a.pct_ns) == (0, 420, -420, 2, 2.0, 0.0, 1.0)
    assert (a.player_id_n, a.player_id_s, a.player_id_e, a.player_id_w, a.player_name_w) == ("110", "120", "111", "121", "f EO12")
    assert (got[1, "3NW"].score_ns, got[1, "3NW"].mp_ns, got[1, "3NW"].result) == (50, 1.0, -1)
    assert (got[1, "PASS"].score_ns, got[1, "PASS"].player_id_n, got[1, "PASS"].player_id_e) == (0, None, "111")
    # the home pair of board 2 sits East-West: the home side's empty text is minus the other side's number
    assert (got[2, "1CS"].score_ns, got[2, "1CS"].score_ew, got[2, "1CS"].pct_ns) == (90, -90, None)
    assert [tuple(r) for r in FR.incomplete_boards(deals, ["deal_dealNumber"]).collect()] == [("3", 1)]
    assert FR.canonical_french(tables.limit(0), deals, roster).count() == 0


def test_frequencies(spark):
    f = [("420", 100.0, "", 0.0, 2), ("", 20.0, "50", 80.0, 1), ("60%", 60.0, "40%", 40.0, 1), ("PASS", 50.0, "PASS", 50.0, 1)]
    df = spark.createDataFrame([(f,), ([],), (None,)], "board_frequencies array<struct<nsScore:string,nsNote:double,ewScore:string,ewNote:double,count:long>>")
    got = df.select(*[v.alias(n) for n, v in FR.frequency_lists().items()], FR.expanded_scores().alias("x")).collect()
    assert got[0].x == [420, 420, -50, None, 0] and got[0].mp_top == 4 and got[0].score_freq_list == [2, 1, 1, 1] and got[0].pcts_list_ew == [0.0, 80.0, 40.0, 50.0]
    assert got[1].x == [] and got[2].x is None
