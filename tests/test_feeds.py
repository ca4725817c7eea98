"""Score-table and LIN feeds, frequency lines, relaxed unions, teams and cache types on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from boardlake.operators import cache as C
from boardlake.operators import perspective as PV
from boardlake.operators import summary as S
from boardlake.sources import board_text as BT
from boardlake.sources import pages as PG


def test_auction_contract(spark):
    rows = [("1C-p-1S-p-2S-p-p-p", "N", "2SS"), ("p-p-p-p", "E", "PASS"), ("p-p-p", "E", None), ("1NT-X-XX-p-p-p", "W", "1NXXW"), ("1H-p-2H-d-p-p-p", "S", "2HXS"),
            ("1S-x-2S-p-p-p", "E", "2SE"), ("", "N", None), (None, "N", None), ("1C-p-p-p", None, None)]
    got = BT.auction_contract(spark.createDataFrame(rows, "calls string, dealer string, want string")).collect()
    assert [r.contract for r in got] == [r.want for r in got]


def test_score_table_feed(spark):
    entry = "struct<contract:string,declarer:string,result:string,pair_id_ns:int,pair_id_ew:int>"
    rows = [(1, "N", [("3NT+1", "W", "10", 1, 2), ("4♠x-1", "N", "9", 3, None), ("Pass", None, "-", 1, 2), ("??", "N", "7", 1, 2), ("2H=", None, "8", 1, 2), (None, "N", None, 1, 2)]), (2, "E", []), (3, "S", None)]
    got = BT.canonical_from_score_table(spark.createDataFrame(rows, f"board int, dealer string, score_table array<{entry}>"), ["board"]).orderBy("row_index").collect()
    assert [(r.board, r.row_index, r.contract, r.tricks, r.result) for r in got] == [
        (1, 0, "3NW", 10, 1), (1, 1, "4SXN", 9, -1), (1, 2, "PASS", None, None), (1, 3, None, 7, None), (1, 4, None, 8, None), (1, 5, None, None, None)]
    assert (got[1].player_id_n, got[1].player_id_s, got[1].player_id_e, got[0].player_id_w) == ("3_N", "3_S", None, "2_W")


def test_frequency_lines(spark):
    head = ["Score", "Nb", "top NS", "top EO"]
    page = lambda *lines: "\n".join(("x", "Score", " y", *head, *lines))
    rows = [(1, page("-50", " 2 ", "1,5", "3", "420", "1", "9", "0", "-50", "9", "9", "9", "90", "1", "1")), (2, page("10", "1", "1", "1", "2010", "1", "1", "1", "20", "1", "1", "1")),
            (3, page("10", "101", "1", "1")), (4, page()), (5, "Score\n10\n1\n1\n1"), (6, ""), (7, None)]
    got = [tuple(r) for r in PG.lines_to_records(spark.createDataFrame(rows, "page_id long, t string"), "t", head).collect()]
    assert sorted(got) == [(1, -50.0, 2.0, 1.5, 3.0), (1, 420.0, 1.0, 9.0, 0.0), (2, 10.0, 1.0, 1.0, 1.0)]


def test_relaxed_union_and_types(spark):
    a = spark.createDataFrame([(1, 2, None)], "i int, x int, n string").withColumn("d", F.to_date(F.lit("2024-01-02")))
    b = spark.createDataFrame([(3, 0.5, "t")], "i long, x double, s string").withColumn("d", F.lit(None))
    u = S.union_relaxed([a, b, a.select(F.col("x").cast("string").alias("i"))])
    assert {f.name: f.dataType.simpleString() for f in u.schema} == {"i": "string", "x": "double", "n": "string", "d": "date", "s": "string"}
    assert [(r.i, r.x, r.s) for r in u.collect()] == [("1", 2.0, None), ("3", 0.5, "t"), ("2", None, None)]
    with pytest.raises(ValueError):
        C.cache_upsert(a.select("i", "x"), b.select(F.col("i").cast("int").alias("i"), "x"), "i")
    teams = PV.team_exists(a.select("i", F.lit("A").alias("s")), spark.createDataFrame([("A", 1), ("A", 2), (None, 1)], "s string, i int"), "s", "i")
    assert {(r.s, r.i): r.team_exists for r in teams.collect()} == {("A", 1): True, ("A", 2): False, (None, 1): False}


def test_compare_teams(spark):
    df = spark.createDataFrame([(5, True), (-2, True), (None, True), (7, False), (-1, None)], "d int, a boolean")
    got = {r.team: (r["sum"], r.gt0, r.lt0) for r in S.compare_teams(df, ["d"], F.col("a")).collect()}
    assert got == {"all": (9, 2, 2), "A": (3, 1, 1), "B": (7, 1, 0), "A-B": (-4, 0, 1)}
