"""Board references (par, best double-dummy, best expected value), feed texts, cells and prediction checks against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from boardlake.functions.codings import sort_suit
from boardlake.operators import matchpoints as mp
from boardlake.operators import predict as M
from boardlake.sources import pages as PG


def test_board_references_against_pairs(spark):
    rng = random.Random(3)
    scores = [(b, s, None if s is None else -s) for b in (1, 2, 3) for s in (rng.choice([None, -50, 0, 110, 420]) for _ in range(rng.randint(1, 30)))]
    scores += [(4, None, None), (4, None, None), (9, 420, -420)]
    refs = [(1, 110, 110.0), (2, -50, 99.5), (3, 0, None), (4, 50, 1.0), (5, 50, 1.0)]
    df = spark.createDataFrame(scores, "board int, score_ns int, score_ew int")
    rf = spark.createDataFrame(refs, "board int, par int, ev double").withColumn("par_ew", -F.col("par"))
    got = mp.board_references(df, rf, "board", {"par_ns": ("par", "score_ns", False), "par_ew": ("par_ew", "score_ew", False), "ev": ("ev", "score_ns", True)})
    rows = {r["board"]: r for r in got.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and got.columns[:4] == ["board", "par", "ev", "par_ew"]
    for board, par, ev in refs:
        own = [s for b, s, _ in scores if b == board]
        real = sum(s is not None for s in own)
        beats = lambda v, s: 1.0 if v > s else 0.5 if v == s else 0.0
        want_par = sum(beats(par, s) for s in own if s is not None) if real else None
        want_ew = sum(beats(-par, -s) for s in own if s is not None) if real else None
        want_ev = sum(beats(ev, s or 0) for s in own) if real and ev is not None else None
        r = rows[board]
        assert (r["mp_top"], r["mp_par_ns"], r["mp_par_ew"], r["mp_ev"]) == (real - 1 if real else None, want_par, want_ew, want_ev)
        assert r["pct_par_ns"] == (want_par / real if real else None)


def test_largest_candidate_has_largest_matchpoints(spark):
    df = spark.createDataFrame([(1, s) for s in (-100, None, 50, 50, 420)], "board int, score int")
    cand = spark.createDataFrame([(1, v) for v in (-200, -100, 0, 50, 51)], "board int, value int")
    long = mp.hypothetical_matchpoints(df, cand, "board").agg(F.max("mp").alias("m")).first()["m"]
    ref = cand.groupBy("board").agg(F.max("value").alias("best"))
    assert mp.board_references(df, ref, "board", {"b": ("best", "score", True)}).first()["mp_b"] == long == 4.0


@pytest.mark.parametrize("text, want", [
    ("3 SA X -1", (3, "N", "X", -1)), ("4♠=", (4, "S", "", 0)), ("1NT +2", (1, "N", "", 2)), ("6 ♥ XX N +1", (6, "H", "XX", 1)), ("2♦", (2, "D", "", None)),
    ("2 ♣  e -3", (2, "C", "", -3)), ("PASS", (None,) * 4), ("", (None,) * 4), (None, (None,) * 4), ("8S=", (None,) * 4),
])
def test_contract_texts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(*[c.alias(k) for k, c in PG.parse_contract_text("t").items()]).first()) == want


def test_sort_suit_and_cells(spark):
    df = spark.createDataFrame([("2TAK",), ("",), (None,), ("55Q",)], "s string")
    assert [r[0] for r in df.select(sort_suit(F.col("s"))).collect()] == ["AKT2", "", None, "Q55"]
    full = ["A K Q J 10 9 8", "765432", "-", "-"] + ["765432", "-", "A K Q J 10 9 8", "-"] + ["-", "AKQJT98", "-", "765432"] + ["-", "-", "2 3 4 5 6 7", "89TJQKA"]
    twice = full[:4] + ["A65432", *full[5:]]
    cells = spark.createDataFrame([(1, full), (2, twice), (3, full[:15]), (4, None)], "id int, cells array<string>")
    got = {r["id"]: r["pbn"] for r in PG.cells_to_deal(cells, "cells").collect()}
    assert got == {1: "N:AKQJT98.765432.. .AKQJT98..765432 ..765432.AKQJT98 765432..AKQJT98.", 2: None, 3: None, 4: None}


def test_prediction_labels_and_constraints(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), (None, 0), ("b", 7), ("b", None)], "y string, p int")
    got = M.prediction_labels(df, "p", "y", M.fit_labels(df, "y")).collect()
    assert {(r["y"], r["p"]): (r["actual_code"], r["pred_label"], r["match"], r["match_code"]) for r in got} == {
        ("b", 0): (2, "MISSING_CAT", False, False), ("a", 1): (1, "a", True, True), (None, 0): (0, "MISSING_CAT", True, True),
        ("b", 7): (2, None, False, False), ("b", None): (2, None, False, False)}
    rows = spark.createDataFrame([(1, 0.4, 0.6), (1, 0.6, 0.4), (2, 0.7, 0.3), (None, 0.5, 0.6)], "s int, ns double, ew double")
    r = M.constraint_report(rows, "ns", "ew", "s").first()
    assert (r["rows"], r["sessions"], r["sessions_with_bad_rows"], r["sessions_off_mean"], r["row_sums_ok"], r["session_means_ok"]) == (4, 3, 1, 2, False, False)
    assert r["max_row_sum_error"] == pytest.approx(0.1) and r["max_session_dev"] == pytest.approx(0.2) and r["ns_mean"] == pytest.approx(0.55)
    empty = M.constraint_report(rows.limit(0), "ns", "ew", "s").first()
    assert (empty["rows"], empty["max_row_sum_error"], empty["row_sums_ok"], empty["session_means_ok"]) == (0, None, True, True)
