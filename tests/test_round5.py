"""Passes over the input: ranks read a table once, rounds of auctions are computed once."""

import pytest
from pyspark.sql import functions as F

from boardlake.operators import bidding as B
from boardlake.operators import ranks as RK


def test_ranks_read_their_rows_once(spark, monkeypatch):
    monkeypatch.setattr(RK, "FEW", 20)
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("x")).mapInArrow(read, "g long, x double")
    targets = spark.createDataFrame([(g, r) for g in (0, 1) for r in (0, 250, 251, 500, 999, 1000)], "g long, r long")
    got = sorted((r["g"], r["r"], r["value"], r["below"]) for r in RK.select_ranks(rows, ["g"], targets).collect())
    values = {g: sorted(float(i * 7919 % 1000) for i in range(2000) if i % 2 == g) for g in (0, 1)}
    assert got == [(g, r, values[g][r], sum(v < values[g][r] for v in values[g])) for g in (0, 1) for r in (0, 250, 251, 500, 999)]
    assert seen.value == 2000


def test_ranks_of_nulls_nans_and_zeros(spark):
    rows = spark.createDataFrame([(None, 2.0), (None, None), (None, float("nan")), (None, -0.0), (None, 0.0), ("a", None)], "g string, x double")
    targets = spark.createDataFrame([(g, r) for g in (None, "a", "b") for r in range(-1, 5)], "g string, r long")
    got = sorted((r["r"], str(r["value"]).lstrip("-"), r["below"]) for r in RK.select_ranks(rows, ["g"], targets).collect() if r["g"] is None)
    assert got == [(0, "0.0", 0), (1, "0.0", 0), (2, "2.0", 2), (3, "nan", 3)]
    assert RK.select_ranks(rows.where("g = 'a'"), ["g"], targets).count() == 0


@pytest.mark.parametrize("sent", [0, 1 << 15])
def test_auction_rounds_are_computed_once(spark, capsys, monkeypatch, sent):
    monkeypatch.setattr(B, "SENT_ENTRIES", sent, raising=False)
    entries = [(0, "", "1S", ["A >= 5"], False), (1, "1S", "p", ["A < 5"], False), (2, "1S", "2S", ["A >= 3"], True), (3, "1S-p", "4S", [], False), (4, "1S-p-4S-p-p", "p", [], True)]
    table = spark.createDataFrame(entries, "bt_id int, prior_calls string, bid string, criteria array<string>, completed boolean")
    features = spark.createDataFrame([(d, s, a) for d, hand in ((1, (6, 1, 0, 0)), (2, (5, 4, 0, 0)), (3, (0, 0, 0, 0))) for s, a in zip("NESW", hand)], "deal_id int, direction string, A int")
    out = B.expand_by_table(features, table, spark.createDataFrame([(d, "N") for d in (1, 2, 2, 3, 4)], "deal_id int, dealer string"))
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan  # what is returned lies in checkpoints
    got = sorted((r["deal_id"], r["calls"], r["bt_ids"], r["completed_by_table"]) for r in out.collect())
    two = [(2, "1S-2S", [0, 2], True), (2, "1S-p-4S-p-p-p", [0, 1, 3, 4], True)]
    assert got == [(1, "1S-p-4S-p-p-p", [0, 1, 3, 4], True), *sorted(two * 2), (3, "p-p-p-p", [], False)]
