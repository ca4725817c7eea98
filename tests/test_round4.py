"""Plans and partitions that keep the driver's and a task's memory from growing with the tables."""

import pytest
from pyspark.sql import functions as F

from boardlake import session
from boardlake.functions import codings as CD
from boardlake.operators import bidding as B
from boardlake.operators import matchpoints as mp
from boardlake.plans.queries import all_queries
from boardlake.sources import fixtures


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["declarer_columns", "feed_pipeline", "enrich_results", "ratings", "lott", "ev_by_vul", "mp_references", "mp_hypothetical",
                                  "mp_missing", "french_sections", "french_lineup", "pbn_roundtrip"])
def test_tables_that_grow_by_generators_are_not_broadcast(spark, sf, capsys, name):
    plan = _plan(all_queries()[name].build(spark, sf), capsys)
    # the null-safe join is that of the score frequencies, which Spark sizes by the results themselves
    assert [line for line in plan.splitlines() if "BroadcastExchange" in line and "coalesce(" not in line] == []


def test_auction_frontier_is_joined_without_broadcast(spark, monkeypatch, capsys):
    seen = []
    cut = session.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda df: (seen.append(_plan(df, capsys)), cut(df))[1])
    accepts = spark.createDataFrame([(1, "N", "", "1C", True), (1, "E", "1C", "1S", False)], "deal_id long, direction string, prior_calls string, bid string, accepted boolean")
    dealer = spark.createDataFrame([(1, "N"), (2, "S")], "deal_id long, dealer string")
    got = B.expand_auctions(None, accepts, dealer).collect()
    assert {(r.deal_id, r.calls) for r in got} == {(1, "1C-p-p-p"), (2, "p-p-p-p")}
    assert any("SortMergeJoin" in p for p in seen) and not any("BroadcastExchange" in p for p in seen)


def test_sources_get_partitions_by_their_rows(spark, tmp_path):
    spark.range(40_000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    b = fixtures.boards(spark, str(tmp_path))
    assert b.rdd.getNumPartitions() == -(-40_000 * 32 // fixtures.BOARDS_A_TASK) > spark.sparkContext.defaultParallelism
    assert b.count() == 40_000 * 32
    one = spark.range(10, numPartitions=1)
    assert session.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(one, 1000, 10).rdd.getNumPartitions() == 100


def test_windows_of_frequencies_are_not_merged(spark):
    freq = spark.createDataFrame([(i, s, 2) for i in range(40) for s in (50, 100)], "k int, score int, n int")
    out = mp.matchpoints_from_frequency(freq, "k")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.score, r.mp_ns, r.pct_ew) for r in out.collect()} == {(50, 0.5, 2.5 / 3), (100, 2.5, 0.5 / 3)}


def test_decoders_evaluate_their_input_once(spark, capsys):
    hand = "AK2..QJT98.76543"
    df = spark.createDataFrame([(hand,), ("...AKQJT98765432",), (None,)], "hand string")
    got = df.select(CD.hex_to_hand(CD.hand_hex(F.col("hand"))).alias("h"), CD.one_hot_to_hand(CD.hand_one_hot(F.col("hand"))).alias("o"))
    assert [tuple(r) for r in got.collect()] == [(hand, hand), ("...AKQJT98765432",) * 2, ("...", "...")]  # a null hand holds no card
    # a hand's code names each of its cards once, however the decoders use it
    coded = CD.hand_hex(F.col("hand"))
    named = [_plan(df.select(c.alias("x")), capsys).count("THEN 4096") for c in (coded, CD.hex_to_hand(coded))]
    assert named[0] == named[1] > 0
    assert df.limit(1).select(CD.one_hot_to_hand(F.array(*[F.lit(2)] * 52)), CD.one_hot_to_hand(F.array(F.lit(1))), CD.bits_to_hand(F.lit(1 << 52))).first() == (None, None, None)
