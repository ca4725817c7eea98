"""Feeds, bidding tables, order statistics, profiles, splits and event-time landing against brute force and hand-worked answers."""

import datetime
import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from boardlake.operators import bidding as B
from boardlake.operators import perspective as P
from boardlake.operators import predict as M
from boardlake.operators import ranks as RK
from boardlake.operators import summary as S
from boardlake.plans.feed import best_pairs, feed_pairs
from boardlake.sources import pages as PG
from boardlake.streaming import scores as ST


def test_rows_by_header_follow_each_page(spark):
    table = lambda *rows: "<table>" + "".join("<TR class=x>" + "".join(f"<td>{c}</td>" for c in r) + "</TR>" for r in rows) + "</table>"
    pages = [
        (1, "https://h/x?club=a&event=7", table(("1", "2", "before any header"), ("Pos", "No", "Players", "MP", "Score%"), ("1", "9", "no section yet", "1", "1"),
                                             ("North / South",), ("1", "4", "A &amp; B", "10.5", "61.2"), ("2", "5", "C&nbsp;x &amp; <b>D</b>", "", ""), ("x", "5", "q", "1", "1"),
                                             ("East / West",), ("1", "4", "E & F", "3", "70"), ("2", "x", "G & H", "3", "70"), ("3", "8"))),
        (2, "https://h/x?event=8", table(("North / South",), ("Score", "Players", "<a href='/p?n=1'>Pair</a>", "Matchpoints", "Position"), ("50", "I & J", "<a href=\"/pair/3\">3</a>", "2", "1"))),
        (3, None, "<p>nothing</p>"), (4, "u", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {tuple(r) for r in feed_pairs(df).select("page_id", "club", "event", "direction", "position", "pair_number", "player_1", "player_2", "match_points", "score_percent").collect()}
    assert got == {(1, "a", "7", "NS", 1, 4, "A", "B", 10.5, 61.2), (1, "a", "7", "NS", 2, 5, "C x", "D", 0.0, 0.0),
                   (1, "a", "7", "EW", 1, 4, "E", "F", 3.0, 70.0), (2, None, "8", "NS", 1, 3, "I", "J", 2.0, 50.0)}
    best = {r["page_id"]: (r["direction"], r["player_1"]) for r in best_pairs(feed_pairs(df)).collect()}
    assert best == {1: ("EW", "E"), 2: ("NS", "I")}
    from boardlake.plans.feed import HEADERS, SECTIONS
    links = PG.rows_by_header(df, HEADERS, SECTIONS).where("page_id = 2").first()["links"]
    assert links == ["/pair/3"]


def test_rule_text_forms():
    assert B.rule_sql("10 <= HCP_{d} <= 15") == "(HCP BETWEEN 10 AND 15)"
    assert B.rule_sql("6 <= HCP < 12") == "(6 <= HCP AND HCP < 12)"
    assert B.rule_sql("15 > SL_{d}_S >= 5") == "(15 > SL_S AND SL_S >= 5)"
    assert B.rule_sql("SL_{d}_H >= 5") == "(SL_H >= 5)"


TABLE = [(0, "", "1S", ["A >= 1"], False), (1, "", "p", ["A < 5"], False), (2, "", "3N", ["A >= 0"], False), (3, "1S", "2S", ["A <= 8"], False), (4, "1S-2S", "p", [], False),
         (5, "1S-2S-p", "p", ["B = 1"], False), (6, "1S-2S-p-p", "p", [], True), (7, "p-1D", "2D", ["A >= 3"], False), (8, "p", "1H", ["B >= 1"], False), (9, "p-1H", "p", ["A >= 2"], False)]


def hands(n, seed=1):
    rng = random.Random(seed)
    return [(d, s, rng.randrange(10) if rng.random() < 0.9 else None, rng.randrange(2)) for d in range(n) for s in "NESW"]


def holds(rule, a, b):
    name, sign, value = rule.split()
    x = {"A": a, "B": b}[name]
    return x is not None and {">=": x >= int(value), "<": x < int(value), "<=": x <= int(value), "=": x == int(value)}[sign]


def outcome(entry, a, b):
    """An entry's criteria and those of its prior bids' entries, by recursion."""
    by = {(p, bid): (i, p, bid, c, f) for i, p, bid, c, f in TABLE}
    ok = all(holds(r, a, b) for r in entry[3])
    calls = entry[1].split("-") if entry[1] else []
    if len(calls) <= 1 or ("-".join(calls[:-1]), calls[-1]) not in by:
        return ok
    return ok and outcome(by["-".join(calls[:-1]), calls[-1]], a, b)


def test_bid_outcomes_with_prior_bids(spark, monkeypatch):
    monkeypatch.setattr(B, "WORD", 3)  # several words
    features = spark.createDataFrame(hands(30), "deal_id int, direction string, A int, B int")
    table = spark.createDataFrame(TABLE, "bt_id int, prior_calls string, bid string, criteria array<string>, completed boolean")
    got = {tuple(r) for r in B.bid_outcomes(features, table).collect()}
    assert got == {(d, s, e[0]) for d, s, a, b in hands(30) for e in TABLE if outcome(e, a, b)}
    monkeypatch.setattr(B, "MOST_RULES", 2)
    with pytest.raises(ValueError):
        B.table_rules(table)


def test_auctions_by_table_like_recursion(spark):
    features = spark.createDataFrame(hands(12), "deal_id int, direction string, A int, B int")
    table = spark.createDataFrame(TABLE, "bt_id int, prior_calls string, bid string, criteria array<string>, completed boolean")
    dealers = [(d, "NESW"[d % 4]) for d in range(12)]
    got = sorted((r["deal_id"], r["calls"], tuple(r["bt_ids"]), r["completed_by_table"])
                 for r in B.expand_by_table(features, table, spark.createDataFrame(dealers, "deal_id int, dealer string"), bogus=("3N",)).collect())
    hand = {(d, s): (a, b) for d, s, a, b in hands(12)}
    want = []

    def grow(d, seat, calls, ids):
        hits = [e for e in TABLE if e[1] == "-".join(calls) and "-".join([*calls, e[2]]) != "3N" and outcome(e, *hand[d, "NESW"[seat]])]
        for e in hits or [(None, None, "p", None, False)]:
            now, used = [*calls, e[2]], ids if e[0] is None else (*ids, e[0])
            if e[4] or now == ["p"] * 4 or (len(now) > 3 and now[-3:] == ["p"] * 3 and set(now) != {"p"}):
                want.append((d, "-".join(now), used, e[4]))
            else:
                grow(d, (seat + 1) % 4, now, used)

    for d, dealer in dealers:
        grow(d, "NESW".index(dealer), [], ())
    assert got == sorted(want) and any(x[3] for x in got)


@pytest.mark.parametrize("few", [3, 40, 10_000])
def test_ranks_and_quantiles_exact(spark, monkeypatch, few):
    monkeypatch.setattr(RK, "FEW", few)
    rng = random.Random(few)
    groups = {"distinct": [rng.gauss(0, 1) * 10 ** rng.randrange(-5, 9) for _ in range(3000)], "two": [0.0] * 500 + [1.0] * 500, "one": [7.0],
              "heavy": [5.0] * 1500 + [rng.random() for _ in range(900)], None: [float(i % 7) for i in range(100)], "none": [None, None]}
    rows = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x double").repartition(6)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in RK.exact_quantiles(rows, ["g"], qs).collect()}
    assert len(got) == 5 * 5
    for g, v in groups.items():
        s = sorted(x for x in v if x is not None)
        for q in qs if s else ():
            at = (len(s) - 1) * q
            low, high = s[int(at)], s[min(int(at) + (at > int(at)), len(s) - 1)]
            assert got[g, q] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)
    targets = spark.createDataFrame([(g, r) for g in groups for r in (0, 50, 700, 10_000)], "g string, r long")
    for r in RK.select_ranks(rows, ["g"], targets).collect():
        s = sorted(groups[r["g"]])
        assert r["value"] == s[r["r"]] and r["below"] == sum(x < r["value"] for x in s)


def test_dense_codes_without_one_window(spark):
    values = [f"v{i * 7919 % 5003:05d}" for i in range(5000)] * 2 + ["é", ""]
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(7)
    got = {r["value"]: r["code"] for r in RK.dense_codes(df).collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values), key=lambda v: v.encode()))}
    plan = RK.dense_codes(df)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in "".join(line for line in plan.splitlines() if "Window [" in line)
    labels = M.fit_labels(spark.createDataFrame([("b",), (None,), ("a",)], "c string"), "c").orderBy("code").collect()
    assert [(r["value"], r["code"]) for r in labels] == [("MISSING_CAT", 0), ("a", 1), ("b", 2)]


def test_scaler_with_nulls_and_without_values(spark):
    x = [3.0, None, 1.0, 10.0, None, 4.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    median = statistics.median(v for v in x if v is not None)
    filled = [median if v is None else v for v in x]
    r = M.fit_scaler(df, "x").first()
    assert (r["median"], r["mean"]) == (median, pytest.approx(statistics.fmean(filled))) and r["std"] == pytest.approx(statistics.pstdev(filled))
    assert tuple(M.fit_scaler(df.where("x is null"), "x").first()) == (None, None, None)


def test_split_is_exact_in_every_stratum(spark):
    import hashlib
    rows = [(i, s) for s, n in (("a", 1000), ("b", 7), ("c", 2), (None, 33)) for i in range(len(s or "zzzz") * 10_000, len(s or "zzzz") * 10_000 + n)]
    rows = [(i * 10 + "abc".find(s or "z") + 1, s) for i, s in rows]
    got = M.split_train(spark.createDataFrame(rows, "k long, s string").repartition(5), 0.2, "k", stratum="s").collect()
    for s in ("a", "b", "c", None):
        keys = sorted((k for k, t in rows if t == s), key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())
        assert sorted(r["k"] for r in got if r["s"] == s and r["split"] == "valid") == sorted(keys[:int(len(keys) * 0.2 + 0.5)])
    lonely = M.split_train(spark.createDataFrame([*rows, (5, "d")], "k long, s string"), 0.2, "k", stratum="s").where("split = 'valid'").count()
    assert lonely == int((len(rows) + 1) * 0.2 + 0.5)
    assert M.split_train(spark.createDataFrame([], "k long, s string"), 0.2, "k", stratum="s").count() == 0


def test_summarize_sketches_keep_their_bounds(spark):
    df = spark.range(40_000).select("id", (F.col("id") * 7919 % 9001).cast("double").alias("x"), F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id") % 1234)).alias("t"),
                                    (F.col("id") % 2 == 0).alias("b"), F.array("id").alias("l"), F.lit(None).cast("date").alias("d"))
    got = {r["column_name"]: r for r in S.summarize(df).collect()}
    assert {c: r["column_type"] for c, r in got.items()} == {"id": "bigint", "x": "double", "t": "string", "b": "boolean", "l": "array<bigint>", "d": "date"}
    for c, n in (("id", 40_000), ("x", 9001), ("t", 1234 * 3 // 4 + 309), ("b", 2), ("d", 0)):
        if c == "t":
            n = len({i % 1234 for i in range(40_000) if i % 4})
        assert abs(got[c]["approx_unique"] - n) <= 4 * 0.02 * n + 1
    assert (got["t"]["null_percentage"], got["d"]["null_percentage"], got["id"]["min"], got["id"]["max"], got["t"]["min"], got["d"]["max"]) == (25.0, 100.0, "0", "39999", "t0", None)
    assert all(abs(got["id"][f"q{q}"] - 400 * q) <= 4 + 1 for q in (25, 50, 75)) and got["b"]["avg"] is None and got["id"]["avg"] == 19999.5


def test_event_time_landing_restarts_and_sets_late_rows_aside(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d)
    schema = "i int, board int, score int, t timestamp"
    src, root = str(tmp_path / "in"), str(tmp_path / "out")

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = ST.stream_files(spark, src, spark.createDataFrame([], schema).schema)  # a new query each time: it resumes from the checkpoint
        return {(r["board"], r["score"]): r["n"] for r in ST.land_within(stream, ["i"], "t", "3 days", "board", "score", root).collect()}

    assert deliver([(1, 1, 50, day(10)), (2, 1, 50, day(8)), (2, 1, 50, day(8)), (3, 1, None, day(2))]) == {(1, 50): 2}
    # the mark is the 7th: a second delivery meets itself, an old row is late, a row without a time is set aside
    assert deliver([(1, 1, 50, day(10)), (4, 1, 50, day(6)), (5, 1, 70, day(7)), (6, 1, 70, None)]) == {(1, 50): 2, (1, 70): 1}
    assert deliver([(7, 2, 10, day(20))]) == {(1, 50): 2, (1, 70): 1, (2, 10): 1}
    assert deliver([(5, 1, 70, day(7)), (8, 2, 10, day(17))]) == {(1, 50): 2, (1, 70): 1, (2, 10): 2}
    late = spark.read.schema(schema).parquet(f"{root}/late")
    assert sorted(r["i"] for r in late.collect()) == [4, 5, 6]
    plan = ST.landed_since(spark, root, spark.createDataFrame([], schema).schema, day(17), 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(epoch" in plan and "event_date" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_perspective_is_lazy_and_knows_absent_players(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", "a", "1NN"), ("x", "a", "c", "d", "c", "1NN"), ("x", "y", "c", "d", None, "PASS")], "n string, e string, s string, w string, declarer_id string, contract string")
    cols = {"N": "n", "E": "e", "S": "s", "W": "w"}
    seen = P.perspective(df, "a", "c", cols).collect()
    assert [(r["player_seat"], r["partner_seat"], r["pair_direction"], r["boards_i_played"], r["boards_we_declared"], r["boards_opponent_declared"]) for r in seen] == [
        ("N", "S", "NS", True, True, False), ("N", "S", "NS", False, True, False), ("N", "S", "NS", False, False, False)]
    gone = P.perspective(df, "q", None, cols).collect()
    assert all(r["player_seat"] is None and r["boards_i_played"] for r in gone)
    assert list(itertools.chain.from_iterable((r["pair_direction"],) for r in gone)) == [None] * 3


def test_pbn_file_in_many_ranges(spark, tmp_path):
    """One file of 320 boards, cut into ranges at any place, gives the blocks of the whole file."""
    from boardlake.sources import board_text as BT
    rng = random.Random(2)
    text = "% comment\r\n"
    for i in range(320):
        text += f'[Event "é {i}"]\r\n[Board "{i}"]\r\n[Note "1:x"]\r\n[Note "2:{"y" * rng.randrange(200)}"]\r\n' + rng.choice(["\r\n", "\n", " \t\r\n\n", "\n\n\n"])
    for name, body in (("a.pbn", text), ("b.pbn", text.replace("\r\n", "\n").rstrip("\n")), ("c.pbn", '[Board "alone"]'), ("d.pbn", "")):
        (tmp_path / name).write_bytes(body.encode())
    whole = BT.split_pbn(spark.read.text(str(tmp_path), wholetext=True))
    lines = lambda v: tuple(x for x in v.replace("\r", "").split("\n") if x.strip())
    want = sorted(lines(r["value"]) for r in whole.collect())
    for size in (256, 1000, 40_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = BT.text_blocks(spark, str(tmp_path))
            if size < 40_000:
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
            assert sorted(lines(r["value"]) for r in got.collect()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert BT.read_pbn(spark, str(tmp_path)).count() == 641


def test_noted_auctions(spark):
    from boardlake.sources import board_text as BT
    blocks = ['[Board "1"]\n[Auction "N"]\n1C! =1= Pass 1NT? =2= $4\nX =3= XX AP\n[Note "1:could be short"]\n[Note "2: 6-9 "]\n[Note "1:second text"]',
              '[Board "2"]\n[Auction "E"]\nAP', '[Board "3"]\n[Auction "S"]\nPass Pass 7N Pass AP', '[Board "4"]', '[Board "5"]\n[Auction "W"]\n1H * +']
    got = {r["tags"][0]["v"]: r for r in BT.noted_auction_arrays(BT.parse_pbn_blocks(spark.createDataFrame([(b,) for b in blocks], "value string"))).collect()}
    one = got["1"]
    assert one["bid_type"] == ["Contract", "Penalty", "Contract"] + ["Penalty"] * 5 and one["bid_level"][:3] == [1, None, 1] and one["bid_denom"][:3] == ["C", None, "N"]
    assert one["bid_penalty"] == [None, "passed", None, "doubled", "redoubled", "passed", "passed", "passed"]
    assert one["bid_alertable"][:5] == [True, False, True, True, False] and one["bid_announcement"][:5] == ["could be short", None, "6-9", None, None]
    assert [len(got[str(i)]["bid_type"]) for i in (2, 3, 4, 5)] == [4, 6, 0, 1]


def test_decoders_refuse_other_values(spark):
    from boardlake.functions import codings as CD
    df = spark.createDataFrame([(1 << 52, "xyz", "01", [0] * 51), (-1, "0" * 12, "2" * 52, [2] * 52), (None, None, None, None)], "b long, h string, t string, o array<int>")
    for r in df.select(CD.bits_to_hand(F.col("b")), CD.hex_to_hand(F.col("h")), CD.binary_to_hand(F.col("t")), CD.one_hot_to_hand(F.col("o"))).collect():
        assert tuple(r) == (None,) * 4
    ok = spark.createDataFrame([(0, "AKQJT98765432...")], "b long, s string").select(CD.bits_to_hand(F.col("b")).alias("none"), CD.hex_to_hand(CD.hand_hex(F.col("s"))).alias("spades")).first()
    assert tuple(ok) == ("...", "AKQJT98765432...")


def test_par_lists_compare_as_multisets(spark):
    from boardlake.operators import singledummy as SD
    kind = "k int, par_ns int, par_contracts array<struct<level:int,strain:string,dbl:string,declarer:string,overs:int>>"
    x, y, z = (4, "S", "", "N", 0), (3, "S", "", "N", 1), (4, "S", "", "S", 0)
    a = spark.createDataFrame([(1, 420, [x, z]), (2, 420, [x, x]), (3, 420, [x]), (4, 0, []), (5, None, None), (6, 1, [x])], kind)
    b = spark.createDataFrame([(1, 420, [z, y]), (2, 420, [x]), (3, 450, [x]), (4, 0, []), (5, None, None), (7, 1, [x])], kind)
    assert {r["k"]: r["par_compare"] for r in SD.compare_pars(a, b, "k").collect()} == {1: "same", 2: "contracts", 3: "score", 4: "same", 5: "same", 6: "a", 7: "b"}
