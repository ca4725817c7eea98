"""Operator tests on small hand-made inputs, checked against brute force or hand-worked answers."""

import itertools
import os
import tempfile

from pyspark.sql import functions as F

from boardlake.operators import bidding as B
from boardlake.operators import cache as C
from boardlake.operators import matchpoints as MP
from boardlake.operators import summary as S
from boardlake.sources import board_text as BT
from boardlake.sources import json_tables as J
from boardlake.sources import pages as PG


def test_matchpoints_ties_and_nulls(spark):
    rows = [(1, 1, 100, -100), (1, 1, 100, -100), (1, 1, 50, -50), (1, 1, None, None), (1, 2, 10, -10)]
    df = spark.createDataFrame(rows, "session_id long, board int, score_ns int, score_ew int")
    out = {(r.board, r.score_ns): r for r in MP.matchpoints(df).collect()}
    assert out[(1, 100)].mp_ns == 1.5 and out[(1, 100)].mp_ew == 0.5
    assert out[(1, 50)].mp_ns == 0.0 and out[(1, 50)].mp_ew == 2.0
    assert out[(1, None)].mp_ns is None and out[(1, None)].mp_top == 2
    assert out[(2, 10)].pct_ns is None  # lone result: top 0


def test_hypothetical_matchpoints_brute_force(spark):
    scores = [(1, s) for s in (100, 100, 50, -50, None)] + [(2, s) for s in (0, 420)]
    cands = [(1, v) for v in (100, 75, -100, 500)] + [(2, 420)]
    sdf = spark.createDataFrame(scores, "board int, score int")
    cdf = spark.createDataFrame(cands, "board int, value int")
    got = {(r.board, r.value): r.mp for r in MP.hypothetical_matchpoints(sdf, cdf, ["board"]).collect()}
    for b, v in cands:
        bs = [0 if s is None else s for bb, s in scores if bb == b]
        want = sum(1.0 if v > s else 0.5 if v == s else 0.0 for s in bs)
        assert got[(b, v)] == want


def test_matchpoints_from_frequency_and_asof(spark):
    freq = spark.createDataFrame([(1, -100, 1), (1, 110, 2), (1, 140, 1)], "board int, score int, n long")
    f = {r.score: r for r in MP.matchpoints_from_frequency(freq, ["board"]).collect()}
    assert f[110].mp_ns == 1.5 and f[140].mp_ns == 3.0 and f[140].pct_ns == 1.0
    new = spark.createDataFrame([(1, 110), (1, 120), (1, 200), (1, -200), (2, 0)], "board int, new_score int")
    a = {(r.board, r.new_score): r.asof_pct for r in MP.matchpoints_asof(new, freq, ["board"]).collect()}
    assert a[(1, 110)] == 0.5          # exact hit: its own share
    assert a[(1, 120)] == 3 / 4        # next higher is 140, which beats 3 results
    assert a[(1, 200)] == 1.0          # above all
    assert a[(1, -200)] == 0.0
    assert a[(2, 0)] is None           # board unknown


def test_cache_upsert_and_newer_wins(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, name string, v double")
    new = spark.createDataFrame([(2, 5.0), (3, 7.0)], "k int, v double")
    out = {r.k: r for r in C.cache_upsert(old, new, "k").collect()}
    assert out[1].upsert_action == "kept" and out[2].v == 5.0 and out[2].name == "b"
    assert out[3].upsert_action == "added" and out[3].name is None
    o = spark.createDataFrame([(1, 10, 1, "x"), (1, 10, 2, "y"), (2, 5, 1, "z")], "k int, upd int, cre int, p string")
    n = spark.createDataFrame([(1, 9, 9, "old"), (2, 6, 0, "new")], "k int, upd int, cre int, p string")
    w = {r.k: r.p for r in C.upsert_newer_wins(o, n, "k", ["upd", "cre"]).collect()}
    assert w == {1: "y", 2: "new"}


def test_auction_analysis(spark):
    df = spark.createDataFrame([(1, "N", "1C-p-1S-p-2S-p-p-p"), (2, "E", "p-p-p-p"), (3, "S", "1S-1H-p-p-p"),
                                (4, "W", "2H-d-p-2S-p-4S-d-p-p-p"), (5, "N", "1N-d-r-p-p-p")],
                               "deal_id long, dealer string, calls string")
    r = {x.deal_id: x for x in B.analyse_auctions(df).collect()}
    assert r[1].contract == "2SS" and r[1].completed and r[1].legal and r[1].opener == "N"
    assert r[2].contract == "PASS" and r[2].completed
    assert not r[3].legal and r[3].first_illegal_pos == 1
    assert r[4].contract == "4SXS" and r[4].completed
    assert r[5].contract == "1NXXN" and r[5].completed


def test_expand_auctions_matches_brute_force(spark):
    feats = spark.createDataFrame(
        [(1, "N", 16, 4, 3, 3, 3, 1.0, True, 17), (1, "E", 12, 5, 2, 3, 3, 2.0, False, 14),
         (1, "S", 5, 2, 4, 4, 3, 0.0, False, 7), (1, "W", 7, 2, 4, 3, 4, 0.5, False, 9)],
        "deal_id long, direction string, hcp int, sl_s int, sl_h int, sl_d int, sl_c int, qt double, balanced boolean, total_points int")
    acc = B.bid_accepts(feats)
    dealer = spark.createDataFrame([(1, "N")], "deal_id long, dealer string")
    got = sorted(r.calls for r in B.expand_auctions(feats, acc, dealer).collect())
    # brute force over the same table
    rows = {r.direction: r.asDict() for r in feats.collect()}

    def ok(seat, crit):
        env = {k.upper(): v for k, v in rows[seat].items()}
        return all(_py_rule(dict(B.RULES)[c], env) for c in crit)

    def grow(prior, seat):
        toks = prior.split("-") if prior else []
        if (len(toks) == 4 and all(t == "p" for t in toks)) or (len(toks) >= 4 and toks[-3:] == ["p"] * 3 and any(t != "p" for t in toks)):
            return [prior]
        nxt = [b for p, b, c in B.BIDS if p == prior and ok(seat, c)] or ["p"]
        ns = "NESW"[("NESW".index(seat) + 1) % 4]
        return list(itertools.chain.from_iterable(grow(b if not prior else prior + "-" + b, ns) for b in nxt))

    assert got == sorted(grow("", "N"))


def _py_rule(text, env):
    """Plain-Python reading of a rule text, independent of the Spark translation."""
    import re

    m = re.match(r"^\s*([-\d.]+)\s*<=\s*(\w+)\s*<=\s*([-\d.]+)\s*$", text)
    if m:
        return float(m.group(1)) <= env[m.group(2).upper()] <= float(m.group(3))
    m = re.match(r"^\s*(\w+)\s*(>=|<=|<|>)\s*([-\d.]+)\s*$", text)
    if m:
        a, op, b = env[m.group(1).upper()], m.group(2), float(m.group(3))
        return {">=": a >= b, "<=": a <= b, "<": a < b, ">": a > b}[op]
    return bool(env[text.strip().upper()])


def test_pbn_and_lin_files(spark):
    d = tempfile.mkdtemp(prefix="boardlake-test-")
    pbn = os.path.join(d, "two.pbn")
    with open(pbn, "w") as f:
        f.write('% header\n[Event "club"]\n[Board "1"]\n[Dealer "N"]\n[Vulnerable "None"]\n'
                '[Deal "N:AKQJ.T98.765.432 T98.765.432.AKQJ 765.432.AKQJ.T98 432.AKQJ.T98.765"]\n'
                '[Declarer "S"]\n[Contract "3NT"]\n[Result "9"]\n\n'
                '[Board "2"]\n[Dealer "E"]\n[Vulnerable "NS"]\n[Deal "N:AKQJ.T98.765.432 T98.765.432.AKQJ 765.432.AKQJ.T98 432.AKQJ.T98.765"]\n'
                '[Declarer ""]\n[Contract "Pass"]\n[Result ""]\n')
    rows = BT.canonical_from_pbn(BT.unnest_tags(BT.read_pbn(spark, pbn), ["Board", "Dealer", "Vulnerable", "Deal", "Declarer", "Contract", "Result"]))
    got = {r.board: r for r in rows.collect()}
    assert got[1].contract == "3NTS" and got[1].tricks == 9 and got[1].vul == "None"
    assert got[2].contract == "PASS" and got[2].vul == "N_S"
    # CRLF, several blank lines, repeated tags, a deal from West, auction and play with a comment
    west = "432.AKQJ.T98.765 AKQJ.T98.765.432 T98.765.432.AKQJ 765.432.AKQJ.T98"
    crlf = os.path.join(d, "crlf.pbn")
    with open(crlf, "w", newline="") as f:
        f.write('\r\n'.join(['[Board "7"]', '[Dealer "S"]', '[Vulnerable "All"]', f'[Deal "W:{west}"]', '[Declarer "W"]', '[Contract "4HX"]', '[Result "8"]',
                             '[Note "1:strong"]', '[Note "2:weak"]', '[Auction "S"]', '1H =1= {long {suit} Pass', '4H X', 'Pass Pass Pass', '[Play "N"]', 'SA S2 S3 S4', '*',
                             '', '  ', '', '[Board "8"]', '[Contract "Pass"]', '']))
    rows = BT.canonical_from_pbn(BT.unnest_tags(BT.read_pbn(spark, crlf), ["Board", "Dealer", "Vulnerable", "Deal", "Declarer", "Contract", "Result", "Note"]))
    got = {r.board: r for r in rows.collect()}
    assert sorted(got) == [7, 8] and got[7].contract == "4HXW" and got[7].vul == "Both" and got[7].note == "1:strong"
    assert got[7].deal == "N:AKQJ.T98.765.432 T98.765.432.AKQJ 765.432.AKQJ.T98 432.AKQJ.T98.765"
    assert got[7].auction == ["1H", "=1=", "Pass", "4H", "X", "Pass", "Pass", "Pass"] and got[7].play == ["SA", "S2", "S3", "S4", "*"]
    assert got[8].auction == [] and got[8].deal is None
    lin = os.path.join(d, "one.lin")
    with open(lin, "w") as f:
        f.write("pn|a,b,c,d|md|3S2345H234D234C234,S6789H5678D5678C5,S10JQKAH9TJD9TJC67|sv|o|ah|Board 1|mb|1C!|an|strong|mb|p|mb|p|mb|p|pc|c2|mc|9|\n")
        f.write("md|3S2345H234D234C234,S6789H5678D5678C5,S10JH9TJD9TJC678|sv|o|\n")  # 11 cards
        f.write("not a board\n")
    rows = BT.read_lin(spark, lin).collect()
    r = next(r for r in rows if r.pbn)
    assert r.dealer == "N" and r.calls == "1C-p-p-p" and r.vul == "None" and r.claimed == 9 and r.play == ["C2"]
    assert r.alerts == [True, False, False, False] and r.announcements == ["strong"] and (r.player_s, r.player_e) == ("a", "d")
    assert r.pbn == "N:AKQJT.JT9.JT9.76 .AKQ.AKQ.AKQJT98 5432.432.432.432 9876.8765.8765.5"
    assert r._corrupt is None and sorted(x._corrupt[:3] for x in rows if x.pbn is None) == ["md|", "not"]


def test_json_flatten_and_relational(spark):
    rows = [(1, '{"a": 1, "n": [4, 5], "kids": [{"x": "p", "g": [{"y": 1}, {"y": 2}]}, {"x": "q", "g": [{"y": 3}, {"y": 4}]}]}'), (2, '{"a": 2, "kids": []}')]
    df = spark.createDataFrame(rows, "id long, j string")
    t = J.json_to_relational(df, "j", "a INT, n ARRAY<INT>, kids ARRAY<STRUCT<x: STRING, g: ARRAY<STRUCT<y: INT>>>>", "id")
    assert sorted((r._parent_id, r.a) for r in t["root"].collect()) == [(1, 1), (2, 2)]
    assert sorted((r._parent_id, r._pos, r.x) for r in t["root_kids"].collect()) == [(1, 0, "p"), (1, 1, "q")]
    assert sorted((r._parent_id, r._pos, r.value) for r in t["root_n"].collect()) == [(1, 0, 4), (1, 1, 5)]
    assert sorted((tuple(r._path), r.y) for r in t["root_kids_g"].collect()) == [((0, 0), 1), ((0, 1), 2), ((1, 0), 3), ((1, 1), 4)]
    flat = J.flatten(df.select("id", F.from_json("j", "a INT, kids ARRAY<STRUCT<x: STRING>>").alias("j")))
    assert set(flat.columns) == {"id", "j_a", "j_kids_x"}
    assert flat.count() == 3  # lists of every row are exploded (outer), not only the first row's


def test_unplayed_board_players_ties_and_ratings(spark):
    from boardlake.operators import cache as C
    from boardlake.operators import ratings as R

    scores = spark.createDataFrame([("a", 100), ("a", None), ("a", 50), ("b", None)], "k string, s int")
    cand = spark.createDataFrame([("a", 60), ("b", 60), ("c", 60)], "k string, v int")
    got = {r.k: (r.mp, r.mp_top) for r in MP.hypothetical_matchpoints(scores, cand, "k", "s", "v").collect()}
    assert got == {"a": (2.0, 1), "b": (None, None), "c": (None, None)}
    old = spark.createDataFrame([("x", 5, "a"), ("y", 5, "a")], "k string, t int, v string")
    new = spark.createDataFrame([("x", 5, "z"), ("y", 6, "b")], "k string, t int, v string")
    assert sorted((r.k, r.v) for r in C.upsert_newer_wins(old, new, "k", "t").collect()) == [("x", "a"), ("y", "b")]
    tables = spark.createDataFrame([("A", 1, 2)], "section string, pair_no_ns int, pair_no_ew int")
    people = spark.createDataFrame([("A", s, n, f"{s}{n}", s.lower()) for s in "NS" for n in (1, 2)] + [("A", s, n, f"{s}{n}", s.lower()) for s in "EW" for n in (1, 2)],
                                   "section string, orientation string, pair_no int, player_id string, player_name string")
    r = C.attach_players(tables, people).first()
    assert (r.player_id_N, r.player_id_S, r.player_id_E, r.player_id_W, r.player_name_W) == ("N1", "S1", "E2", "W2", "w")
    df = spark.createDataFrame([(1, "p", "q", 1.0), (2, "p", None, 3.0), (3, None, "q", 5.0)], "i int, a string, b string, v double")
    got = {r.i: (r.ra, r.rb) for r in R.ratings_many(df, [("v", "a", "ra"), ("v", "b", "rb")]).collect()}
    assert got == {1: (2.0, 3.0), 2: (2.0, None), 3: (None, 3.0)}


def test_lines_to_records_and_mp_text(spark):
    text = "junk\nScore\n420\n3\n4,5\n1,5\n-50\n2\n1\n5\nbad\n1\n1\n1\n"
    df = spark.createDataFrame([(1, text)], "page_id long, t string")
    recs = [(r.score, r.frequency) for r in PG.lines_to_records(df, "t", "Score").collect()]
    assert recs == [(420.0, 3.0), (-50.0, 2.0)]
    m = spark.createDataFrame([("164,2 (83,35 %)",)], "t string").select(*[c.alias(k) for k, c in PG.parse_mp_text("t").items()]).first()
    assert m.mp == 164.2 and m.pct == 83.35


def test_query_with_macros(spark):
    df = spark.createDataFrame([(1, "NS", 100), (1, "EW", -50), (2, "NS", 30)], "board int, side string, s int")
    out = S.query(df, S.expand_macros("SELECT board, sum(s) AS t WHERE side = '{Pair_Direction}' GROUP BY board", {"Pair_Direction": "NS"}))
    assert sorted((r.board, r.t) for r in out.collect()) == [(1, 100), (2, 30)]
    assert S.expand_macros("x {Opp}", {"Opp": None}) == "x {Opp}"


def test_matchpoints_by_value_hot_key_brute_force(spark):
    import random

    rnd = random.Random(7)
    rows = [(1, rnd.choice([None] + [round(rnd.uniform(-50, 50), 1) for _ in range(5)])) for _ in range(400)]
    rows += [(2, float(v)) for v in (3, 3, 1)] + [(3, 5.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = [(r.k, r.v, r.mp, r.mp_top) for r in MP.matchpoints_by_value(df, ["k"], "v", buckets=8).collect()]
    want = []
    for k, v in rows:
        vals = [x for kk, x in rows if kk == k and x is not None]
        mp = None if v is None else sum(1 for x in vals if x < v) + (sum(1 for x in vals if x == v) - 1) / 2.0
        want.append((k, v, mp, len(vals) - 1))
    key = lambda t: (t[0], -1e9 if t[1] is None else t[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_deal_validator_rejects_bad_deals(spark):
    from boardlake.operators import perspective as P

    good = "N:AKQJ.T98.765.432 T98.765.432.AKQJ 765.432.AKQJ.T98 432.AKQJ.T98.765"
    dup = "N:AKQJ.T98.765.432 T98.765.432.AKQJ 765.432.AKQJ.T98 432.AKQJ.T98.76A"   # two club aces... and a missing 5
    short = "N:AKQ.T98.765.432 T98.765.432.AKQJ 765.432.AKQJ.T98 432.AKQJ.T98.765"   # North has 12 cards
    df = spark.createDataFrame([(1, good), (2, dup), (3, short), (4, None)], "deal_id long, pbn string")
    r = P.quality_report(df).first()
    assert r.rows == 4 and r.null_deals == 1 and r.bad_length == 1 and r.invalid_deals == 2


def test_score_lists_are_frequency_pairs(spark):
    df = spark.createDataFrame([(1, 100), (1, 100), (1, -50), (2, 0)], "board int, s int")
    got = {r.board: [(x.score, x.n) for x in r.scores] for r in S.score_lists(df, "board", "s").collect()}
    assert got == {1: [(-50, 1), (100, 2)], 2: [(0, 1)]}


def test_stream_resumes_and_keeps_late_rows(spark):
    from boardlake.streaming import scores as ST

    root, src = tempfile.mkdtemp(prefix="boardlake-stream-"), tempfile.mkdtemp(prefix="boardlake-src-") + "/in"
    schema = "id long, board int, s int, t timestamp"

    def deliver(rows):
        spark.createDataFrame(rows, "id long, board int, s int, t string").withColumn("t", F.to_timestamp("t")).write.mode("append").parquet(src)

    def run():
        stream = ST.stream_files(spark, src, spark.createDataFrame([], schema).schema)
        return sorted(tuple(r) for r in ST.land_and_count(stream, ["id"], "board", "s", root).collect())

    deliver([(1, 1, 100, "2024-01-10 00:00:00"), (2, 1, 50, "2024-01-10 00:00:00"), (1, 1, 100, "2024-01-10 00:00:00"), (9, 2, None, "2024-01-10 00:00:00")])
    assert run() == [(1, 50, 1), (1, 100, 1)]
    # the query stopped; a second delivery repeats one result and brings others, one of them years late
    deliver([(2, 1, 50, "2024-01-10 00:00:00"), (3, 1, 50, "2020-01-01 00:00:00"), (4, 2, 7, "2024-02-01 00:00:00")])
    assert run() == [(1, 50, 2), (1, 100, 1), (2, 7, 1)]
    assert run() == [(1, 50, 2), (1, 100, 1), (2, 7, 1)]
