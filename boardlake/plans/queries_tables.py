"""Registered table-level queries: nested JSON, lookups, rankings, splits, concatenation, frequency tables
(S10, S11, S22, J3, J6, K2, K6, U1, U2, F3, F5, F6, F7, A10, A11, A17, W10, M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as C
from ..operators import matchpoints as mp
from ..operators import perspective as PV
from ..operators import summary as S
from ..session import read_table
from ..sources import json_tables as J
from ..sources import pages as PG
from .oracle import with_fixtures
from .queries_mp import FREQ_CTE, _freq_df
from .registry import register


@register(
    "json_relational",
    "S10",
    """select o_orderkey parent_id, cast(row_number() over (partition by o_orderkey order by l_linenumber, l_returnflag) - 1 as int) pos, 'item' kind,
  cast(l_linenumber as bigint) number, l_returnflag as text
from orders join lineitem on l_orderkey = o_orderkey
union all select distinct on (o_orderkey, l_returnflag) o_orderkey, cast(dense_rank() over (partition by o_orderkey order by l_returnflag) - 1 as int), 'mode', null, l_returnflag
from orders join lineitem on l_orderkey = o_orderkey where l_returnflag is not null
union all select o_orderkey, null, 'root', o_custkey, o_orderpriority from orders""",
)
def q_json_relational(spark, sf_dir):
    """Orders written as nested JSON (items as structs, return flags as scalars) and split into relational tables."""
    items = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"]).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("items"), F.sort_array(F.collect_set("l_returnflag")).alias("modes"))
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"]).join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    docs = o.select("o_orderkey", F.to_json(F.struct("o_custkey", "o_orderpriority", "items", "modes")).alias("j"))
    t = J.json_to_relational(docs, "j", "o_custkey BIGINT, o_orderpriority STRING, items ARRAY<STRUCT<l_linenumber: BIGINT, l_returnflag: STRING>>, modes ARRAY<STRING>",
                             "o_orderkey")
    none = F.lit(None)
    return (t["root_items"].select(F.col("_parent_id").alias("parent_id"), F.col("_pos").alias("pos"), F.lit("item").alias("kind"),
                                   F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("text"))
            .unionByName(t["root_modes"].select(F.col("_parent_id").alias("parent_id"), F.col("_pos").alias("pos"), F.lit("mode").alias("kind"),
                                                none.cast("bigint").alias("number"), F.col("value").alias("text")))
            .unionByName(t["root"].select(F.col("_parent_id").alias("parent_id"), none.cast("int").alias("pos"), F.lit("root").alias("kind"),
                                          F.col("o_custkey").alias("number"), F.col("o_orderpriority").alias("text"))))


@register(
    "newer_wins_tables",
    "S11,U1,A17",
    """with o as (select o_custkey k, o_orderdate t, max(o_orderkey) v from orders where o_orderstatus = 'F' group by all),
n as (select o_custkey k, o_orderdate t, max(o_orderkey) v from orders where o_orderstatus <> 'F' group by all),
u as (select k, t, v, 1 is_old from o union all select k, t, v, 0 from n)
select k, t, v, 'upsert' part from u qualify row_number() over (partition by k order by t desc, is_old desc, v desc) = 1
union all select distinct k, null, null, 'key' from u""",
)
def q_newer_wins_tables(spark, sf_dir):
    """Newest order of every customer: filled orders as the old table, the others as the new one (old rows stay on ties);
    and the distinct keys of both."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"])
    parts = [o.filter(c).groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t")).agg(F.max("o_orderkey").alias("v"))
             for c in (F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F")]
    best = C.upsert_newer_wins(parts[0], parts[1], "k", "t").withColumn("part", F.lit("upsert"))
    keys = S.dedupe(S.union_all(parts), ["k"]).select("k", F.lit("key").alias("part"))
    return S.union_all([best.select("k", "t", "v", "part"), keys])


@register(
    "player_lookup",
    "J6,J3",
    """with p as (select c_mktsegment section, substr('NESW', cast(c_custkey % 4 as int) + 1, 1) orientation, c_custkey pair_no, c_name from customer),
t as (select o_orderkey, c_mktsegment section, o_custkey pair_no_ns, o_custkey + 1 pair_no_ew from orders join customer on c_custkey = o_custkey)
select t.o_orderkey, n.c_name player_n, e.c_name player_e, s.c_name player_s, w.c_name player_w, c.c_name names_ns, d.c_name names_ew
from t left join p n on n.section = t.section and n.orientation = 'N' and n.pair_no = t.pair_no_ns
left join p e on e.section = t.section and e.orientation = 'E' and e.pair_no = t.pair_no_ew
left join p s on s.section = t.section and s.orientation = 'S' and s.pair_no = t.pair_no_ns
left join p w on w.section = t.section and w.orientation = 'W' and w.pair_no = t.pair_no_ew
left join customer c on c.c_custkey = t.pair_no_ns left join customer d on d.c_custkey = t.pair_no_ew""",
)
def q_player_lookup(spark, sf_dir):
    """Players by section, seat and pair number, and pair names by pair id, for every order as a table result."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    players = c.select(F.col("c_mktsegment").alias("section"), F.substring(F.lit("NESW"), (F.col("c_custkey") % 4).cast("int") + 1, 1).alias("orientation"),
                       F.col("c_custkey").alias("pair_no"), F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name"))
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]).join(c, F.col("o_custkey") == F.col("c_custkey"))
    t = o.select("o_orderkey", F.col("c_mktsegment").alias("section"), F.col("o_custkey").alias("pair_no_ns"), (F.col("o_custkey") + 1).alias("pair_no_ew"))
    out = C.attach_players(t, players)
    ranks = c.select(F.col("c_custkey").alias("pair_id"), F.col("c_name").alias("full_names"))
    out = C.attach_rankings(out, ranks, "pair_id", "pair_no_ns", "pair_no_ew")
    return out.select("o_orderkey", *[F.col(f"player_name_{s}").alias(f"player_{s.lower()}") for s in "NESW"],
                      F.col("full_names_ns").alias("names_ns"), F.col("full_names_ew").alias("names_ew"))


@register(
    "top_orders",
    "K2,K6,S22",
    """with t as (select o_custkey, o_orderkey, o_totalprice, o_orderdate from orders)
select o_custkey, o_orderkey, o_totalprice, 'top3' part from t qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_custkey, o_orderkey, o_orderdate) <= 3
union all select o_custkey, o_orderkey, o_totalprice, 'latest' from t qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc, o_totalprice desc) = 1""",
)
def q_top_orders(spark, sf_dir):
    """The three dearest orders of every customer (ties by the other columns), and every customer's latest order."""
    t = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"])
    top = S.top(t, "o_totalprice", 3, by="o_custkey").withColumn("part", F.lit("top3"))
    latest = PG.latest_results(t, "o_custkey", "o_orderdate").withColumn("part", F.lit("latest"))
    cols = ["o_custkey", "o_orderkey", "o_totalprice", "part"]
    return top.select(*cols).unionByName(latest.select(*cols))


@register(
    "order_filters",
    "F3,F5,F6,F7,U2",
    """with t as (select o_orderkey, o_custkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%d') d, o_orderkey % 100 opp from orders)
select o_orderkey, case when o_orderdate < date '1995-06-17' then 'before' else 'after' end side,
  o_custkey % 100 <> opp played, ltrim(lpad(cast(o_custkey as varchar), 8, '0'), '0') = '7' or ltrim(lpad(cast(opp as varchar), 8, '0'), '0') = '7' is_player, d = '1995-06-17' on_day
from t""",
)
def q_order_filters(spark, sf_dir):
    """Each order's side of a date, whether it drops out as played against itself, names player 7 or falls on a day:
    the filters' results put side by side by key."""
    t = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]).withColumns({
        "own": F.col("o_custkey") % 100, "opp": F.col("o_orderkey") % 100, "d": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "own_id": F.lpad(F.col("o_custkey").cast("string"), 8, "0"), "opp_id": F.lpad((F.col("o_orderkey") % 100).cast("string"), 8, "0")})
    before, after = PV.split_by_date(t, "o_orderdate", "1995-06-17")
    sides = S.union_all([before.select("o_orderkey", F.lit("before").alias("side")), after.select("o_orderkey", F.lit("after").alias("side"))])
    keys = t.select("o_orderkey")

    def flag(kept, name):
        return keys.join(kept.select("o_orderkey", F.lit(True).alias(name)), "o_orderkey", "left").select("o_orderkey", F.coalesce(name, F.lit(False)).alias(name))

    return S.join_by_row_key([sides, flag(PV.drop_unplayed(t, "own", "opp"), "played"), flag(PV.find_player(t, "007", ["own_id", "opp_id"]), "is_player"),
                              flag(PV.find_by_date(t, "d", "1995-06-17"), "on_day")], "o_orderkey")


@register(
    "mp_add_scores",
    "W10,A10,A11",
    with_fixtures(["board_results"], FREQ_CTE + """,
m as (select session_id, board, score_ns, cast(sum(n) as bigint) n from (select session_id, board, score_ns, n from freq union all select session_id, board, score_ns, n from freq) group by all),
t as (select session_id, board, sum(n) - 1 top, count(*) n_scores from m group by all)""",
                  """select m.session_id, m.board, m.score_ns, m.n, cast(t.top as bigint) top, t.n_scores,
  coalesce(sum(m.n) over (partition by m.session_id, m.board order by m.score_ns rows between unbounded preceding and 1 preceding), 0) + (m.n - 1) / 2.0 mp_ns
from m join t using (session_id, board)"""),
)
def q_mp_add_scores(spark, sf_dir):
    """Every board's score frequencies, expanded to results and added once more: matchpoints anew, and the board's lists and top."""
    freq = _freq_df(spark, sf_dir)
    k = ["session_id", "board"]
    again = mp.expand_frequency(freq).select(*k, "score_ns")
    merged = mp.add_scores(freq, again, k, "score_ns", "n")
    lists = merged.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct(F.col("score_ns").alias("score"), "n"))).alias("scores_of"))  # a board's distinct scores: few
    lists = S.split_frequency(lists, "scores_of").select(*k, "top", F.size("scores").cast("long").alias("n_scores"))
    return merged.join(lists, k).select(*k, "score_ns", "n", "top", "n_scores", "mp_ns")
