"""Registered queries of score-table and LIN feeds, frequency texts, histories, and the table operators around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codings as CD
from ..operators import cache as C
from ..operators import matchpoints as mp
from ..operators import perspective as PV
from ..operators import summary as S
from ..session import not_broadcast
from ..sources import board_text as BT
from ..sources import fixtures
from ..sources import pages as PG
from .boards import scored_results, with_board_facts
from .oracle import sql_scored_results, with_fixtures
from .registry import register


def _results(spark, sf_dir):
    return scored_results(fixtures.board_results(spark, sf_dir))


PLAYER_IDS = ", ".join(f"cast(l_{k} % 14 + 1 as varchar) || '_{d}' player_id_{d.lower()}" for d, k in zip("NESW", ("partkey", "orderkey") * 2))


@register(
    "score_table_feed",
    "S5,C16,P2,P3",
    with_fixtures(["board_results"], sql_scored_results(), """select session_id, board, dealer, vul,
  cast(row_number() over (partition by session_id, board order by l_orderkey, l_linenumber, l_partkey, tricks nulls first) - 1 as int) row_index, contract, tricks, result,
  cast(l_partkey % 14 + 1 as varchar) pair_number_ns, cast(l_orderkey % 14 + 1 as varchar) pair_number_ew, """ + PLAYER_IDS + " from scored"),
)
def q_score_table_feed(spark, sf_dir):
    """Boards with nested result lists (contracts as '3NT+1', no tricks for a pass) as canonical results."""
    res = _results(spark, sf_dir)
    suffix = F.when(F.col("result") > 0, F.concat(F.lit("+"), "result")).when(F.col("result") < 0, F.col("result").cast("string")).otherwise("=")
    text = F.when(F.col("contract") == "PASS", "Pass").otherwise(F.concat(F.col("level").cast("string"), F.when(F.col("strain") == "N", "NT").otherwise(F.col("strain")), "dbl", F.coalesce(suffix, F.lit(""))))
    entry = F.struct("l_orderkey", "l_linenumber", "l_partkey", "tricks", text.alias("contract"), F.col("declarer"), F.coalesce(F.col("tricks").cast("string"), F.lit("-")).alias("result"),
                     (F.col("l_partkey") % 14 + 1).alias("pair_id_ns"), (F.col("l_orderkey") % 14 + 1).alias("pair_id_ew"))
    nested = res.groupBy("session_id", "board").agg(F.sort_array(F.collect_list(entry)).alias("score_table"))
    out = BT.canonical_from_score_table(with_board_facts(nested), ["session_id", "board"])
    return out.select("session_id", "board", "dealer", "vul", "row_index", "contract", "tricks", "result", "pair_number_ns", "pair_number_ew",
                      *[f"player_id_{d}" for d in "nesw"])


@register(
    "lin_feed",
    "S2,C16,P2,P3,P20",
    with_fixtures(["deals", "auctions", "boards"], "", """select a.deal_id, b.board, a.dealer, d.pbn,
  case when bid = 'PASS' then 'PASS' else bid || dbl || substr('NESW', cast((strpos('NESW', a.dealer) - 1 + turns) % 4 + 1 as int), 1) end contract,
  cast(a.deal_id % 14 as int) tricks, case when bid <> 'PASS' then cast(a.deal_id % 14 - 6 - cast(substr(bid, 1, 1) as int) as int) end result
from auctions a join boards b using (deal_id) join deals d using (deal_id)
join (values (0, '2S', '', 2), (1, 'PASS', '', 0), (2, '1N', 'XX', 0), (3, '3C', '', 2), (4, '1H', '', 1), (5, '3N', '', 1), (6, '4S', 'X', 3)) t(k, bid, dbl, turns)
  on a.deal_id % 7 = k"""),
)
def q_lin_feed(spark, sf_dir):
    """Every deal written as a LIN line with its auction and claim, read back as a canonical result.  The oracle states the contract of each auction by hand."""
    a = fixtures.auctions(spark, sf_dir)
    j = a.join(not_broadcast(with_board_facts(fixtures.boards(spark, sf_dir)).select("deal_id", "board", "vul")), "deal_id").join(not_broadcast(fixtures.deals(spark, sf_dir)), "deal_id")
    line = BT.render_lin(F.col("dealer"), F.col("pbn"), F.lit("o"), F.col("board"), F.col("calls"))
    lines = j.select("deal_id", F.concat(line, F.lit("mc|"), (F.col("deal_id") % 14).cast("string"), F.lit("|")).alias("value"))
    return BT.canonical_from_lin(BT.parse_lin(lines, "value")).select("deal_id", "board", "dealer", "pbn", "contract", "tricks", "result")


@register(
    "frequency_lines",
    "S19",
    with_fixtures(["board_results"], sql_scored_results() + """,
f as (select session_id, board, score_ns, count(*) n from scored where score_ns is not null group by all)""",
                  """select session_id * 100 + board page_id, cast(score_ns as double) score, cast(n as double) frequency, cast(n * 1.5 as double) mp_ns, 0.25::double mp_ew
from f where abs(score_ns) <= 2000"""),
)
def q_frequency_lines(spark, sf_dir):
    """Every board's score frequencies as the text of a page (by size of score, the first one twice, then other text), read back."""
    f = mp.score_frequency(_results(spark, sf_dir), ["session_id", "board"], "score_ns")
    group = F.concat_ws("\n", F.col("score_ns").cast("string"), F.concat(F.lit(" "), F.col("n").cast("string")), F.replace((F.col("n") * 1.5).cast("string"), F.lit("."), F.lit(",")), F.lit("0,25"))
    f = f.withColumn("_g", F.struct(F.abs("score_ns").alias("size"), "score_ns", group.alias("text")))
    p = f.groupBy((F.col("session_id") * 100 + F.col("board")).alias("page_id")).agg(F.sort_array(F.collect_list(F.when(F.col("score_ns").isNotNull(), F.col("_g")))).alias("_g"))
    # the first record again with another frequency: the first one counts
    again = F.regexp_replace(F.get("_g", F.lit(0))["text"], r"\n .*", "\n99")
    texts = F.transform("_g", lambda g: g["text"])
    body = F.array_join(F.concat(F.slice(texts, 1, 1), F.array(again), F.slice(texts, 2, F.size(texts))), "\n")
    p = p.withColumn("text", F.concat(F.lit("Score\nof the day\n  Score\nNb\ntop NS\ntop EO\n"), body, F.lit("\nend\n1\n2\n3\n100\n1\n1\n1")))
    return PG.lines_to_records(p, "text", ["Score", "Nb", "top NS", "top EO"])


@register(
    "derived_values",
    "J1,J2,C11,C15",
    with_fixtures(["board_results", "boards", "deals", "par_scores"], sql_scored_results(), """select session_id, board, l_orderkey, l_linenumber, score_ns, par_ns, score_ns - par_ns score_par_diff
from scored join boards using (session_id, board) join deals using (deal_id) join par_scores using (deal_id) where deal_id % 5 <> 0"""),
)
def q_derived_values(spark, sf_dir):
    """Results with the stored par of their (deal, dealer, vulnerability), under legacy names; deals that are not stored drop out."""
    b = with_board_facts(fixtures.boards(spark, sf_dir)).join(not_broadcast(fixtures.deals(spark, sf_dir)), "deal_id")
    stored = b.join(not_broadcast(fixtures.par_scores(spark, sf_dir)), "deal_id").where("deal_id % 5 <> 0").select(F.col("pbn").alias("PBN"), F.col("dealer").alias("Dealer"), F.col("vul").alias("Vul"), "par_ns")
    res = _results(spark, sf_dir).drop("dealer", "vul").join(not_broadcast(b.select("session_id", "board", "pbn", "dealer", "vul")), ["session_id", "board"])
    out = C.attach_derived(res, CD.rename_legacy(stored))
    return out.select("session_id", "board", "l_orderkey", "l_linenumber", "score_ns", "par_ns", (F.col("score_ns") - F.col("par_ns")).alias("score_par_diff"))


TEAM_SQL = ", ".join(f"cast(coalesce(sum(case when {c} then score_ns end), 0) as bigint) sum_{t}, count(case when {c} and score_ns > 0 then 1 end) gt_{t}, count(case when {c} and score_ns < 0 then 1 end) lt_{t}"
                     for t, c in (("all", "true"), ("a", "l_partkey % 3 = 1"), ("b", "l_partkey % 3 = 2")))


@register(
    "team_sides",
    "A13",
    with_fixtures(["board_results"], sql_scored_results() + f", g as (select session_id, {TEAM_SQL} from scored group by session_id)",
                  "\nunion all\n".join(f"select session_id, 'score_ns' as \"column\", '{t.replace('_', '')}' team, sum_{t.strip('_')} \"sum\", gt_{t.strip('_')} gt0, lt_{t.strip('_')} lt0 from g" for t in ("all",))
                  + "\nunion all select session_id, 'score_ns', 'A', sum_a, gt_a, lt_a from g\nunion all select session_id, 'score_ns', 'B', sum_b, gt_b, lt_b from g"
                  + "\nunion all select session_id, 'score_ns', 'A-B', sum_a - sum_b, gt_a - gt_b, lt_a - lt_b from g"),
)
def q_team_sides(spark, sf_dir):
    """Scores of two teams (and of rows of neither) per session: sums, gains and losses, and their differences."""
    team = F.when(F.col("l_partkey") % 3 == 1, True).when(F.col("l_partkey") % 3 == 2, False)
    return S.compare_teams(_results(spark, sf_dir), ["score_ns"], team, "session_id")


@register(
    "score_lists",
    "A15",
    with_fixtures(["board_results"], sql_scored_results() + ", f as (select session_id, board, score_ns, count(*) n from scored where score_ns is not null group by all)",
                  "select session_id, board, string_agg(score_ns || 'x' || n, ' ' order by score_ns) scores, cast(sum(n) as bigint) n_results from f group by session_id, board"),
)
def q_score_lists(spark, sf_dir):
    """Every board's scores with their counts, in order."""
    lists = S.score_lists(_results(spark, sf_dir), ["session_id", "board"], "score_ns")
    lists = lists.withColumn("scores", F.filter("scores", lambda x: x["score"].isNotNull())).where(F.size("scores") > 0)
    return lists.select("session_id", "board", F.array_join(F.transform("scores", lambda x: F.concat(x["score"].cast("string"), F.lit("x"), x["n"].cast("string"))), " ").alias("scores"),
                        F.aggregate("scores", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_results"))


@register(
    "history_check",
    "S23",
    """with o as (select o_custkey, o_orderkey, case o_orderkey % 11 when 0 then 'tmp:' || o_orderkey when 1 then '#' || o_orderkey else cast(o_orderkey as varchar) end id from orders)
select cast(o_custkey as bigint) custkey, count(case when o_orderkey % 11 > 1 then 1 end) seen, cast(max(n) as bigint) total, count(case when o_orderkey % 11 > 1 then 1 end) >= max(n) complete
from (select *, count(*) over (partition by o_custkey) - (o_custkey % 2) n from o) group by o_custkey having count(case when o_orderkey % 11 > 1 then 1 end) > 0""",
)
def q_history_check(spark, sf_dir):
    """Customers' histories as pages of orders with an announced total, against the sessions seen (temporary ids left out)."""
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").select(F.col("o_custkey").cast("long").alias("custkey"), F.col("o_orderkey").alias("k"))
    rest = F.col("k") % 11
    entry = F.struct(F.concat(F.when(rest == 0, "tmp:").when(rest == 1, "#").otherwise(""), F.col("k").cast("string")).alias("id"))
    totals = o.groupBy("custkey").agg((F.count(F.lit(1)) - F.col("custkey") % 2).alias("total"))
    pages = o.groupBy("custkey", (F.col("k") % 3).alias("page")).agg(F.collect_list(entry).alias("data")).join(totals, "custkey")
    return BT.history_pages(pages, "data", "total", "custkey")[1]


@register(
    "relaxed_union",
    "U1,J4,F8",
    """with a as (select cast(c_custkey as integer) k, cast(c_custkey % 7 as integer) v, cast(null as varchar) w, 'int' src from customer where c_custkey % 2 = 0),
b as (select cast(c_custkey as integer) k, c_acctbal v, cast(c_custkey % 5 as varchar) w, 'double' src from customer where c_custkey % 3 = 0)
select cast(k as bigint) k, cast(v as double) v, w, src, k % 4 <> 2 or src = 'double' team_exists from (select k, cast(v as double) v, w, src from a union all select k, cast(v as double), w, src from b)""",
)
def q_relaxed_union(spark, sf_dir):
    """Two frames whose columns have other types and names, one below the other; and which (kind, key) a third frame has."""
    c = spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    a = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("int").alias("k"), (F.col("c_custkey") % 7).cast("int").alias("v"), F.lit("int").alias("src"))
    b = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 5).cast("string").alias("w"), F.lit("double").alias("src"))
    u = S.union_relaxed([a, b])
    there = u.where("k % 4 <> 2 or src = 'double'").select("src", "k")
    return PV.team_exists(there, u, "src", "k")
