"""Registered filter / perspective / summary / SQL / model-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contracts
from ..operators import perspective as P
from ..operators import predict as M
from ..operators import summary as S
from ..session import read_table
from ..sources import fixtures
from .boards import scored_results
from .oracle import sql_scored_results, with_fixtures
from .pipeline import PLAYERS
from .registry import register

SCORED = with_fixtures(["board_results"], sql_scored_results(), "{body}")


def _scored(spark, sf_dir):
    return scored_results(fixtures.board_results(spark, sf_dir))


@register(
    "board_filter",
    "F1,C4",
    SCORED.replace("{body}", """select session_id, board, l_orderkey, l_linenumber, contract,
  case when level = 7 then 'GSlam' when level = 6 then 'SSlam' when strain = 'N' and level >= 3 then 'Game'
       when strain in ('H','S') and level >= 4 then 'Game' when strain in ('C','D') and level >= 5 then 'Game' else 'Partial' end contract_type
from scored where vul_ns and vul_ew and declarer_pair = 'NS' and strain in ('S', 'H', 'N') and dbl in ('', 'X')
  and (case when level = 7 then 'GSlam' when level = 6 then 'SSlam' when strain = 'N' and level >= 3 then 'Game'
       when strain in ('H','S') and level >= 4 then 'Game' when strain in ('C','D') and level >= 5 then 'Game' else 'Partial' end)
      in ('Game', 'SSlam', 'GSlam')"""),
)
def q_board_filter(spark, sf_dir):
    """Results on boards with both sides vulnerable, NS declaring a major or notrump game or slam, not redoubled."""
    df = _scored(spark, sf_dir).filter(F.col("level").isNotNull())
    df = df.withColumn("contract_type", contracts.contract_type("level", "strain"))
    out = P.filter_boards(df, vul="Both", side="NS", suits="SHN", types=["Game", "SSlam", "GSlam"], doubles=["", "X"])
    return out.select("session_id", "board", "l_orderkey", "l_linenumber", "contract", "contract_type")


PERSPECTIVE_SQL = SCORED.replace("{body}", """select session_id, board, l_orderkey, l_linenumber, contract, declarer_id,
  '{seat}' player_seat, i_played boards_i_played, i_decl boards_i_declared, p_decl boards_partner_declared,
  coalesce(i_decl, false) or coalesce(p_decl, false) boards_we_declared,
  i_played and not (coalesce(i_decl, false) or coalesce(p_decl, false)) and contract <> 'PASS' boards_opponent_declared
from (select *, player_n = 'N7' i_played, declarer_id = 'N7' i_decl, declarer_id = 'S7' p_decl from (
  select *, case declarer when 'N' then player_n when 'E' then player_e when 'S' then player_s when 'W' then player_w end declarer_id
  from scored))""").replace("'{seat}'", """(select case when max(player_n = 'N7') then 'N' when max(player_e = 'N7') then 'E'
    when max(player_s = 'N7') then 'S' when max(player_w = 'N7') then 'W' end from board_results)""")


@register("perspective", "F2,C3", PERSPECTIVE_SQL)
def q_perspective(spark, sf_dir):
    """Player N7's view of every result: boards played, declared by me / partner S7 / opponents."""
    df = contracts.with_seats(_scored(spark, sf_dir), "declarer", PLAYERS)
    out = P.perspective(df, "N7", "S7", PLAYERS)
    return out.select("session_id", "board", "l_orderkey", "l_linenumber", "contract", "declarer_id", "player_seat",
                      "boards_i_played", "boards_i_declared", "boards_partner_declared", "boards_we_declared",
                      "boards_opponent_declared")


SUMMARY_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "summarize",
    "A12,Q4",
    " union all ".join(
        f"""select l_returnflag, count({c}) count, cast(sum(case when {c} is null then 1 else 0 end) as bigint) nulls,
  round(avg({c}), 6) mean, round(stddev_samp({c}), 6) std, min({c}) min,
  round(quantile_cont({c}, 0.25), 6) q25, round(quantile_cont({c}, 0.5), 6) q50, round(quantile_cont({c}, 0.75), 6) q75,
  max({c}) max, '{c}' "column" from lineitem group by l_returnflag""" for c in SUMMARY_COLS),
)
def q_summarize(spark, sf_dir):
    """Count, nulls, mean, std, min, quartiles and max of the line-item measures per return flag."""
    li = read_table(spark, sf_dir, "lineitem", ["l_returnflag", *SUMMARY_COLS])
    return S.describe(li, SUMMARY_COLS, by="l_returnflag")


@register(
    "side_compare",
    "A13,A14",
    SCORED.replace("{body}", """select session_id, cast(sum(score_ns) as bigint) score_ns_sum, cast(sum(case when score_ns > 0 then 1 else 0 end) as bigint) score_ns_gt0,
  cast(sum(case when score_ns < 0 then 1 else 0 end) as bigint) score_ns_lt0, count(*) n, count(distinct contract) distinct_contract
from scored group by session_id"""),
)
def q_side_compare(spark, sf_dir):
    """Per session: NS score sum, how often NS scored plus / minus, results and distinct contracts."""
    df = _scored(spark, sf_dir)
    a = S.compare_sides(df, "score_ns", by="session_id")
    b = S.counts(df, "session_id", distinct_col="contract")
    return a.join(b, "session_id")


REPORT_SQL = "SELECT board, count(*) AS n, round(avg(score_ns), 6) AS avg_ns WHERE declarer_pair = '{Pair_Direction}' GROUP BY board"


@register(
    "self_query",
    "Q1,Q2,Q3",
    SCORED.replace("{body}", "select board, count(*) n, round(avg(score_ns), 6) avg_ns from scored where declarer_pair = 'NS' group by board"),
)
def q_self_query(spark, sf_dir):
    """User SQL with a direction macro, run against the scored results registered as 'self'."""
    rep = S.run_report(_scored(spark, sf_dir), [("by_board", [REPORT_SQL])], {"Pair_Direction": "NS", "Opponent_Pair_Direction": None})
    return rep["by_board"][0]


@register(
    "session_normalise",
    "W9",
    """with m1 as (select l_suppkey, avg(l_discount) m1 from lineitem group by l_suppkey),
a as (select l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_discount, least(1.0, greatest(0.0, l.l_discount - m1.m1 + 0.5)) adj
  from lineitem l join m1 using (l_suppkey)),
m2 as (select l_suppkey, avg(adj) m2 from a group by l_suppkey)
select l_orderkey, l_linenumber, l_suppkey, l_discount,
  round(case when abs(m2 - 0.5) > 1e-6 then least(1.0, greatest(0.0, 0.5 + (adj - 0.5) * (0.5 / m2))) else adj end, 6) l_discount_norm
from a join m2 using (l_suppkey)""",
)
def q_session_normalise(spark, sf_dir):
    """Discounts normalised per supplier session so each session's mean is 0.5 (clipped to [0, 1])."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_discount"])
    out = M.normalise_by_session(li, "l_discount", "l_suppkey")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount", F.round("l_discount_norm", 6).alias("l_discount_norm"))


@register(
    "errors",
    "A16",
    """with d as (select l_returnflag, l_extendedprice * (1 - l_discount) pred, l_extendedprice actual from lineitem),
g as (select l_returnflag, avg(actual) ybar from d group by l_returnflag),
o as (select avg(actual) ybar from d)
select d.l_returnflag, count(*) n, round(sqrt(avg((pred - actual) * (pred - actual))), 6) rmse, round(avg(abs(pred - actual)), 6) mae,
  round(1 - sum((pred - actual) * (pred - actual)) / nullif(sum((actual - ybar) * (actual - ybar)), 0), 6) r2
from d join g using (l_returnflag) group by d.l_returnflag
union all
select null, count(*), round(sqrt(avg((pred - actual) * (pred - actual))), 6), round(avg(abs(pred - actual)), 6),
  round(1 - sum((pred - actual) * (pred - actual)) / nullif(sum((actual - ybar) * (actual - ybar)), 0), 6)
from d, o""",
)
def q_errors(spark, sf_dir):
    """RMSE, MAE and R^2 of discounted price as a predictor of list price, per return flag and overall."""
    li = read_table(spark, sf_dir, "lineitem", ["l_returnflag", "l_extendedprice", "l_discount"])
    d = li.select("l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred"),
                  F.col("l_extendedprice").alias("actual"))
    return M.error_metrics(d, "pred", "actual", by="l_returnflag").select("l_returnflag", "n", "rmse", "mae", "r2")


@register(
    "label_encode",
    "M2",
    """with v as (select distinct coalesce(c_mktsegment, 'MISSING_CAT') value from customer union select 'MISSING_CAT'),
lab as (select value, cast(row_number() over (order by value) - 1 as int) code from v)
select c_custkey, c_mktsegment, coalesce(code, 0) c_mktsegment_code
from customer left join lab on coalesce(c_mktsegment, 'MISSING_CAT') = lab.value""",
)
def q_label_encode(spark, sf_dir):
    """Market segment of every customer as a sorted-class label code (missing token included)."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    return M.apply_labels(c, "c_mktsegment", M.fit_labels(c, "c_mktsegment")).select("c_custkey", "c_mktsegment", "c_mktsegment_code")


@register(
    "standardise",
    "M3",
    """with s0 as (select quantile_cont(c_acctbal, 0.5) median from customer),
f as (select c_custkey, c_acctbal, coalesce(c_acctbal, median) x from customer, s0),
s as (select avg(x) mean, stddev_pop(x) std from f)
select c_custkey, c_acctbal, round((x - mean) / nullif(std, 0), 6) c_acctbal_scaled from f, s""",
)
def q_standardise(spark, sf_dir):
    """Account balances median-filled and standardised (population std)."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    out = M.apply_scaler(c, "c_acctbal", M.fit_scaler(c, "c_acctbal"))
    return out.select("c_custkey", "c_acctbal", F.round("c_acctbal_scaled", 6).alias("c_acctbal_scaled"))


@register(
    "split_train",
    "M4",
    """select c_custkey, c_mktsegment, case when row_number() over (partition by c_mktsegment order by md5(c_custkey || '|42'))
    <= floor(count(*) over (partition by c_mktsegment) * 0.2 + 0.5) then 'valid' else 'train' end split from customer""",
)
def q_split_train(spark, sf_dir):
    """Validation split of customers: exactly 20 % of every segment, by md5 of the key."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    return M.split_train(c, 0.2, "c_custkey", seed=42, stratum="c_mktsegment")


@register(
    "predictions",
    "M1,M5",
    """with v as (select distinct coalesce(c_mktsegment, 'MISSING_CAT') value from customer union select 'MISSING_CAT'),
lab as (select value, cast(row_number() over (order by value) - 1 as int) code from v),
p as (select c_custkey, c_mktsegment, cast(c_custkey % 8 as int) pred_code from customer)
select c_custkey, c_mktsegment, pred_code, a.code actual_code, l.value pred_label, coalesce(l.value = coalesce(c_mktsegment, 'MISSING_CAT'), false) "match", pred_code = a.code match_code
from p join lab a on a.value = coalesce(c_mktsegment, 'MISSING_CAT') left join lab l on l.code = pred_code""",
)
def q_predictions(spark, sf_dir):
    """Predicted segment codes of the customers (some of no class) with labels, actual codes and matches."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    (target,) = M.split_columns(c, "c_custkey")["categorical"]
    p = c.withColumn("pred_code", (F.col("c_custkey") % 8).cast("int"))
    out = M.prediction_labels(p, "pred_code", target, M.fit_labels(c, target))
    return out.select("c_custkey", "c_mktsegment", "pred_code", "actual_code", "pred_label", "match", "match_code")


@register(
    "constraints",
    "M6,W9",
    """with s as (select l_suppkey, avg(l_discount) m1 from lineitem group by l_suppkey),
d as (select 'normalised' kind, l_suppkey, l_discount - m1 + 0.5 ns, 1 - (l_discount - m1 + 0.5) ew from lineitem join s using (l_suppkey)
  union all select 'raw', l_suppkey, l_discount, 1 - l_discount - l_tax from lineitem),
g as (select kind, l_suppkey, max(abs(ns + ew - 1)) r, greatest(abs(avg(ns) - 0.5), abs(avg(ew) - 0.5)) dev from d group by kind, l_suppkey),
o as (select kind, count(*) n, round(avg(ns), 6) ns_mean, round(avg(ew), 6) ew_mean from d group by kind)
select kind, cast(max(n) as bigint) "rows", count(*) sessions, round(max(r), 6) max_row_sum_error, round(max(dev), 6) max_session_dev,
  cast(sum(case when r >= 1e-10 then 1 else 0 end) as bigint) sessions_with_bad_rows, cast(sum(case when dev >= 1e-6 then 1 else 0 end) as bigint) sessions_off_mean,
  max(ns_mean) ns_mean, max(ew_mean) ew_mean, max(r) < 1e-10 row_sums_ok, max(dev) < 1e-6 session_means_ok
from g join o using (kind) group by kind""",
)
def q_constraints(spark, sf_dir):
    """Row sums and session means of normalised shares, which keep the constraints, and of raw ones, which do not."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_discount", "l_tax"])
    norm = M.normalise_by_session(li, "l_discount", "l_suppkey", "ns").withColumn("ew", 1 - F.col("ns"))
    raw = li.withColumns({"ns": F.col("l_discount"), "ew": 1 - F.col("l_discount") - F.col("l_tax")})
    got = [M.constraint_report(d, "ns", "ew", "l_suppkey").withColumn("kind", F.lit(k)) for k, d in (("normalised", norm), ("raw", raw))]
    rounded = {c: F.round(c, 6) for c in ("max_row_sum_error", "max_session_dev", "ns_mean", "ew_mean")}
    return got[0].unionByName(got[1]).withColumns(rounded)


PROFILE_COLS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


@register(
    "summarize_table",
    "Q4",
    " union all ".join(f"""select '{c}' column_name, count({c}) "count", round((count(*) - count({c})) / count(*) * 100, 6) null_percentage,
  """ + ("cast(null as double) avg, cast(null as double) std" if c in ("l_returnflag", "l_linestatus") else f"round(avg({c}), 8) avg, round(stddev_samp({c}), 8) std")
                       + f""", true unique_near, {'cast(null as boolean)' if c in ("l_returnflag", "l_linestatus") else 'true'} median_near from lineitem""" for c in PROFILE_COLS),
)
def q_summarize_table(spark, sf_dir):
    """Profile of the line items, every column in one scan; the two sketched values as whether they keep their stated bounds
    (a distinct count within four standard errors, a median whose rank is off by at most rows / accuracy)."""
    li = read_table(spark, sf_dir, "lineitem", PROFILE_COLS)
    got = S.summarize(li, digits=8)
    exact = li.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"u_{c}") for c in PROFILE_COLS])
    got = got.crossJoin(F.broadcast(exact))  # one row
    unique = F.element_at(F.create_map(*[x for c in PROFILE_COLS for x in (F.lit(c), F.col(f"u_{c}"))]), F.col("column_name"))
    mids = got.select(F.col("column_name").alias("_c"), F.col("q50").alias("_m")).where("_m is not null")
    long = li.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_x")) for c in PROFILE_COLS if not c.endswith(("flag", "status"))])))
    ranks = long.join(F.broadcast(mids), F.col("_name") == F.col("_c")).groupBy("_c").agg(
        F.count_if(F.col("_x") < F.col("_m")).alias("_lt"), F.count_if(F.col("_x") <= F.col("_m")).alias("_le"))
    slack = F.col("n") / 10_000 + 1
    near = (F.col("_lt") <= F.col("n") / 2 + slack) & (F.col("_le") >= F.col("n") / 2 - slack)
    return got.join(ranks, F.col("column_name") == F.col("_c"), "left").select(
        "column_name", "count", "null_percentage", "avg", "std", (F.abs(F.col("approx_unique") - unique) <= 4 * 0.02 * unique + 1).alias("unique_near"), near.alias("median_near"))


@register(
    "deal_quality",
    "F4,P18",
    with_fixtures(["deals"], """c0 as (
  select deal_id, substr('NESW', i + 1, 1) direction, substr('SHDC', j + 1, 1) suit,
    string_split(string_split(substr(pbn, 3), ' ')[i + 1], '.')[j + 1] x
  from deals, range(0, 4) t(i), range(0, 4) u(j)),
c1 as (select deal_id, direction, suit, unnest(string_split(x, '')) rnk from c0 where x <> ''),
per_deal as (select deal_id, count(*) = 52 and count(distinct suit || rnk) = 52 ok52 from c1 group by deal_id),
per_hand as (select deal_id, min(n) = 13 and max(n) = 13 and count(*) = 4 ok13 from
    (select deal_id, direction, count(*) n from c1 group by all) group by deal_id),
chk as (select d.deal_id, d.pbn, coalesce(substr(d.pbn, 1, 2) = 'N:' and len(string_split(substr(d.pbn, 3), ' ')) = 4
    and pd.ok52 and ph.ok13, false) valid
  from deals d left join per_deal pd using (deal_id) left join per_hand ph using (deal_id))""",
        """select count(*) "rows", cast(sum(case when pbn is null then 1 else 0 end) as bigint) null_deals,
  cast(sum(case when length(pbn) <> 69 then 1 else 0 end) as bigint) bad_length,
  cast(sum(case when not valid then 1 else 0 end) as bigint) invalid_deals from chk"""),
)
def q_deal_quality(spark, sf_dir):
    """Null, wrong-length and invalid (not one full deck, not 13 cards a hand) deal counts over all deals."""
    return P.quality_report(fixtures.deals(spark, sf_dir))
