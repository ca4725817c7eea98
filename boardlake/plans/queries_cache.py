"""Registered cache / key-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as C
from ..session import read_table
from .registry import register


def _customers(spark, sf_dir):
    return read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])


def _order_summary(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"])
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal"), F.max("o_orderkey").alias("last_orderkey"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("max_filled_price"))


ORDER_SUMMARY_SQL = """os as (select o_custkey c_custkey, max(o_totalprice) c_acctbal, max(o_orderkey) last_orderkey,
    max(case when o_orderstatus = 'F' then o_totalprice end) max_filled_price from orders group by o_custkey)"""


@register(
    "cache_upsert",
    "J4",
    "with " + ORDER_SUMMARY_SQL + """
select coalesce(c.c_custkey, n.c_custkey) c_custkey, c.c_name, coalesce(n.c_acctbal, c.c_acctbal) c_acctbal, c.c_mktsegment,
  n.last_orderkey,
  case when c.c_custkey is null then 'added' when n.c_custkey is null then 'kept' else 'updated' end upsert_action
from customer c full outer join (select c_custkey, c_acctbal, last_orderkey from os) n on c.c_custkey = n.c_custkey""",
)
def q_cache_upsert(spark, sf_dir):
    """Customer cache updated with each customer's order summary: new non-null values win, new keys appended."""
    new = _order_summary(spark, sf_dir).select("c_custkey", "c_acctbal", "last_orderkey")
    return C.cache_upsert(_customers(spark, sf_dir), new, "c_custkey").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "last_orderkey", "upsert_action")


@register(
    "work_list",
    "J5,U3",
    "with " + ORDER_SUMMARY_SQL + """
select c_custkey, 'missing' reason from customer where c_custkey not in (select c_custkey from os)
union all
select c_custkey, 'null_value' reason from customer where c_custkey in (select c_custkey from os where max_filled_price is null)""",
)
def q_work_list(spark, sf_dir):
    """Customers still to process: no cached order summary, or a summary with a null value."""
    return C.work_list(_customers(spark, sf_dir), _order_summary(spark, sf_dir), "c_custkey", ["max_filled_price"])


@register(
    "newer_wins",
    "S11",
    """select user_id, ts, event_id, event_type, value, props from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc, event_type desc, value desc, props desc) rn
  from events) where rn = 1""",
)
def q_newer_wins(spark, sf_dir):
    """Newest event of every user (newest timestamp, then newest id): the newer-wins upsert rule."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_id", "event_type", "value", "props"])
    return C.upsert_newer_wins(ev, None, "user_id", ["ts", "event_id"]).select(
        "user_id", "ts", "event_id", "event_type", "value", "props")


@register(
    "only_unprocessed",
    "S12",
    """select o_orderkey, o_custkey, o_orderstatus from orders
where o_orderstatus in ('F', 'O') and o_orderkey not in (select l_orderkey from lineitem)""",
)
def q_only_unprocessed(spark, sf_dir):
    """Orders of the selected statuses with no line items yet (inputs without an output in the manifest)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    done = read_table(spark, sf_dir, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").alias("o_orderkey"))
    return C.only_unprocessed(o, done, "o_orderkey", "o_orderstatus", ["F", "O"])


@register(
    "key_sets",
    "U3,U4",
    """select cast(c_custkey as varchar) k, 'left_only' side from customer where c_custkey not in (select o_custkey from orders)
union all select cast(c_custkey as varchar), 'both' from customer where c_custkey in (select o_custkey from orders)
union all select cast(o_custkey as varchar), 'right_only' from (select distinct o_custkey from orders) where o_custkey not in (select c_custkey from customer)
union all select distinct o_orderpriority, 'name_left_only' from orders where o_orderpriority not in (select c_mktsegment from customer)
union all select distinct c_mktsegment, 'name_right_only' from customer where c_mktsegment not in (select o_orderpriority from orders)""",
)
def q_key_sets(spark, sf_dir):
    """Customer keys with and without orders, order keys without a customer, and names on one side only."""
    c = _customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("k"))
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority"])
    ok = o.select(F.col("o_custkey").cast("string").alias("k"))
    names = C.missing_names(o.select(F.col("o_orderpriority").alias("n")),
                            read_table(spark, sf_dir, "customer", ["c_mktsegment"]).select(F.col("c_mktsegment").alias("n")), "n")
    return (
        C.key_diff(c, ok, "k").withColumn("side", F.lit("left_only"))
        .unionByName(C.key_common(c, ok, "k").withColumn("side", F.lit("both")))
        .unionByName(C.key_diff(ok, c, "k").withColumn("side", F.lit("right_only")))
        .unionByName(names.select(F.col("name").alias("k"), F.concat(F.lit("name_"), F.col("only_in"), F.lit("_only")).alias("side")),
                     allowMissingColumns=False)
    )
