"""Registered bidding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bidding as B
from ..operators import hands as H
from ..sources import fixtures
from .oracle import with_fixtures
from .queries_hands import HF_BODY, HF_CTES
from .registry import register

HF = HF_CTES + ",\nhf as (" + HF_BODY + ")"


def _features(spark, sf_dir):
    return H.hand_features(fixtures.deals(spark, sf_dir))


@register(
    "rule_eval",
    "F9",
    with_fixtures(["deals"], HF, " union all ".join(
        f"select deal_id, direction, '{n}' rule, {B.rule_sql(t)} ok from hf" for n, t in B.RULES)),
)
def q_rule_eval(spark, sf_dir):
    """Every bidding rule evaluated for every hand of every deal."""
    return B.evaluate_rules(_features(spark, sf_dir))


@register(
    "bid_accept",
    "F10",
    with_fixtures(["deals"], HF, " union all ".join(
        f"select deal_id, direction, '{p}' prior_calls, '{b}' bid, '{','.join(c)}' criteria, "
        + (" and ".join(B.rule_sql(dict(B.RULES)[r]) for r in c) or "true") + " accepted from hf"
        for p, b, c in B.BIDS)),
)
def q_bid_accept(spark, sf_dir):
    """Whether each hand meets all criteria of each entry of the bidding table."""
    return B.bid_accepts(_features(spark, sf_dir))


AUCTION_SQL = with_fixtures(["auctions"], """c0 as (
  select deal_id, dealer, cast(pos as int) pos, upper(string_split(calls, '-')[pos + 1]) call
  from auctions, range(0, len(string_split(calls, '-'))) r(pos)),
c1 as (select *, substr('NESW', cast((strpos('NESW', dealer) - 1 + pos) % 4 as int) + 1, 1) seat,
    case when regexp_matches(call, '^[1-7][CDHSN]$') then (cast(substr(call, 1, 1) as int) - 1) * 5 + strpos('CDHSN', substr(call, 2, 1)) - 1 end rnk,
    regexp_matches(call, '^[1-7][CDHSN]$') is_bid, call = 'P' is_pass, call = 'D' is_dbl, call = 'R' is_rdbl from c0),
c2 as (select *,
    max(rnk) over (partition by deal_id order by pos rows between unbounded preceding and 1 preceding) max_before,
    last_value(case when not is_pass then call end ignore nulls) over (partition by deal_id order by pos rows between unbounded preceding and 1 preceding) last_action
  from c1),
c3 as (select *, case when is_bid then max_before is null or rnk > max_before
    when is_dbl then coalesce(regexp_matches(last_action, '^[1-7][CDHSN]$'), false)
    when is_rdbl then coalesce(last_action = 'D', false) else is_pass end legal from c2),
g as (select deal_id, count(*) n_calls, min(case when not legal then pos end) first_illegal_pos,
    arg_min(seat, case when is_bid then pos end) opener, arg_max(call, rnk) last_bid, max(case when is_bid then pos end) last_bid_pos,
    arg_max(seat, rnk) last_bid_seat, max(case when is_dbl then pos end) last_dbl_pos, max(case when is_rdbl then pos end) last_rdbl_pos,
    max(pos) last_pos
  from c3 group by deal_id),
d as (select c.deal_id, arg_min(c.seat, c.pos) declarer from c1 c join g using (deal_id)
  where c.is_bid and substr(c.call, 2, 1) = substr(g.last_bid, 2, 1) and (c.seat in ('N', 'S')) = (g.last_bid_seat in ('N', 'S'))
  group by c.deal_id),
f as (select g.*, d.declarer,
    case when last_rdbl_pos > last_bid_pos then 'XX' when last_dbl_pos > last_bid_pos then 'X' else '' end dbl,
    last_pos - greatest(last_bid_pos, coalesce(last_dbl_pos, -1), coalesce(last_rdbl_pos, -1)) passes_after
  from g left join d using (deal_id))""", """select deal_id, cast(n_calls as int) n_calls, cast(first_illegal_pos as int) first_illegal_pos,
  first_illegal_pos is null legal, opener,
  case when last_bid_pos is not null then last_bid end last_bid,
  case when last_bid_pos is not null then dbl end dbl,
  case when last_bid_pos is not null then declarer end declarer,
  case when last_bid_pos is null then n_calls = 4 else passes_after = 3 end completed,
  case when last_bid_pos is null then 'PASS' else concat(last_bid, dbl, declarer) end contract
from f""")


@register("auction_analysis", "W11", AUCTION_SQL)
def q_auction_analysis(spark, sf_dir):
    """Legality, opener, final contract, doubling, declarer and completion of every auction."""
    return B.analyse_auctions(fixtures.auctions(spark, sf_dir))


@register("auction_expand", "J11,F10")
def q_auction_expand(spark, sf_dir):
    """Auctions grown from the bidding table for every deal (iterative frontier join; no SQL oracle)."""
    feats = _features(spark, sf_dir)
    acc = B.bid_accepts(feats)
    dealer = fixtures.auctions(spark, sf_dir).select("deal_id", "dealer")
    return B.expand_auctions(feats, acc, dealer)


def _entries_sql() -> str:
    """The fixture's bidding table for DuckDB: entries and their criteria as (feature, least, most)."""
    rows = fixtures.bidding_entries()
    entries = ", ".join(f"({i}, '{prior}', '{bid}', {'true' if done else 'false'})" for i, prior, bid, _, done in rows)
    needs = ", ".join(f"({i}, '{f}', {lo}, {hi})" for i, _, _, criteria, _ in rows for f, lo, hi in criteria)
    return f"""bt(bt_id, prior_calls, bid, completed) as (values {entries}),
need(bt_id, feature, least, most) as (values {needs}),
up as (select b.*, p.bt_id up_id from bt b left join bt p
  on len(string_split(b.prior_calls, '-')) > 1 and b.prior_calls = case when p.prior_calls = '' then p.bid else p.prior_calls || '-' || p.bid end),
chain as (select bt_id, bt_id node from bt union all select c.bt_id, u.up_id from chain c join up u on u.bt_id = c.node where u.up_id is not null),
paths as (select distinct c.bt_id, feature, least, most from chain c join need on need.bt_id = c.node),
wanted as (select bt_id, count(*) n from paths group by bt_id),
long as (select deal_id, direction, feature, v from (unpivot (select deal_id, direction, cast("HCP" as int) "HCP", cast("SL_S" as int) "SL_S", cast("SL_H" as int) "SL_H",
  cast("SL_D" as int) "SL_D", cast("SL_C" as int) "SL_C" from hf) on "HCP", "SL_S", "SL_H", "SL_D", "SL_C" into name feature value v)),
hits as (select deal_id, direction, bt_id, count(*) n from long join paths using (feature) where v between least and most group by all),
acc as materialized (select deal_id, direction, bt_id from hits join wanted using (bt_id, n)
  union all select deal_id, direction, bt_id from hf, bt where bt_id not in (select bt_id from wanted))"""


def _recursive(sql: str) -> str:
    return "with recursive " + sql.removeprefix("with ")


@register(
    "bid_outcomes",
    "F9,F10",
    _recursive(with_fixtures(["deals"], HF + ",\n" + _entries_sql(), """
select b.bt_id, b.prior_calls, b.bid, d.direction, count(a.deal_id) n_accepted
from bt b cross join (values ('N'), ('E'), ('S'), ('W')) d(direction) left join acc a on a.bt_id = b.bt_id and a.direction = d.direction
group by all""")),
)
def q_bid_outcomes(spark, sf_dir):
    """How many hands of each direction meet each entry of a bidding table, its prior bids' criteria included."""
    table = fixtures.bidding_table(spark)
    got = B.bid_outcomes(_features(spark, sf_dir), table).groupBy("bt_id", "direction").agg(F.count("*").alias("n_accepted"))
    every = table.select("bt_id", "prior_calls", "bid", F.explode(F.array(*[F.lit(d) for d in "NESW"])).alias("direction"))
    return every.join(got, ["bt_id", "direction"], "left").select("bt_id", "prior_calls", "bid", "direction", F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"))


@register(
    "auction_tree",
    "J11,F10",
    _recursive(with_fixtures(["deals", "boards"], HF + ",\n" + _entries_sql() + """,
can as materialized (select a.deal_id, a.direction, b.prior_calls, b.bid, b.bt_id, b.completed from acc a join bt b using (bt_id)
  where case when prior_calls = '' then bid else prior_calls || '-' || bid end not in ('3N', 'p-3N', 'p-p-2C')),
grown as (
  select deal_id, (board - 1) % 4 seat, '' calls, cast([] as int[]) bt_ids, false done, false completed_by_table from boards
  union all
  select g.deal_id, (g.seat + 1) % 4, n.calls, case when c.bt_id is null then g.bt_ids else list_append(g.bt_ids, c.bt_id) end,
    coalesce(c.completed, false) or n.calls = 'p-p-p-p' or regexp_matches(n.calls, '[1-7].*-p-p-p$'), coalesce(c.completed, false)
  from grown g left join can c on c.deal_id = g.deal_id and c.direction = substr('NESW', cast(g.seat as int) + 1, 1) and c.prior_calls = g.calls,
    lateral (select case when g.calls = '' then '' else g.calls || '-' end || coalesce(c.bid, 'p') calls) n
  where not g.done)""", "select deal_id, calls, array_to_string(bt_ids, ',') bt_ids, completed_by_table from grown where done")),
)
def q_auction_tree(spark, sf_dir):
    """Every auction that each deal can have by a bidding table, with the entries it went through."""
    dealers = fixtures.auctions(spark, sf_dir).select("deal_id", "dealer")
    out = B.expand_by_table(_features(spark, sf_dir), fixtures.bidding_table(spark), dealers, bogus=fixtures.BOGUS_SEQUENCES)
    return out.withColumn("bt_ids", F.array_join("bt_ids", ","))
