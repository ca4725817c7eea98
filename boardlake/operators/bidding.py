"""Bidding rules and auctions.

Rules are SQL predicates over hand features (``HCP >= 12``, ``10 <= HCP <= 15``, ...).  A
rule table is a small vocabulary; each rule becomes one boolean Column and all rules are
evaluated on the hand's own row -- no join, no shuffle -- then turned into long rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, not_broadcast

# fixed values of the fixture's rule table and bidding table
RULES = (
    ("hcp_12", "HCP >= 12"),
    ("hcp_10_15", "10 <= HCP <= 15"),
    ("hcp_15_17", "15 <= HCP <= 17"),
    ("sl_s_5", "SL_S >= 5"),
    ("sl_h_5", "SL_H >= 5"),
    ("sl_d_4", "SL_D >= 4"),
    ("sl_c_3", "SL_C >= 3"),
    ("qt_2", "QT >= 2"),
    ("balanced", "Balanced"),
    ("tp_22", "Total_Points >= 22"),
    ("hcp_lt_12", "HCP < 12"),
)
BIDS = (
    ("", "1N", ("hcp_15_17", "balanced")),
    ("", "1S", ("hcp_12", "sl_s_5")),
    ("", "1H", ("hcp_12", "sl_h_5")),
    ("", "1D", ("hcp_12", "sl_d_4")),
    ("", "1C", ("hcp_12", "sl_c_3")),
    ("", "2C", ("tp_22",)),
    ("", "p", ("hcp_lt_12",)),
    ("p", "1N", ("hcp_15_17", "balanced")),
    ("p", "1S", ("hcp_12", "sl_s_5")),
    ("p", "1H", ("hcp_12", "sl_h_5")),
    ("p", "p", ("hcp_lt_12",)),
    ("p-p", "1S", ("hcp_10_15", "sl_s_5")),
    ("p-p", "p", ("hcp_lt_12",)),
    ("p-p-p", "1S", ("hcp_10_15", "sl_s_5", "qt_2")),
    ("p-p-p", "p", ("hcp_lt_12",)),
)

_CHAIN = re.compile(r"^\s*([-\d.]+)\s*(<=?|>=?)\s*([A-Za-z_][A-Za-z0-9_]*)\s*(<=?|>=?)\s*([-\d.]+)\s*$")


def rule_sql(text: str) -> str:
    """A criterion as Spark SQL.  A chained comparison (``a <= X < b``, any of the four signs) becomes two comparisons;
    the direction placeholder ``{d}`` goes, as a hand is a row of its own."""
    text = text.replace("_{d}", "")
    m = _CHAIN.match(text)
    if m:
        low, first, name, second, high = m.groups()
        if (first, second) == ("<=", "<="):
            return f"({name} BETWEEN {low} AND {high})"
        return f"({low} {first} {name} AND {name} {second} {high})"
    return f"({text})"


def rule_columns(rules=RULES) -> dict[str, Column]:
    return {name: F.expr(rule_sql(text)) for name, text in rules}


def evaluate_rules(features: DataFrame, keys=("deal_id", "direction"), rules=RULES) -> DataFrame:
    """every rule for every hand -> long rows (keys..., rule, ok)."""
    keys = list(keys)
    cols = rule_columns(rules)
    arr = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("ok")) for n, c in cols.items()])
    return features.select(*keys, F.inline(arr))


def bid_accepts(features: DataFrame, keys=("deal_id", "direction"), rules=RULES, bids=BIDS) -> DataFrame:
    """for each hand and each (prior calls, candidate bid) of the bidding table, whether
    all the bid's criteria hold (AND of the rules, each rule evaluated once per row)."""
    keys = list(keys)
    cols = rule_columns(rules)
    with_rules = features.select(*keys, *[c.alias(f"_r_{n}") for n, c in cols.items()])
    entries = []
    for prior, bid, crit in bids:
        ok = F.lit(True)
        for r in crit:
            ok = ok & F.col(f"_r_{r}")
        entries.append(F.struct(F.lit(prior).alias("prior_calls"), F.lit(bid).alias("bid"),
                                F.lit(",".join(crit)).alias("criteria"), ok.alias("accepted")))
    return with_rules.select(*keys, F.inline(F.array(*entries)))


def _call_rank(call: Column) -> Column:
    """Bids rank 1C=0 ... 7N=34; passes, doubles and redoubles null."""
    return F.when(call.rlike(r"^[1-7][CDHSN]$"),
                  (F.substring(call, 1, 1).cast("int") - 1) * 5 + F.instr(F.lit("CDHSN"), F.substring(call, 2, 1)) - 1)


def analyse_auctions(df: DataFrame, key: str = "deal_id", calls: str = "calls", dealer: str = "dealer", sep: str = "-") -> DataFrame:
    """Per auction: legality of every call, opener, final contract, doubling, declarer, completion.

    A bid is legal if it outranks every earlier bid; a double if the last non-pass call is a
    bid; a redouble if it is a double (the side that doubles is not checked, as in the
    reference).  Declarer is the first player of the final bidding side to name the final
    strain.  Complete after three passes following a bid, or four passes.  The calls are
    exploded with their position and every step is a window over one auction (partitions
    are as long as an auction) followed by one aggregate on the same partitioning.
    """
    seats = F.lit("NESW")
    c = df.select(key, dealer, F.posexplode(F.split(F.col(calls), sep)).alias("pos", "call"))
    c = c.withColumn("call", F.upper(F.col("call")))
    c = c.withColumns({
        "seat": F.substring(seats, F.pmod(F.instr(seats, F.col(dealer)) - 1 + F.col("pos"), F.lit(4)) + 1, 1),
        "rank": _call_rank(F.col("call")),
        "is_bid": F.col("call").rlike(r"^[1-7][CDHSN]$"),
        "is_pass": F.col("call") == "P",
        "is_dbl": F.col("call") == "D",
        "is_rdbl": F.col("call") == "R",
    })
    w = Window.partitionBy(key).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumns({
        "_max_before": F.max("rank").over(before),
        "_last_action": F.last(F.when(~F.col("is_pass"), F.col("call")), ignorenulls=True).over(before),
    })
    legal = (
        F.when(F.col("is_bid"), F.col("_max_before").isNull() | (F.col("rank") > F.col("_max_before")))
        .when(F.col("is_dbl"), F.coalesce(F.col("_last_action").rlike(r"^[1-7][CDHSN]$"), F.lit(False)))
        .when(F.col("is_rdbl"), F.coalesce(F.col("_last_action") == "D", F.lit(False)))
        .otherwise(F.col("is_pass"))
    )
    c = c.withColumn("legal", legal)
    g = c.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.min(F.when(~F.col("legal"), F.col("pos"))).alias("first_illegal_pos"),
        F.min_by("seat", F.when(F.col("is_bid"), F.col("pos"))).alias("opener"),
        F.max_by("call", F.col("rank")).alias("last_bid"),
        F.max(F.when(F.col("is_bid"), F.col("pos"))).alias("_last_bid_pos"),
        F.max_by("seat", F.col("rank")).alias("_last_bid_seat"),
        F.max(F.when(F.col("is_dbl"), F.col("pos"))).alias("_last_dbl_pos"),
        F.max(F.when(F.col("is_rdbl"), F.col("pos"))).alias("_last_rdbl_pos"),
        F.max("pos").alias("_last_pos"),
        F.sort_array(F.collect_list(F.struct("pos", "seat", "call", "is_bid"))).alias("_seq"),
    )
    strain = F.substring(F.col("last_bid"), 2, 1)
    side = F.when(F.col("_last_bid_seat").isin("N", "S"), F.lit("NS")).otherwise(F.lit("EW"))
    firsts = F.filter(F.col("_seq"), lambda x: x["is_bid"] & (F.substring(x["call"], 2, 1) == strain)
                      & F.lit("NS").contains(x["seat"]).eqNullSafe(side == "NS"))
    declarer = F.element_at(firsts, 1)["seat"]
    dbl = (F.when(F.col("_last_rdbl_pos") > F.col("_last_bid_pos"), F.lit("XX"))
           .when(F.col("_last_dbl_pos") > F.col("_last_bid_pos"), F.lit("X")).otherwise(F.lit("")))
    passes_after = F.col("_last_pos") - F.greatest(F.col("_last_bid_pos"), F.coalesce(F.col("_last_dbl_pos"), F.lit(-1)),
                                                   F.coalesce(F.col("_last_rdbl_pos"), F.lit(-1)))
    completed = F.when(F.col("_last_bid_pos").isNull(), F.col("n_calls") == 4).otherwise(passes_after == 3)
    contract = F.when(F.col("_last_bid_pos").isNull(), F.lit("PASS")).otherwise(F.concat(F.col("last_bid"), dbl, declarer))
    return g.select(
        key, F.col("n_calls").cast("int").alias("n_calls"), F.col("first_illegal_pos").cast("int").alias("first_illegal_pos"),
        F.col("first_illegal_pos").isNull().alias("legal"), "opener",
        F.when(F.col("_last_bid_pos").isNotNull(), F.col("last_bid")).alias("last_bid"),
        F.when(F.col("_last_bid_pos").isNotNull(), dbl).alias("dbl"),
        F.when(F.col("_last_bid_pos").isNotNull(), declarer).alias("declarer"),
        completed.alias("completed"), contract.alias("contract"),
    )


#: Calls of the longest legal auction: 3 passes, then 35 bids that each take up to 9 calls with double, redouble and passes, the last one 10.
LONGEST_AUCTION = 319


def expand_auctions(hands: DataFrame, accepts: DataFrame, dealer: DataFrame, key: str = "deal_id",
                    checkpoint_every: int = 4) -> DataFrame:
    """Grow auctions from the empty one by the bidding table, round by round.

    Frontier rows are (key, calls so far, seat to call).  Each round joins the frontier with
    the accepted (prior calls, bid) entries of the hand to call; a frontier row with no
    accepted entry passes.  An auction stops after four passes, or three passes after a
    bid.  The loop runs until no auction is open; the rules bound it (``LONGEST_AUCTION`` calls),
    so a table that makes longer auctions has illegal bids and raises.  Lineage is cut with a reliable
    checkpoint every few rounds; finished auctions are checkpointed once, with their rounds.
    """
    acc = cut_lineage(accepts.filter(F.col("accepted")).select(key, F.col("direction").alias("seat"), "prior_calls", "bid"))
    seats = F.lit("NESW")
    frontier = dealer.select(key, F.lit("").alias("prior_calls"), F.col("dealer").alias("seat"), F.lit(0).alias("round"))
    done, rounds = [], 0
    while True:
        if rounds == LONGEST_AUCTION:
            raise ValueError(f"auctions are still open after {LONGEST_AUCTION} calls: the bidding table accepts illegal bids")
        nxt = frontier.join(not_broadcast(acc), on=[key, "seat", "prior_calls"], how="left")
        nxt = nxt.withColumn("bid", F.coalesce(F.col("bid"), F.lit("p")))
        calls = F.when(F.col("prior_calls") == "", F.col("bid")).otherwise(F.concat_ws("-", "prior_calls", "bid"))
        nxt = nxt.select(key, calls.alias("prior_calls"),
                         F.substring(seats, F.pmod(F.instr(seats, F.col("seat")), F.lit(4)) + 1, 1).alias("seat"),
                         F.lit(rounds + 1).alias("round"))
        toks = F.split(F.col("prior_calls"), "-")
        n = F.size(toks)
        all_pass4 = (n == 4) & F.forall(toks, lambda t: t == "p")
        tail3 = (n >= 4) & F.forall(F.slice(toks, -3, 3), lambda t: t == "p") & F.exists(toks, lambda t: t != "p")
        fin = nxt.withColumn("_done", all_pass4 | tail3)
        rounds += 1
        if rounds % checkpoint_every:
            done.append(fin.filter("_done").drop("_done"))
            frontier = fin.filter(~F.col("_done")).drop("_done")
            continue
        fin = cut_lineage(reduce(DataFrame.unionByName, [d.withColumn("_done", F.lit(True)) for d in done[-(checkpoint_every - 1):]] + [fin]))
        done = done[:-(checkpoint_every - 1)] + [fin.filter("_done").drop("_done")]
        frontier = fin.filter(~F.col("_done")).drop("_done")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, done).select(key, F.col("prior_calls").alias("calls"), "round")


#: Entries of a bidding table that is sent to the tasks whole; a larger one is joined by sorting.
SENT_ENTRIES = 1 << 15
#: Rules of one mask word (a long without its sign), and the most distinct criteria of a bidding table.
WORD, MOST_RULES = 62, 2000


def with_paths(table: DataFrame) -> DataFrame:
    """the bidding table with ``path``: the criteria of an entry and of the entries its prior calls went through.

    A bid needs its prior bid's outcome to be true as well, and that one its own prior's, up to the entry with at most one
    prior call; so the outcome is the AND over the path.  The tree is walked level by level (by number of prior calls),
    each level one join with the level above; an entry whose prior is not in the table starts a path of its own.
    Every level is checkpointed: its size is that of the table, not of the hands.
    """
    depth = F.when(F.col("prior_calls") == "", 0).otherwise(F.size(F.split("prior_calls", "-")))
    last = F.substring_index("prior_calls", "-", -1)
    entries = table.select("*", depth.alias("_depth"), F.when(depth > 1, last).alias("_up_bid"),
                           F.when(depth > 1, F.expr("substr(prior_calls, 1, length(prior_calls) - length(substring_index(prior_calls, '-', -1)) - 1)")).alias("_up_prior"))
    entries = cut_lineage(entries)
    levels = sorted(r["_depth"] for r in entries.select("_depth").distinct().collect())  # one row a number of prior calls
    done, above = [], None
    for level in levels:
        here = entries.where(F.col("_depth") == level)
        if above is None:
            here = here.withColumn("path", F.array_distinct("criteria"))
        else:
            up = above.groupBy(F.col("prior_calls").alias("_p"), F.col("bid").alias("_b")).agg(F.min("path").alias("_path"))
            here = here.join(up, (F.col("_up_prior") == F.col("_p")) & (F.col("_up_bid") == F.col("_b")), "left")
            here = here.withColumn("path", F.array_union(F.coalesce("_path", F.array().cast("array<string>")), "criteria")).drop("_p", "_b", "_path")
        above = cut_lineage(here)
        done.append(above)
    return reduce(DataFrame.unionByName, done).drop("_depth", "_up_bid", "_up_prior") if done else entries.select(*table.columns, F.col("criteria").alias("path"))


def table_rules(table: DataFrame) -> list[str]:
    """The distinct criteria of a bidding table, in order.  They become columns of the hands' plan, so there must be few."""
    found = [r["rule"] for r in table.select(F.explode("criteria").alias("rule")).distinct().limit(MOST_RULES + 1).collect()]
    if len(found) > MOST_RULES:
        raise ValueError(f"the bidding table has more than {MOST_RULES} distinct criteria")
    return sorted(found)


def hand_masks(features: DataFrame, rules: list[str], keys=("deal_id", "direction")) -> DataFrame:
    """F9 for a table's rules: which of them each hand meets, as words of bits; a rule over a null feature is not met."""
    words = []
    for at in range(0, max(len(rules), 1), WORD):
        bits = [F.when(F.expr(rule_sql(r)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules[at:at + WORD])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits) if bits else F.lit(0).cast("long"))
    return features.select(*keys, F.array(*words).alias("mask"))


def path_masks(table: DataFrame, rules: list[str]) -> DataFrame:
    """The table with ``need``: the words of bits of its path's rules."""
    number = F.expr("map(" + ", ".join(f"{_quoted(r)}, {i}" for i, r in enumerate(rules)) + ")") if rules else F.expr("cast(map() as map<string, int>)")
    words = [F.expr(f"aggregate(filter(_numbers, n -> n >= {at} AND n < {at + WORD}), 0L, (a, n) -> a | shiftleft(1L, n - {at}))")
             for at in range(0, max(len(rules), 1), WORD)]
    table = table.withColumn("_numbers", F.transform("path", lambda r: F.element_at(number, r)))
    return table.withColumn("need", F.array(*words)).drop("_numbers")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _meets(mask: Column, need: Column, words: int) -> Column:
    return reduce(lambda a, b: a & b, [mask[i].bitwiseAND(need[i]) == need[i] for i in range(words)])


def bid_outcomes(features: DataFrame, table: DataFrame, keys=("deal_id", "direction")) -> DataFrame:
    """(keys..., bt_id) of every hand and entry whose criteria, and those of the prior bids' entries, all hold.

    A hand meets an entry through one rule of its path, the table's commonest rule excepted where it can be: hands
    are joined by the rules they meet, then the whole path is tested on the joined row.  Entries without criteria meet every hand.
    """
    rules = table_rules(table)
    words = max(1, -(-len(rules) // WORD))
    paths = path_masks(with_paths(table), rules)
    used = paths.select(F.explode("path").alias("_rule")).groupBy("_rule").agg(F.count("*").alias("_n"))
    ranked = paths.select("bt_id", "need", F.explode_outer("path").alias("_rule")).join(used, "_rule", "left")
    door = ranked.groupBy("bt_id").agg(F.min("need").alias("need"), F.min_by("_rule", F.struct("_n", "_rule")).alias("_rule"))
    hands = hand_masks(features, rules, keys)
    met = F.filter(F.array(*[F.when(F.col("mask")[i // WORD].bitwiseAND(F.lit(1 << (i % WORD)).cast("long")) != 0, F.lit(r)) for i, r in enumerate(rules)] + [F.lit("")]), lambda r: r.isNotNull())
    by_rule = hands.select(*keys, "mask", F.explode(met).alias("_rule"))
    hits = by_rule.join(door.withColumn("_rule", F.coalesce("_rule", F.lit(""))), "_rule").where(_meets(F.col("mask"), F.col("need"), words))
    return hits.select(*keys, "bt_id")


def expand_by_table(features: DataFrame, table: DataFrame, dealers: DataFrame, bogus=(), key: str = "deal_id",
                    checkpoint_every: int = 4) -> DataFrame:
    """J11 with the bidding table as rows: (key, calls, bt_ids, completed_by_table) of every auction that a deal can have.

    A row is an auction so far with the masks of the four hands.  Each round joins the rows with the table's candidates after those
    calls (one row a sequence; a table of up to ``SENT_ENTRIES`` entries is sent to the tasks, as all auctions start with the same
    calls) and takes every bid whose path the hand to call meets; without one it passes.  Auctions end with an entry marked completed, four passes
    or three passes after a bid; until the next reliable checkpoint they stay among the rows, so that no round is computed twice.
    Sequences in ``bogus`` are never bid.  Every round makes auctions one call longer, so no cycle is possible, and none is longer
    than the rules allow (``LONGEST_AUCTION``).
    """
    rules = table_rules(table)
    words = max(1, -(-len(rules) // WORD))
    entry = F.struct("bid", "bt_id", "need", F.coalesce("completed", F.lit(False)).alias("completed"))
    sequence = F.concat_ws("-", F.when(F.col("prior_calls") != "", F.col("prior_calls")), "bid")
    after = cut_lineage(path_masks(with_paths(table), rules).where(~sequence.isin(*bogus) if bogus else F.lit(True))
                        .groupBy(F.col("prior_calls").alias("calls")).agg(F.sort_array(F.collect_set(entry)).alias("candidates")))
    seat = F.instr(F.lit("NESW"), F.col("direction")) - 1
    hands = hand_masks(features, rules, (key, "direction")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(seat.alias("seat"), "mask"))).alias("hands"))
    small = table.count() <= SENT_ENTRIES
    after = after.select(F.col("calls").alias("_at"), "candidates")
    after = F.broadcast(after) if small else not_broadcast(after)
    rows = dealers.select(key, (F.instr(F.lit("NESW"), F.col("dealer")) - 1).alias("seat")).join(not_broadcast(hands), key).select(
        key, "seat", F.transform("hands", lambda h: h["mask"]).alias("hands"), F.lit("").alias("calls"), F.array().cast("array<int>").alias("bt_ids"),
        F.lit(False).alias("completed"), F.lit(False).alias("_done"))
    rows, done, rounds = cut_lineage(rows), [], 0
    while True:
        if rounds == LONGEST_AUCTION:
            raise ValueError(f"auctions are still open after {LONGEST_AUCTION} calls: the bidding table accepts illegal bids")
        over = F.col("_done")
        own = F.get("hands", F.col("seat"))
        hits = F.when(~over, F.filter("candidates", lambda c: _meets(own, c["need"], words)))
        # what ended waits by its key, so that it is spread where the table is not sent
        nxt = rows.withColumn("_at", F.when(over, F.col(key).cast("string")).otherwise(F.col("calls"))).join(after, "_at", "left").withColumn("_hits", hits)
        nxt = nxt.select(key, "seat", "hands", "calls", "bt_ids", "completed", "_done", F.explode_outer("_hits").alias("x"))
        bid = F.when(F.col("x").isNull(), F.lit("p")).otherwise(F.col("x.bid"))
        nxt = nxt.select(
            key, ((F.col("seat") + 1) % 4).alias("seat"), F.when(~over, F.col("hands")).alias("hands"),
            F.when(over, F.col("calls")).otherwise(F.concat_ws("-", F.when(F.col("calls") != "", F.col("calls")), bid)).alias("calls"),
            F.when(F.col("x.bt_id").isNull(), F.col("bt_ids")).otherwise(F.array_append("bt_ids", F.col("x.bt_id"))).alias("bt_ids"),
            (F.col("completed") | F.coalesce("x.completed", F.lit(False))).alias("completed"), "_done")
        passed = F.col("calls").rlike("^p-p-p-p$") | F.col("calls").rlike("[^p-].*-p-p-p$")
        rows = nxt.withColumn("_done", over | F.col("completed") | passed)
        rounds += 1
        if rounds % checkpoint_every == 0:
            rows = cut_lineage(rows)
            done.append(rows.where("_done").select(key, "calls", "bt_ids", F.col("completed").alias("completed_by_table")))
            rows = rows.where("not _done")
            if rows.isEmpty():
                return reduce(DataFrame.unionByName, done)
