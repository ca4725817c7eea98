"""Bridge-shaped input tables derived from the driver's TPC-H-like tables.

These only give rows in the schemas the operators expect (see FIXTURES.md); they do none
of the operators' work.  Every table grows with its driver table: boards with
``supplier``, results with ``lineitem``.  All derivations are row-local (generators and
higher-order functions); the only exchange is the round-robin ``spread`` of a source that
arrives in fewer partitions than the cluster has cores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, spread

BOARDS_PER_SESSION = 32
#: Boards that one task takes: a board becomes hundreds of sample rows.
BOARDS_A_TASK = 1 << 14
# fixed auction templates of the fixture (template 4 is illegal on purpose; p pass, d double, r redouble)
AUCTION_TEMPLATES = (
    "1C-p-1S-p-2S-p-p-p",
    "p-p-p-p",
    "1N-d-r-p-p-p",
    "p-1H-2C-2H-3C-p-p-p",
    "1S-1H-p-p-p",
    "p-p-p-1D-p-3N-p-p-p",
    "2H-d-p-2S-p-4S-d-p-p-p",
)


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, board 1..32, deal_id): one session per supplier."""
    s = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select("s_suppkey")
    b = s.select(
        F.col("s_suppkey").cast("long").alias("session_id"),
        F.explode(F.sequence(F.lit(1), F.lit(BOARDS_PER_SESSION))).alias("board"),
    ).select(
        "session_id",
        F.col("board").cast("int").alias("board"),
        (F.col("session_id") * 100 + F.col("board")).cast("long").alias("deal_id"),
    )
    return spread(b, BOARDS_PER_SESSION * s.count(), BOARDS_A_TASK)


def board_results(spark: SparkSession, sf_dir: str, by_rows: bool = True) -> DataFrame:
    """One played table result per lineitem row; (l_orderkey, l_linenumber, l_partkey, session_id) is its id."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"], by_rows)
    contract = F.when(F.col("l_partkey") % 97 == 0, F.lit("PASS")).otherwise(
        F.concat(
            (F.col("l_partkey") % 7 + 1).cast("string"),
            F.substring(F.lit("CDHSN"), (F.col("l_orderkey") % 5 + 1).cast("int"), 1),
            F.when(F.col("l_linenumber") == 6, F.lit("X")).when(F.col("l_linenumber") == 7, F.lit("XX")).otherwise(F.lit("")),
            F.substring(F.lit("NESW"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4 + 1).cast("int"), 1),
        )
    )
    tricks = F.when((F.col("l_partkey") % 97 == 0) | (F.col("l_partkey") % 89 == 0), F.lit(None)).otherwise(
        ((F.col("l_quantity").cast("int") * 3 + F.col("l_linenumber")) % 14)
    ).cast("int")
    return li.select(
        F.col("l_suppkey").cast("long").alias("session_id"),
        (F.col("l_orderkey") % 32 + 1).cast("int").alias("board"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
        F.col("l_shipdate").alias("result_time"),
        contract.alias("contract"),
        tricks.alias("tricks"),
        F.concat(F.lit("N"), (F.col("l_partkey") % 199).cast("string")).alias("player_n"),
        F.concat(F.lit("E"), (F.col("l_orderkey") % 211).cast("string")).alias("player_e"),
        F.concat(F.lit("S"), (F.col("l_partkey") % 197).cast("string")).alias("player_s"),
        F.concat(F.lit("W"), (F.col("l_orderkey") % 193).cast("string")).alias("player_w"),
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deal_id, pbn): a 52-card deal per board, cards dealt in md5 order of (deal_id, card).

    Card c is suit c div 13 (S, H, D, C) and rank 'AKQJT98765432'[c % 13]; the card in
    shuffled position p goes to seat p div 13.  Computed on the board's own row.
    """
    b = boards(spark, sf_dir).select("deal_id")
    keyed = F.transform(
        F.sequence(F.lit(0), F.lit(51)),
        lambda c: F.struct(
            F.md5(F.concat(F.col("deal_id").cast("string"), F.lit("-"), c.cast("string"))).alias("k"),
            c.alias("card"),
        ),
    )
    # a letter a card, in order of suit and rank, so that a hand's sorted letters are its cards in the order of its text
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    b = b.withColumn("shuffled", F.transform(F.sort_array(keyed), lambda x: F.substring(F.lit(letters), x["card"] + 1, F.lit(1))))
    b = b.withColumns({f"_h{seat}": F.array_join(F.sort_array(F.slice("shuffled", seat * 13 + 1, 13)), "") for seat in range(4)})

    def holding(seat: int, suit: int):
        mine = letters[suit * 13:suit * 13 + 13]  # letters without a counterpart (the other suits') are dropped
        return F.translate(f"_h{seat}", mine + "".join(x for x in letters if x not in mine), "AKQJT98765432")

    hands = [F.concat_ws(".", *[holding(seat, suit) for suit in range(4)]) for seat in range(4)]
    return b.select("deal_id", F.concat(F.lit("N:"), F.concat_ws(" ", *hands)).alias("pbn"))


def dd_tricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deal_id, seat 0..3 NESW, strain 0..4 CDHSN, tricks): a stand-in double-dummy table."""
    b = boards(spark, sf_dir).select("deal_id")
    b = b.select("deal_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seat"))
    b = b.select("deal_id", "seat", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("strain"))
    t = (
        F.col("deal_id") * 31 + (F.col("seat") % 2) * 17 + F.col("strain") * 5
        + F.when((F.col("seat") >= 2) & (F.col("deal_id") % 3 == 0), F.lit(1)).otherwise(F.lit(0))
    ) % 14
    return b.select("deal_id", F.col("seat").cast("int"), F.col("strain").cast("int"), t.cast("int").alias("tricks"))


def sd_samples(spark: SparkSession, sf_dir: str, samples: int = 10) -> DataFrame:
    """(deal_id, fixed_pair 0/1, sample, seat, strain, tricks): sampled trick counts for every deal."""
    b = boards(spark, sf_dir).select("deal_id")
    for name, hi in (("fixed_pair", 1), ("sample", samples - 1), ("seat", 3), ("strain", 4)):
        b = b.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(hi))))
    t = (F.col("deal_id") * 7 + F.col("sample") * 3 * (F.col("strain") + 1) + F.col("seat") * 5 + F.col("fixed_pair") * 11) % 14
    return b.select(
        "deal_id",
        F.col("fixed_pair").cast("int"),
        F.col("sample").cast("int"),
        F.col("seat").cast("int"),
        F.col("strain").cast("int"),
        t.cast("int").alias("tricks"),
    )


def par_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deal_id, par_ns): a stand-in par score of every deal, as solvers store them."""
    b = boards(spark, sf_dir).select("deal_id")
    return b.select("deal_id", ((F.col("deal_id") * 37 % 41 - 20) * 50).cast("int").alias("par_ns"))


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deal_id, dealer, calls): one dash-joined auction per board."""
    b = boards(spark, sf_dir)
    templates = F.array(*[F.lit(t) for t in AUCTION_TEMPLATES])
    return b.select(
        "deal_id",
        F.substring(F.lit("NESW"), ((F.col("board") - 1) % 4 + 1).cast("int"), 1).alias("dealer"),
        F.element_at(templates, (F.col("deal_id") % len(AUCTION_TEMPLATES) + 1).cast("int")).alias("calls"),
    )


def bidding_entries() -> list[tuple]:
    """Rows of the fixture's bidding table, by rule: (bt_id, prior_calls, bid, criteria, completed).

    Criteria are (feature, least, most) triples.  Openings of three levels after up to three passes, three raises and a pass to each,
    two calls after that pass, and the pass that completes the auction.
    """
    strains, rows = "CDHSN", []

    def add(prior, bid, criteria=(), completed=False):
        rows.append((len(rows), "-".join(prior), bid, tuple(criteria), completed))

    def strength(level, strain):
        if strain == "N":
            return [("HCP", 10 + 5 * level, 12 + 5 * level)]
        return [("HCP", (11, 6, 5)[level - 1], (21, 11, 10)[level - 1]), (f"SL_{strain}", (4, 6, 7)[level - 1], 13)]

    for passes in range(4):
        prior = ["p"] * passes
        add(prior, "p", [("HCP", 0, 11)])
        for rank in range(15):
            bid = f"{rank // 5 + 1}{strains[rank % 5]}"
            add(prior, bid, strength(rank // 5 + 1, strains[rank % 5]))
            add([*prior, bid], "p")
            for more in (rank + 1, rank + 2, rank + 3):
                strain = strains[more % 5]
                add([*prior, bid], f"{more // 5 + 1}{strain}", [("HCP", 8, 40), *([(f"SL_{strain}", 3, 13)] if strain != "N" else [])])
            add([*prior, bid, "p"], "p")
            add([*prior, bid, "p"], f"{(rank + 1) // 5 + 1}{strains[(rank + 1) % 5]}", [("HCP", 16, 40)])
            add([*prior, bid, "p", "p"], "p", completed=True)
    return rows


def bidding_table(spark: SparkSession) -> DataFrame:
    """(bt_id, prior_calls, bid, criteria, completed): the entries with their criteria as rule texts for any direction {d}."""
    def text(feature: str, least: int, most: int) -> str:
        name = "HCP_{d}" if feature == "HCP" else feature.replace("SL_", "SL_{d}_")
        if least == 0:
            return f"{name} < {most + 1}"
        return f"{name} >= {least}" if most in (13, 40) else (f"{least} <= {name} <= {most}" if least % 2 else f"{least - 1} < {name} <= {most}")

    rows = [(i, prior, bid, [text(*c) for c in criteria], done) for i, prior, bid, criteria, done in bidding_entries()]
    return spark.createDataFrame(rows, "bt_id int, prior_calls string, bid string, criteria array<string>, completed boolean")


#: Opening sequences that the fixture's bidding table should not have.
BOGUS_SEQUENCES = ("3N", "p-3N", "p-p-2C")


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): a result page per session, with a table of each side's pairs.

    Columns come in three orders and spellings (by session), names hold character references, and some rows are no
    results (a position that is no number, a missing cell, an empty score).
    """
    s = spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("page_id")))
    pair = """named_struct('pair', p, 'mp', cast((p * 13 + page_id * 7 + {k}) % 400 as decimal(6,1)) / 2, 'pct', cast((p * 377 + page_id * 101 + {k}) % 6000 + 2000 as decimal(8,2)) / 100)"""
    cell = "concat('<td>', {0}, '</td>')".format
    names = "concat('{s}', x.pair, 'a of ', page_id, ' &amp; {s}', x.pair, 'b of ', page_id)"
    orders = (("i + 1", "x.pair", "{names}", "x.mp", "x.pct"), ("i + 1", "x.pair", "x.pct", "{names}", "x.mp"),
              ("i + 1", "'club'", "x.pair", "{names}", "x.mp", "x.pct", "'0.1'"))
    heads = (("Pos", "No", "Players", "Matchpoints", "Score%"), ("Position", "Pair", "Score", "Players", "MP"),
             ("Pos", "Club", "Pair", "Players", "MPs", "Score%", "Masterpoints"))
    parts = []
    for side, label, k in (("NS", "North / South", 0), ("EW", "East / West", 1)):
        by_order = []
        for order, head in zip(orders, heads):
            row = "concat('<tr>', " + ", ".join(cell(f"cast({c.replace('{names}', names.replace('{s}', side))} as string)") for c in order) + ", '</tr>')"
            ranked = f"array_sort(transform(sequence(1, 12), p -> {pair.format(k=k)}), (a, b) -> case when a.pct > b.pct then -1 when a.pct < b.pct then 1 else a.pair - b.pair end)"
            body = f"array_join(transform({ranked}, (x, i) -> {row}), '')"
            by_order.append(f"concat('<tr>{''.join(f'<th>{h}</th>' for h in head)}</tr>', {body})")
        pick = f"case page_id % 3 when 0 then {by_order[0]} when 1 then {by_order[1]} else {by_order[2]} end"
        parts.append(f"'<tr><td colspan=5>{label}</td></tr>', {pick}, '<tr><td>-</td><td>77</td><td>none</td><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td>13</td><td>78</td></tr>'")
    html = "concat('<html><body><h1>Results</h1><table>', " + ", ".join(parts) + ", '</table></body></html>')"
    return s.select("page_id", F.expr("concat('https://results.example/show?club=c', page_id % 7, '&event=', page_id)").alias("url"), F.expr(html).alias("html"))


def par_lists(spark: SparkSession, sf_dir: str, other: bool = False) -> DataFrame:
    """(deal_id, par_ns, par_contracts): stored par results; ``other``: as a second solver stores them, in another order and with other levels,
    with a different score, contract or no row for some deals."""
    par = par_scores(spark, sf_dir)
    one = "named_struct('level', 1 + (deal_id + i) % 5, 'strain', substr('CDHSN', 1 + (deal_id * 3 + i) % 5, 1), 'dbl', if(deal_id % 4 = 0, 'X', ''), 'declarer', substr('NESW', 1 + (deal_id + i) % 4, 1), 'overs', (deal_id + 2 * i) % 3)"
    if not other:
        return par.where("deal_id % 11 <> 3").select("deal_id", "par_ns", F.expr(f"transform(sequence(0, cast(deal_id % 3 as int)), i -> {one})").alias("par_contracts"))
    moved = "named_struct('level', x.level + x.overs, 'strain', x.strain, 'dbl', if(deal_id % 9 = 5, 'XX', x.dbl), 'declarer', x.declarer, 'overs', 0L)"
    return par.where("deal_id % 13 <> 4").select("deal_id", F.expr("if(deal_id % 7 = 2, par_ns + 10, par_ns)").alias("par_ns"),
                                               F.expr(f"transform(reverse(transform(sequence(0, cast(deal_id % 3 as int)), i -> {one})), x -> {moved})").alias("par_contracts"))
