"""Registered board-text queries: PBN and LIN written from the tables by Spark, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import not_broadcast
from ..sources import board_text as BT
from ..sources import fixtures
from .boards import scored_results
from .oracle import sql_scored_results, with_fixtures
from .registry import register

PBN_TAGS = ["Event", "Site", "Board", "Dealer", "Vulnerable", "Deal", "Declarer", "Contract", "Result"]


@register(
    "pbn_roundtrip",
    "S1,S4,C16,P22,J2",
    with_fixtures(["board_results", "boards", "deals"], sql_scored_results(), """select s.session_id, cast(s.l_orderkey as varchar) || '-' || cast(s.l_linenumber as varchar) table_key,
  s.board, s.dealer, s.vul, d.pbn deal, s.contract, s.tricks
from scored s join boards b using (session_id, board) join deals d using (deal_id)"""),
)
def q_pbn_roundtrip(spark, sf_dir):
    """Every table result written as a PBN tag block, parsed back and canonicalised."""
    res = scored_results(fixtures.board_results(spark, sf_dir))
    res = res.join(not_broadcast(fixtures.boards(spark, sf_dir).select("session_id", "board", "deal_id")), ["session_id", "board"])
    res = res.join(not_broadcast(fixtures.deals(spark, sf_dir)), "deal_id")
    pbn_vul = F.element_at(F.create_map(*[F.lit(x) for x in ("None", "None", "N_S", "NS", "E_W", "EW", "Both", "All")]), F.col("vul"))
    block = BT.render_pbn(res, {
        "Event": F.col("session_id"), "Site": F.concat_ws("-", "l_orderkey", "l_linenumber"), "Board": F.col("board"),
        "Dealer": F.col("dealer"), "Vulnerable": pbn_vul, "Deal": F.col("pbn"), "Declarer": F.col("declarer"),
        "Contract": F.when(F.col("contract") == "PASS", F.lit("Pass")).otherwise(F.concat("level", "strain", "dbl")),
        "Result": F.col("tricks"),
    })
    parsed = BT.parse_pbn_blocks(res.select(block.alias("value")), "value")
    out = BT.canonical_from_pbn(BT.unnest_tags(parsed, PBN_TAGS))
    return out.select(F.col("event").cast("long").alias("session_id"), F.col("site").alias("table_key"), "board", "dealer",
                      "vul", F.col("deal"), "contract", "tricks")


@register(
    "lin_roundtrip",
    "S2,P20,P3",
    with_fixtures(["deals", "auctions", "boards"], "", """select a.deal_id, a.dealer,
  case ((b.board-1)//4 + (b.board-1)%4) % 4 when 0 then 'None' when 1 then 'N_S' when 2 then 'E_W' else 'Both' end vul,
  'Board ' || cast(b.board as varchar) board_text, a.calls, d.pbn
from auctions a join boards b using (deal_id) join deals d using (deal_id)"""),
)
def q_lin_roundtrip(spark, sf_dir):
    """Every deal and its auction written as a LIN line, parsed back (fourth hand inferred from the deck)."""
    from .boards import with_board_facts

    a = fixtures.auctions(spark, sf_dir)
    b = with_board_facts(fixtures.boards(spark, sf_dir)).select("deal_id", "board", "vul")
    d = fixtures.deals(spark, sf_dir)
    j = a.join(not_broadcast(b), "deal_id").join(not_broadcast(d), "deal_id")
    code = F.element_at(F.create_map(*[F.lit(x) for x in ("None", "o", "N_S", "n", "E_W", "e", "Both", "b")]), F.col("vul"))
    lines = j.select("deal_id", BT.render_lin(F.col("dealer"), F.col("pbn"), code, F.col("board"), F.col("calls")).alias("value"))
    out = BT.parse_lin(lines, "value")
    return out.select("deal_id", "dealer", "vul", "board_text", "calls", "pbn")


@register(
    "pbn_files",
    "S1,S4",
    with_fixtures(["deals", "boards"], "", "select d.deal_id, b.board, d.pbn deal from deals d join boards b using (deal_id)"),
)
def q_pbn_files(spark, sf_dir):
    """All deals written as PBN files of many boards, read back by byte ranges."""
    from ..streaming.scores import scratch_path

    d = fixtures.deals(spark, sf_dir).join(not_broadcast(fixtures.boards(spark, sf_dir).select("deal_id", "board")), "deal_id")
    block = BT.render_pbn(d, {"Event": F.col("deal_id"), "Board": F.col("board"), "Deal": F.col("pbn")})
    path = scratch_path(spark, "pbn")
    # a block is one row of the file; blank lines, some with blanks and carriage returns, stand between
    d.select(F.concat(block, F.when(F.col("deal_id") % 3 == 0, F.lit("\r\n \t\r\n")).otherwise(F.lit("\n\n"))).alias("value")).repartition(2).write.text(path)
    out = BT.unnest_tags(BT.read_pbn(spark, path), ["Event", "Board", "Deal"])
    return out.select(F.col("event").cast("long").alias("deal_id"), F.col("board").cast("int").alias("board"), "deal")


@register(
    "auction_notes",
    "S3,S4",
    with_fixtures(["auctions"], """c as (select deal_id, pos, string_split(calls, '-')[pos + 1] call, len(string_split(calls, '-')) n from auctions, range(0, 12) t(pos) where pos < len(string_split(calls, '-'))),
t as (select *, call not in ('p', 'd', 'r') is_bid, pos % 3 = 1 and pos < n - 3 noted, pos % 4 = 2 and pos < n - 3 marked from c)""",
        """select deal_id, string_agg(case when is_bid then 'Contract' else 'Penalty' end, ',' order by pos) types,
  string_agg(case when is_bid then substr(call, 1, 1) else '-' end, ',' order by pos) levels, string_agg(case when is_bid then substr(call, 2, 1) else '-' end, ',' order by pos) denoms,
  string_agg(case call when 'p' then 'passed' when 'd' then 'doubled' when 'r' then 'redoubled' else '-' end, ',' order by pos) penalties,
  string_agg(case when noted or marked then 'true' else 'false' end, ',' order by pos) alertables,
  string_agg(case when noted then case when pos % 2 = 0 then '-' else 'call ' || pos || ' of ' || deal_id end else '-' end, ',' order by pos) announcements
from t group by deal_id"""),
)
def q_auction_notes(spark, sf_dir):
    """Auctions written as PBN sections with note references, alerts and AP, parsed into parallel arrays with the notes resolved."""
    a = fixtures.auctions(spark, sf_dir).withColumns({"c": F.split("calls", "-"), "n": F.size(F.split("calls", "-"))})
    shown = F.expr("transform(slice(c, 1, greatest(n - 3, 0)), (x, i) -> concat(case x when 'p' then 'Pass' when 'd' then 'X' when 'r' then 'XX' else x end, if(i % 4 = 2, '!', ''), if(i % 3 = 1, concat(' =', i, '='), '')))")
    notes = F.expr("transform(filter(sequence(0, greatest(n - 4, 0)), i -> i % 6 = 1), i -> concat('[Note \"', i, ':call ', i, ' of ', deal_id, '\"]'))")
    value = F.concat(F.lit('[Board "'), F.col("deal_id"), F.lit('"]\n[Auction "N"]\n'), F.array_join(shown, " "), F.lit(" AP\n"), F.array_join(notes, "\n"))
    out = BT.noted_auction_arrays(BT.parse_pbn_blocks(a.select("deal_id", value.alias("value"))))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-")
    return out.select("deal_id", *[text(f"bid_{c}").alias(n) for c, n in (("type", "types"), ("level", "levels"), ("denom", "denoms"), ("penalty", "penalties"),
                                                                       ("alertable", "alertables"), ("announcement", "announcements"))])
