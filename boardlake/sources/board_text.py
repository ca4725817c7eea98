"""Board record text formats: PBN tag blocks (S1, S4) and LIN lines (S2, P20), plus stage files.

``read_pbn`` reads files in byte ranges and puts the lines between blank lines (LF or CRLF) together to one block per
board; the tag pairs of a block stay an ordered array, since tags such as ``Note`` repeat, and a
lookup takes the first.  The sections that follow ``[Auction]`` and ``[Play]`` are kept as token arrays.
``read_lin`` reads one board per line of ``key|value|`` pairs and infers the fourth hand as the full
deck minus the three given; a line that gives no valid deal keeps its text in ``_corrupt``.  Parsing is
done with Spark's string and array functions on each record's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.codings import rotate_to_north
from ..functions.contracts import is_contract, normalise_contract, result_of

TAG_RE = r'\[(\w+)\s+"([^"]*)"\]'
PBN_VUL = {"None": "None", "Love": "None", "-": "None", "NS": "N_S", "EW": "E_W", "All": "Both", "Both": "Both"}
LIN_DEALER = {"1": "S", "2": "W", "3": "N", "4": "E"}          # fixed value: LIN dealer codes
LIN_VUL = {"o": "None", "0": "None", "n": "N_S", "e": "E_W", "b": "Both"}


def _section(text: Column, tag: str) -> Column:
    """Tokens of the lines after ``[tag "..."]`` up to the next tag; comments in braces and after ';' dropped."""
    body = F.regexp_extract(text, r'\[' + tag + r'\s+"[^"]*"\]([^\[]*)', 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\{[^}]*\}", " "), r";[^\n]*", " "), r"\s+", " "))
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def parse_pbn_blocks(df: DataFrame, text: str = "value") -> DataFrame:
    """The tag pairs of a block as an array ``tags`` of (k, v) in file order (tags may repeat), and the
    auction and play sections as arrays ``auction`` and ``play``; raw text kept, blocks without tags dropped."""
    t = F.regexp_replace(F.col(text), "\r", "")
    keys = F.regexp_extract_all(t, F.lit(TAG_RE), F.lit(1))
    vals = F.regexp_extract_all(t, F.lit(TAG_RE), F.lit(2))
    out = df.withColumns({"tags": F.arrays_zip(keys.alias("k"), vals.alias("v")),
                          "auction": _section(t, "Auction"), "play": _section(t, "Play")})
    return out.filter(F.size("tags") > 0)


def split_pbn(df: DataFrame, text: str = "value") -> DataFrame:
    """Whole files to one row per block of lines without a blank line between (LF or CRLF)."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(F.split(F.col(text), r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")).alias(text)).filter(F.trim(text) != "")


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): blocks of lines without a blank line between, of files of any size.

    The text source cuts files into byte ranges at line ends, so a file is read by many tasks.  Within a range, counting blank
    lines numbers the blocks; a block that a cut went through is put together again, as the lines before a range's first blank line
    belong to the last block of the nearest range before it that has a blank line.  A window holds one range, or one row a range of a file;
    a group holds one block.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"),
                                         F.monotonically_increasing_id().alias("_line"), F.regexp_replace("value", "\r$", "").alias("value"))
    blank = F.trim(F.regexp_replace("value", "\t", " ")) == ""
    w = Window.partitionBy("file", "_range").orderBy("_line")
    lines = lines.withColumns({"_blank": blank, "_block": F.sum(blank.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    ranges = lines.groupBy("file", "_range").agg(F.max("_block").alias("_last"))
    before = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # (range, number) of the block that is open where this range begins; of a file's first ranges without a blank line, block 0 of the first one
    opened = F.coalesce(F.last(F.when(F.col("_last") > 0, F.struct("_range", "_last")), ignorenulls=True).over(before),
                        F.struct(F.min("_range").over(Window.partitionBy("file")).alias("_range"), F.lit(0).cast("long").alias("_last")))
    ranges = ranges.select(F.col("file").alias("_f"), F.col("_range").alias("_r"), opened.alias("_open"))
    rows = lines.where(~F.col("_blank")).join(ranges, (F.col("file") == F.col("_f")) & (F.col("_range") == F.col("_r")))
    owner = F.when(F.col("_block") == 0, F.col("_open")).otherwise(F.struct("_range", F.col("_block").alias("_last")))
    blocks = rows.groupBy("file", owner.alias("_owner")).agg(F.sort_array(F.collect_list(F.struct("_range", "_line", "value"))).alias("_lines"))
    return blocks.select("file", F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("value"))


def read_pbn(spark: SparkSession, path: str) -> DataFrame:
    """PBN files of any size -> one row per board block."""
    return parse_pbn_blocks(text_blocks(spark, path).select("value"), "value")


def first_tag(tags: Column, name: str) -> Column:
    """The first value of a tag, null if the block lacks it."""
    return F.get(F.filter(tags, lambda p: p["k"] == name), F.lit(0))["v"]


def unnest_tags(df: DataFrame, names, tags: str = "tags") -> DataFrame:
    """Spread named tags to columns (missing tags give null); player tags become player_*."""
    cols = {}
    for n in names:
        out = {"North": "player_n", "East": "player_e", "South": "player_s", "West": "player_w"}.get(n, n.lower())
        cols[out] = first_tag(F.col(tags), n)
    return df.withColumns(cols)


def canonical_from_pbn(df: DataFrame) -> DataFrame:
    """Canonical result columns from PBN tags: contract with declarer, tricks, vul, dealer, and the deal
    (which may start at any seat) written from North."""
    c = F.upper(F.col("contract"))
    contract = F.when(c == "PASS", F.lit("PASS")).when(c.isNotNull() & (c != ""), F.concat(c, F.col("declarer")))
    return df.withColumns({
        "contract": contract,
        "tricks": F.col("result").try_cast("int"),
        "vul": vocab.map_vocab(F.col("vulnerable"), PBN_VUL),
        "board": F.col("board").try_cast("int"),
        **({"deal": rotate_to_north(F.col("deal"))} if "deal" in df.columns else {}),
    })


def auction_contract(df: DataFrame, calls: str = "calls", dealer: str = "dealer", sep: str = "-") -> DataFrame:
    """Contract with declarer that an auction ends in ('PASS' after four passes), row-local.

    The last bid counts, with the doubles after it; its declarer is the first of its side to name its strain.  An auction without a
    bid and of fewer than four calls, an unknown dealer and a null give null; whether calls are legal is not looked at (W11 does).
    """
    text = F.replace(F.upper(F.col(calls)), F.lit("NT"), F.lit("N"))
    made = F.transform(F.split(text, sep), lambda c, i: F.struct(
        i.alias("i"), F.trim(c).alias("call"), ((vocab.seat_index(F.col(dealer)) + i) % 4).alias("seat"), F.trim(c).rlike("^[1-7][CDHSN]$").alias("bid")))
    out = df.withColumn("_made", made)
    out = out.withColumn("_bids", F.filter("_made", lambda x: x["bid"])).withColumn("_last", F.get(F.reverse("_bids"), F.lit(0)))
    strain = lambda x: F.substring(x["call"], 2, 1)
    first = F.get(F.filter("_bids", lambda x: (strain(x) == strain(F.col("_last"))) & (x["seat"] % 2 == F.col("_last.seat") % 2)), F.lit(0))
    after = lambda *names: F.exists("_made", lambda x: (x["i"] > F.col("_last.i")) & x["call"].isin(*names))
    dbl = F.when(after("R", "XX"), "XX").when(after("D", "X"), "X").otherwise("")
    bid = F.concat(F.col("_last.call"), dbl, F.substring(F.lit(vocab.DIRECTIONS), first["seat"] + 1, F.lit(1)))
    passed = F.col("_last").isNull() & (F.size("_made") >= 4)
    return out.withColumn("contract", F.when(passed, F.lit("PASS")).otherwise(bid)).drop("_made", "_bids", "_last")


def canonical_from_lin(df: DataFrame) -> DataFrame:
    """Canonical result columns of parsed LIN rows (``parse_lin``): board number, contract from the auction, tricks claimed and result.

    The board's number is the last one in its text.  Without a claim tricks and result are null (the play is not counted out).
    """
    out = auction_contract(df)
    board = F.nullif(F.regexp_extract("board_text", r"(\d+)\D*$", 1), F.lit("")).try_cast("int")
    return out.withColumns({"board": board, "tricks": F.col("claimed"), "result": F.when(F.col("contract") != "PASS", F.col("claimed") - 6 - F.substring("contract", 1, 1).try_cast("int"))})


def canonical_from_score_table(df: DataFrame, k, table: str = "score_table") -> DataFrame:
    """A record per board with its nested result list -> one canonical result per list entry.

    Entries have contract ('3NT+1' style suffixes are cut), declarer, result (tricks as text), pair_id_ns and pair_id_ew.  ``row_index``
    counts a board's entries from 0 in list order, so that (``k``, row_index) names a row.  Pair numbers become texts, and the four
    ``player_id_*`` are made up from them ('12_N').  A contract without level, strain and declarer is null unless it begins with
    'PASS'; tricks that are no number are null.
    """
    rest = [c for c in df.columns if c not in (table, *k)]
    out = df.select(*k, *rest, F.posexplode(table).alias("row_index", "_r"))
    name = F.regexp_extract(normalise_contract(F.col("_r.contract")), r"^([^-+=]*)", 1)
    bid = F.concat(F.regexp_replace(F.trim(name), r"\s+", ""), F.upper(F.substring("_r.declarer", 1, 1)))
    out = out.withColumn("contract", F.when(name.startswith("PASS"), F.lit("PASS")).when(is_contract(bid), bid))
    out = out.withColumns({"tricks": F.col("_r.result").try_cast("int"), "pair_number_ns": F.col("_r.pair_id_ns").cast("string"), "pair_number_ew": F.col("_r.pair_id_ew").cast("string")})
    out = out.withColumns({"result": F.when(F.col("contract") != "PASS", result_of(F.substring("contract", 1, 1).try_cast("int"), F.col("tricks"))),
                           **{f"player_id_{d.lower()}": F.concat(F.col(f"pair_number_{side}"), F.lit(f"_{d}")) for d, side in zip("NESW", ("ns", "ew", "ns", "ew"))}})
    return out.drop("_r")


def render_pbn(df: DataFrame, tags: dict[str, Column]) -> Column:
    """A PBN block from columns: one ``[Tag "value"]`` line per tag (null values omitted)."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f'[{t} "'), v.cast("string"), F.lit('"]'))) for t, v in tags.items()]
    return F.concat_ws("\n", *lines)


def _suit_holdings_from_lin_hand(h: Column) -> list[Column]:
    """S, H, D, C holdings (high to low) of a LIN hand 'S<cards>H<cards>D<cards>C<cards>' (cards low to high)."""
    out = []
    for s in "SHDC":
        cards = F.regexp_extract(F.replace(F.upper(h), F.lit("10"), F.lit("T")), s + r"([2-9TJQKA]*)", 1)
        out.append(F.reverse(cards))
    return out


def parse_lin(df: DataFrame, line: str = "value") -> DataFrame:
    """Board, players, calls with alerts and announcements, play and claim of a LIN line.  The 4th hand is the deck
    minus the three given; a line without three hands of 13 different cards has a null ``pbn`` and its text in ``_corrupt``."""
    toks = F.split(F.col(line), r"\|", -1)
    keys = F.filter(F.transform(toks, lambda t, i: F.when(i % 2 == 0, t)), lambda x: x.isNotNull())
    vals = F.filter(F.transform(toks, lambda t, i: F.when(i % 2 == 1, t)), lambda x: x.isNotNull())
    pairs = F.arrays_zip(keys.alias("k"), F.slice(vals, 1, F.size(keys)).alias("v"))
    out = df.withColumn("_pairs", pairs)
    first = lambda k: F.get(F.filter("_pairs", lambda p: p["k"] == k), F.lit(0))["v"]
    calls = F.transform(F.filter("_pairs", lambda p: p["k"] == "mb"), lambda p: F.regexp_replace(p["v"], "!", ""))
    md = first("md")
    names = F.split(first("pn"), ",")
    out = out.withColumns({
        "dealer": F.try_element_at(vocab.map_literal(LIN_DEALER), F.substring(md, 1, 1)),
        "vul": F.try_element_at(vocab.map_literal(LIN_VUL), F.lower(first("sv"))),
        "board_text": first("ah"),
        "calls": F.array_join(calls, "-"),
        "alerts": F.transform(F.filter("_pairs", lambda p: p["k"] == "mb"), lambda p: p["v"].endswith("!")),
        "announcements": F.transform(F.filter("_pairs", lambda p: p["k"] == "an"), lambda p: p["v"]),
        "play": F.transform(F.filter("_pairs", lambda p: p["k"] == "pc"), lambda p: F.upper(p["v"])),
        "claimed": first("mc").try_cast("int"),
        # players are given S, W, N, E
        **{f"player_{seat}": F.nullif(F.get(names, F.lit(i)), F.lit("")) for i, seat in enumerate("swne")},
        "_hands": F.split(F.substr(md, F.lit(2)), ","),
    })
    # given hands are S, W, N (clockwise from South); E is inferred
    hs = [F.coalesce(F.get(F.col("_hands"), F.lit(i)), F.lit("")) for i in (0, 1, 2)]
    holdings = {seat: _suit_holdings_from_lin_hand(h) for seat, h in zip("SWN", hs)}
    deck = F.array(*[F.lit(s + r) for s in "SHDC" for r in "AKQJT98765432"])

    def tagged(holding: Column, suit: str) -> Column:
        return F.transform(F.split(holding, ""), lambda r: F.concat(F.lit(suit), r))

    def of_suit(cards: Column, suit: str) -> Column:
        return F.array_join(F.transform(F.filter(cards, lambda c: F.substring(c, 1, 1) == F.lit(suit)),
                                        lambda c: F.substring(c, 2, 1)), "")

    held = F.flatten(F.array(*[tagged(holdings[seat][i], s) for seat in "SWN" for i, s in enumerate("SHDC")]))
    east_cards = F.array_except(deck, F.filter(held, lambda c: F.length(c) == 2))
    east = [of_suit(east_cards, s) for s in "SHDC"]
    holdings["E"] = east
    hand = {seat: F.concat_ws(".", *holdings[seat]) for seat in "NESW"}
    pbn = F.concat(F.lit("N:"), F.concat_ws(" ", hand["N"], hand["E"], hand["S"], hand["W"]))
    given = [F.length(F.concat(*holdings[seat])) == 13 for seat in "SWN"]
    valid = F.coalesce(given[0] & given[1] & given[2] & (F.size(east_cards) == 13) & F.col("dealer").isNotNull(), F.lit(False))
    return (out.withColumn("pbn", F.when(valid, pbn)).withColumn("_corrupt", F.when(~valid, F.col(line)))
            .drop("_pairs", "_hands"))


def read_lin(spark: SparkSession, path: str) -> DataFrame:
    """A LIN file -> one parsed board per non-empty line."""
    return parse_lin(spark.read.text(path).filter(F.length(F.trim("value")) > 0), "value")


def render_lin(dealer: Column, pbn: Column, vul_code: Column, board: Column, calls: Column) -> Column:
    """A LIN line: md (dealer code + S, W, N hands, cards low to high), sv, ah and one mb per call."""
    code = F.element_at(vocab.map_literal({v: k for k, v in LIN_DEALER.items()}), dealer)
    hands = F.split(F.substr(pbn, F.lit(3)), " ")

    def lin_hand(i: int) -> Column:
        suits = F.split(F.element_at(hands, i + 1), r"\.", -1)
        return F.concat(*[F.concat(F.lit(s), F.reverse(F.element_at(suits, j + 1))) for j, s in enumerate("SHDC")])

    md = F.concat(code, F.concat_ws(",", lin_hand(2), lin_hand(3), lin_hand(0)))
    mbs = F.array_join(F.transform(F.split(calls, "-"), lambda c: F.concat(F.lit("mb|"), c, F.lit("|"))), "")
    return F.concat(F.lit("md|"), md, F.lit("|sv|"), vul_code, F.lit("|ah|Board "), board.cast("string"), F.lit("|"), mbs)


def save_stage(df: DataFrame, root: str, name: str) -> str:
    """Write a stage result as parquet (overwrite) so a later run can resume from it."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    """S9."""
    df.write.mode("overwrite").option("header", True).csv(path)


def auction_arrays(df: DataFrame, calls: str = "calls", sep: str = "-") -> DataFrame:
    """S3: an auction string into parallel arrays: call type, level, denomination, penalty."""
    c = F.transform(F.split(F.col(calls), sep), lambda x: F.upper(F.trim(x)))
    is_bid = lambda x: x.rlike(r"^[1-7][CDHSN]$")
    return df.withColumns({
        "bid_type": F.transform(c, lambda x: F.when(is_bid(x), F.lit("bid")).when(x == "P", F.lit("pass"))
                                .when(x == "D", F.lit("double")).when(x == "R", F.lit("redouble"))),
        "bid_level": F.transform(c, lambda x: F.when(is_bid(x), F.substring(x, 1, 1).cast("int"))),
        "bid_denom": F.transform(c, lambda x: F.when(is_bid(x), F.substring(x, 2, 1))),
        "bid_penalty": F.transform(c, lambda x: F.when(x == "D", F.lit("X")).when(x == "R", F.lit("XX"))),
    })


def noted_auction_arrays(df: DataFrame, auction: str = "auction", tags: str = "tags") -> DataFrame:
    """S3: parallel arrays of a PBN auction: bid_type (Contract or Penalty), bid_level, bid_denom, bid_penalty (passed, doubled,
    redoubled), bid_alertable and bid_announcement.

    A note reference ``=n=`` after a call is resolved against the block's ``Note "n:text"`` tags (the first one of that number) and,
    like a trailing ``!``, makes the call alertable; ``AP`` stands for the passes that end the auction; suffix tokens (``$n``, ``*``,
    ``+``, ``^..``) are no calls.  Unknown tokens and references without a note give nulls.
    """
    text = F.transform(F.col(auction), lambda t: F.upper(F.regexp_replace(t, r"[!?]+$", "")))
    call = r"^([1-7](C|D|H|S|NT?)|PASS|P|X|XX|D|R|AP)$"
    tokens = F.arrays_zip(text.alias("call"), F.transform(F.col(auction), lambda t: t.rlike(r"![?!]*$")).alias("mark"))
    following = F.transform(F.col("_tokens"), lambda t, i: F.struct(
        t["call"].alias("call"), t["mark"].alias("mark"), F.regexp_extract(F.coalesce(F.get(F.col("_tokens"), i + 1)["call"], F.lit("")), r"^=(\d+)=$", 1).alias("ref")))
    made = F.filter(F.col("_all"), lambda t: t["call"].rlike(call))
    passed = lambda t: t["call"].isin("PASS", "P")
    given = F.filter(F.col("_made"), lambda t: t["call"] != "AP")
    trailing = F.aggregate(F.reverse(given), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                           lambda a, t: F.struct((a["n"] + F.when(a["on"] & passed(t), 1).otherwise(0)).alias("n"), (a["on"] & passed(t)).alias("on")))["n"]
    ends = F.when(F.exists(given, lambda t: ~passed(t)), F.lit(3)).otherwise(F.lit(4))
    rest = F.array_repeat(F.struct(F.lit("PASS").alias("call"), F.lit(False).alias("mark"), F.lit("").alias("ref")), F.greatest(ends - trailing, F.lit(0)).cast("int"))
    whole = F.when(F.exists("_made", lambda t: t["call"] == "AP"), F.concat(given, rest)).otherwise(given)
    out = df.withColumn("_tokens", tokens).withColumn("_all", following).withColumn("_made", made).withColumn("_calls", whole)
    bid = lambda t: t["call"].rlike("^[1-7]")
    note = lambda t: F.get(F.filter(F.col(tags), lambda p: (p["k"] == "Note") & (F.substring_index(p["v"], ":", 1) == t["ref"])), F.lit(0))["v"]
    penalty = lambda t: F.when(passed(t), "passed").when(t["call"].isin("X", "D"), "doubled").when(t["call"].isin("XX", "R"), "redoubled")
    return out.withColumns({
        "bid_type": F.transform("_calls", lambda t: F.when(bid(t), F.lit("Contract")).otherwise(F.lit("Penalty"))),
        "bid_level": F.transform("_calls", lambda t: F.when(bid(t), F.substring(t["call"], 1, 1).cast("int"))),
        "bid_denom": F.transform("_calls", lambda t: F.when(bid(t), F.substring(t["call"], 2, 1))),
        "bid_penalty": F.transform("_calls", lambda t: F.when(~bid(t), penalty(t))),
        "bid_alertable": F.transform("_calls", lambda t: t["mark"] | (t["ref"] != "")),
        "bid_announcement": F.transform("_calls", lambda t: F.when(t["ref"] != "", F.trim(F.regexp_replace(note(t), r"^[^:]*:", "")))),
    }).drop("_tokens", "_all", "_made", "_calls")


def play_arrays(df: DataFrame, play: str = "play", sep: str = " ") -> DataFrame:
    """S3: a play string of cards ('SA HK ...') into parallel suit and rank arrays."""
    cards = F.filter(F.split(F.trim(F.col(play)), sep), lambda x: F.length(x) >= 2)
    return df.withColumns({
        "play_suit": F.transform(cards, lambda x: F.substring(x, 1, 1)),
        "play_rank": F.transform(cards, lambda x: F.substring(x, 2, 2)),
    })


def explode_score_table(df: DataFrame, col: str) -> DataFrame:
    """A nested per-board result list (array of structs) -> one row per result, board columns kept."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.explode(col).alias("_r")).select(*rest, "_r.*")


def history_pages(df: DataFrame, data_col: str, total_col: str, key: str, id_field: str = "id") -> tuple[DataFrame, DataFrame]:
    """Pages of ``data[]`` into rows (ids starting 'tmp:' or '#' skipped) and a per-key check
    of the announced total against the sessions seen."""
    rows = df.select(key, total_col, F.explode(data_col).alias("_d")).select(key, total_col, "_d.*")
    rows = rows.filter(~F.col(id_field).cast("string").rlike(r"^(tmp:|#)"))
    check = rows.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.max(total_col).alias("total"))
    return rows, check.withColumn("complete", F.col("seen") >= F.col("total"))
