"""Two French result feeds as canonical results (C17): a section's table listing, and a session's lineups.

Both give one row per table result with this library's column names.  The work is row-local but for the joins
that look up the players of a section's pairs (J6) and a board's deal with the matchpoints of its scores (W1-W3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codings as CD
from ..functions import deals as D
from ..functions.vocab import DIRECTIONS, map_literal
from ..operators import matchpoints as mp
from ..session import by_key, not_broadcast, own_shuffle

SEAT_WORDS = {"N": "north", "E": "east", "S": "south", "W": "west"}
SUIT_WORDS = ("spade", "heart", "diamond", "club")


def french_contract(contract: Column, declarant: Column) -> Column:
    """'3SAx' by 'O' -> '3NXW'; any text that begins with 'pass' -> 'PASS'; other texts, unknown strains or declarers give null."""
    c = F.upper(F.regexp_replace(contract, r"\s+", ""))
    strain = CD.translate_strain(F.regexp_extract(c, r"^[1-7](SA|[PCKTN])X{0,2}$", 1))
    bid = F.concat(F.substring(c, 1, 1), strain, F.regexp_extract(c, r"(X{0,2})$", 1), CD.translate_direction(declarant))
    return F.when(c.startswith("PASS"), F.lit("PASS")).when(c.rlike(r"^[1-7]"), bid)


def feed_result(text: Column) -> Column:
    """'+2' -> 2, '-1' -> -1, any other text ('=', '') -> 0; null and a sign without a number give null."""
    return F.when(text.startswith("+"), F.substr(text, F.lit(2)).try_cast("int")).when(text.startswith("-"), text.try_cast("int")).when(text.isNotNull(), F.lit(0))


def feed_score(own: Column, other: Column) -> Column:
    """A side's score where a feed writes only the gaining side's: own number, 0 if passed out, minus the other side's number, else null."""
    digits = r"^\d+$"
    passed = lambda c: F.upper(F.coalesce(c, F.lit(""))).startswith("PASS")
    return (F.when(own.rlike(digits), own.try_cast("int")).when(passed(own) | passed(other), F.lit(0))
            .when(other.rlike(digits), -other.try_cast("int")))


def french_deal(prefix: str = "deal_") -> Column:
    """16 columns ``<prefix>northCardSpade`` ... with French card letters -> deal text; null if one is null."""
    hand = lambda d: [CD.translate_cards(F.col(f"{prefix}{SEAT_WORDS[d]}Card{s.title()}")) for s in SUIT_WORDS]
    parts = [F.concat(*[x for i, s in enumerate(hand(d)) for x in ([F.lit(".")] if i else []) + [s]]) for d in DIRECTIONS]
    return F.concat(F.lit("N:"), *[x for i, h in enumerate(parts) for x in ([F.lit(" ")] if i else []) + [h]])


def incomplete_boards(df: DataFrame, k, rows: int = 4) -> DataFrame:
    """the boards whose number of rows is no multiple of ``rows`` (a feed lists a board once a direction)."""
    return df.groupBy(*k).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") % rows != 0)


def pair_players(roster: DataFrame) -> DataFrame:
    """One row per (section, side, pair number): ids and full names of the players at positions 1 (N, E) and 2 (S, W).

    Repeated entries of a place give the largest id with its name.
    """
    who = F.struct(F.col("team_players_id").cast("string").alias("id"),
                   F.concat("team_players_firstname", F.lit(" "), "team_players_lastname").alias("name"))
    place = lambda p: F.max(F.when(F.col("team_players_position") == p, who)).alias(f"player_{p}")
    return roster.groupBy(F.col("team_section_name").alias("section"), F.element_at(map_literal(CD.FRENCH_PAIRS), F.col("team_orientation")).alias("side"),
                          F.col("team_table_number").cast("int").alias("pair")).agg(place(1), place(2))


def canonical_french(tables: DataFrame, deals: DataFrame, roster: DataFrame, k=("section", "board"),
                     team: str = "score_eo", opponents: str = "score_ns") -> DataFrame:
    """C17, section feed: contract, result, deal, pairs, players, both scores and matchpoints of every listed table.

    ``tables`` has section, board, contract, declarant, result, the score texts ``team`` (of the home pair's side, which the
    deal's row names) and ``opponents``, team_ns_id, team_eo_id; ``deals`` one row per board, direction and pair with cards,
    dealer, vulnerability and both positions (rows of a pair against its own position are unplayed and dropped, F5);
    ``roster`` one row per player.  Tables without a deal are dropped (inner join, J2), unknown players and scores are null.
    Columns of ``tables`` that are not named here stay.  Matchpoints are those of the scores within ``k``; null scores do
    not count.
    """
    home = F.element_at(map_literal(CD.FRENCH_PAIRS), F.col("teams_players_position"))
    played = deals.where(F.col("teams_players_position") != F.col("teams_opponents_position"))
    played = played.select(
        F.col("tournament_team_section_name").alias("_section"), F.col("deal_dealNumber").cast("int").alias("_board"), french_deal().alias("pbn"),
        CD.translate_direction(F.col("deal_dealer")).alias("dealer"), CD.translate_vul(F.col("deal_vulnerability")).alias("vul"),
        home.alias("pair_direction"), F.col("tournament_team_section_table_number").cast("int").alias("pair_number")).distinct()
    df = tables.withColumn("board", F.col("board").cast("int"))
    k = list(k)
    own, other = feed_score(F.col(team), F.col(opponents)), feed_score(F.col(opponents), F.col(team))
    ns = F.col("pair_direction") == "NS"
    ew = F.col("pair_direction") == "EW"
    scores = {"_ns": F.when(ns, own).when(ew, other), "_ew": F.when(ew, own).when(ns, other)}
    this_board = (F.col("section") == F.col("_section")) & (F.col("board") == F.col("_board"))
    # a board's distinct texts are few, so its matchpoints need none of the tables' other columns
    texts = df.groupBy(*dict.fromkeys(["section", "board", *k]), team, opponents).agg(F.count(F.lit(1)).alias("_n"))
    texts = by_key(texts, "section", "board").join(not_broadcast(played.select("_section", "_board", "pair_direction")), this_board).withColumns(scores)
    freq = texts.groupBy(*k, "_ns", "_ew").agg(F.sum("_n").alias("_n"))
    listed = mp.list_scores(mp.frequency_matchpoints(freq, k, "_ns", "_ew"), k, "_ns", "_ew")
    facts = played.withColumnsRenamed({"_section": "section", "_board": "board"})
    if k == ["section", "board"]:
        facts = own_shuffle(listed.join(not_broadcast(facts), k), *k)
    players = pair_players(roster).groupBy("section").agg(F.collect_list(F.struct("side", "pair", "player_1", "player_2")).alias("_players"))
    df = df.withColumns({"pair_number_ns": F.col("team_ns_id").cast("int"), "pair_number_ew": F.col("team_eo_id").cast("int")}).drop("team_ns_id", "team_eo_id")
    df = df.join(not_broadcast(own_shuffle(players, "section")), "section", "left")
    for side, seats in (("NS", "ns"), ("EW", "ew")):
        mine = F.filter("_players", lambda x: (x["side"] == side) & (x["pair"] == F.col(f"pair_number_{seats}")))  # noqa: B023
        df = df.withColumn("_pair", F.get(mine, F.lit(0)))
        df = df.withColumns({f"player_{what}_{seat}": F.col(f"_pair.player_{i}.{what}") for what in ("id", "name") for i, seat in ((1, seats[0]), (2, seats[1]))})
    df = df.drop("_players", "_pair").join(not_broadcast(facts), ["section", "board"])
    df = df.withColumns({"contract": french_contract(F.col("contract"), F.col("declarant")), "result": feed_result(F.col("result")), **scores})
    df = df.drop(team, opponents, "declarant").withColumnsRenamed({"_ns": "score_ns", "_ew": "score_ew"})
    if k != ["section", "board"]:
        listed = listed.withColumnsRenamed({c: f"_k_{c}" for c in k})
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in k]
        df = df.join(not_broadcast(listed), same, "left").drop(*[f"_k_{c}" for c in k])
    return mp.percentages(mp.listed_matchpoints(df))


def frequency_lists(freqs: str = "board_frequencies") -> dict[str, Column]:
    """A board's list of (nsScore, nsNote, ewScore, ewNote, count) as five parallel lists, and the top."""
    f = F.col(freqs)
    names = {"scores_list_ns": "nsScore", "pcts_list_ns": "nsNote", "scores_list_ew": "ewScore", "pcts_list_ew": "ewNote", "score_freq_list": "count"}
    top = F.aggregate(f, F.lit(0).cast("long"), lambda a, x: a + x["count"]) - 1
    return {**{out: F.col(f"{freqs}.{name}") for out, name in names.items()}, "mp_top": top}


def expanded_scores(freqs: str = "board_frequencies") -> Column:
    """A10: North-South's score of every table of a board, from its frequencies: null if adjusted ('60%'), 0 if passed out,
    East-West's with the other sign where only theirs is given."""
    def score(x):
        text = F.concat(F.coalesce(x["nsScore"], F.lit("")), F.coalesce(x["ewScore"], F.lit("")))
        return F.when(~text.contains("%"), feed_score(x["nsScore"], x["ewScore"]))

    return F.flatten(F.transform(F.col(freqs), lambda x: F.array_repeat(score(x), x["count"].cast("int"))))


def canonical_french_lineup(df: DataFrame) -> DataFrame:
    """C17, lineup feed: canonical results with both scores, percentages, matchpoints, players and pair numbers.

    Dealer and vulnerability follow the board number; the deal is written from North; the contract is 'PASS', a bid
    with its declarer, or null; percentages are the feed's notes, matchpoints percentage x top to two digits; a pair's number is
    taken from the home or away team by that team's orientation ('NS', 'EW'; others sit out).  A passed-out board scores 0.
    """
    c = F.upper(F.replace(F.col("contract"), F.lit("NT"), F.lit("N")))
    contract = F.when(c == "PASS", F.lit("PASS")).when(c.rlike("^[1-7]"), F.concat(c, F.upper(F.col("declarer"))))
    team = lambda side, field: F.col(f"lineup_segment_game_{side}Team_{field}")
    pair = lambda d: (F.when(team("home", "orientation") == d, team("home", "startTableNumber"))
                      .when(team("away", "orientation") == d, team("away", "startTableNumber")).cast("int"))
    player = lambda d, field: F.col(f"lineup_{SEAT_WORDS[d]}Player_{field}")
    out = df.select(
        "group_id", "board_id", F.col("boardNumber").cast("int").alias("board"), *[v.alias(n) for n, v in frequency_lists().items()],
        D.dealer_of("boardNumber").alias("dealer"), D.vul_of("boardNumber").alias("vul"), CD.rotate_to_north(F.col("board_deal")).alias("pbn"),
        contract.alias("contract"), feed_result(F.col("result")).alias("result"),
        feed_score(F.col("nsScore"), F.col("ewScore")).alias("score_ns"), feed_score(F.col("ewScore"), F.col("nsScore")).alias("score_ew"),
        (F.col("nsNote") / 100.0).alias("pct_ns"), (F.col("ewNote") / 100.0).alias("pct_ew"),
        *[F.concat(player(d, "firstName"), F.lit(" "), player(d, "lastName")).alias(f"player_name_{d.lower()}") for d in DIRECTIONS],
        *[player(d, "ffbId").cast("string").alias(f"player_id_{d.lower()}") for d in DIRECTIONS],
        team("home", "section").alias("section"), (team("home", "section") != team("away", "section")).alias("sections_differ"),
        pair("NS").alias("pair_number_ns"), pair("EW").alias("pair_number_ew"))
    return out.withColumns({f"mp_{side}": F.round(F.col(f"pct_{side}") * F.col("mp_top"), 2) for side in ("ns", "ew")})
