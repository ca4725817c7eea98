"""Q6: result pages and table results to enriched results seen by each session's best pair, in one plan.

pages -> pairs by each page's own header (S13); results -> scores, matchpoints, double dummy, EV (Q5) -> players of every result (J3)
and best pair of the session (K2) -> its perspective (F2).  All of it is lazy; pages and sessions of any number go through together.  What a
page says is one row a session, met by the results last, so that no name or club is carried through another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import not_broadcast, own_shuffle
from ..sources import pages as PG
from .pipeline import enrich, with_players

# fixed values: header names and section labels of the result pages
HEADERS = {"position": ["pos", "position"], "pair_number": ["no", "pair"], "players": ["players"],
           "match_points": ["matchpoints", "mp", "mps"], "score_percent": ["score%", "score"]}
SECTIONS = {"North / South": "NS", "East / West": "EW"}


def feed_pairs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, club, event, direction, position, pair_number, player_1, player_2, match_points, score_percent) of every listed pair.

    Rows whose position is not a number, that miss a cell or whose values are no numbers are no results; an empty value is 0.
    """
    p = PG.query_params(pages, "url", ["club", "event"]).select(key, "html", F.col("q_club").alias("club"), F.col("q_event").alias("event"))
    rows = PG.rows_by_header(p, HEADERS, SECTIONS, key).where(F.col("position").rlike("^[0-9]+$"))
    number: dict[str, Column] = {c: F.when(F.col(c) == "", F.lit(0.0)).otherwise(F.col(c).try_cast("double")) for c in ("match_points", "score_percent")}
    names = F.split("players", r"\s*&\s*")
    rows = rows.select(key, F.col("section").alias("direction"), F.col("position").cast("int").alias("position"),
                       F.col("pair_number").try_cast("int").alias("pair_number"), F.get(names, F.lit(0)).alias("player_1"), F.get(names, F.lit(1)).alias("player_2"),
                       *[v.alias(c) for c, v in number.items()])
    return rows.dropna(subset=["pair_number", "match_points", "score_percent"]).join(not_broadcast(p.select(key, "club", "event")), key)


def _best() -> Column:
    order = F.struct(F.col("score_percent"), (F.col("direction") == "NS").alias("_ns"), (-F.col("position")).alias("_p"), (-F.col("pair_number")).alias("_n"))
    fields = ["club", "event", "direction", "pair_number", "player_1", "player_2", "score_percent"]
    return F.max_by(F.struct(*fields), order).alias("_best")


def best_pairs(pairs: DataFrame, key: str = "page_id") -> DataFrame:
    """K2: the pair with the highest percentage of each page; ties go to NS, then to the smaller position and number."""
    return pairs.groupBy(key).agg(_best()).select(key, "_best.*")


def page_facts(pairs: DataFrame, key: str = "page_id") -> DataFrame:
    """One row a page: its best pair (K2) as ``_best`` and the pairs that it lists as ``_pairs``."""
    return pairs.groupBy(key).agg(_best(), F.collect_list(F.struct("direction", "pair_number", F.struct("position", "player_1", "player_2").alias("who"))).alias("_pairs"))


def process_feed(pages: DataFrame, results: DataFrame, boards: DataFrame, dd: DataFrame, sd_samples: DataFrame,
                 session: str = "session_id", page_key: str = "page_id") -> DataFrame:
    """Q6.  ``results`` has the session, board, pair numbers (pair_no_ns, pair_no_ew), contract and tricks;
    pages are matched by ``page_key`` = session.  Results of pairs that no page lists keep null players; of sessions
    without a page, a null best pair."""
    facts = own_shuffle(page_facts(feed_pairs(pages, page_key), page_key).withColumnRenamed(page_key, "_page"), "_page")
    out = enrich(results, boards, dd, sd_samples).join(not_broadcast(facts), F.col(session) == F.col("_page"), "left")
    for side, one, two in (("NS", "player_n", "player_s"), ("EW", "player_e", "player_w")):
        listed = F.filter("_pairs", lambda x: (x["direction"] == side) & (x["pair_number"] == F.col(f"pair_no_{side.lower()}")))  # noqa: B023
        out = out.withColumn("_p", F.array_min(F.transform(listed, lambda x: x["who"])))
        out = out.withColumns({one: F.col("_p.player_1"), two: F.col("_p.player_2")})
    out = with_players(out).drop("_pairs", "_p")
    best = {"club": "club", "event": "event", "pair_direction": "direction", "_number": "pair_number", "player_id": "player_1", "partner_id": "player_2"}
    out = out.withColumns({c: F.col(f"_best.{f}") for c, f in best.items()}).drop("_best")
    mine = F.when(F.col("pair_direction") == "NS", F.col("pair_no_ns")).otherwise(F.col("pair_no_ew")) == F.col("_number")
    out = out.withColumn("boards_i_played", F.coalesce(mine, F.lit(False)))
    declared = lambda who: F.coalesce(F.col("boards_i_played") & (F.col("declarer_id") == F.col(who)), F.lit(False))
    out = out.withColumns({"boards_i_declared": declared("player_id"), "boards_partner_declared": declared("partner_id")})
    out = out.withColumn("boards_we_declared", F.col("boards_i_declared") | F.col("boards_partner_declared"))
    theirs = F.col("boards_i_played") & ~F.col("boards_we_declared") & (F.col("contract") != "PASS")
    return out.withColumn("boards_opponent_declared", F.coalesce(theirs, F.lit(False))).drop("_page", "_number")
