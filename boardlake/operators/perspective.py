"""Row filters and a player's perspective on a results table (F1-F8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import DIRECTIONS, PAIR_OF_SEAT, PARTNER


def filter_boards(df: DataFrame, club: str | None = None, vul: str | None = None, side: str | None = None,
                  suits=None, types=None, doubles=None, key_col: str = "key", side_col: str = "declarer_pair",
                  strain_col: str = "strain", type_col: str = "contract_type", dbl_col: str = "dbl") -> DataFrame:
    """optional filters by club prefix, vulnerability, declaring side, strains, contract types, doubles.

    vul is one of 'None', 'NS', 'EW', 'Both' (Both tests both sides; the reference tests NS twice).
    """
    out = df
    if club is not None:
        out = out.filter(F.col(key_col).startswith(club))
    if vul is not None:
        ns, ew = F.col("vul_ns"), F.col("vul_ew")
        cond = {"None": ~(ns | ew), "NS": ns, "EW": ew, "Both": ns & ew}[vul]
        out = out.filter(cond)
    if side is not None:
        out = out.filter(F.col(side_col) == side)
    if suits is not None:
        out = out.filter(F.col(strain_col).isin(list(suits)))
    if types is not None:
        out = out.filter(F.col(type_col).isin(list(types)))
    if doubles is not None:
        out = out.filter(F.col(dbl_col).isin(list(doubles)))
    return out


def player_seat(df: DataFrame, player_id: str, player_cols: dict[str, str]) -> str | None:
    """The seat where ``player_id`` sits, first of N, E, S, W that has it anywhere (one aggregate row)."""
    row = df.agg(*[F.max((F.col(c) == F.lit(str(player_id))).cast("int")).alias(s) for s, c in player_cols.items()]).first()
    for s in DIRECTIONS:
        if s in player_cols and row[s] == 1:
            return s
    return None


def perspective(df: DataFrame, player_id: str, partner_id: str | None, player_cols: dict[str, str],
                declarer_id: str = "declarer_id", contract: str = "contract") -> DataFrame:
    """boards I played, I / partner / we declared, opponents declared (all True if the player is absent)."""
    # one row: the first seat that has the player anywhere
    has = df.agg(*[F.max((F.col(c) == F.lit(str(player_id))).cast("int")).alias(f"_has_{s}") for s, c in player_cols.items()])
    first = F.coalesce(*[F.when(F.col(f"_has_{s}") == 1, F.lit(s)) for s in DIRECTIONS if s in player_cols])
    out = df.crossJoin(F.broadcast(has.select(first.alias("player_seat"))))
    absent = F.col("player_seat").isNull()
    here = F.element_at(F.create_map(*[x for s, c in player_cols.items() for x in (F.lit(s), F.col(c).cast("string"))]), F.col("player_seat"))
    of = lambda names: F.element_at(F.create_map(*[F.lit(x) for s in DIRECTIONS for x in (s, names[s])]), F.col("player_seat"))
    out = out.withColumns({
        "boards_i_played": absent | (here == F.lit(str(player_id))),
        "boards_i_declared": absent | (F.col(declarer_id) == F.lit(str(player_id))),
        "boards_partner_declared": absent | (F.col(declarer_id) == F.lit(str(partner_id))),
        "partner_seat": of(PARTNER), "pair_direction": of(PAIR_OF_SEAT),
    })
    out = out.withColumn("boards_we_declared", F.coalesce(F.col("boards_i_declared"), F.lit(False)) | F.coalesce(F.col("boards_partner_declared"), F.lit(False)))
    return out.withColumn(
        "boards_opponent_declared",
        F.col("boards_i_played") & ~F.col("boards_we_declared") & (F.col(contract) != "PASS"))


def perspective_pair(df: DataFrame, side: str, pair_no, pair_cols: dict[str, str]) -> DataFrame:
    """F2 by pair number: rows where the given pair sat on the given side."""
    return df.withColumn("boards_we_played", F.col(pair_cols[side]) == F.lit(pair_no))


def split_by_date(df: DataFrame, col: str, date: str) -> tuple[DataFrame, DataFrame]:
    """rows before a date and rows from it on."""
    d = F.to_date(F.lit(date))
    return df.filter(F.col(col) < d), df.filter(F.col(col) >= d)


def drop_unplayed(df: DataFrame, own: str, opp: str) -> DataFrame:
    """drop rows where a pair 'played' itself (own side = opponent side)."""
    return df.filter(F.col(own) != F.col(opp))


def find_player(df: DataFrame, player_id: str, cols) -> DataFrame:
    """rows where the id appears in any of ``cols``, leading zeros ignored on both sides."""
    want = F.regexp_replace(F.lit(str(player_id)), r"^0+", "")
    cond = None
    for c in cols:
        t = F.regexp_replace(F.col(c).cast("string"), r"^0+", "") == want
        cond = t if cond is None else cond | t
    return df.filter(cond)


def find_by_date(df: DataFrame, col: str, date: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """rows whose date text parses to the given date; other texts match nothing."""
    return df.filter(F.try_to_date(F.col(col), fmt) == F.to_date(F.lit(date)))


def team_listing(df: DataFrame, section_col: str, team_col: str) -> DataFrame:
    """F8: teams present in each section."""
    return df.groupBy(section_col).agg(F.sort_array(F.collect_set(team_col)).alias("teams"))


def team_exists(df: DataFrame, wanted: DataFrame, section_col: str, team_col: str) -> DataFrame:
    """F8: every (section, team) of ``wanted`` with whether it is in ``df``; nulls match nulls."""
    there = df.select(F.col(section_col).alias("_s"), F.col(team_col).alias("_t")).distinct().withColumn("_there", F.lit(True))
    out = wanted.join(there, F.col(section_col).eqNullSafe(F.col("_s")) & F.col(team_col).eqNullSafe(F.col("_t")), "left")
    return out.withColumn("team_exists", F.coalesce("_there", F.lit(False))).drop("_s", "_t", "_there")


def quality_report(df: DataFrame, pbn: str = "pbn") -> DataFrame:
    """one aggregate of null / malformed deal counts."""
    from ..functions.deals import is_valid_deal

    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(pbn).isNull().cast("int")).alias("null_deals"),
        F.sum((F.length(pbn) != 69).cast("int")).alias("bad_length"),
        F.sum((~is_valid_deal(pbn)).cast("int")).alias("invalid_deals"),
    )
