"""Contract, result and score Column expressions.

A contract string is ``PASS`` or level + strain + ('' | X | XX) + declarer seat, e.g. ``4SXN``.
Null means "no or invalid contract" and stays distinct from PASS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring, vocab

# fixed value: the grammar of a normalised contract
CONTRACT_RE = r"^([1-7])([CDHSN])(X{0,2})([NESW])$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_contract(col) -> Column:
    """Upper case, suit symbols to letters, NT to N."""
    c = F.upper(F.trim(_c(col)))
    c = F.translate(c, "♠♥♦♣", "SHDC")
    return F.replace(c, F.lit("NT"), F.lit("N"))


def is_contract(col) -> Column:
    return _c(col).rlike(CONTRACT_RE)


def level_of(col) -> Column:
    c = _c(col)
    return F.when(is_contract(c), F.substring(c, 1, 1).cast("int"))


def strain_of(col) -> Column:
    c = _c(col)
    return F.when(is_contract(c), F.substring(c, 2, 1))


def dbl_of(col) -> Column:
    c = _c(col)
    return F.when(is_contract(c), F.substring(c, 3, F.length(c) - 3))


def declarer_of(col) -> Column:
    c = _c(col)
    return F.when(is_contract(c), F.substring(c, -1, 1))


def with_contract_parts(df: DataFrame, contract: str = "contract", vul_ns: str = "vul_ns", vul_ew: str = "vul_ew") -> DataFrame:
    """Declarer, declarer pair, level, strain, dbl and declarer vulnerability; null for PASS/invalid."""
    out = df.withColumn("_ok", is_contract(contract))
    c = F.col(contract)
    ok = F.col("_ok")
    out = out.withColumns({
        "level": F.when(ok, F.substring(c, 1, 1).cast("int")),
        "strain": F.when(ok, F.substring(c, 2, 1)),
        "dbl": F.when(ok, F.substring(c, 3, F.length(c) - 3)),
        "declarer": F.when(ok, F.substring(c, -1, 1)),
    }).drop("_ok")
    out = out.withColumn("declarer_pair", vocab.pair_of(F.col("declarer")))
    if vul_ns in df.columns and vul_ew in df.columns:
        out = out.withColumn(
            "vul_declarer",
            F.when(F.col("declarer_pair") == "NS", F.col(vul_ns)).when(F.col("declarer_pair") == "EW", F.col(vul_ew)),
        )
    return out


def with_seats(df: DataFrame, declarer: str = "declarer", player_cols: dict | None = None) -> DataFrame:
    """On-lead (LHO), dummy and not-on-lead (RHO) seats; player ids of them when given."""
    d = F.col(declarer)
    out = df.withColumns({
        "seat_on_lead": vocab.next_seat(d),
        "seat_dummy": vocab.partner_seat(d),
        "seat_not_on_lead": vocab.next_seat(vocab.partner_seat(d)),
        "opponent_pair": F.element_at(vocab.map_literal(vocab.OPPONENT_PAIR), vocab.pair_of(d)),
    })
    if player_cols:
        def pick(seat: Column) -> Column:
            names = F.array(*[F.lit(s) for s in player_cols])
            vals = F.array(*[F.col(c).cast("string") for c in player_cols.values()])
            return F.element_at(F.map_from_arrays(names, vals), seat)
        out = out.withColumns({
            "declarer_id": pick(d),
            "on_lead_id": pick(F.col("seat_on_lead")),
            "dummy_id": pick(F.col("seat_dummy")),
            "not_on_lead_id": pick(F.col("seat_not_on_lead")),
        })
    return out


def contract_type(level, strain) -> Column:
    """C4: Pass / Partial / Game / SSlam / GSlam of a bid contract."""
    lv, st = _c(level), _c(strain)
    return (
        F.when(lv.isNull(), F.lit("Pass"))
        .when(lv == 7, F.lit("GSlam"))
        .when(lv == 6, F.lit("SSlam"))
        .when((st == "N") & (lv >= 3), F.lit("Game"))
        .when(st.isin("H", "S") & (lv >= 4), F.lit("Game"))
        .when(st.isin("C", "D") & (lv >= 5), F.lit("Game"))
        .otherwise(F.lit("Partial"))
    )


def tricks_type(tricks, strain) -> Column:
    """Contract type reachable with a number of tricks in a strain; null tricks give null."""
    t, st = _c(tricks), _c(strain)
    return (
        F.when(t.isNull(), F.lit(None).cast("string"))
        .when(t < 7, F.lit("Pass"))
        .when((t == 11) & st.isin("C", "D"), F.lit("Game"))
        .when(t.isin(10, 11) & st.isin("H", "S"), F.lit("Game"))
        .when(t.isin(9, 10, 11) & (st == "N"), F.lit("Game"))
        .when(t == 12, F.lit("SSlam"))
        .when(t == 13, F.lit("GSlam"))
        .otherwise(F.lit("Partial"))
    )


def result_of(level, tricks) -> Column:
    """Result relative to the contract (tricks - 6 - level)."""
    return (_c(tricks) - 6 - _c(level)).cast("int")


def tricks_of(level, result) -> Column:
    return (_c(level) + 6 + _c(result)).cast("int")


def parse_result(text) -> Column:
    """C6: '=', '+n', '-n' (or a plain signed number) to a relative result; bad text gives null."""
    t = F.trim(_c(text))
    digits = F.regexp_extract(t, r"^([+-]?)([0-9]{1,2})$", 2)
    sign = F.when(F.regexp_extract(t, r"^([+-]?)([0-9]{1,2})$", 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    return (
        F.when(t == "=", F.lit(0))
        .when(t.rlike(r"^[+-]?[0-9]{1,2}$"), sign * digits.cast("int"))
        .cast("int")
    )


def result_text(result) -> Column:
    r = _c(result)
    return F.when(r.isNull(), F.lit(None)).when(r == 0, F.lit("=")).when(r > 0, F.concat(F.lit("+"), r.cast("string"))).otherwise(r.cast("string"))


def with_signed_scores(df: DataFrame, contract: str = "contract", score_col: str = "score_declarer") -> DataFrame:
    """NS/EW scores from the declarer-relative score; PASS scores 0 for both."""
    is_pass = F.col(contract) == "PASS"
    s = F.col(score_col)
    return df.withColumns({
        "score_ns": F.when(is_pass, F.lit(0)).when(F.col("declarer_pair") == "NS", s).when(F.col("declarer_pair") == "EW", -s).cast("int"),
        "score_ew": F.when(is_pass, F.lit(0)).when(F.col("declarer_pair") == "EW", s).when(F.col("declarer_pair") == "NS", -s).cast("int"),
    })


def with_scores(df: DataFrame, contract: str = "contract", tricks: str = "tricks") -> DataFrame:
    """C2 + C6 + C7 + C9 on a results table that already has vul_ns / vul_ew."""
    out = with_contract_parts(df, contract)
    out = out.withColumn("result", result_of(F.col("level"), F.col(tricks)))
    out = out.withColumn(
        "score_declarer",
        F.when(F.col(contract) == "PASS", F.lit(0)).otherwise(
            scoring.score("level", "strain", "dbl", "vul_declarer", "result")
        ),
    )
    return with_signed_scores(out, contract)


def with_trick_flags(df: DataFrame, result: str = "result", tricks: str = "tricks", dd: str | None = None) -> DataFrame:
    """Over-tricks / just made / under-tricks, and tricks minus double-dummy tricks."""
    r = F.col(result)
    out = df.withColumns({"over_tricks": r > 0, "just_made": r == 0, "under_tricks": r < 0})
    if dd:
        out = out.withColumn("tricks_dd_diff", (F.col(tricks) - F.col(dd)).cast("int"))
    return out
