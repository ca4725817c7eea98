"""Fixed vocabularies of contract bridge.

These are values of the game itself and must be exactly these for results to be right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------------
DIRECTIONS = "NESW"            # seat order used in deal strings (PBN)
PAIRS = ("NS", "EW")
SUITS = "SHDC"                 # suit order inside a hand of a deal string
STRAINS = "CDHSN"              # strain index order (clubs low, notrump high)
STRAINS_HIGH_FIRST = "SHDCN"   # strain order used for ties in arg-max selections
RANKS = "AKQJT98765432"        # card ranks, high to low
VULS = ("None", "N_S", "E_W", "Both")  # vulnerability code 0..3
DOUBLES = ("", "X", "XX")
HCP_VALUES = {"A": 4, "K": 3, "Q": 2, "J": 1}
# quick tricks by the start of a suit holding, checked in this order
QUICK_TRICKS = (("AK", 2.0), ("AQ", 1.5), ("A", 1.0), ("KQ", 1.0), ("K", 0.5))
# distribution points by suit length 0, 1, 2
DISTRIBUTION_POINTS = {0: 3, 1: 2, 2: 1}
NEXT_SEAT = {"N": "E", "E": "S", "S": "W", "W": "N"}
PARTNER = {"N": "S", "E": "W", "S": "N", "W": "E"}
PAIR_OF_SEAT = {"N": "NS", "S": "NS", "E": "EW", "W": "EW"}
OPPONENT_PAIR = {"NS": "EW", "EW": "NS"}
CONTRACT_TYPES = ("Pass", "Game", "SSlam", "GSlam", "Partial")
# spellings found in result feeds, mapped to the canonical value
VUL_SPELLINGS = {
    "None": "None", "Love": "None", "-": "None", "0": "None", "none": "None", "NONE": "None",
    "NS": "N_S", "N_S": "N_S", "N-S": "N_S", "ns": "N_S",
    "EW": "E_W", "E_W": "E_W", "E-W": "E_W", "ew": "E_W",
    "Both": "Both", "All": "Both", "ALL": "Both", "BOTH": "Both", "b": "Both", "both": "Both",
}
STRAIN_SPELLINGS = {
    "C": "C", "D": "D", "H": "H", "S": "S", "N": "N", "NT": "N", "SA": "N",
    "♣": "C", "♦": "D", "♥": "H", "♠": "S",
}
DOUBLE_SPELLINGS = {"": "", "X": "X", "XX": "XX", "*": "X", "**": "XX", "D": "X", "R": "XX"}
# ------------------------------------------------------------------------------------


def map_literal(mapping: dict) -> Column:
    """A small fixed dictionary as a map literal (folded into the plan, no join)."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def map_vocab(col: Column | str, vocab: dict, strict: bool = False) -> Column:
    """Translate spellings to canonical values; strict raises on unknown non-null values."""
    c = F.col(col) if isinstance(col, str) else col
    mapped = F.element_at(map_literal(vocab), c)
    if not strict:
        return mapped
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.coalesce(mapped, F.raise_error(F.concat(F.lit("unknown value: "), c.cast("string"))))
    )


def seat_index(seat: Column) -> Column:
    """'N','E','S','W' -> 0..3 (null for anything else)."""
    pos = F.instr(F.lit(DIRECTIONS), seat)
    return F.when((F.length(seat) == 1) & (pos > 0), (pos - 1).cast("int"))


def next_seat(seat: Column) -> Column:
    return F.element_at(map_literal(NEXT_SEAT), seat)


def partner_seat(seat: Column) -> Column:
    return F.element_at(map_literal(PARTNER), seat)


def pair_of(seat: Column) -> Column:
    return F.element_at(map_literal(PAIR_OF_SEAT), seat)
