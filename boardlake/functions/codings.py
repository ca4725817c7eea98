"""Deal encodings and conversions (P1, P16, P17, P19, P21, P24, C15) as Column expressions.

All row-local: bit codes are sums of constant shifts selected by ``contains``; rotations
and conversions are string slicing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import deals as D
from .vocab import DIRECTIONS, RANKS, map_literal

# fixed values: French spellings of cards, strains and vulnerability found in result feeds
FRENCH_CARDS = {"R": "K", "D": "Q", "V": "J", "10": "T", "0": "T"}
FRENCH_STRAINS = {"P": "S", "C": "H", "K": "D", "T": "C", "SA": "N", "N": "N"}   # pique, coeur, carreau, trefle, sans atout
FRENCH_DIRECTIONS = {"N": "N", "E": "E", "S": "S", "O": "W", "W": "W"}
FRENCH_PAIRS = {"NS": "NS", "EO": "EW", "EW": "EW"}
FRENCH_VUL = {"Personne": "None", "NS": "N_S", "EO": "E_W", "Tous": "Both", "None": "None", "N_S": "N_S", "E_W": "E_W", "Both": "Both"}
FRENCH_MONTHS = {"janvier": "01", "février": "02", "mars": "03", "avril": "04", "mai": "05", "juin": "06",
                 "juillet": "07", "août": "08", "septembre": "09", "octobre": "10", "novembre": "11", "décembre": "12"}


def with_default_ids(df: DataFrame) -> DataFrame:
    """group_id = 0, session_id = 0, section_name = '' when the column is absent."""
    defaults = {"group_id": F.lit(0).cast("long"), "session_id": F.lit(0).cast("long"), "section_name": F.lit("")}
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def sort_suit(holding: Column) -> Column:
    """The cards of a holding from ace to two, repeats kept; other characters come first."""
    cards = F.filter(F.split(holding, ""), lambda c: c != "")
    placed = F.transform(cards, lambda c: F.struct(F.instr(F.lit(RANKS), c).alias("at"), c.alias("card")))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["card"]), "")


def _once(value: Column, of) -> Column:
    """``of(value)`` with ``value`` evaluated once, however often ``of`` names it (higher-order functions share no subexpressions)."""
    return F.element_at(F.transform(F.array(value), of), 1)


def suit_bits(holding: Column) -> Column:
    """13-bit code of a suit holding, ace = bit 12 ... two = bit 0."""
    total = None
    for i, r in enumerate(RANKS):
        term = F.when(holding.contains(r), F.lit(1 << (12 - i))).otherwise(F.lit(0))
        total = term if total is None else total + term
    return total.cast("int")


def hand_bits(hand: Column) -> Column:
    """52-bit code of a hand 'S.H.D.C': spades in the top 13 bits, clubs in the lowest."""
    suits = D.suits_of_hand(hand)
    total = None
    for j in range(4):
        term = F.shiftleft(suit_bits(F.element_at(suits, j + 1)).cast("long"), 13 * (3 - j))
        total = term if total is None else total + term
    return total


def hand_hex(hand: Column) -> Column:
    return F.lpad(F.hex(hand_bits(hand)), 13, "0")


def hand_binary(hand: Column) -> Column:
    """The 52-bit code as text of 52 binary digits, spade ace first."""
    return F.lpad(F.bin(hand_bits(hand)), 52, "0")


def hand_one_hot(hand: Column) -> Column:
    """52 values 0 / 1, spade ace first."""
    return _once(hand, lambda h: F.transform(F.split(hand_binary(h), ""), lambda x: x.cast("int")))


def one_hot_to_hand(one_hot: Column) -> Column:
    """52 values 0 / 1 back to 'S.H.D.C'; null if there are not 52 or one is neither."""
    def text(flags: Column) -> Column:
        cards = F.transform(flags, lambda x, i: F.when(x == 1, F.substring(F.lit(RANKS), i % 13 + 1, F.lit(1))).otherwise(F.lit("")))
        suits = [F.array_join(F.slice(cards, 1 + 13 * j, 13), "") for j in range(4)]
        return F.when((F.size(flags) == 52) & F.forall(flags, lambda x: x.isin(0, 1)), F.concat_ws(".", *suits))

    return _once(one_hot, text)


def binary_to_hand(text: Column) -> Column:
    """52 binary digits back to the hand."""
    return _once(text, lambda t: F.when(t.rlike("^[01]{52}$"), one_hot_to_hand(F.transform(F.split(t, ""), lambda x: x.cast("int")))))


def bits_to_hand(bits: Column) -> Column:
    """The 52-bit code back to the hand; null outside its range."""
    return _once(bits, lambda b: F.when((b >= 0) & (b < (1 << 52)), binary_to_hand(F.lpad(F.bin(b), 52, "0"))))


def hex_to_hand(text: Column) -> Column:
    """13 hexadecimal digits back to the hand."""
    return _once(text, lambda t: F.when(t.rlike("^[0-9A-Fa-f]{13}$"), bits_to_hand(F.conv(t, 16, 10).cast("long"))))


def rotate_deal(pbn: Column, first: str) -> Column:
    """A deal string written from another seat: 'E:' followed by the hands E, S, W, N."""
    hands = D.hands_of(pbn)
    k = DIRECTIONS.index(first)
    order = [F.element_at(hands, (k + i) % 4 + 1) for i in range(4)]
    return F.concat(F.lit(f"{first}:"), F.concat_ws(" ", *order))


def rotate_to_north(pbn: Column) -> Column:
    """A deal given from E, S or W re-ordered so it starts with North."""
    first = F.substring(pbn, 1, 1)
    hands = F.split(F.substr(pbn, F.lit(3)), " ")
    k = F.instr(F.lit(DIRECTIONS), first) - 1
    # hand of North is at position (4 - k) % 4 in the given order
    order = [F.get(hands, F.pmod(F.lit(i) - k, F.lit(4))) for i in range(4)]
    return F.when(pbn.isNotNull(), F.concat(F.lit("N:"), F.concat_ws(" ", *order)))


def pbn_to_brs(pbn: Column) -> Column:
    """The four hands in N, W, E, S order joined without separators, suits as 'S..H..D..C..'."""
    hands = D.hands_of(pbn)

    def brs_hand(h: Column) -> Column:
        s = D.suits_of_hand(h)
        return F.concat(*[F.concat(F.lit(x), F.element_at(s, j + 1)) for j, x in enumerate("SHDC")])

    return F.concat(*[brs_hand(F.element_at(hands, i + 1)) for i in (0, 3, 1, 2)])


def translate_cards(col: Column) -> Column:
    """French card letters to English (R, D, V -> K, Q, J; '10' or '0' -> T)."""
    out = F.regexp_replace(col, "10", "T")
    return F.translate(out, "RDV0", "KQJT")


def translate_strain(col: Column) -> Column:
    return F.element_at(map_literal(FRENCH_STRAINS), F.upper(F.trim(col)))


def translate_direction(col: Column) -> Column:
    return F.element_at(map_literal(FRENCH_DIRECTIONS), F.upper(F.trim(col)))


def translate_vul(col: Column) -> Column:
    return F.element_at(map_literal(FRENCH_VUL), F.trim(col))


def french_date(col: Column) -> Column:
    """'5 mars 2024' -> date 2024-03-05 (month name through the fixed month map); other texts give null."""
    parts = F.split(F.lower(F.trim(col)), r"\s+")
    part = lambda i: F.get(parts, F.lit(i))
    txt = F.concat(part(2), F.lit("-"), F.element_at(map_literal(FRENCH_MONTHS), part(1)), F.lit("-"), F.lpad(part(0), 2, "0"))
    return F.try_to_timestamp(txt, F.lit("yyyy-MM-dd")).cast("date")


def metric_by_suits(df: DataFrame, metric: str, prefix: str) -> DataFrame:
    """A (total, per hand, per suit) struct metric -> hand / suit columns and pair sums.

    ``metric`` is a struct column with fields ``total``, ``hands`` (array of 4) and
    ``suits`` (array of 4 arrays of 4), hands in N, E, S, W order and suits S, H, D, C.
    """
    m = F.col(metric)
    cols = {f"{prefix}": m["total"]}
    for i, d in enumerate(DIRECTIONS):
        cols[f"{prefix}_{d}"] = F.element_at(m["hands"], i + 1)
        for j, s in enumerate("SHDC"):
            cols[f"{prefix}_{d}_{s}"] = F.element_at(F.element_at(m["suits"], i + 1), j + 1)
    cols[f"{prefix}_NS"] = F.element_at(m["hands"], 1) + F.element_at(m["hands"], 3)
    cols[f"{prefix}_EW"] = F.element_at(m["hands"], 2) + F.element_at(m["hands"], 4)
    return df.withColumns(cols)


LEGACY_NAMES = {"board_number": "board", "Board": "board", "PBN": "pbn", "Dealer": "dealer", "Vul": "vul",
                "Contract": "contract", "Tricks": "tricks", "Score": "score"}


def rename_legacy(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Legacy column names to this library's names (only those present)."""
    names = names or LEGACY_NAMES
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
