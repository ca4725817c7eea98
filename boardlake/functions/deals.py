"""Board and hand Column expressions.

A deal string is ``N:`` followed by the four hands N, E, S, W separated by blanks; a hand
is four suits S.H.D.C separated by dots, cards high to low, a void is empty.

Everything here is row-local: features of all four hands and both pairs are computed on
the deal's own row with higher-order functions, so building them never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import DIRECTIONS, HCP_VALUES, QUICK_TRICKS, SUITS, VULS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- board facts -------------------------------------------------------------------

def dealer_of(board) -> Column:
    """Dealer seat of a board number (1 -> N, 2 -> E, ...)."""
    b = _c(board)
    return F.substring(F.lit(DIRECTIONS), F.pmod(b - 1, F.lit(4)).cast("int") + 1, 1)


def vul_code_of(board) -> Column:
    """Vulnerability code 0..3 (None, N_S, E_W, Both) of a board number."""
    n = _c(board) - 1
    return F.pmod(F.floor(n / 4) + F.pmod(n, F.lit(4)), F.lit(4)).cast("int")


def vul_of(board) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VULS]), vul_code_of(board) + 1)


def vul_ns(vul) -> Column:
    """Is North-South vulnerable."""
    return _c(vul).isin("N_S", "Both")


def vul_ew(vul) -> Column:
    return _c(vul).isin("E_W", "Both")


# ---- hands ---------------------------------------------------------------------------

def hands_of(pbn) -> Column:
    """P5: array of the four hand strings in N, E, S, W order."""
    return F.split(F.substr(_c(pbn), F.lit(3)), " ")


def suits_of_hand(hand: Column) -> Column:
    """P5: array of the four suit holdings S, H, D, C of one hand string (voids kept)."""
    return F.split(hand, r"\.", -1)


def count_char(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def suit_hcp(suit: Column) -> Column:
    """A4 K3 Q2 J1 in one suit holding."""
    total = None
    for r, v in HCP_VALUES.items():
        term = count_char(suit, r) * v
        total = term if total is None else total + term
    return total.cast("int")


def suit_quick_tricks(suit: Column) -> Column:
    """Quick tricks of one suit holding by its top cards."""
    expr = None
    for prefix, value in QUICK_TRICKS:
        cond = suit.startswith(prefix)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(0.0))


def distribution_points(length: Column) -> Column:
    """Void 3, singleton 2, doubleton 1."""
    return F.when(length == 0, F.lit(3)).when(length == 1, F.lit(2)).when(length == 2, F.lit(1)).otherwise(F.lit(0))


def shape_sorted(lengths_cdhs: Column) -> Column:
    """P10: array of struct(len, idx) sorted by length then index, both descending."""
    pairs = F.transform(lengths_cdhs, lambda x, i: F.struct(x.alias("len"), i.alias("idx")))
    return F.reverse(F.array_sort(pairs))


def dash_join(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), "-")


def is_balanced(shape_ml: Column, sl_c: Column, sl_d: Column) -> Column:
    """4-3-3-3, 4-4-3-2, or 5-3-3-2 / 5-4-2-2 with a five-card minor."""
    return shape_ml.isin("4-3-3-3", "4-4-3-2") | (shape_ml.isin("5-3-3-2", "5-4-2-2") & ((sl_c == 5) | (sl_d == 5)))


def is_valid_deal(pbn) -> Column:
    """P18: 'N:' + four hands of 13 cards each; sorted cards equal the full deck once."""
    p = _c(pbn)
    cards = F.flatten(
        F.transform(
            hands_of(p),
            lambda h: F.flatten(
                F.transform(suits_of_hand(h), lambda s, i: F.transform(F.split(s, ""), lambda r: F.concat(F.substring(F.lit(SUITS), i + 1, 1), r)))
            ),
        )
    )
    real = F.filter(cards, lambda c: F.length(c) == 2)
    deck = sorted(s + r for s in SUITS for r in "AKQJT98765432")
    per_hand = F.forall(
        hands_of(p),
        lambda h: (F.length(F.regexp_replace(h, r"\.", "")) == 13) & (F.size(suits_of_hand(h)) == 4),
    )
    return (
        p.startswith("N:")
        & (F.size(hands_of(p)) == 4)
        & per_hand
        & (F.array_join(F.array_sort(real), ",") == F.lit(",".join(deck)))
    )
