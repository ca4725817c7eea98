"""Registered deal-coding query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codings as CD
from ..functions import deals as D
from ..sources import fixtures
from .oracle import with_fixtures
from .registry import register

RANKS = "AKQJT98765432"


def _sql_bits(x: str) -> str:
    return "(" + " + ".join(f"(case when contains({x}, '{r}') then {1 << (12 - i)} else 0 end)" for i, r in enumerate(RANKS)) + ")"


@register(
    "hand_codings",
    "P16,P17,P19",
    with_fixtures(["deals"], """h0 as (select deal_id, pbn, i, substr('NESW', i + 1, 1) direction,
    string_split(string_split(substr(pbn, 3), ' ')[i + 1], '.') sp from deals, range(0, 4) t(i)),
h1 as (select *, """ + ", ".join(f"cast({_sql_bits(f'sp[{j + 1}]')} as int) bits_{s}" for j, s in enumerate("shdc")) + """ from h0),
rot as (select deal_id, 'E:' || string_split(substr(pbn, 3), ' ')[2] || ' ' || string_split(substr(pbn, 3), ' ')[3] || ' '
    || string_split(substr(pbn, 3), ' ')[4] || ' ' || string_split(substr(pbn, 3), ' ')[1] rotated,
  string_split(substr(pbn, 3), ' ') hs from deals),
brs as (select deal_id, array_to_string(list_transform([1, 4, 2, 3], lambda i: 'S' || string_split(hs[i], '.')[1] || 'H' || string_split(hs[i], '.')[2]
    || 'D' || string_split(hs[i], '.')[3] || 'C' || string_split(hs[i], '.')[4]), '') brs from rot)""",
        """select h1.deal_id, direction, bits_s, bits_h, bits_d, bits_c,
  (cast(bits_s as bigint) << 39) + (cast(bits_h as bigint) << 26) + (cast(bits_d as bigint) << 13) + cast(bits_c as bigint) hand_bits,
  lpad(upper(hex((cast(bits_s as bigint) << 39) + (cast(bits_h as bigint) << 26) + (cast(bits_d as bigint) << 13) + cast(bits_c as bigint))), 13, '0') hand_hex,
  rot.rotated, 'N:' || array_to_string(rot.hs, ' ') back_to_north, brs.brs
from h1 join rot using (deal_id) join brs using (deal_id)"""),
)
def q_hand_codings(spark, sf_dir):
    """Suit and hand bit codes of every hand, the deal written from East and turned back to North, and the deal in N-W-E-S order."""
    d = fixtures.deals(spark, sf_dir)
    d = d.withColumns({"rotated": CD.rotate_deal(F.col("pbn"), "E"), "brs": CD.pbn_to_brs(F.col("pbn"))})
    d = d.withColumn("back_to_north", CD.rotate_to_north(F.col("rotated")))
    hands = D.hands_of("pbn")
    per_hand = d.select("deal_id", "rotated", "back_to_north", "brs",
                        F.posexplode(hands).alias("_i", "_hand"))
    per_hand = per_hand.withColumn("direction", F.substring(F.lit("NESW"), F.col("_i") + 1, 1))
    suits = D.suits_of_hand(F.col("_hand"))
    per_hand = per_hand.withColumns({f"bits_{s}": CD.suit_bits(F.element_at(suits, j + 1)) for j, s in enumerate("shdc")})
    hand_bits = sum((F.shiftleft(F.col(f"bits_{s}").cast("long"), 13 * (3 - j)) for j, s in enumerate("shdc")), F.lit(0).cast("long"))
    per_hand = per_hand.withColumn("hand_bits", hand_bits)
    per_hand = per_hand.withColumn("hand_hex", F.lpad(F.hex(F.col("hand_bits")), 13, "0"))
    return per_hand.select(
        "deal_id", "direction", "bits_s", "bits_h", "bits_d", "bits_c", "hand_bits", "hand_hex", "rotated", "back_to_north", "brs")


@register(
    "hand_decodings",
    "P16",
    with_fixtures(["hands"], "", """select deal_id, substr('NESW', cast(seat as int) + 1, 1) direction, hand from_bits, hand from_hex, hand from_binary, hand from_one_hot,
  array_to_string(list_transform(range(0, 52), lambda i: case when contains(string_split(hand, '.')[i // 13 + 1], substr('AKQJT98765432', cast(i % 13 as int) + 1, 1)) then '1' else '0' end), '') binary_text,
  13 n_cards from hands"""),
)
def q_hand_decodings(spark, sf_dir):
    """Every hand coded as bits, hexadecimal, binary text and one-hot values, and decoded again."""
    d = fixtures.deals(spark, sf_dir).select("deal_id", F.posexplode(D.hands_of("pbn")).alias("_i", "hand"))
    d = d.withColumns({"bits": CD.hand_bits(F.col("hand")), "one_hot": CD.hand_one_hot(F.col("hand"))})
    return d.select("deal_id", F.substring(F.lit("NESW"), F.col("_i") + 1, F.lit(1)).alias("direction"), CD.bits_to_hand(F.col("bits")).alias("from_bits"),
                    CD.hex_to_hand(CD.hand_hex(F.col("hand"))).alias("from_hex"), CD.binary_to_hand(CD.hand_binary(F.col("hand"))).alias("from_binary"),
                    CD.one_hot_to_hand(F.col("one_hot")).alias("from_one_hot"), CD.hand_binary(F.col("hand")).alias("binary_text"),
                    F.aggregate("one_hot", F.lit(0), lambda a, x: a + x).alias("n_cards"))
