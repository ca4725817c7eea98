"""Q5: the whole enrichment of table results, composed from the library's operators.

results -> contract parts and scores (C1-C9) -> matchpoints (W1-W3) -> deal join (J2) ->
seats and player ids (C3) -> double-dummy columns (C11-C13) -> expected value of the
contract actually played (A1, A4 joined on deal, side, declarer, strain).

Results are shuffled twice: by board, where one row holds the board's deal, distinct scores with their matchpoints and
double-dummy tricks, and by the played declarer and strain.  Columns that a result's own row gives are evaluated again after the
first shuffle and not carried through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import contracts
from ..operators import matchpoints as mp
from ..operators import ratings as R
from ..operators import singledummy as SD
from ..session import not_broadcast, own_shuffle
from .boards import scored_results

PLAYERS = {"N": "player_n", "E": "player_e", "S": "player_s", "W": "player_w"}


def with_players(results: DataFrame) -> DataFrame:
    """C3 from the contract's text alone, before the results travel: four names become those that are asked for."""
    return contracts.with_seats(results.withColumn("declarer", contracts.declarer_of(contracts.normalise_contract("contract"))), "declarer", PLAYERS)


def enrich(results: DataFrame, boards: DataFrame, dd: DataFrame, sd_samples: DataFrame,
           k=("session_id", "board")) -> DataFrame:
    """Scores, matchpoints, DD columns and EV of the played contract for every result row; seats and ids come from ``with_players``.

    ``dd`` has (deal_id, declarer, strain, tricks) with letter codes; ``sd_samples`` the
    fixture's integer codes (deal_id, fixed_pair, seat, strain, tricks, sample).
    """
    k = list(k)
    facts = R.with_trick_lists(boards.select(*k, "deal_id"), dd)
    facts = own_shuffle(mp.board_scores(scored_results(results), k).join(not_broadcast(facts), k), *k)
    res = scored_results(results.join(not_broadcast(facts), on=k))
    return mp.percentages(SD.with_played_ev(R.with_declarer_columns(mp.listed_matchpoints(res)), sd_samples))
