"""DuckDB SQL for the oracle check: fixture tables and shared SQL fragments.

The driver runs these statements against the raw parquet views; each query's SQL starts
with the fixture CTEs it needs (``with_fixtures``) and then states the operator in plain
SQL.  The fixtures here are the relational form (window + string_agg) of what
``sources.fixtures`` builds with array functions in Spark.
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "boards": (
        "select cast(s_suppkey as bigint) session_id, cast(b as int) board, "
        "cast(s_suppkey*100+b as bigint) deal_id from supplier, range(1,33) t(b)",
        (),
    ),
    "board_results": (
        """select cast(l_suppkey as bigint) session_id, cast(l_orderkey % 32 as int)+1 board, l_orderkey, l_linenumber,
  l_partkey, l_shipdate result_time,
  case when l_partkey % 97 = 0 then 'PASS'
       else concat(cast(1 + l_partkey % 7 as varchar), substr('CDHSN', cast(1 + l_orderkey % 5 as int), 1),
                   case l_linenumber when 6 then 'X' when 7 then 'XX' else '' end,
                   substr('NESW', cast(1 + (l_orderkey + l_linenumber) % 4 as int), 1)) end contract,
  case when l_partkey % 97 = 0 or l_partkey % 89 = 0 then null
       else cast((cast(l_quantity as int)*3 + l_linenumber) % 14 as int) end tricks,
  'N' || cast(l_partkey % 199 as varchar) player_n, 'E' || cast(l_orderkey % 211 as varchar) player_e,
  'S' || cast(l_partkey % 197 as varchar) player_s, 'W' || cast(l_orderkey % 193 as varchar) player_w
from lineitem""",
        (),
    ),
    "cards": (
        """select deal_id, cast(card as int) card,
  cast(row_number() over (partition by deal_id
       order by md5(concat(cast(deal_id as varchar), '-', cast(card as varchar))), card) - 1 as int) pos
from boards, range(0,52) t(card)""",
        ("boards",),
    ),
    "hands": (
        """select deal_id, pos // 13 seat,
  coalesce(string_agg(substr('AKQJT98765432', card % 13 + 1, 1), '' order by card) filter (where card // 13 = 0), '') || '.' ||
  coalesce(string_agg(substr('AKQJT98765432', card % 13 + 1, 1), '' order by card) filter (where card // 13 = 1), '') || '.' ||
  coalesce(string_agg(substr('AKQJT98765432', card % 13 + 1, 1), '' order by card) filter (where card // 13 = 2), '') || '.' ||
  coalesce(string_agg(substr('AKQJT98765432', card % 13 + 1, 1), '' order by card) filter (where card // 13 = 3), '') hand
from cards group by deal_id, pos // 13""",
        ("cards",),
    ),
    "deals": (
        "select deal_id, 'N:' || string_agg(hand, ' ' order by seat) pbn from hands group by deal_id",
        ("hands",),
    ),
    "dd_tricks": (
        """select deal_id, cast(seat as int) seat, cast(strain as int) strain,
  cast((deal_id*31 + (seat % 2)*17 + strain*5 + case when seat >= 2 and deal_id % 3 = 0 then 1 else 0 end) % 14 as int) tricks
from boards, range(0,4) s(seat), range(0,5) t(strain)""",
        ("boards",),
    ),
    "sd_samples": (
        """select deal_id, cast(fixed as int) fixed_pair, cast(sample as int) sample, cast(seat as int) seat, cast(strain as int) strain,
  cast((deal_id*7 + sample*3*(strain+1) + seat*5 + fixed*11) % 14 as int) tricks
from boards, range(0,2) f(fixed), range(0,10) x(sample), range(0,4) s(seat), range(0,5) t(strain)""",
        ("boards",),
    ),
    "par_scores": ("select deal_id, cast((deal_id * 37 % 41 - 20) * 50 as int) par_ns from boards", ("boards",)),
    "auctions": (
        """select deal_id, substr('NESW', cast((board-1) % 4 + 1 as int), 1) dealer, calls
from boards join (values (0,'1C-p-1S-p-2S-p-p-p'),(1,'p-p-p-p'),(2,'1N-d-r-p-p-p'),(3,'p-1H-2C-2H-3C-p-p-p'),
  (4,'1S-1H-p-p-p'),(5,'p-p-p-1D-p-3N-p-p-p'),(6,'2H-d-p-2S-p-4S-d-p-p-p')) a(k,calls) on deal_id % 7 = k""",
        ("boards",),
    ),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for dep in FIXTURE_SQL[n][1]:
            visit(dep)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_fixtures(needed, ctes: str, body: str) -> str:
    """``with`` clause of the needed fixture tables (and their inputs), then ``ctes``, then ``body``."""
    parts = [f"{n} as ({FIXTURE_SQL[n][0]})" for n in _order(needed)]
    if ctes.strip():
        parts.append(ctes.strip())
    return "with " + ",\n".join(parts) + "\n" + body


def sql_score(level: str, strain: str, dbl: str, vul: str, result: str) -> str:
    """Declarer-relative duplicate score in SQL (same rules as functions.scoring.score)."""
    tp = (f"((case when {strain} in ('C','D') then 20 else 30 end) * {level} + (case when {strain} = 'N' then 10 else 0 end))"
          f" * (case {dbl} when 'XX' then 4 when 'X' then 2 else 1 end)")
    made = (
        f"{tp} + (case when {tp} >= 100 then (case when {vul} then 500 else 300 end) else 50 end)"
        f" + (case when {level} = 6 then (case when {vul} then 750 else 500 end) when {level} = 7 then (case when {vul} then 1500 else 1000 end) else 0 end)"
        f" + (case {dbl} when 'XX' then 100 when 'X' then 50 else 0 end)"
        f" + {result} * (case {dbl} when '' then (case when {strain} in ('C','D') then 20 else 30 end)"
        f" when 'X' then (case when {vul} then 200 else 100 end) else (case when {vul} then 400 else 200 end) end)"
    )
    down = (
        f"(case {dbl} when '' then -({result}) * (case when {vul} then 100 else 50 end)"
        f" else (case when {vul} then -({result})*300-100 else (case -({result}) when 1 then 100 when 2 then 300 else -({result})*300-400 end) end)"
        f" * (case {dbl} when 'XX' then 2 else 1 end) end)"
    )
    return (f"cast(case when {level} is null or {strain} is null or {vul} is null or {result} is null then null "
            f"when {result} >= 0 then {made} else -{down} end as int)")


CONTRACT_RE = "^([1-7])([CDHSN])(X{0,2})([NESW])$"


def sql_scored_results(src: str = "board_results") -> str:
    """CTEs ``r1`` (board facts + contract parts) and ``scored`` (result + signed scores) over ``src``."""
    c = "replace(translate(upper(trim(contract)), '♠♥♦♣', 'SHDC'), 'NT', 'N')"
    part = lambda i: f"case when regexp_matches(c, '{CONTRACT_RE}') then regexp_extract(c, '{CONTRACT_RE}', {i}) end"
    return f"""r0 as (
  select * replace ({c} as contract), {c} as c,
    substr('NESW', cast((board-1) % 4 + 1 as int), 1) dealer,
    case ((board-1)//4 + (board-1)%4) % 4 when 0 then 'None' when 1 then 'N_S' when 2 then 'E_W' else 'Both' end vul
  from {src}),
r1 as (
  select * exclude (c), vul in ('N_S','Both') vul_ns, vul in ('E_W','Both') vul_ew,
    cast({part(1)} as int) level, {part(2)} strain, {part(3)} dbl, {part(4)} declarer
  from r0),
r2 as (
  select *, case when declarer in ('N','S') then 'NS' when declarer in ('E','W') then 'EW' end declarer_pair,
    cast(tricks - 6 - level as int) result
  from r1),
r3 as (
  select *, case when declarer_pair = 'NS' then vul_ns when declarer_pair = 'EW' then vul_ew end vul_declarer from r2),
r4 as (
  select *, case when contract = 'PASS' then 0 else {sql_score('level', 'strain', 'dbl', 'vul_declarer', 'result')} end score_declarer from r3),
scored as (
  select *,
    cast(case when contract = 'PASS' then 0 when declarer_pair = 'NS' then score_declarer when declarer_pair = 'EW' then -score_declarer end as int) score_ns,
    cast(case when contract = 'PASS' then 0 when declarer_pair = 'EW' then score_declarer when declarer_pair = 'NS' then -score_declarer end as int) score_ew
  from r4)"""
