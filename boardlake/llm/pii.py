"""Operator 9, personal data: proposals by pattern, checksums, context words; SQL functions only.

Every kind has a pattern that proposes spans (leftmost, not overlapping within the kind), a check that
confirms them (numbers of digits, byte values, Luhn, mod-97, no digits next to them) and a score,
which rises when words of the kind stand in the ``CONTEXT`` characters of the text before the span or after it.  A span counts when
its score reaches ``LEAST``.  The base kinds (email, ip, card, phone) start above it and so always
stay; the added kinds are IBANs (confirmed by mod-97), and social security and local phone numbers
(which need their words).

A pattern gives the pieces between spans (split) and the spans (extract); running sums of their
lengths, in blocks of ``BLOCK``, are the places in code points.  Patterns take their repeats possessively,
so long runs of digits or letters cost no recursion.

Defined results: a null or empty text has no spans; a null id is kept; repeated rows give one result row each; an
empty table gives no rows.  Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT, LEAST, BLOCK = 40, 0.6, 256

_LUHN = """aggregate(sequence(1, length(d)), 0L, (a, i) -> a + case when i % 2 = 1 then cast(substr(d, length(d) - i + 1, 1) as int)
    else (2 * cast(substr(d, length(d) - i + 1, 1) as int)) div 10 + (2 * cast(substr(d, length(d) - i + 1, 1) as int)) % 10 end) % 10 = 0"""
_MOD_97 = """aggregate(split(concat(substr(m, 5), substr(m, 1, 4)), ''), 0L, (a, c) -> case when c = '' then a
    when ascii(c) < 58 then (a * 10 + ascii(c) - 48) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"""
_APART = "not (g rlike '[0-9-]$') and not (n rlike '^[0-9-]')"


@dataclass(frozen=True)
class Kind:
    """A pattern, its check (SQL over the match ``m``, its digits ``d``, the pieces before and after, ``g`` and ``n``),
    the score of a confirmed match, its context words and what they add."""

    name: str
    pattern: str
    check: str
    score: float
    words: str
    more: float


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, "mail|contact|kontakt|correo|courriel", 0.1),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(p as int), 0) <= 255)", 0.6, "ip|host|server|addr|login", 0.2),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", f"length(d) between 12 and 19 and {_LUHN}", 0.8, "card|visa|karte|carte|tarjeta|pay", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 9 and 15", 0.7, "tel|phone|call|mobil|fax", 0.2),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}", _MOD_97, 0.8, "iban|bank|account|konto|cuenta|compte", 0.2),
    Kind("ssn", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", _APART, 0.3, "ssn|social|security|insurance", 0.4),
    Kind("tel", r"[(]?[0-9][0-9][0-9][)]?[\x20.-][0-9][0-9][0-9][\x20.-][0-9][0-9][0-9][0-9]", _APART, 0.3, "tel|phone|call|mobil|fax", 0.4),
)
BASE = 4


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(kind: Kind) -> str:
    """SQL: array of (start, kind number, end, score) of the kind's spans in ``text``.  A value used
    more than once is named by ``transform(array(x), name -> ...)``, so nothing is computed per element."""
    number, pattern = KINDS.index(kind), _sql(kind.pattern)
    # pieces before, between and after the proposals, with the proposals among them; only their ends can be context
    pieces = f"named_struct('g', split(text, {pattern}, -1), 'm', regexp_extract_all(text, {pattern}, 0))"
    around = {"before": f"right(array_join(slice(tails, greatest(1, 2 * i + 2 - {2 * CONTEXT}), least(2 * i + 1, {2 * CONTEXT})), ''), {CONTEXT})",
              "after": f"left(array_join(slice(heads, 2 * i + 3, {2 * CONTEXT}), ''), {CONTEXT})"}
    context = " or ".join(f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') rlike {_sql('(' + kind.words + ')')}" for x in around.values())
    score = _named("get(s.g, i)", "g", _named("get(s.g, i + 1)", "n", _judged(kind, context)))
    judged = f"transform(s.m, (m, i) -> named_struct('skip', length(get(s.g, i)), 'size', length(m), 'score', {score}))"
    judged = _named("transform(p, x -> right(x, {0}))".format(CONTEXT), "tails", _named("transform(p, x -> left(x, {0}))".format(CONTEXT), "heads", judged))
    judged = _named(pieces, "s", _named("flatten(zip_with(s.g, s.m, (g, m) -> array(g, coalesce(m, ''))))", "p", judged))
    block = f"""aggregate(block, named_struct('at', 0, 'out', cast(array() as array<struct<s: int, k: int, e: int, score: double>>)), (a, x) -> named_struct(
        'at', a.at + x.skip + x.size, 'out', case when x.score >= {LEAST}D then concat(a.out, array(named_struct('s', a.at + x.skip, 'k', {number}, 'e', a.at + x.skip + x.size, 'score', x.score))) else a.out end))"""
    none = "cast(array() as array<struct<s: int, k: int, e: int, score: double>>)"
    return f"""get(transform(array({judged}), all -> case when size(all) = 0 then {none} else
        aggregate(transform(sequence(1, size(all), {BLOCK}), i -> get(transform(array(slice(all, i, {BLOCK})), block -> {block}), 0)),
            named_struct('at', 0, 'out', {none}),
            (a, b) -> named_struct('at', a.at + b.at, 'out', case when size(b.out) = 0 then a.out else
                concat(a.out, transform(b.out, x -> named_struct('s', x.s + a.at, 'k', x.k, 'e', x.e + a.at, 'score', x.score))) end), a -> a.out) end), 0)"""


def _named(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _judged(kind: Kind, context: str) -> str:
    digits = "regexp_replace(m, '[^0-9]', '')"
    return _named(digits, "d", f"case when {kind.check} then {kind.score}D + case when {context} then {kind.more}D else 0D end else 0D end")


def personal_data(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and ``found``: array of (s: start, k: number of the kind, e: end, score), by start and kind, and the columns in ``more``, of every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # without one of these characters there is nothing to propose
    none = "cast(array() as array<struct<s: int, k: int, e: int, score: double>>)"
    arrays = [f"case when text rlike {_sql('@' if k.name == 'email' else '[0-9]')} then {spans_of(k)} else {none} end" for k in KINDS]
    return d.select("doc_id", *more, F.expr(f"sort_array(concat({', '.join(arrays)}))").alias("found"))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets (a span that begins
    within an earlier one is part of it); every row."""
    names = "array(" + ", ".join(f"'<{k.name}>'" for k in KINDS) + ")"
    return personal_data(docs, "text").select("doc_id", F.expr(f"""aggregate(found, named_struct('at', 0, 'out', ''), (a, x) ->
        case when x.s < a.at then named_struct('at', greatest(a.at, x.e), 'out', a.out)
             else named_struct('at', x.e, 'out', concat(a.out, substr(text, a.at + 1, x.s - a.at), get({names}, x.k))) end,
        a -> concat(a.out, substr(text, a.at + 1)))""").alias("text"))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    names = "array(" + ", ".join(f"'{k.name}'" for k in KINDS) + ")"
    listed = lambda of: f"array_join(transform({of}, x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')"
    count = lambda i: F.expr(f"cast(size(filter(found, x -> x.k = {i})) as bigint)").alias(f"n_{KINDS[i].name}")
    return personal_data(docs).select("doc_id", *[count(i) for i in range(BASE)],
                                      F.sha2(F.expr(listed(f"filter(found, x -> x.k < {BASE})")), 256).alias("base_sha256"), F.expr(listed("found")).alias("spans"))


def _lowered(sql: str) -> str:
    return f"translate({sql}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _oracle() -> str:
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+"}
    checks = {
        "email": "true",
        "ip": "list_bool_and([len(ltrim(p, '0')) <= 3 and coalesce(try_cast(p as int), 0) <= 255 for p in string_split(m, '.')])",
        "card": "len(d) between 12 and 19 and list_sum([case when i % 2 = 1 then d[-i]::int else (2 * d[-i]::int) // 10 + (2 * d[-i]::int) % 10 end for i in range(1, len(d) + 1)]) % 10 = 0",
        "phone": "len(d) between 9 and 15",
        # a prime greater than 2 ** 64 is never reached: 34 characters give at most 68 digits, taken nine at a time
        "iban": "list_reduce(list_concat([0::bigint], [case when ascii(c) < 58 then ascii(c) - 48 else 1000 + ascii(c) - 55 end for c in string_split(substr(m, 5) || substr(m, 1, 4), '')]), "
                "lambda a, v: case when v < 1000 then (a * 10 + v) % 97 else (a * 100 + v - 1000) % 97 end) = 1",
        "ssn": "not regexp_matches(g, '[0-9-]$') and not regexp_matches(n, '^[0-9-]')",
        "tel": "not regexp_matches(g, '[0-9-]$') and not regexp_matches(n, '^[0-9-]')",
    }
    parts = []
    for i, k in enumerate(KINDS):
        pattern = plain.get(k.name, k.pattern)
        parts.append(f"""
  select k, s, {i} as kind, e from (
    select *, (sum(length(g) + length(m)) over (partition by k order by i) - length(m))::bigint as s, (sum(length(g) + length(m)) over (partition by k order by i))::bigint as e,
           regexp_replace(m, '[^0-9]', '', 'g') as d
    from (select k, text, i, gs[i] as g, ms[i] as m, gs[i + 1] as n from (
      select k, text, gs, ms, unnest(range(1, len(ms) + 1)) as i from (
        select k, text, string_split_regex(text, '{pattern}') as gs, regexp_extract_all(text, '{pattern}') as ms from d))))
  where {checks[k.name]} and {k.score} + case when regexp_matches({_lowered(f"substr(text, greatest(s - {CONTEXT}, 0) + 1, least(s, {CONTEXT}))")}, '({k.words})')
    or regexp_matches({_lowered(f"substr(text, e + 1, {CONTEXT})")}, '({k.words})') then {k.more} else 0 end >= {LEAST}""")
    names = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    return f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
x as ({' union all '.join(parts)}),
a as (
  select k, {', '.join(f'count(*) filter (kind = {i}) as n_{KINDS[i].name}' for i in range(BASE))},
         string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' order by s, kind) filter (kind < {BASE}) as base,
         string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' order by s, kind) as spans
  from x group by k)
select d.doc_id, {', '.join(f'coalesce(n_{KINDS[i].name}, 0)::bigint as n_{KINDS[i].name}' for i in range(BASE))},
       sha256(coalesce(a.base, '')) as base_sha256, coalesce(a.spans, '') as spans
from d left join a using (k)
"""


ORACLE = _oracle()
