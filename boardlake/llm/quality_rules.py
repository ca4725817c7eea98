"""Operator 5, quality rules as a short-circuit cascade, SQL functions only.

Base counts are computed for every whole text.  A document that passes the base rules goes
through the rules below; each keeps or rejects by integer comparisons.  On a bounded sample of rows the
cost (seconds to evaluate it) and the selectivity (share rejected) of every rule are measured, the rules are
ordered by rejection per cost, and the verdict is one CASE that stops at the first rule that
rejects.  The order changes what is evaluated, never the verdict.

Defined results: a null or empty text has no words and fails the base; repeated rows give one result row each; a null id
is kept as it is; an empty table gives no rows (rules then keep their listed order).  Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, saved

#: Rows of the sample that cost and selectivity are measured on, of a random tenth at most.
SAMPLE_ROWS, SAMPLE_SHARE = 2000, 0.1
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _count(column: str, characters: str) -> Column:
    c = F.col(column)
    return F.length(c) - F.length(F.translate(c, characters, ""))


# Words in three-word windows found twice or more.  ``transform(array(x), name -> ...)`` names a value,
# so that it is computed once wherever the optimizer moves the expression.  Window hashes are sorted
# with their places: equal ones stand side by side; then the places' spans of three are added up.
_REPEATED = r"""
get(transform(array(regexp_extract_all(text, 'WORD', 0)), w ->
  get(transform(array(case when size(w) < 3 then cast(array() as array<struct<h: bigint, i: int>>) else sort_array(
      transform(sequence(0, size(w) - 3), i -> named_struct('h', xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), 'i', i))) end), z ->
    aggregate(
      sort_array(transform(filter(z, (x, k) -> coalesce(get(z, k - 1).h = x.h, false) or coalesce(get(z, k + 1).h = x.h, false)), x -> x.i)),
      named_struct('upto', 0, 'total', 0L),
      (a, i) -> named_struct('upto', i + 3, 'total', a.total + i + 3 - greatest(a.upto, i)),
      a -> a.total)), 0)), 0)""".replace("WORD", SPACE_WORD.replace("\\", "\\\\"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed of every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = F.get(F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))), F.lit(0))
    out = d.select("doc_id", "text", F.regexp_count("text", F.lit(SPACE_WORD)).cast("long").alias("n_words"),
                   F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"), _count("text", "#*$%&|<>").cast("long").alias("n_symbols"),
                   counts.alias("qr_lines"), F.expr(_REPEATED).alias("n_repeat_words"))
    out = out.select("doc_id", "text", "n_words", "word_chars", "n_symbols", F.col("qr_lines.n").alias("n_lines"), F.col("qr_lines.dup").alias("n_dup_lines"), "n_repeat_words")
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def rules() -> dict[str, Column]:
    """Name and condition to keep of every rule, over the columns of ``base_counts``."""
    n = F.col("n_words")
    letters = _count("text", UPPER + LOWER)
    distinct = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(SPACE_WORD), 0)))
    return {
        "symbols": F.col("n_symbols") * 10 <= n * 3,
        "repeated_lines": F.col("n_dup_lines") * 10 <= F.col("n_lines") * 4,
        "repeated_words": F.col("n_repeat_words") * 10 <= n * 4,
        "mean_word": (F.col("word_chars") >= n * 2) & (F.col("word_chars") <= n * 15),
        "exclamations": _count("text", "!") * 10 <= n * 2,
        "capitals": _count("text", UPPER) * 2 <= letters,
        "digits": _count("text", DIGITS) * 5 <= F.col("word_chars"),
        "distinct_words": distinct * 20 >= n,
    }


def cascade(docs: DataFrame, by_name: dict[str, Column]) -> list[tuple[str, float, float]]:
    """(rule, cost in seconds, share rejected) in the order to apply, from the sample."""
    sample = saved(base_counts(docs.select("doc_id", "text").sample(SAMPLE_SHARE, seed=7).limit(SAMPLE_ROWS))).where("not base_failed")
    found = []
    for name, keep in by_name.items():
        seconds, rejected, total = float("inf"), 0, 0
        for _ in range(2):
            began = time.perf_counter()
            r = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if(~keep).alias("no")).first()
            seconds, rejected, total = min(seconds, time.perf_counter() - began), r["no"], r["n"]
        found.append((name, seconds, rejected / total if total else 0.0))
    return sorted(found, key=lambda x: -x[2] / x[1])


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    base, by_name = base_counts(docs), rules()
    verdict = F.when(F.col("base_failed"), False)
    for name, _, _ in cascade(docs, by_name):
        verdict = verdict.when(~by_name[name], False)
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.otherwise(True).alias("kept"))


ORACLE = r"""
with d as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
t as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select k, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (
  select k, count(distinct p) as n from (select k, unnest(range(i, i + 3)) as p from (select k, i, count(*) over (partition by k, g) as c from t) where c > 1)
  group by k),
b as (
  select d.doc_id, d.text, d.w, len(d.w)::bigint as n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(d.l)::bigint as n_lines,
         (len(d.l) - len(list_distinct(d.l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d left join r using (k)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_symbols * 10 <= n_words * 3 and n_dup_lines * 10 <= n_lines * 4 and n_repeat_words * 10 <= n_words * 4
       and word_chars >= n_words * 2 and word_chars <= n_words * 15
       and (length(text) - length(replace(text, '!', ''))) * 10 <= n_words * 2
       and len(regexp_extract_all(text, '[A-Z]')) * 2 <= len(regexp_extract_all(text, '[A-Za-z]'))
       and len(regexp_extract_all(text, '[0-9]')) * 5 <= word_chars
       and len(list_distinct(w)) * 20 >= n_words as kept
from f
"""
