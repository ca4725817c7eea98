"""Operator 6, mixing sources to target weights: systematic sampling, SQL functions only.

Sizes are words.  Sources in code point order (null last) weigh 5, 2, 1, repeating, and share
``SHARE`` times all words; no target passes ``MOST`` times its source's words and what is over
goes to the others by weight.  As every resharing keeps target = weight x one common level for
the sources below their bound, the level is found directly: sources sorted by bound / weight,
running sums, first one that the level does not reach.

Every document of a source expects target / source_size copies.  Documents stand in a fixed order (size class,
bucket, size, hash of id and text); the prefix sum of expected copies plus one offset per source (from a hash of the
source and the seed) is cut at whole numbers, a document is emitted once for each number crossed.  The order by size spreads
long documents evenly, so a source's words stay near its target.  The prefix sum has three
levels (size classes of a source, buckets of a class, rows of a bucket), so no task holds a
source; there are as many buckets as keep one class at some ``BUCKET_ROWS`` rows of a mean table.

Defined results: a null or empty text has size 0 and may be emitted; null sources are one
source, the last; null ids are ordered as empty ids; repeated rows are documents of their own (rows that agree in id and text
share a bucket, however many; which of them is repeated does not show); rows that share only an id, or have none, are spread by their texts;
an empty table gives no rows; without any word every target is 0.  Extra columns are kept by
``mix_documents`` under their own names.  Reruns over the same rows agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, saved

WEIGHTS = (5, 2, 1)
#: Share of all words that the targets add up to, as a fraction of integers; most copies of a source.
SHARE, MOST = (3, 2), 2
SEED, BUCKET_ROWS = "mix", 20_000
_KEY = ["mx_source", "mx_class", "mx_bucket"]


def _hash(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(value.cast("string"), F.lit("")))), 1, digits), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Bit length and the next two bits: classes of about a quarter of an octave."""
    bits = F.length(F.bin(size))
    return F.when(size < 4, size).otherwise(bits * 4 + F.expr("shiftright(mx_size, length(bin(mx_size)) - 3) & 3"))


def measured(docs: DataFrame) -> DataFrame:
    """Every row as struct ``mx_doc`` with its source, size, hash and size class."""
    return (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mx_doc"))
            .select("mx_doc", F.col("mx_doc.source").alias("mx_source"),
                    F.coalesce(F.regexp_count("mx_doc.text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("mx_size"),
                    _hash(F.concat_ws("|", F.coalesce(F.col("mx_doc.doc_id").cast("string"), F.lit("")), F.coalesce("mx_doc.text", F.lit(""))), 15).alias("mx_hash"))
            .withColumn("mx_class", size_class(F.col("mx_size"))))


def source_targets(rows: DataFrame) -> DataFrame:
    """One row per source: source_size, target (double).  One row per source is all the windows hold."""
    per = rows.groupBy("mx_source").agg(F.sum("mx_size").alias("source_size"))
    order = Window.orderBy(F.col("mx_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    big = lambda c: c.cast("decimal(38,0)")
    per = (per.withColumn("w", weight.cast("long")).withColumn("bound", F.lit(MOST) * F.col("source_size"))
           .withColumn("total", F.sum("source_size").over(Window.partitionBy())))
    # bound / weight, as an integer: all weights divide 10
    by_level = Window.orderBy(F.col("bound") * (F.lit(10) / F.col("w")).cast("long"), F.col("mx_source").asc_nulls_last())
    per = (per.withColumn("before", F.coalesce(F.sum("bound").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("w_left", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("left", F.lit(SHARE[0]) * F.col("total") - F.lit(SHARE[1]) * F.col("before"))
           .withColumn("at_bound", big(F.col("left")) * big(F.col("w")) > big(F.lit(SHARE[1]) * F.col("bound")) * big(F.col("w_left"))))
    first = F.min(F.when(~F.col("at_bound"), F.struct((F.col("bound") * (F.lit(10) / F.col("w")).cast("long")).alias("k"), "left", "w_left"))).over(Window.partitionBy())
    per = per.withColumn("first", first)
    target = (F.when(F.col("at_bound"), F.col("bound").cast("double"))
              .otherwise((F.col("w") * F.col("first.left")).cast("double") / (F.lit(SHARE[1]) * F.col("first.w_left")).cast("double")))
    return per.select("mx_source", "source_size", target.alias("target"))


def copies(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with source_size, target and ``mx_copies``."""
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    rows = rows.withColumn("mx_bucket", F.col("mx_hash") % buckets)
    n = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    classes = n.groupBy("mx_source", "mx_class").agg(F.sum("n").alias("class_n"))
    before = Window.partitionBy("mx_source").orderBy("mx_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("class_before", F.coalesce(F.sum("class_n").over(before), F.lit(0))).drop("class_n")
    before = Window.partitionBy("mx_source", "mx_class").orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("bucket_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    targets = source_targets(rows).withColumn("offset", _hash(F.col("mx_source"), 5) / F.lit(1048576.0))
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    n = n.join(classes.withColumnsRenamed({k: f"c_{k}" for k in _KEY[:2]}),
               [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in _KEY[:2]]).drop(*[f"c_{k}" for k in _KEY[:2]])
    n = n.join(targets.withColumnRenamed("mx_source", "t_source"), F.col("mx_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    n = n.withColumnsRenamed({k: f"n_{k}" for k in _KEY})
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy("mx_size", "mx_hash", F.col("mx_doc.doc_id")))
    ranked = rows.withColumn("rank", rank).join(n, [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in _KEY])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("class_before") + F.col("bucket_before") + F.col("rank")
    out = ranked.withColumn("rate", rate).withColumn("place", place)
    crossed = F.floor(F.col("place") * F.col("rate") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("rate") + F.col("offset"))
    return out.withColumn("mx_copies", crossed.cast("long"))


def mixing_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.  The texts are read once, into a
    checkpoint of narrow rows."""
    rows = saved(measured(docs).withColumn("mx_doc", F.struct(F.col("mx_doc.doc_id").alias("doc_id"))))
    return copies(rows, rows.count()).select("mx_doc.doc_id", F.col("mx_size").alias("size"), "source_size", "target",
                                            (F.col("mx_copies") * F.col("mx_size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Every row as often as the mix takes it, with all its columns."""
    out = copies(measured(docs), docs.count()).where("mx_copies > 0")
    return out.select("mx_doc", F.explode(F.sequence(F.lit(1), F.col("mx_copies").cast("int"))).alias("mx_copy")).select("mx_doc.*")


ORACLE = r"""
with r as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
k as (
  select *, case when size < 4 then size else length(bin(size)) * 4 + ((size >> (length(bin(size)) - 3)) & 3) end as cls,
         h % greatest(1, ((select count(*) from documents) + 19999) // 20000) as bucket
  from r),
s as (select source, sum(size)::bigint as source_size from r group by source),
w as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w, 2 * source_size as bound,
         (sum(source_size) over ())::bigint as total
  from s),
l as (
  select *, coalesce(sum(bound) over (order by bound * (10 // w), source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as b4,
         (sum(w) over (order by bound * (10 // w), source nulls last rows between current row and unbounded following))::bigint as w_left
  from w),
c as (select *, 3 * total - 2 * b4 as room, (3 * total - 2 * b4)::hugeint * w > 2::hugeint * bound * w_left as at_bound from l),
f as (select room, w_left from c where not at_bound order by bound * (10 // w), source nulls last limit 1),
t as (
  select source, source_size,
         case when at_bound then bound::double else (w * (select room from f))::double / (2 * (select w_left from f))::double end as target,
         ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 5))::bigint / 1048576.0::double as o
  from c),
p as (
  select k.doc_id, k.size, t.source_size, t.target, t.o, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
         row_number() over (partition by k.source order by cls, bucket, k.size, h, k.doc_id nulls first) as place
  from k join t on k.source is not distinct from t.source)
select doc_id, size, source_size, target,
       ((floor(place * rate + o) - floor((place - 1) * rate + o))::bigint * size)::bigint as taken
from p
"""
