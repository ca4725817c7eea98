"""Operator 2, n-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set is its distinct shingles of ``words`` words (A-Z lower-cased; fewer words: the whole
sequence as one).  Two documents link when 100 * intersection >= ``percent`` * union.  The registered query
takes ``N`` and ``PERCENT``.

1. *Order.*  A table of ``2 ** COUNTER_BITS`` hashed counters (that size whatever the corpus)
   counts in how many documents shingles occur, over all documents.  Sets are ordered by
   (count, hash): rare first, the same order everywhere, so any collision costs sharpness only.
2. *Sets.*  Documents of one set (a 128-bit sum over its hashes and its size) are one node, its
   smallest doc_id stands for it: exact copies never meet in a join.
3. *Prefix join.*  Two sets that link share a shingle among the first n - ceil(n * percent / 100) + 1 of each.
   Prefix rows meet by shingle.  Candidates pass a length filter, a positional filter (what can still match:
   the earlier prefix shingles that any other set shares, and all that follow) and a suffix filter (a lower bound
   of the difference of two sets: the bits in which the parities of their hashes in ``64 * PARITY`` bins differ).
4. *No quadratic groups.*  In a group that shares a shingle all members are first compared with
   one of them, the pivot, which has the fewest rarer shingles.  Once the found links have made
   components, only pairs of the group in different components remain, of which one member is
   outside the pivot's component; those that pass all filters (within the join) are compared.
   Every pair that could connect two components is thus compared, each once.
5. *Verify.*  The whole texts of a pair are read again and their sets compared.

Components come from repeated contraction to the smallest neighbour, with reliable checkpoints;
nothing of them passes through the driver.

Defined results: a null or empty text, or one without words, has the empty set (0 shingles) and
is linked with nothing; rows that repeat a doc_id are one document with several texts, linked
by any of them, each row with its own n_shingles; a row with a null id is linked with nothing and its component is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import by_bits, key_bits, map_batches, saved

N, PERCENT = 3, 90
COUNTER_BITS, LANES, PARITY = 20, 32, 4
_SHIFT = np.uint64(64 - COUNTER_BITS)


def shingle_sets(col: pa.Array, words: int = N) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes ascending within each row, row offsets) of slices of a text column."""
    for w in wh.words_of(col):
        g, r = wh.ngrams(w, words, short=True)
        s, off = wh.row_sets(g, r, len(w.counts))
        yield w.first, s, off


def shingle_counters(docs: DataFrame, words: int = N) -> np.ndarray:
    """In how many documents a shingle of each counter occurs, over all documents."""
    lanes = [f"c{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            for _, s, _ in shingle_sets(b.column("text"), words):
                total += np.bincount((s >> _SHIFT).astype(np.int64), minlength=len(total))
        grid = total.reshape(-1, LANES)
        at = np.flatnonzero(grid.any(1))
        for i in range(0, len(at), 4096):
            part = at[i:i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(grid[part, j]) for j in range(LANES))], ["block", *lanes])

    rows = map_batches(docs.select("text"), run, "block int, " + ", ".join(f"{c} long" for c in lanes))
    got = rows.groupBy("block").agg(*[F.sum(c).alias(c) for c in lanes]).toPandas()  # at most 2 ** COUNTER_BITS / LANES rows
    grid = np.zeros(((1 << COUNTER_BITS) // LANES, LANES), np.int64)
    if len(got):
        grid[got["block"].to_numpy()] = got[lanes].to_numpy()
    return np.minimum(grid.ravel(), 0xFFFFFFFF).astype(np.uint32)


def sketches(docs: DataFrame, counters, words: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, sig1, sig2, prefix (rare first), parity bits b0 .. of every row."""
    bits = [f"b{i}" for i in range(PARITY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = np.frombuffer(counters.value, np.uint32)
        for b in batches:
            ids = b.column("doc_id")
            for first, s, off in shingle_sets(b.column("text"), words):
                n = np.diff(off)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(wh.mix(s, seed), dtype=np.uint64)]) for seed in (11, 12)]
                sig = [(c[off[1:]] - c[off[:-1]]).view(np.int64) for c in sums]
                key = (order_of[(s >> _SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))
                at, odd = (s >> np.uint64(58)) & np.uint64(PARITY - 1), np.uint64(1) << (s & np.uint64(63))
                flips = [np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(np.where(at == np.uint64(i), odd, np.uint64(0)))]) for i in range(PARITY)]
                parity = [(c[off[1:]] ^ c[off[:-1]]).view(np.int64) for c in flips]
                size = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
                prefix = np.empty(int(size.sum()), np.uint64)
                p = np.concatenate([[0], np.cumsum(size)])
                for i in np.flatnonzero(n).tolist():
                    part = slice(off[i], off[i + 1])
                    prefix[p[i]:p[i + 1]] = s[part][np.argsort(key[part], kind="stable")[:size[i]]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), pa.array(n.astype(np.int64)), pa.array(sig[0]), pa.array(sig[1]),
                     wh.list_array(prefix.view(np.int64), p, pa.int64()), *map(pa.array, parity)],
                    ["doc_id", "n", "sig1", "sig2", "prefix", *bits])

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, sig1 long, sig2 long, prefix array<long>, " + ", ".join(f"{c} long" for c in bits))


def _least_overlap(a: str, b: str, percent: int) -> str:
    return f"ceil({percent} * ({a} + {b}) / {100 + percent}.0D)"


def _passes(a: str, b: str, percent: int) -> str:
    """Length and positional filters of two prefix rows (n: size, p: place, c: earlier shared shingles) of one shingle."""
    n1, p1, c1, n2, p2, c2 = (f"{x}{f}" for x in (a, b) for f in "npc")
    return (f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and "
            f"least({c1}, {c2}) + least({n1} - {p1}, {n2} - {p2}) >= {_least_overlap(n1, n2, percent)}")


def _near(a: str, b: str, percent: int) -> str:
    """Suffix filter: the differing parity bits are at most as many as two linked sets differ in."""
    return f"{' + '.join(f'bit_count({a}b{i} ^ {b}b{i})' for i in range(PARITY))} <= {a}n + {b}n - 2 * {_least_overlap(a + 'n', b + 'n', percent)}"


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the ids, once each: m and n copies of a row would give m x n pairs of the same texts.  Only texts of
    ids that repeat are compared with each other.  Texts of other ids are dropped before the shuffle, but for a few (``by_bits``)."""
    docs = by_bits(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), F.col("id"), key_bits(ids, "id"), True)
    texts = docs.join(ids, "id", "left_semi")
    repeated = docs.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("id")
    return texts.join(repeated, "id", "left_anti").unionAll(texts.join(repeated, "id", "left_semi").distinct())


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int = N, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link: suffix filter, then the sets of their whole texts."""
    bits = [f"b{i}" for i in range(PARITY)]
    sides = [nodes.select(F.col("rep").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", *bits)]) for x in "ab"]
    pairs = pairs.join(sides[0], "a").join(sides[1], "b").where(_near("a_", "b_", percent)).select("a", "b").distinct()
    pairs = saved(pairs)
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    texts = texts_of(docs, ids)
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                count = b.num_rows
                sets = []
                for c in ("text_a", "text_b"):
                    parts = [(s, np.repeat(np.arange(first, first + len(off) - 1), np.diff(off))) for first, s, off in shingle_sets(b.column(c), words)]
                    sets.append([np.concatenate(x) for x in zip(*parts)])
                (ga, ra), (gb, rb) = sets
                na, nb = np.bincount(ra, minlength=count), np.bincount(rb, minlength=count)
                r = np.concatenate([ra, rb])
                order = np.argsort(r, kind="stable")
                s, off = wh.row_sets(np.concatenate([ga, gb])[order], r[order], count)
                union = np.diff(off)
                ok = pa.array((100 * (na + nb - union) >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    return saved(map_batches(both.select("a", "b", "text_a", "text_b"), run, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the edges (a, b)."""
    flipped = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not edges.isEmpty():
        up = (flipped(edges).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
              .select("node", F.least("node", "near").alias("up")))
        up, moved = saved(up), True
        while moved:  # up to the roots: each turn halves the way
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = saved(up.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moved = not up.where("moved").isEmpty()
            up = up.select("node", "up")
        if label is None:
            label = up.select("node", F.col("up").alias("component"))
        else:
            label = saved(label.join(up.select(F.col("node").alias("component"), F.col("up").alias("root")), "component", "left")
                          .select("node", F.coalesce("root", "component").alias("component")))
        a, b = (up.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        edges = saved(edges.join(a, "a").join(b, "b").where("up_a <> up_b")
                      .select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def linked(docs: DataFrame, words: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketch rows; doc_id to node rows; links between nodes that connect all that links)."""
    spark = docs.sparkSession
    counters = spark.sparkContext.broadcast(shingle_counters(docs, words).tobytes())
    rows = saved(sketches(docs, counters, words, percent))
    sets = ["sig1", "sig2", "n"]
    bits = [f"b{i}" for i in range(PARITY)]
    some = rows.where("n > 0 and doc_id is not null")
    # the prefixes of sets that occur once are not shuffled
    same = F.struct(*sets)
    copied = some.groupBy(*sets).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(same.alias("set"))
    marks = saved(key_bits(copied, "set"))
    alone = by_bits(some, same, marks, False).select(*sets, F.col("doc_id").alias("rep"), "prefix", *bits)
    grouped = saved(by_bits(some, same, marks, True).groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), *[F.first(c).alias(c) for c in bits]))
    whole = alone.unionAll(grouped)
    nodes = saved(whole.drop("prefix"))
    member = some.select("doc_id", *sets).distinct().join(nodes.select("rep", *sets), sets).select("doc_id", "rep").distinct()
    # a repeated id ties the sets of its texts together
    ties = (member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
            .select("doc_id", "a").join(member, "doc_id").select("a", F.col("rep").alias("b")))
    member = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))

    # one shuffle by shingle both counts a shingle's sets and keeps the rows of those that meet
    prefix = whole.select("rep", "n", F.posexplode("prefix").alias("p", "h"))
    met = prefix.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("m > 1")
    earlier = F.row_number().over(Window.partitionBy("rep").orderBy("p")) - 1
    shared = saved(met.select("h", "rep", "n", "p", "m").withColumn("c", earlier))
    pivots = shared.groupBy("h").agg(F.min(F.struct("p", "rep", "n", "c")).alias("pivot"))
    shared = saved(shared.join(pivots, "h"))
    row, pivot = _fields("r_"), _fields("v_", "pivot.")
    pairs = saved(shared.where("rep <> pivot.rep").select(*row, *pivot).where(_passes("r_", "v_", percent))
                  .select(F.col("v_rep").alias("a"), F.col("r_rep").alias("b")).distinct())
    links = verified(pairs, nodes, docs, words, percent).unionAll(ties)

    of = components(links)
    seen = of.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    pivot_of = of.select(F.col("node").alias("pivot_rep"), F.col("component").alias("pivot_comp"))
    marked = (shared.where("m > 2").withColumn("pivot_rep", F.col("pivot.rep")).where("rep <> pivot_rep")
              .join(seen, "rep", "left").join(pivot_of, "pivot_rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
              .withColumn("out", F.col("comp") != F.coalesce("pivot_comp", "pivot_rep"))
              .select("h", "rep", "n", "p", "c", "comp", "out"))
    open_groups = marked.where("out").select("h").distinct()
    marked = saved(marked.join(open_groups, "h", "left_semi").join(nodes.select("rep", *bits), "rep"))
    wide = ["comp", "out", *bits]
    x = marked.where("out").select("h", *_fields("x_"), *[F.col(c).alias(f"x_{c}") for c in wide])
    y = marked.select("h", *_fields("y_"), *[F.col(c).alias(f"y_{c}") for c in wide])
    more = (x.join(y, "h").where(f"x_comp <> y_comp and (not y_out or x_rep < y_rep) and {_passes('x_', 'y_', percent)} and {_near('x_', 'y_', percent)}")
            .select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct())
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return rows, member, links.unionAll(verified(more.join(known, ["a", "b"], "left_anti"), nodes, docs, words, percent))


def _fields(to: str, of: str = "") -> list:
    return [F.col(f"{of}{f}").alias(f"{to}{f}") for f in ("rep", "n", "p", "c")]


def similar_components(docs: DataFrame, words: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, member, links = linked(docs, words, percent)
    of = components(links).select(F.col("node").alias("rep"), "component")
    found = member.join(of, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return (rows.select("doc_id", "n").join(found, "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = N, percent: int = PERCENT) -> DataFrame:
    """One row (all its columns) of every component: that of the smallest doc_id; of rows that
    repeat this id, the one with the smallest text.  Rows with a null id stay.  Only rows whose id goes or repeats, and
    a few more, are shuffled (``by_bits``)."""
    gone = saved(similar_components(docs, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("nj_id")).distinct())
    whole = docs.select(F.col("doc_id").cast("long").alias("nj_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("nj_row"))
    ids = docs.select(F.col("doc_id").cast("long").alias("nj_id")).where("nj_id is not null")
    marks = saved(key_bits(gone.unionAll(ids.groupBy("nj_id").agg(F.count(F.lit(1)).alias("nj_count")).where("nj_count > 1").select("nj_id")), "nj_id"))
    plain = by_bits(whole, F.col("nj_id"), marks, False).select("nj_row")
    kept = by_bits(whole, F.col("nj_id"), marks, True).join(gone, "nj_id", "left_anti")
    repeated = kept.where("nj_id is not null").groupBy("nj_id").agg(F.count(F.lit(1)).alias("nj_count")).where("nj_count > 1").select("nj_id")
    once = kept.join(repeated, "nj_id", "left_anti").select("nj_row")
    again = kept.join(repeated, "nj_id", "left_semi")
    first = again.groupBy("nj_id").agg(F.min_by("nj_row", F.struct(F.xxhash64("nj_row.text"), "nj_row.text")).alias("nj_row"))
    return plain.unionByName(once).unionByName(first.select("nj_row")).select("nj_row.*")
