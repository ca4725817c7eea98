"""Landed web pages -> tables (S13-S21), re-aimed from site scrapers to pattern-driven operators.

Input is a table of pages (page_id, url, html); every pattern is a parameter.  Each page is
one row and every operator works on that row (``regexp_extract_all`` + ``posexplode``) or
over one page's elements, so pages are processed in parallel and nothing goes through the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codings import sort_suit
from ..functions.deals import is_valid_deal

# fixed values: spellings of the strains in contract texts
SUIT_WORDS = {"♠": "S", "♥": "H", "♦": "D", "♣": "C", "NT": "N", "SA": "N"}
CONTRACT_TEXT = r"^([1-7])([CDHSN])(X{0,2})[NESW]?(=|[+-][0-9]+)?$"


def _all(col: str | Column, pattern: str, group: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def html_rows(pages: DataFrame, row_re: str, cell_re: str, key: str = "page_id", html: str = "html",
              aliases: dict[int, str] | None = None) -> DataFrame:
    """One row per match of ``row_re`` (group 1) with its position and the cells of ``cell_re``.

    ``aliases`` maps a cell position to a column name.  Decimal commas can be fixed with
    ``to_decimal_point``.
    """
    rows = pages.select(key, F.posexplode(_all(html, row_re, 1)).alias("pos", "row_html"))
    rows = rows.withColumn("cells", _all("row_html", cell_re, 1))
    for i, name in (aliases or {}).items():
        rows = rows.withColumn(name, F.element_at("cells", i + 1))
    return rows


def plain_text(col: str | Column) -> Column:
    """Text of a piece of markup: without tags, the named characters of result pages decoded, white space as one space."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def link_targets(col: str | Column) -> Column:
    """Targets of all links in a piece of markup."""
    return _all(col, r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", 1)


def rows_by_header(pages: DataFrame, aliases: dict[str, list[str]], sections: dict[str, str], key: str = "page_id", html: str = "html",
                   row_re: str = r"(?is)<tr\b[^>]*>(.*?)</tr>", cell_re: str = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>") -> DataFrame:
    """Table rows with their cells picked by the names in the page's own header row.

    ``aliases`` gives each output column its header names (lower case), the first that is there counts; a row in which every column
    has one is a header and holds for the rows below it.  A row whose text contains a key of ``sections`` starts that section.
    Other rows below a header and a section come out as (key, pos, section, one text per column, links); a row with too few cells has nulls.
    The windows run over one page's rows.
    """
    rows = pages.select(key, F.posexplode(_all(html, row_re, 1)).alias("pos", "_row"))
    rows = rows.withColumns({"_cells": F.transform(_all("_row", cell_re, 1), plain_text), "links": link_targets("_row")})
    rows = rows.withColumn("_names", F.transform("_cells", F.lower))
    place = {c: F.coalesce(*[F.nullif(F.array_position("_names", a), F.lit(0).cast("long")) for a in names]) for c, names in aliases.items()}
    rows = rows.withColumn("_head", F.struct(*[p.cast("int").alias(c) for c, p in place.items()]))
    is_head = F.lit(True)
    for c in aliases:
        is_head = is_head & F.col("_head")[c].isNotNull()
    text = F.array_join("_cells", " ")
    label = F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in sections.items()])
    rows = rows.withColumns({"_is_head": is_head, "_label": F.when(~is_head, label)})
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_at": F.last(F.when(F.col("_is_head"), F.col("_head")), ignorenulls=True).over(w),
                             "section": F.last("_label", ignorenulls=True).over(w)})
    rows = rows.where(~F.col("_is_head") & F.col("_label").isNull() & F.col("_at").isNotNull() & F.col("section").isNotNull())
    return rows.select(key, "pos", "section", *[F.get("_cells", F.col("_at")[c] - 1).alias(c) for c in aliases], "links")


def to_decimal_point(col: str | Column) -> Column:
    """'164,2' -> 164.2 (null when not a number)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, ",", ".").try_cast("double")


def carry_heading(rows: DataFrame, k: str, pos: str, heading: str, is_heading: str) -> DataFrame:
    """The last heading seen before each row of a page applies to it (headings themselves dropped)."""
    w = Window.partitionBy(k).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("current_heading", F.last(F.when(F.col(is_heading), F.col(heading)), ignorenulls=True).over(w))
    return out.filter(~F.col(is_heading))


def page_fields(pages: DataFrame, spec: dict[str, tuple[str, int, str]], key: str = "page_id", html: str = "html") -> DataFrame:
    """One value per page and name from (regex, group, type); null when absent or not castable."""
    cols = [F.col(key)]
    for name, (pattern, group, typ) in spec.items():
        v = F.nullif(F.regexp_extract(F.col(html), pattern, group), F.lit(""))
        cols.append((v if typ == "string" else v.try_cast(typ)).alias(name))
    return pages.select(*cols)


def zip_lists(pages: DataFrame, re_a: str, re_b: str, key: str = "page_id", html: str = "html",
              names: tuple[str, str] = ("a", "b"), keep: tuple[str, ...] = ()) -> DataFrame:
    """I-th match of one pattern with the i-th of another; the shorter list wins.
    ``keep`` columns of the page ride along (no join back)."""
    a, b = _all(html, re_a, 1), _all(html, re_b, 1)
    n = F.least(F.size(a), F.size(b))
    z = F.arrays_zip(F.slice(a, 1, n).alias(names[0]), F.slice(b, 1, n).alias(names[1]))
    return pages.select(key, *keep, F.posexplode(z).alias("pos", "_z")).select(
        key, *keep, "pos", f"_z.{names[0]}", f"_z.{names[1]}")


def query_params(df: DataFrame, url: str, names) -> DataFrame:
    """Host, path and named query parameters of a URL (null when absent or not a URL)."""
    u = F.col(url)
    cols = {"host": F.try_parse_url(u, F.lit("HOST")), "path": F.try_parse_url(u, F.lit("PATH"))}
    for n in names:
        cols[f"q_{n}"] = F.try_parse_url(u, F.lit("QUERY"), F.lit(n))
    return df.withColumns(cols)


def extract_embedded_json(pages: DataFrame, pattern: str, schema: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """JSON text captured by ``pattern`` (group 1) parsed with ``schema``."""
    txt = F.nullif(F.regexp_extract(F.col(html), pattern, 1), F.lit(""))
    return pages.select(key, F.from_json(txt, schema).alias("data"))


def cells_to_deal(df: DataFrame, cells: str) -> DataFrame:
    """16 suit cells in N, W, E, S order (S, H, D, C each) -> deal string in N, E, S, W order.

    Hyphens and blanks are removed ('10' becomes 'T') and a suit's cards sorted; rows without 16 cells, or whose deal is
    not one full deck in four hands of 13, get null.
    """
    clean = F.transform(F.col(cells), lambda x: sort_suit(F.regexp_replace(F.regexp_replace(x, "10", "T"), r"[-\s]", "")))
    hand = lambda i: F.concat_ws(".", *[F.get("_clean", F.lit(i * 4 + j)) for j in range(4)])
    n, w, e, s = hand(0), hand(1), hand(2), hand(3)
    # staged, so that each step is evaluated once
    out = df.withColumn("_clean", clean).withColumn("_deal", F.concat(F.lit("N:"), F.concat_ws(" ", n, e, s, w)))
    whole = (F.size("_clean") == 16) & (F.length("_deal") == 69) & is_valid_deal("_deal")
    return out.withColumn("pbn", F.when(whole, F.col("_deal"))).drop("_clean", "_deal")


def parse_mp_text(col: str | Column) -> dict[str, Column]:
    """S18: '164,2 (83,35 %)' -> matchpoints 164.2 and percent 83.35."""
    c = F.col(col) if isinstance(col, str) else col
    mp = F.regexp_replace(F.regexp_extract(c, r"^\s*([0-9]+(?:[.,][0-9]+)?)", 1), ",", ".").try_cast("double")
    pct = F.regexp_replace(F.regexp_extract(c, r"\(\s*([0-9]+(?:[.,][0-9]+)?)\s*%\s*\)", 1), ",", ".").try_cast("double")
    return {"mp": mp, "pct": pct}


def parse_contract_text(col: str | Column) -> dict[str, Column]:
    """S18: '3 SA X -1', '4♠=' or '1NT +2' -> level, strain letter, doubling ('', X, XX) and result (0, +n, -n).

    A text without a contract (a pass, an empty cell, null) gives nulls; a contract without a result has a null result.
    """
    c = F.upper(F.col(col) if isinstance(col, str) else col)
    for word, letter in SUIT_WORDS.items():
        c = F.replace(c, F.lit(word), F.lit(letter))
    c = F.regexp_replace(c, r"\s+", "")
    part = lambda i: F.when(c.rlike(CONTRACT_TEXT), F.regexp_extract(c, CONTRACT_TEXT, i))
    result = F.when(part(4) == "=", F.lit(0)).otherwise(part(4).try_cast("int"))
    return {"level": part(1).cast("int"), "strain": part(2), "dbl": part(3), "result": result}


def lines_to_records(df: DataFrame, text: str, header, n: int = 4, key: str = "page_id",
                     names=("score", "frequency", "mp_ns", "mp_ew"), ranges=None) -> DataFrame:
    """After the header (a line, or lines in a row), every ``n`` lines make one record of ``names``; stop at the first bad group
    (a line that is no number, or a value outside ``ranges``: by default scores within +-2000 and frequencies 0 to 100); of
    records with the same first field the first one stays; a page's rows come sorted by it, descending.

    Row-local: a page's lines are one array, so there is no shuffle.  A page without header, and a null, give no rows.
    """
    head = [header] if isinstance(header, str) else list(header)
    ranges = {"score": (-2000, 2000), "frequency": (0, 100)} if ranges is None else ranges
    out = df.select(key, F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)).alias("_lines"))
    starts = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.slice("_lines", i, len(head)) == F.array(*[F.lit(h) for h in head]))
    # nulls pass through to the end, where they give no rows; a filter in between would evaluate all steps before it twice
    out = out.withColumn("_at", F.get(starts, F.lit(0)))
    out = out.withColumn("_body", F.slice("_lines", F.col("_at") + len(head), F.size("_lines")))
    number = lambda x: F.when(x.rlike(r"^-?[0-9]+([.,][0-9]+)?$"), F.regexp_replace(x, ",", ".").try_cast("double"))
    groups = F.when(F.size("_body") >= n, F.sequence(F.lit(0), F.floor(F.size("_body") / n).cast("int") - 1))
    recs = F.transform(groups, lambda g: F.struct(*[number(F.get("_body", g * n + i)).alias(nm) for i, nm in enumerate(names)]))
    out = out.withColumn("_recs", recs)

    def bad(r):
        test = F.lit(False)
        for nm in names:
            low, high = ranges.get(nm, (None, None))
            test = test | r[nm].isNull() | (F.lit(False) if low is None else ~r[nm].between(low, high))
        return test

    stop = F.array_min(F.transform("_recs", lambda r, i: F.when(bad(r), i)))
    out = out.withColumn("_good", F.slice("_recs", F.lit(1), F.coalesce(stop, F.size("_recs"))))
    once = F.filter("_good", lambda r, i: ~F.exists(F.slice("_good", F.lit(1), i), lambda x: x[names[0]] == r[names[0]]))
    return out.select(key, F.inline(F.sort_array(once, asc=False)))


def latest_results(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row per event id (the newest, via a partial aggregate, so a hot id is folded
    map-side), newest first."""
    from ..operators.cache import upsert_newer_wins

    return upsert_newer_wins(df, None, id_col, [order_col]).orderBy(F.col(order_col).desc())
