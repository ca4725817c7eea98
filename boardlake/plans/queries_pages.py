"""Registered page / JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codings import with_default_ids
from ..session import read_table
from ..sources import fixtures
from ..sources import json_tables as J
from ..sources import pages as PG
from .boards import scored_results
from .oracle import sql_scored_results, with_fixtures
from .registry import register

LINK_ROW = r"<li>(.*?)</li>"
CELL = r">([^<]*)<"
HREF = r'<a href="([^"]*)"'
LINK_TEXT = r'<a href="[^"]*">([^<]*)</a>'


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])


@register(
    "page_rows",
    "S13",
    f"""with r as (select page_id, unnest(regexp_extract_all(html, '{LINK_ROW}', 1)) row_html,
    unnest(range(len(regexp_extract_all(html, '{LINK_ROW}', 1)))) pos from pages)
select page_id, cast(pos as int) pos, row_html, array_to_string(regexp_extract_all(row_html, '{CELL}', 1), '|') cells,
  cast(len(regexp_extract_all(row_html, '{CELL}', 1)) as int) n_cells,
  regexp_extract_all(row_html, '{CELL}', 1)[1] first_cell from r""",
)
def q_page_rows(spark, sf_dir):
    """Every list row of every page with its cells."""
    rows = PG.html_rows(_pages(spark, sf_dir), LINK_ROW, CELL, aliases={0: "first_cell"})
    return rows.select("page_id", "pos", "row_html", F.array_join("cells", "|").alias("cells"),
                       F.size("cells").cast("int").alias("n_cells"), "first_cell")


@register(
    "page_links",
    "S20,S21",
    f"""with z as (select page_id, url, regexp_extract_all(html, '{HREF}', 1) a, regexp_extract_all(html, '{LINK_TEXT}', 1) b from pages),
e as (select page_id, url, unnest(range(least(len(a), len(b)))) pos, a, b from z)
select page_id, cast(pos as int) pos, a[pos + 1] href, b[pos + 1] text,
  nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') q_page,
  nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') q_ref
from e""",
)
def q_page_links(spark, sf_dir):
    """i-th link target zipped with i-th link text on every page, with the page URL's host, path and query values."""
    p = PG.query_params(_pages(spark, sf_dir), "url", ["page", "ref"])
    z = PG.zip_lists(p, HREF, LINK_TEXT, names=("href", "text"), keep=("host", "path", "q_page", "q_ref"))
    return z.select("page_id", "pos", "href", "text", "host", "path", "q_page", "q_ref")


FIELD_SPEC = {
    "lang": (r'<html lang="([a-z]+)"', 1, "string"),
    "title": (r"<title>([^<]*)</title>", 1, "string"),
    "heading": (r"<h1>([^<]*)</h1>", 1, "string"),
    "ad_no": (r"<!-- ad ([0-9]+) -->", 1, "int"),
    "track_id": (r"track\(([0-9]+)\)", 1, "bigint"),
}


@register(
    "page_fields",
    "S16",
    "select page_id, " + ", ".join(
        (f"nullif(regexp_extract(html, '{p}', {g}), '')" if t == "string"
         else f"try_cast(nullif(regexp_extract(html, '{p}', {g}), '') as {'integer' if t == 'int' else 'bigint'})") + f" {n}"
        for n, (p, g, t) in FIELD_SPEC.items()) + " from pages",
)
def q_page_fields(spark, sf_dir):
    """Language, title, first heading, ad number and tracking id of every page (null when absent)."""
    return PG.page_fields(_pages(spark, sf_dir), FIELD_SPEC)


BLOCK = r"<(h1|p)>([^<]*)"


@register(
    "page_headings",
    "S15",
    f"""with t as (select page_id, regexp_extract_all(html, '{BLOCK}', 1) tags, regexp_extract_all(html, '{BLOCK}', 2) texts from pages),
e as (select page_id, unnest(range(len(tags))) pos, tags, texts from t),
r as (select page_id, cast(pos as int) pos, tags[pos + 1] = 'h1' is_heading, texts[pos + 1] text from e)
select page_id, pos, text,
  last_value(case when is_heading then text end ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and current row) current_heading
from r qualify not is_heading""",
)
def q_page_headings(spark, sf_dir):
    """Every paragraph of every page with the last heading above it."""
    p = _pages(spark, sf_dir)
    tags = F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(BLOCK), F.lit(2))
    rows = p.select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("text"))).alias("pos", "_z"))
    rows = rows.select("page_id", "pos", (F.col("_z.tag") == "h1").alias("is_heading"), F.col("_z.text").alias("text"))
    return PG.carry_heading(rows, "page_id", "pos", "text", "is_heading").select("page_id", "pos", "text", "current_heading")


@register(
    "json_children",
    "S6",
    """select event_id, user_id, event_type, try_cast(json_extract_string(props, '$.k') as integer) props_k from events""",
)
def q_json_children(spark, sf_dir):
    """Event properties parsed from JSON text and flattened into relational columns."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "props"])
    parsed = ev.select("event_id", "user_id", "event_type", F.from_json("props", "k INT").alias("props"))
    return J.flatten(parsed)


@register("embedded_json", "S14", "select event_id, try_cast(json_extract_string(props, '$.k') as integer) k from events")
def q_embedded_json(spark, sf_dir):
    """JSON read back from a script of a page that holds each event's properties."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "props"])
    pages = ev.select(F.col("event_id").alias("page_id"), F.concat(F.lit("<html><script>var data = "), "props", F.lit(";</script></html>")).alias("html"))
    got = PG.extract_embedded_json(pages, r"var data = (\{.*?\});", "k INT")
    return got.select(F.col("page_id").alias("event_id"), F.col("data.k").alias("k"))


@register(
    "deal_cells",
    "S17,P23,P18",
    with_fixtures(["deals"], "", """select deal_id, case when deal_id % 17 <> 0
    or split_part(split_part(substr(pbn, 3), ' ', 1), '.', 1) = split_part(split_part(substr(pbn, 3), ' ', 4), '.', 1) then pbn end pbn from deals"""),
)
def q_deal_cells(spark, sf_dir):
    """Deals read from 16 table cells (N, W, E, S; cards low to high, 10 for T, a hyphen for a void); every 17th deal's
    north has west's spades, so that it is no full deck."""
    hands = F.transform(F.split(F.substring("pbn", 3, 67), " "), lambda h: F.split(h, r"\."))
    order = F.flatten(F.array(*[F.get(hands, F.lit(i)) for i in (0, 3, 1, 2)]))
    df = fixtures.deals(spark, sf_dir).select("deal_id", order.alias("cells"))
    df = df.withColumn("cells", F.transform("cells", lambda x, i: F.when((F.col("deal_id") % 17 == 0) & (i == 0), F.element_at("cells", 5)).otherwise(x)))
    written = F.transform("cells", lambda x: F.when(x == "", F.lit(" - ")).otherwise(F.replace(F.concat(F.lit(" "), F.reverse(x)), F.lit("T"), F.lit("10"))))
    return PG.cells_to_deal(df.withColumn("cells", written), "cells").select("deal_id", "pbn")


@register(
    "result_texts",
    "S18,P1",
    with_fixtures(["board_results"], sql_scored_results(), """select session_id, cast(0 as bigint) group_id, '' section_name, board, l_orderkey, l_linenumber, l_partkey,
  level, strain, dbl, result, cast((l_orderkey % 400) || '.' || l_linenumber as double) mp, cast((l_partkey % 100) || '.' || (l_orderkey % 9) as double) pct
from scored"""),
)
def q_result_texts(spark, sf_dir):
    """Contract, result, matchpoints and percentage of every result read back from a feed's texts, with the default ids."""
    res = scored_results(fixtures.board_results(spark, sf_dir))
    words = F.create_map(*[F.lit(x) for pair in (("S", "♠"), ("H", "♥"), ("D", "♦"), ("C", "♣"), ("N", "SA")) for x in pair])
    r = F.col("result")
    made = F.when(r == 0, F.lit("=")).when(r > 0, F.concat(F.lit("+"), r.cast("string"))).otherwise(r.cast("string"))
    text = F.concat_ws(" ", F.col("level").cast("string"), F.element_at(words, F.col("strain")), F.col("dbl"), F.col("declarer"), made)
    df = res.select("session_id", "board", "l_orderkey", "l_linenumber", "l_partkey",
                    F.when(F.col("level").isNull(), F.col("contract")).otherwise(text).alias("contract_text"),
                    F.concat((F.col("l_orderkey") % 400).cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), F.lit(" ("),
                             (F.col("l_partkey") % 100).cast("string"), F.lit(","), (F.col("l_orderkey") % 9).cast("string"), F.lit(" %)")).alias("mp_text"))
    out = with_default_ids(df).withColumns(PG.parse_contract_text("contract_text") | PG.parse_mp_text("mp_text"))
    return out.drop("contract_text", "mp_text")
