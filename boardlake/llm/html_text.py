"""Operator 4, main text of web pages by tag-path ratios.

A page is read once into text leaves, each with its root-to-leaf path of block elements (with
their classes and, in ``article`` or ``main``, the number of that element; inline markup adds nothing to a path).
On every page the text length and the punctuation of a path's leaves are aggregated to ratios a leaf; the ratios are
smoothed over neighbouring leaves in page order and fused (text ratio x punctuation ratio).  Structure is evidence:
a path below ``article`` or ``main`` counts ``WITHIN`` times; each element around it that speaks of menus,
page headers, footers, sidebars, notices, adverts, forms or reader comments makes it ``APART`` times as much
(by element name or role) or ``NAMED`` times (by class or id), and at most a share of the best path with fewer of
them in ``article`` or ``main`` (on a page without these, of the best path with none), so long comments don't hide a short text.  Paths above a threshold (a share of the deviation over
the page's paths) are content.  Content paths bring in what their ``article`` or ``main`` also holds under no more such
elements than they have, except nested articles without a content path, and paths of links alone that
are no heading and stay below the threshold by their links' own text and punctuation.  Without such an element, the headings and
other leaves below the smallest element that holds the content paths belong to it too.  Only what a page does not
show is never content: the head, scripts, styles, hidden parts.

Character references are decoded; white space inside a block becomes one blank, blocks are
trimmed, empty ones skipped, and joined in page order by one line feed.  Nothing is capped.

Defined results: a null or empty page, or one without content, has the empty text; broken or cut markup is
read as far as it goes (a tag without end is dropped); repeated rows give one result row each; an empty
table gives no rows.  Columns beyond page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of the deviation of the fused ratios that a path must reach, and the smoothing weights.
THRESHOLD, SMOOTH = 0.8, (0.25, 0.5, 0.25)
#: What a path's score is multiplied by: in article or main; for each element around it that is apart by its name, by its class or id.
WITHIN, APART, NAMED = 4.0, 0.01, 0.01
#: At most this share of the best score that is less apart: in article or main, on a page without them.
SHARE_MAIN, SHARE = 0.25, 1.0

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
                   "time tt u var wbr img input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements, roles and words of class or id that seldom hold article text.
OUTSIDE = frozenset("nav footer aside form button dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|paywall"
    r"|sidebars?|side|aside|menus?|nav|navbar|navigation|breadcrumbs?|foot|footer|header|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|respond"
    r"|share|sharing|social|related|recommend\w*|widgets?|login|signup|register|search|form|pagination|pager|skip)(?=$|[\s_-])", re.I)
INSIDE_FREE = frozenset(("header",))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>|</?[a-zA-Z][^<>]*>", re.S)
_CUT = re.compile(r"<[!?/]?[a-zA-Z!][^>]*\Z")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡]")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _hidden(name: str, attributes: dict[str, str]) -> bool:
    return name == "head" or "hidden" in attributes or attributes.get("aria-hidden") == "true" \
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _apart(name: str, attributes: dict[str, str], in_main: bool) -> float:
    """What an element does to the score of the paths below it."""
    if name in ("html", "body", "main", "article"):
        return 1.0
    if name in OUTSIDE or (name == "header" and not in_main) or attributes.get("role", "").lower() in ROLES:
        return APART
    for key in ("class", "id"):
        for m in NAMES.finditer(attributes.get(key, "")):
            if not (in_main and m[0].strip(" _-\t\n").lower() in INSIDE_FREE):
                return NAMED
    return 1.0


class _Path(NamedTuple):
    """A path, with the numbers of the article and main elements around it and the elements that set it apart: how many, their product."""

    name: str
    mains: tuple[int, ...]
    apart: int
    weight: float


class _Page:
    """Leaves of one page: (block, path, text, is link)."""

    def __init__(self, page: str):
        self.leaves: list[tuple[int, _Path, str, bool]] = []
        self.block = 0
        root = ("", _Path("", (), 0, 1.0), False)
        stack: list[tuple[str, _Path, bool]] = []  # name, path, hidden
        links = mains = 0
        at, end = 0, len(page)
        while at < end:
            m = _TAG.search(page, at)
            text = page[at:m.start()] if m else _CUT.sub("", page[at:])
            if text:
                top = stack[-1] if stack else root
                if not top[2]:
                    self.leaves.append((self.block, top[1], unescape(text) if "&" in text else text, links > 0))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    continue
                if not re.match(r"</?[a-zA-Z]", m[0]):
                    continue
                inner = re.match(r"<(/?)([a-zA-Z][^\s/>]*)(.*)>", m[0], re.S)  # quotes that do not close
                closing, name, rest = inner[1], inner[2].lower(), ""
            else:
                closing, name, rest = m[1], m[2].lower(), m[3]
            if name not in INLINE:
                self.block += 1
            if closing:
                if any(s[0] == name for s in stack):
                    while stack:
                        gone = stack.pop()
                        links -= gone[0] == "a"
                        if gone[0] == name:
                            break
                continue
            if name in RAW:
                if not rest.endswith("/"):
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    at = stop.end() if stop else end
                continue
            if name in VOID:
                continue
            if name not in INLINE:  # an open paragraph ends here, with the inline markup in it
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        links -= sum(s[0] == "a" for s in stack[i:])
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
                if name in CLOSES:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in BOUNDS[name]:
                            break
                        if stack[i][0] in CLOSES[name]:
                            links -= sum(s[0] == "a" for s in stack[i:])
                            del stack[i:]
                            break
            if rest.rstrip().endswith("/") and name in INLINE:
                continue
            _, parent, hidden = stack[-1] if stack else root
            attributes = _attributes(rest) if rest.strip(" /\n\t") else {}
            path, within = parent.name, parent.mains
            if name in ("article", "main"):
                mains += 1
                within = (*within, mains)
            if name not in INLINE:
                path = f"{path}/{name}" + (f".{'.'.join(sorted(attributes['class'].split()))}" if attributes.get("class") else "")
            less = _apart(name, attributes, bool(parent.mains))
            links += name == "a"
            stack.append((name, _Path(path, within, parent.apart + (less < 1), parent.weight * less), hidden or _hidden(name, attributes)))


def _fused(order: list[_Path], ratios: dict[_Path, tuple[float, float]]) -> dict[_Path, float]:
    """Smoothed and fused ratios of every path, times its evidence."""
    ratio = np.array([ratios[p] for p in order])
    padded = np.vstack([ratio[:1], ratio, ratio[-1:]])
    smooth = sum(w * padded[i:i + len(order)] for i, w in enumerate(SMOOTH))
    total: dict[_Path, list[float]] = {}
    for p, (t, q) in zip(order, smooth):
        s = total.setdefault(p, [0, 0.0])
        s[0] += 1
        s[1] += t * q
    return {p: s / n * p.weight * (WITHIN if p.mains else 1.0) for p, (n, s) in total.items()}


def _heading(p: _Path) -> bool:
    return p.name.rsplit("/", 1)[-1].split(".")[0] in HEADINGS


def content_paths(leaves: list[tuple[int, _Path, str, bool]]) -> set[_Path]:
    """Paths above the threshold of the smoothed, fused and weighted ratios, and what belongs to them."""
    length: dict[_Path, list[int]] = {}
    order = []
    for _, path, text, link in leaves:
        size = len(text.strip())
        if size:
            order.append(path)
            marks = len(_PUNCTUATION.findall(text))
            s = length.setdefault(path, [0, 0, 0, 0, 0])
            s[0] += 1
            s[1] += 0 if link else size
            s[2] += 0 if link else marks
            s[3] += size
            s[4] += marks
    if not length:
        return set()
    fused = _fused(order, {p: (s[1] / s[0], (1 + s[2]) / s[0]) for p, s in length.items()})
    stated = [p for p in length if p.mains and length[p][1] > 0]
    first = min((p.apart for p in stated or length if length[p][1] > 0), default=0)
    best = max((fused[p] for p in stated or length if p.apart == first), default=0.0) * (SHARE_MAIN if stated else SHARE)
    if stated or first == 0:
        fused = {p: min(v, best) if p.apart > first else v for p, v in fused.items()}
    values = np.array(list(fused.values()))
    least = max(THRESHOLD * values.std(), 1e-9) if len(values) > 1 else 1e-9
    chosen = {p for p, v in fused.items() if v >= least and length[p][1] > 0}
    if not chosen:
        return chosen
    keep = {p for p, s in length.items() if s[1] > 0 or _heading(p) or s[3] * s[4] / s[0] ** 2 * p.weight * (WITHIN if p.mains else 1.0) >= least}
    level: dict[int, int] = {}  # article or main with a content path: the elements apart around it
    for p in chosen:
        if p.mains:
            level[p.mains[-1]] = min(level.get(p.mains[-1], p.apart), p.apart)
    found = {p for p in length if p.mains and p.apart <= level.get(p.mains[-1], -1)} & keep | chosen
    for most in {p.apart for p in chosen if not p.mains}:
        common = None
        for p in chosen:
            if p.mains or p.apart != most:
                continue
            parts = p.name.split("/")[:-1] or [""]
            if common is None:
                common = parts
            else:
                same = 0
                while same < min(len(common), len(parts)) and common[same] == parts[same]:
                    same += 1
                common = common[:same]
        inside = "/".join(common or [""]) + "/"
        near = {p for p in keep if not p.mains and p.name.startswith(inside) and p.apart <= most}
        depth = len([x for x in common or [] if x])
        found |= near if depth >= 3 else {p for p in near if _heading(p)}  # from 3: a container of its own, below body
    return found


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    leaves = _Page(page).leaves
    paths = content_paths(leaves)
    blocks: dict[int, list[str]] = {}
    for block, path, text, _ in leaves:
        if path in paths:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    slim = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                texts = [main_text(x) for x in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    kinds = dict(slim.dtypes)
    return slim.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
