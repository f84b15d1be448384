"""Operator 1: main text of web pages by composite text density.

A page is read into a tree; every node gets its characters per tag, adjusted by how much of them is link text
(composite text density). A node's density sum adds its children's densities (a paragraph's is its own density). The sparsest node on the way from the
body to the subtree with the largest density sum sets a threshold. From the body down, each node at least that dense
has the subtree of the largest sum at or below it marked; the marked subtrees in page order are the main text.
Parts that a page itself marks as something else (navigation, adverts, forms, comments...) are cut before.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_rows, table

# Element names of the HTML standard, and words by which pages name parts that are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object canvas".split())
DROPPED = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object canvas head nav footer aside form button select option datalist dialog menu audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul br caption".split()
)
ENDS_P = BLOCKS - frozenset("br td th tr tbody thead tfoot body html option optgroup caption legend summary".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("html body table td th ul ol dl select article section div main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adblock sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead header topbar toolbar comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager skip disclaimer copyright feedback form search paywall".split()
)

TOKEN = re.compile(
    r"""<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Za-z]+")


class Page:
    """A page's tree in parallel lists: node 0 is the root, and a node comes after its parent."""

    def __init__(self) -> None:
        self.names, self.parents, self.cut, self.chars, self.tags, self.items = ["#root"], [-1], [False], [0], [0], []

    def add(self, name: str, parent: int, cut: bool) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.cut.append(cut or self.cut[parent])
        self.chars.append(0)
        self.tags.append(0)
        return len(self.names) - 1


def _is_side_part(name: str, attrs: str, inside_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not inside_article):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in ATTR.findall(attrs):
        value = (a or b or c).lower()
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and not (inside_article and name == "header") and any(w in SIDE_WORDS for w in WORDS.findall(value)):
            return True
    return False


def parse(source: str) -> Page:
    """Read a page of any quality: unclosed, crossed and stray tags are taken as browsers roughly take them."""
    page = Page()
    open_nodes = [0]
    at, size = 0, len(source)
    articles = 0
    while at < size:
        m = TOKEN.match(source, at)
        at = m.end()
        text = m.group("text")
        if text is not None:
            page.items.append((open_nodes[-1], text))
            continue
        name = m.group("name") or m.group("name2")
        if not name:
            continue
        name = name.lower()
        if m.group("end") or m.group("end2"):
            if name == "br":
                page.items.append((open_nodes[-1], None))
            for k in range(len(open_nodes) - 1, 0, -1):
                if page.names[open_nodes[k]] == name:
                    articles -= sum(page.names[i] in ("article", "main") for i in open_nodes[k:])
                    del open_nodes[k:]
                    break
                if name not in BLOCKS and page.names[open_nodes[k]] in SCOPES:
                    break
            page.items.append((open_nodes[-1], None if name in BLOCKS else ""))
            continue
        closes = ENDS_SAME.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if closes:
            for k in range(len(open_nodes) - 1, 0, -1):
                opened = page.names[open_nodes[k]]
                if opened in closes:
                    del open_nodes[k:]
                elif opened in SCOPES:
                    break
        attrs = m.group("attrs") or m.group("attrs2") or ""
        node = page.add(name, open_nodes[-1], _is_side_part(name, attrs, articles > 0))
        if name in BLOCKS:
            page.items.append((node, None))
        if name in VOID or attrs.endswith("/") and name in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else size
            continue
        open_nodes.append(node)
        articles += name in ("article", "main")
    return page


class Measures:
    """Of every node of a page: composite text density, density sum, characters outside links per tag, and whether blocks stand in it; cut parts count for nothing.

    A node's density is its characters per tag, times a logarithm that falls as link text takes a larger share of it.
    Its sum adds the densities of its children; of a node without blocks in it (a paragraph and all inline parts),
    which the text runs through, the sum is its own density.
    """

    def __init__(self, page: Page, cut: list[bool]):
        n = len(page.names)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = page.names[i] == "a" or in_link[page.parents[i]]
        for node, text in page.items:
            if text and not cut[node]:
                k = len("".join(text.split()))
                chars[node] += k
                if in_link[node]:
                    link_chars[node] += k
        self.blocks = [False] * n
        for i in range(n - 1, 0, -1):
            p = page.parents[i]
            if not cut[i]:
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (page.names[i] == "a")
                self.blocks[p] |= self.blocks[i] or (page.names[i] in BLOCKS and page.names[i] not in ("br", "hr") and chars[i] > 0)
        share = link_chars[0] / max(chars[0], 1)
        self.density, self.plain, sums = [0.0] * n, [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, t, lc, lt = chars[i], max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
            if c and not cut[i]:
                self.plain[i] = (c - link_chars[i]) / t
                base = math.log(c / max(c - link_chars[i], 1) * link_chars[i] + share * c + math.e)
                self.density[i] = c / t * max(math.log(c / lc * t / lt) / max(math.log(base), 1.0), 1e-6)
            if i:
                sums[page.parents[i]] += self.density[i]
        self.total = [sums[i] if self.blocks[i] else self.density[i] for i in range(n)]


def choose(page: Page) -> list[int]:
    """The nodes whose subtrees hold the main text, in page order; none if the page has none."""
    n = len(page.names)
    own = Measures(page, page.cut)
    density, total, plain, blocks = own.density, own.total, own.plain, own.blocks
    live = [i for i in range(n) if not page.cut[i] and density[i] > 0]
    if not live:
        return []
    # The parts of a paragraph are no subtrees of their own: a bold part of it would always be the denser one.
    whole = [i for i in live if not i or blocks[page.parents[i]]]
    best = max(whole, key=lambda i: (total[i], -i))
    path = []
    at = best
    while at >= 0:
        path.append(at)
        at = page.parents[at]
    body = max((k for k, i in enumerate(path) if page.names[i] == "body"), default=len(path) - 1)
    top, path = path[body], path[: body + 1]
    # The threshold is that of the page as it stands, cut parts and all: without them a body is hardly sparser than its text.
    # As composite density grows with the size of a part, one with as many characters outside links per tag passes too.
    around = Measures(page, [name in RAW for name in page.names])
    floor = min(min(density[i], around.density[i]) for i in path if density[i] > 0)
    plain_floor = min(min(plain[i], around.plain[i]) for i in path if density[i] > 0)
    dense = [density[i] >= floor or plain[i] >= plain_floor > 0 for i in range(n)]
    # The subtree of the largest sum at or below each node.
    peak = list(range(n))
    for i in reversed(whole):
        p = page.parents[i]
        if i and (total[peak[i]], -peak[i]) > (total[peak[p]], -peak[p]):
            peak[p] = peak[i]
    # From the body on, each node that is dense enough has that subtree marked; a paragraph is marked whole.
    reached, marked = [False] * n, [False] * n
    for i in live:
        p = page.parents[i]
        if i > top and marked[p]:
            marked[i] = True
        elif not marked[i] and (i == top or i > top and reached[p]) and dense[i]:
            reached[i] = True
            marked[peak[i]] = True
    return [i for i in live if marked[i] and not (i and marked[page.parents[i]])]


def main_text(source: str | None) -> str:
    """Main text of a page: character references decoded, blocks in page order, runs of white space as one space."""
    page = parse(source or "")
    inside = [False] * len(page.names)
    for i in choose(page):
        inside[i] = True
    for i in range(1, len(page.names)):
        inside[i] = (inside[i] or inside[page.parents[i]]) and not page.cut[i]
    parts = [" " if text is None else text for node, text in page.items if inside[node] or (text is None and page.parents[node] >= 0 and inside[page.parents[node]])]
    return " ".join(html.unescape("".join(parts)).split())


def _row(source: str | None) -> tuple[str, int]:
    text = main_text(source)
    return text, len(text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. A null or empty html, or a page without text, gives the empty text; rows are independent, so repeated pages stay; other columns are ignored."""
    return map_rows(pages, _row, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], ["page_id", "url"], ["html"])


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
