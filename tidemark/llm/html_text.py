"""HTML extraction by composite text density.

A tolerant parser, linear in the page, builds the element tree (void elements, implied
ends of p, li and table parts, unclosed inline elements).  What isn't the article by
its element (nav, footer, aside, form, script, ...), role or a plain name in class or id
(ad, comments, sidebar, ...) goes first; names that an article may use for its own parts
(related, notice, banner, ...) count only outside ``article`` elements.  Every element
left gets its composite text density

    C / T * log_b(C * T / (LC * LT)),   b = ln(C * LC / NC + LCb * C / Cb + e)

(C characters, T elements, LC and LT those in links, NC those outside; b: of the body),
link-adjusted characters per element.  The threshold is the least density on the path from
the densest element up to the body, and of the elements that reach it the one with the
largest sum of its children's densities is the article.  If it stands in an ``article``
element, the outermost one takes its place; if not, its parent does while the parent
is at least as dense as the body and what the parent adds isn't mostly links (headings
belong, lists of other pages don't).  The text of that element comes out block by block.

Defined results: null and empty html give an empty text; a line break element counts as
white space; a tag that never ends is dropped with what follows; a quote that never ends
ends with its tag; text before any body element belongs to the body; very long and very
deep pages take time and memory in proportion; extra columns are ignored; repeated rows
repeat; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
#: After so many tags with a quote that never ends, tags of the page end at their first >.
OPEN_QUOTES = 8

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noscript noframes xmp template".split())
OF_HEAD = frozenset("base link meta".split()) | RAW
NOT_ARTICLE = frozenset("head nav footer aside form button select option dialog menu object canvas audio video map".split()) | RAW
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
P_SCOPE = "td th li div article section table button".split()
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Whole names in class or id, with _ as -, of what is no part of an article; and first parts of such names.
PLAIN_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo sidebar side-bar nav navbar nav-bar navigation menu breadcrumb breadcrumbs footer site-footer site-header page-header masthead comments comment comment-list "
    "disqus replies respond share sharing social social-share newsletter subscribe skip-link toolbar cookies cookie-notice cookie-banner cookie-consent gdpr".split()
)
PLAIN_FIRST = frozenset("ad ads advert advertisement sponsor sponsored cookie cookies gdpr comments disqus".split())
# Parts of names that count only outside article elements.
WEAK_PARTS = frozenset("ad ads advert promo banner cookie cookies consent notice notices alert alerts popup modal overlay sidebar widget widgets menu nav navbar footer header comments comment related recommended login signup copyright pagination paging pager share social newsletter subscribe".split())


class Tree:
    """Elements in page order; element 0 is the page.

    ``events``: k for the start of element k, ~k for its end, and text.
    """

    def __init__(self) -> None:
        self.tags, self.parents, self.out, self.starts, self.ends = ["html"], [-1], [False], [0], [0]
        self.events: list[int | str] = [0]


def _named_out(attributes: str, in_article: bool) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower().replace("_", "-")
        if m[1].lower() == "role":
            if value.strip() in ROLES:
                return True
            continue
        for name in value.split():
            parts = name.split("-")
            if name in PLAIN_NAMES or parts[0] in PLAIN_FIRST or not in_article and not WEAK_PARTS.isdisjoint(parts):
                return True
    return False


def parse(page: str) -> Tree:
    """The element tree; elements that aren't part of an article are marked ``out``."""
    tree = Tree()
    tags, parents, out, starts, ends, events = tree.tags, tree.parents, tree.out, tree.starts, tree.ends, tree.events
    stack = [0]
    open_at: dict[str, list[int]] = {"html": [0]}  # places in the stack, by tag
    blocks_at = [0]
    at, end, open_quotes = 0, len(page), 0

    def text(value: str) -> None:
        if value and not out[stack[-1]]:
            events.append(html.unescape(value) if "&" in value else value)

    def start(tag: str, is_out: bool) -> int:
        node = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        out.append(is_out)
        starts.append(len(events))
        ends.append(len(events))
        events.append(node)
        return node

    def close_from(place: int) -> None:
        while len(stack) > place:
            node = stack.pop()
            open_at[tags[node]].pop()
            if tags[node] in BLOCK:
                blocks_at.pop()
            ends[node] = len(events)
            events.append(~node)

    def last(tag: str) -> int:
        places = open_at.get(tag)
        return places[-1] if places else -1

    while at < end:
        opens = page.find("<", at)
        if opens < 0:
            text(page[at:])
            break
        following = page[opens + 1 : opens + 2]
        if following in ("!", "?"):
            text(page[at:opens])
            comment = page.startswith("!--", opens + 1)
            closes = page.find("-->" if comment else ">", opens + (4 if comment else 2))
            at = end if closes < 0 else closes + (3 if comment else 1)
            continue
        m = NAME.match(page, opens + 1)
        if m is None:
            text(page[at : opens + 1])
            at = opens + 1
            continue
        text(page[at:opens])
        first = page.find(">", m.end())
        if first < 0:
            break
        whole = ATTRIBUTES.match(page, m.end()) if open_quotes < OPEN_QUOTES else None
        if whole is None:
            open_quotes += 1
        at = whole.end() if whole else first + 1
        tag, attributes = m[2].lower(), page[m.end() : at - 1]
        if m[1]:
            place = last(tag)
            if place > 0 and (tag in BLOCK or blocks_at[-1] < place):
                close_from(place)
            continue
        if open_at.get("head") and tag not in OF_HEAD:
            close_from(last("head"))
        if tag in BLOCK and last("p") > max(map(last, P_SCOPE)):
            close_from(last("p"))
        if tag in CLOSES:
            shut, bounds = CLOSES[tag]
            bound = max(map(last, bounds))
            inner = [places[k] for places in (open_at.get(t, []) for t in shut) for k in [bisect_right(places, bound)] if k < len(places)]
            if inner:
                close_from(min(inner))
        if tag == "html":
            continue
        if tag in RAW:
            closes = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            closes = page.find(">", closes.end()) if closes else -1
            at = end if closes < 0 else closes + 1
            continue
        in_article = bool(open_at.get("article"))
        is_out = out[stack[-1]] or tag in NOT_ARTICLE or tag == "header" and not in_article and not open_at.get("main")
        if not is_out and "=" in attributes and tag not in ("body", "article", "main"):
            is_out = _named_out(attributes, in_article)
        node = start(tag, is_out)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            ends[node] = len(events)
            events.append(~node)
            continue
        stack.append(node)
        open_at.setdefault(tag, []).append(len(stack) - 1)
        if tag in BLOCK:
            blocks_at.append(len(stack) - 1)
    close_from(1)
    ends[0] = len(events)
    events.append(~0)
    return tree


class Measures:
    """For each element: characters and elements below it, those in links, and density."""

    def __init__(self, tree: Tree):
        n = len(tree.tags)
        self.chars, self.tags, self.link_chars, self.link_tags = ([0] * n for _ in range(4))
        stack: list[int] = []
        for e in tree.events:
            if isinstance(e, str):
                self.chars[stack[-1]] += len("".join(e.split()))
            elif e >= 0:
                stack.append(e)
            else:
                stack.pop()
        for k in range(n - 1, -1, -1):
            if tree.out[k]:
                continue
            if tree.tags[k] == "a":
                self.link_chars[k], self.link_tags[k] = self.chars[k], self.tags[k] + 1
            up = tree.parents[k]
            if up >= 0:
                self.chars[up] += self.chars[k]
                self.tags[up] += self.tags[k] + 1
                self.link_chars[up] += self.link_chars[k]
                self.link_tags[up] += self.link_tags[k]
        self.body = next((k for k in range(n) if tree.tags[k] == "body" and not tree.out[k]), 0)
        self.density = [0.0 if tree.out[k] else self._density(k) for k in range(n)]

    def _density(self, k: int) -> float:
        c, t = self.chars[k], max(1, self.tags[k])
        if not c:
            return 0.0
        lc, lt = max(1, self.link_chars[k]), max(1, self.link_tags[k])
        base = math.log(c * self.link_chars[k] / max(1, c - self.link_chars[k]) + self.link_chars[self.body] * c / max(1, self.chars[self.body]) + math.e)
        return c / t * max(0.0, math.log(max(1.0, c * t / (lc * lt))) / math.log(max(base, 1.0001)))


def article(tree: Tree) -> int:
    """The element with the largest density sum among those that reach the threshold of the path."""
    m = Measures(tree)
    inside = [k for k in range(1, len(tree.tags)) if not tree.out[k]]
    if not any(m.density[k] for k in inside):
        return m.body if m.chars[m.body] else 0
    walk = max(inside, key=lambda k: (m.density[k], -k))
    threshold = m.density[walk]
    while walk > 0 and walk != m.body:
        walk = tree.parents[walk]
        threshold = min(threshold, m.density[walk])
    sums = [0.0] * len(tree.tags)
    for k in inside:
        sums[tree.parents[k]] += m.density[k]
    best = max((k for k in inside if m.density[k] >= threshold), key=lambda k: (sums[k], m.density[k], -k))
    up, around = best, -1
    while up >= 0:
        if tree.tags[up] == "article":
            around = up
        up = tree.parents[up]
    if around >= 0:
        return around
    while best != m.body and tree.parents[best] >= 0:
        up = tree.parents[best]
        if m.density[up] < m.density[m.body] or 2 * (m.link_chars[up] - m.link_chars[best]) > m.chars[up] - m.chars[best]:
            break
        best = up
    return best


def blocks_of(tree: Tree, node: int) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    found: list[str] = []
    line: list[str] = []

    def flush() -> None:
        value = " ".join("".join(line).split())
        line.clear()
        if value:
            found.append(value)

    at, end = tree.starts[node], tree.ends[node]
    while at <= end:
        e = tree.events[at]
        at += 1
        if isinstance(e, str):
            line.append(e)
            continue
        k = e if e >= 0 else ~e
        if tree.tags[k] in BLOCK:
            flush()
        if e >= 0 and tree.out[k]:
            at = tree.ends[k] + 1
        elif e >= 0 and tree.tags[k] == "br":
            line.append(" ")
    flush()
    return found


def main_text(page: str | None) -> str:
    """The article's text: one line for each block."""
    if not page:
        return ""
    tree = parse(page)
    return "\n".join(blocks_of(tree, article(tree)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    narrow = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(trimmed(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
