"""Operator 11, main text of web pages by a minimum cut between content and boilerplate.

A page becomes blocks of text. A linear classifier over a block's place (the elements around
it, their classes and roles) and its words gives its cost of either label; these costs are
its capacities to source and sink. Smoothness edges join neighbouring blocks and, through
nodes for elements, blocks near each other in the DOM. The minimum cut labels all at once:
a short line between paragraphs goes with them, a line of links in a menu with the menu.
Before the flow is sent, nodes whose own cost outweighs all their edges take their side,
which no minimum cut contradicts; only what is then left open goes into the max-flow.

Place outweighs words: inside an article (or ``main``) words alone never take a block away,
and beside one they never make it content. Pages without either are left to words.

Edge cases: a null, empty or tagless-blank html gives an empty text. Unclosed elements, stray
end tags, unclosed comments and scripts are taken as browsers take them, roughly. Pages are
read whole, one at a time; very long ones take time and memory in proportion. Repeated rows
and ids are rows of their own; costs that tie leave a block out. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements of HTML, and words in classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp".split())
SCOPES = frozenset("html body table td th caption object template button".split())
#: What an element's start ends, up to where.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
BOILERPLATE = frozenset("nav footer aside form button select option datalist dialog menu noscript template iframe noframes object svg canvas audio video fieldset label search".split())
MAIN = frozenset("article main".split())
MAIN_ROLES = frozenset("main article".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist tooltip".split())
MAIN_WORDS = frozenset("article articlebody post entry story content body prose".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot advertorial banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager masthead topbar toolbar skip footer foot colophon sidebar sidebars aside rail widget widgets "
    "related recommended recommendations popular trending comment comments commentlist disqus respond reply replies discussion share sharing social follow "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login signin register search form "
    "copyright legal disclaimer paywall hidden".split()
)
HEADER_WORDS = frozenset("header head".split())
#: Of an article's own classes (which often name its topics) only these count.
OWN_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended teaser".split())
# Costs in hundredths: log-odds of the classifier and weights of the edges.
IN_MAIN, BESIDE_MAIN, IN_BOILERPLATE, CONTENT_CLASS = 600, -600, -1200, 150
BIAS, A_WORD, MOST_WORDS, SENTENCE, HEADING, LINKED, RIGHTS = 20, 6, 30, 60, 60, -350, -150
NEXT_TO, IN_ELEMENT, IN_PARENT = 100, 50, 25
MOST_BY_WORDS = 350

_TOKEN = re.compile(r"""<!--(?:>|->|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD_OF_CLASS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """An open element: whether it or one around it is an article, boilerplate or content by class, and its node."""

    __slots__ = ("tag", "parent", "main", "boilerplate", "content", "linked", "apart", "node")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent, self.node, self.apart = tag, parent, -1, tag not in INLINE
        self.main, self.boilerplate, self.content, self.linked = (parent.main, parent.boilerplate, parent.content, parent.linked) if parent else (False, False, False, False)

    def look(self, attributes: str) -> None:
        """Take in the tag, class, id, role and visibility."""
        tag = self.tag
        found = {}
        for name, *value in _ATTRIBUTE.findall(attributes) if attributes else ():
            found.setdefault(name.lower(), entities.unescape("".join(value)))
        words = set(_WORD_OF_CLASS.findall(f"{found.get('class', '')} {found.get('id', '')}"))
        words = {w.lower() for w in words}
        role = found.get("role", "").strip().lower()
        main = tag in MAIN or role in MAIN_ROLES or "articlebody" in found.get("itemprop", "").lower()
        bad = tag in BOILERPLATE or role in BOILERPLATE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_NOT_SHOWN.search(found.get("style", "")))
        if tag in ("html", "body"):
            bad = False
        elif main:
            bad = bad or bool(words & OWN_WORDS)
        else:
            bad = bad or bool(words & BOILERPLATE_WORDS)
            if not self.main and (tag == "header" or words & HEADER_WORDS):
                bad = True  # a page's header; an article's own has its title
            self.content = self.content or bool(words & MAIN_WORDS)
        self.main, self.linked = self.main or main, self.linked or tag == "a"
        if bad and not self.boilerplate:
            self.boilerplate, self.apart = True, True


class Block:
    __slots__ = ("pieces", "element", "linked")

    def __init__(self, element: Element):
        self.pieces, self.element, self.linked = [], element, 0


def blocks_of(page: str) -> list[tuple[str, Element, int, str]]:
    """(text, element, characters in links, block tag) of every block that has text, in page order."""
    out: list[tuple[str, Element, int, str]] = []
    root = Element("html", None)
    stack, block = [root], None
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal block
        if block is not None:
            text = " ".join(entities.unescape("".join(block.pieces)).split())
            if text:
                out.append((text, block.element, block.linked, block.element.tag))
            block = None

    def add(text: str) -> None:
        nonlocal block
        top = stack[-1]
        if block is None:
            if text.isspace():
                return
            own = top
            while not own.apart:
                own = own.parent
            block = Block(own)
        block.pieces.append(text)
        if top.linked:
            block.linked += len(text)

    def pop_to(k: int) -> None:
        if any(e.apart for e in stack[k:]):
            flush()
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def close(tags: tuple[str, ...], until) -> None:
        """End the open elements of ``tags`` above the nearest of ``until``."""
        if not any(opened[t] for t in tags):
            return
        lowest = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                lowest = k
            elif stack[k].tag in until:
                break
        if lowest is not None:
            pop_to(lowest)

    at = 0
    while at < len(page):
        start = page.find("<", at)
        m = _TOKEN.match(page, start) if start >= 0 else None
        if m is None:
            tag_to_the_end = start >= 0 and page[start + 1 : start + 2].isascii() and page[start + 1 : start + 2].isalpha()
            stop = start if tag_to_the_end else start + 1 if start >= 0 else len(page)
            if stop > at:
                add(page[at:stop])
            at = len(page) if tag_to_the_end else stop
            continue
        if start > at:
            add(page[at:start])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE or stack[k].tag in SCOPES and tag not in SCOPES and tag not in MAIN:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                if tag == "hr":
                    flush()
                elif block is not None:
                    block.pieces.append("\n")
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if tag not in ("script", "style"):
                flush()
            at = end.end() if end else len(page)
            continue
        if tag in ("html", "body"):
            continue
        if tag not in INLINE:
            close(("p",), SCOPES)
            if tag in ENDS:
                close(*ENDS[tag])
        element = Element(tag, stack[-1])
        element.look(m.group(3))
        if element.apart:
            flush()
        if not m.group(3).endswith("/") or tag not in ("svg", "path"):
            stack.append(element)
            opened[tag] += 1
    flush()
    return out


def cost_of(text: str, element: Element, linked: int, has_main: bool) -> int:
    """Log-odds in hundredths that a block is content."""
    words = text.count(" ") + 1
    own = BIAS + A_WORD * min(words, MOST_WORDS)
    if text[-1] in ".!?\"'”’»)。！？" and words > 3:
        own += SENTENCE
    if element.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        own += HEADING
    if element.tag == "li" and words < 8:
        own -= HEADING
    own += LINKED * min(linked, len(text)) // len(text)
    if "©" in text or "all rights reserved" in text.lower():
        own += RIGHTS
    own = max(-MOST_BY_WORDS, min(MOST_BY_WORDS, own))
    if element.boilerplate:
        return own + IN_BOILERPLATE
    if element.main:
        return own + IN_MAIN
    return own + (BESIDE_MAIN if has_main else CONTENT_CLASS if element.content else 0)


def minimum_cut(own: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut, the smallest such side.

    ``own`` is the capacity from the source (above 0) or to the sink; ``edges`` hold both ways.
    """
    n = len(own)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    own, left = list(own), [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:  # what outweighs its edges is decided, and weighs on its neighbours
        a = todo.popleft()
        if side[a] is not None or not (own[a] > left[a] or own[a] <= -left[a]):
            continue
        side[a] = own[a] > left[a]
        for b, w in near[a].items():
            if side[b] is None:
                own[b] += w if side[a] else -w
                left[b] -= w
                todo.append(b)
    rest = [a for a in range(n) if side[a] is None]
    if rest:
        number = {a: i for i, a in enumerate(rest)}
        source, sink = len(rest), len(rest) + 1
        room: list[dict[int, int]] = [{} for _ in range(len(rest) + 2)]
        for a, i in number.items():
            for b, w in near[a].items():
                if b in number:
                    room[i][number[b]] = w
            if own[a] > 0:
                room[source][i], room[i][source] = own[a], 0
            elif own[a] < 0:
                room[i][sink], room[sink][i] = -own[a], 0
        reached = max_flow(room, source, sink)
        for a, i in number.items():
            side[a] = reached[i] >= 0
    return [bool(s) for s in side]


def max_flow(room: list[dict[int, int]], source: int, sink: int) -> list[int]:
    """Send a maximum flow by levels; the last levels are below 0 where the source no longer reaches."""
    while True:
        level = [-1] * len(room)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for b, w in room[a].items():
                if w and level[b] < 0:
                    level[b] = level[a] + 1
                    todo.append(b)
        if level[sink] < 0:
            return level
        ways = [iter(list(r)) for r in room]
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                least = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= least
                    room[y][x] = room[y].get(x, 0) + least
                path = path[: next(k for k, (x, y) in enumerate(zip(path, path[1:])) if not room[x][y]) + 1]
                continue
            for b in ways[a]:
                if room[a][b] and level[b] == level[a] + 1:
                    path.append(b)
                    break
            else:
                level[a] = -1
                path.pop()


def labelled(page: str | None) -> list[tuple[str, int, bool]]:
    """(text, cost, content) of the blocks of a page in their order."""
    found = blocks_of(page or "")
    has_main = any(e.main and not e.boilerplate for _, e, _, _ in found)
    own = [cost_of(text, e, linked, has_main) for text, e, linked, _ in found]
    costs = list(own)
    edges: list[tuple[int, int, int]] = []
    for k, (_, e, _, _) in enumerate(found):
        if k:
            before = found[k - 1][1]
            near = before is e or before.parent is e.parent
            edges.append((k - 1, k, NEXT_TO if near else NEXT_TO // 4))
        child, weight = k, IN_ELEMENT
        while e is not None:
            known = e.node >= 0
            if not known:
                e.node = len(costs)
                costs.append(0)
            edges.append((child, e.node, weight))
            if known:
                break
            child, weight, e = e.node, IN_PARENT, e.parent
    side = minimum_cut(costs, edges)
    return [(text, cost, side[k]) for k, ((text, *_), cost) in enumerate(zip(found, own, strict=True))]


def main_text(page: str | None) -> str:
    return " ".join(text for text, _, content in labelled(page) if content)


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, n, text, cost, content of every block of every page."""
    schema = "page_id long, n long, text string, cost long, content boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, page in zip(batch.column(0), batch.column(1), strict=True):
                rows = labelled(page.as_py())
                if rows:
                    cols = [[page_id.as_py()] * len(rows), range(len(rows)), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["page_id", "n", "text", "cost", "content"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, schema)


def extract(pages: DataFrame, size: int = 16 << 20) -> DataFrame:
    """page_id, url and the main text of every page; a batch of results has about ``size`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, held = [], 0, 0
            for k, page in enumerate(batch.column(2)):
                texts.append(main_text(page.as_py()))
                held += len(texts[-1])
                if held >= size or k + 1 == batch.num_rows:
                    own = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
                    texts, first, held = [], k + 1, 0

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


#: These pages have one article each, with headings, paragraphs, bold and breaks.
ORACLE = """
with a as (select page_id, url, regexp_extract(html, '<article>(.*?)(</article>|<footer>|$)', 1, 's') as body from pages),
t as (select page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as text from a),
u as (select page_id, url, replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&') as text from t)
select page_id, url, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') as text, length(coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) as n_chars from u"""

QUERIES = {"op11_html_extraction": query}
ORACLE_SQL = {"op11_html_extraction": ORACLE}
