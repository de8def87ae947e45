"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text. A classifier gives every block a cost for
being called content and a cost for being called boilerplate; these are the
capacities from and to the two terminals of a flow network. Neighbouring blocks
and blocks with a common parent are joined by smoothness edges, weaker the
farther apart they are in the tree. The minimum cut, found by maximum flow,
separates content from boilerplate.

Defined results: null and empty pages give an empty text; text that no element
can hold (scripts, styles, comments, forms) never becomes a block; unclosed and
stray tags are tolerated; repeated rows stay rows; an empty table gives no
rows. Only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.text import rows

# Fixed values of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary"
    " table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNREAD_TAGS = frozenset("script style title head template noscript textarea select option button form iframe xmp noembed noframes svg math object canvas audio video dialog".split())
# A start tag of the second kind ends an open element of the first.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"]),
}
# Words of class, id and role attributes, as weights toward boilerplate.
OUTSIDE = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "header": 2.5, "menu": 6.0, "search": 6.0, "main": -1.5, "article": -2.0, "li": 0.4, "address": 1.0}
NAMED = re.compile(
    r"(?i)(?:^|[^a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|foot|header|masthead|banner|sidebar|side|aside|widget|related|recommend(?:ed|ations)?|promo(?:tion)?|"
    r"ads?|advert(?:s|isement|ising)?|adsense|sponsor(?:ed)?|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|"
    r"comments?|reply|replies|respond|disqus|pagination|pager|toolbar|topbar|legal|copyright|tags?|complementary|contentinfo|search|form)(?:$|[^a-z])"
)
BODY_NAMED = re.compile(r"(?i)(?:^|[^a-z])(?:article|content|post|entry|story|main|body|text)(?:$|[^a-z])")
LEGAL = re.compile(r"(?i)©|\(c\)|copyright|all rights reserved|cookie")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WHITE = re.compile(r"\s+")


class Element:
    """A block element: its number, the one around it, and how deep it lies."""

    __slots__ = ("number", "parent", "depth")

    def __init__(self, number: int, parent: Element | None):
        self.number, self.parent, self.depth = number, parent, parent.depth + 1 if parent else 1


class Block:
    """A run of text without a block boundary, in the innermost block element around it."""

    __slots__ = ("text", "inside", "weight", "linked", "heading")

    def __init__(self, text: str, inside: Element | None, weight: float, linked: int, heading: bool):
        self.text, self.inside, self.weight, self.linked, self.heading = text, inside, weight, linked, heading


class Tags:
    """The tags of a page in order, in time linear in its length whatever it holds."""

    def __init__(self, page: str):
        self.page, self.span, self.ends = page, (0, -1), {}

    def _special(self, at: int) -> int:
        """The next end of tag or quote; one that lies ahead is not searched for again."""
        if not self.span[0] <= at <= self.span[1]:
            m = SPECIAL.search(self.page, at)
            self.span = (at, m.start() if m else len(self.page))
        return self.span[1]

    def _end(self, at: int) -> int:
        """After the ``>`` that ends a tag, outside quotes; -1 if there is none. What one search learned serves the next."""
        passed, end = [], -1
        while (s := self._special(at)) < len(self.page):
            if s in self.ends:
                end = self.ends[s]
                break
            passed.append(s)
            if self.page[s] == ">":
                end = s + 1
                break
            close = self.page.find(self.page[s], s + 1)
            if close < 0:
                break
            at = close + 1
        self.ends.update(dict.fromkeys(passed, end))
        return end

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name and attributes of the next tag; comments and declarations have no name."""
        page, size = self.page, len(self.page)
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, size if end < 0 else end + 3, False, "", ""
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start + 2)
                return start, size if end < 0 else end + 1, False, "", ""
            m = NAME.match(page, start)
            end = self._end(m.end()) if m else -1
            if end >= 0:
                return start, end, bool(m.group(1)), m.group(2).lower(), page[m.end() : end - 1]
            at = start + 1
        return None


def blocks(page: str) -> list[Block]:
    """Blocks in page order, white space made single."""
    found: list[Block] = []
    # Name, innermost block element, weight toward boilerplate with all elements around, unread, whether a heading is open.
    stack: list[tuple[str, Element | None, float, bool, bool]] = []
    outside = ("", None, 0.0, False, False)
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    linked, number, at = 0, 0, 0
    tags = Tags(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = WHITE.sub(" ", "".join(parts)).strip()
            if text:
                _, inside, weight, _, heading = stack[-1] if stack else outside
                found.append(Block(text, inside, weight, linked, heading))
            parts.clear()
        linked = 0

    def words(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][3]):
            text = html.unescape(raw)
            parts.append(text)
            if open_names["a"]:
                linked += len(text.strip())

    def close(depth: int) -> None:
        if any(s[0] in BLOCK_TAGS for s in stack[depth:]):
            flush()
        open_names.subtract(s[0] for s in stack[depth:])
        del stack[depth:]

    while True:
        tag = tags.after(at)
        if not tag:
            words(page[at:])
            break
        start, end, closes, name, attributes = tag
        words(page[at:start])
        at = end
        if not name:
            continue
        if closes:
            if open_names[name] > 0:
                close(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth][0] == name))
            continue
        if name == "br":
            words(" ")
            continue
        for depth in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
            if name in CLOSED_BY.get(stack[depth][0], ()):
                close(depth)
                break
            if stack[depth][0] in ("table", "ul", "ol", "div", "article", "section", "body"):
                break
        if name in BLOCK_TAGS:
            flush()
        if name in VOID_TAGS:
            continue
        number += 1
        _, inside, around, unread, heading = stack[-1] if stack else outside
        weight, unread = OUTSIDE.get(name, 0.0), unread or name in UNREAD_TAGS
        if attributes and name not in ("html", "body"):
            for key, value in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    unread = True
                elif key in ("class", "id", "role") and value:
                    body = bool(BODY_NAMED.search(value))
                    weight += (3.0 if body else 6.0) if NAMED.search(value) else -1.0 if body else 0.0
        if name in RAW_TAGS:
            last = re.compile(rf"(?i)</{name}\b[^>]*>?").search(page, at)
            at = last.end() if last else len(page)
            continue
        heading = heading or len(name) == 2 and name[0] == "h" and name[1].isdigit()
        stack.append((name, Element(number, inside) if name in BLOCK_TAGS else inside, around + weight, unread, heading))
        open_names[name] += 1
    flush()
    return found


def costs(block: Block) -> float:
    """Log-odds of content: positive where calling the block boilerplate costs."""
    text = block.text
    size = len(text)
    words = text.count(" ") + 1
    stops = sum(text.count(c) for c in ".,;:!?")
    share = min(1.0, block.linked / size)
    odds = 0.9 * math.log1p(words) - 1.2 + 0.6 * min(3, stops) / 2 - 4.0 * share - block.weight
    if block.heading:
        odds += 1.5
    if words < 40 and LEGAL.search(text):
        odds -= 2.0
    return odds


def smoothness(a: Block, b: Block) -> float:
    """Weight of keeping two neighbouring blocks together: large for siblings, small for far branches."""
    x, y, apart = a.inside, b.inside, 0
    while x is not y:  # up from the deeper one until the paths meet
        if y is None or x is not None and x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        apart += 1
    return 1.6 / (1 + max(0, apart - 2)) if apart > 2 else 1.6


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (Dinic's blocking flows)."""
    n = len(odds)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(odds):
        if x > 0:
            add(source, i, x, 0.0)
        elif x < 0:
            add(i, sink, -x, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[a] < len(heads[a]):
                e = heads[a][tried[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(heads[a]):
                path.append(heads[a][tried[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
                tried[a] += 1
            else:
                break


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    edges = [(i, i + 1, smoothness(found[i], found[i + 1])) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(found):  # the nearest earlier block below the same parent, if another one lies between
        parent = block.inside.parent.number if block.inside and block.inside.parent else -1
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, 0.8))
        last[parent] = i
    content = min_cut([costs(b) for b in found], edges)
    return "\n".join(b.text for b, kept in zip(found, content) if kept)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(page) for (page,) in rows([part], ("html",))]
                yield pa.record_batch({
                    "page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64()),
                })

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
