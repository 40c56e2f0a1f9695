"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page becomes a list of text blocks with the elements they stand in. A classifier weighs what speaks for a block being content against
what speaks for boilerplate: its length, its end, its links, its element, the telling elements and class names around it and the heading it
follows. The two sums are the capacities to the two terminals. Blocks next to each other, and blocks of the same
parent, are tied by smoothness edges. A maximum flow finds the cheapest labelling: the blocks that stay connected to the
source are the content. So a short line inside the text is kept, and a sentence inside a menu is dropped.

A class name is evidence and no verdict: an element that is marked as boilerplate but holds the page's largest article is a wrapper, and its mark is void.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg math select object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new one of the same group ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog button fieldset head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense banner sponsor sponsored promo promotion promoted sidebar aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer foot masthead topbar header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login search social share sharing follow related recommended recommendations comment comments reply replies disqus discussion widget toolbar pagination pager "
    "copyright legal skip".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_WORDS = frozenset("article articlebody story entry post main maintext bodytext content".split())
#: Words of a class name that say nothing about its kind; those that, first or last, say that a page has or shows something elsewhere.
NEUTRAL = frozenset("box block area list item items container wrapper wrap section inner outer bar top bottom left right link links text body form panel group slot unit site page global primary secondary large small row col".split())
HAVING = frozenset("has have no not with without is hide show enable enabled disable disabled supports js".split())
STATES = frozenset("open opened closed off on enabled disabled visible active count".split())
RIGHTS = re.compile(r"©|\(c\)\s|copyright\b", re.I)
PHRASES = re.compile(r"all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|sign up|log in|advertisement|read more|click here", re.I)
#: What a heading says when readers' comments or other pages' teasers follow.
LEAVES = re.compile(
    r"\W*(?:\d+\s+)?(?:(?:reader|user|readers'|your)\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?|(?:leave|post|add|write) an? (?:comment|reply)"
    r"|join the (?:discussion|conversation)|(?:related|recommended|more) (?:articles?|posts?|stories|links|news|reading)|you (?:may|might) also like)(?:\s*\(\d+\))?\W*",
    re.I,
)

#: Weights of the classifier and of the edges.
HIDDEN, MARKED, PARTLY_MARKED, PAGE_HEADER, INNER_HEADER, LEFT = 60, 30, 10, 25, 6, 45
INSIDE_CONTENT, INSIDE_CONTENT_CLASS, PARAGRAPH, HEADING, ENDED, MOST_FOR_WORDS = 18, 8, 5, 5, 3, 12
LINKED, LISTED, SHORT, PHRASE, COPYRIGHT = 12, 3, 4, 10, 20
NEXT_TO, SAME_PARENT, SAME_GRANDPARENT = 2, 4, 2
#: Elements nested deeper count as siblings, as in browsers.
DEEPEST = 512

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag. A quotation mark counts only after an equals sign.
TAG_END = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """hidden, marked (by its own tag, role, class), voidable (the mark), core (may hold the text), header; words and last (element) of all below it,
    most: words of the largest core below it; bad: weight against the blocks inside; good: weight for them."""

    __slots__ = ("tag", "parent", "link", "inline", "order", "own", "voidable", "core", "header", "words", "most", "last", "bad", "good", "clean")

    def __init__(self, tag: str, parent: Element | None, link: bool, order: int):
        self.tag, self.parent, self.link, self.inline, self.order = tag, parent, link, tag in INLINE, order
        self.own = self.core = self.words = self.most = self.bad = self.good = 0
        self.voidable = self.header = False
        self.clean = True
        self.last = order


class Block:
    __slots__ = ("text", "owner", "linked", "words", "left")

    def __init__(self, text: str, owner: Element, linked: int):
        self.text, self.owner, self.linked, self.words, self.left = text, owner, linked, text.count(" ") + 1, 0


def _class_mark(name: str) -> tuple[int, bool, bool]:
    """Weight against content, whether it names a header, whether it names content. A name's last telling word says what it is."""
    words = [x.lower() for x in NAME.findall(name)]
    if not words or words[0] in HAVING or words[-1] in STATES:
        return 0, False, False
    telling = [x for x in words if x not in NEUTRAL] or words
    if telling[-1] in BOILERPLATE_WORDS:
        return MARKED, telling[-1] == "header", False
    if not BOILERPLATE_WORDS.isdisjoint(telling):
        return PARTLY_MARKED, False, False
    return 0, False, telling[-1] in CONTENT_WORDS


def _read_marks(e: Element, attrs: str) -> None:
    """What an element's own tag and attributes say."""
    tag = e.tag
    if tag in BOILERPLATE_TAGS:
        e.own = MARKED
    elif tag == "form":
        e.own, e.voidable = MARKED, True
    elif tag == "header":
        e.header = True
    elif tag in CONTENT_TAGS:
        e.core = INSIDE_CONTENT
    if not attrs or tag in ("body", "html"):
        return
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            e.own, e.voidable = HIDDEN, False
        elif name == "role":
            if value in ("main", "article"):
                e.core = INSIDE_CONTENT
            elif value in BOILERPLATE_ROLES and e.own < MARKED:
                e.own = MARKED
        elif name in ("class", "id"):
            for one in value.split():
                weight, header, content = _class_mark(one)
                if header and weight:
                    e.header = True
                elif weight > e.own:
                    e.own, e.voidable = weight, True
                if content and not e.core:
                    e.core = INSIDE_CONTENT_CLASS
    if e.own >= MARKED:
        e.core = 0


def parsed(html: str) -> tuple[list[Block], list[Element]]:
    """Blocks: text between borders of block elements, references decoded, white space as one space, without empty ones. Elements: those
    that may hold any, in the order of their start tags. One pass; nothing is read twice. A tag, a comment or a raw element that never ends takes the rest of the page."""
    root = Element("", None, False, 0)
    elements, blocks = [root], []
    stack = [root]
    #: Open elements by tag, and the open inline ones of each open block element.
    count: dict[str, int] = {}
    frames: list[dict[str, int]] = [{}]
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                k = len(stack) - 1
                while k and stack[k].inline:
                    k -= 1
                blocks.append(Block(text, stack[k], linked))
            parts.clear()
        linked = 0

    def pop(size: int):
        while len(stack) > size:
            e = stack.pop()
            count[e.tag] -= 1
            if e.inline:
                frames[-1][e.tag] -= 1
            else:
                frames.pop()

    def say(text: str):
        nonlocal linked
        text = unescape(text)
        parts.append(text)
        if stack[-1].link:
            linked += len(text)

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start != at:
            say(html[at : start if start >= 0 else size])
            if start < 0:
                break
        m = TAG.match(html, start)
        if not m:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                at = end + 3 if end >= 0 else size
            elif html.startswith(("<!", "<?", "</"), start):
                end = html.find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                say("<")
                at = start + 1
            continue
        rest = TAG_END.match(html, m.end())
        if not rest:
            break
        at = rest.end()
        tag = m[2].lower()
        if m[1]:
            if not count.get(tag):
                if tag not in INLINE:
                    flush()
            elif tag not in INLINE:
                flush()
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            elif frames[-1].get(tag):
                # An inline end tag ends no block element around it.
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            close = end and html.find(">", end.end())
            at = close + 1 if close and close > 0 else size
            continue
        if tag in ("br", "hr"):
            parts.append(" ")
        if tag in VOID:
            continue
        if tag not in INLINE:
            flush()
            k = len(stack)
            while stack[k - 1].inline:
                k -= 1
            if stack[k - 1].tag == "p":
                k -= 1
            ends = CLOSES.get(tag)
            if ends and any(count.get(x) for x in ends):
                scope, j = SCOPES.get(tag, ()), k - 1
                while j and stack[j].tag not in ends and stack[j].tag not in scope:
                    j -= 1
                if stack[j].tag in ends:
                    k = j
            pop(k)
        if len(stack) > DEEPEST:
            if not stack[-1].inline or tag not in INLINE:
                flush()
            pop(DEEPEST)
        e = Element(tag, stack[-1], stack[-1].link or tag == "a", len(elements))
        _read_marks(e, rest[1])
        elements.append(e)
        stack.append(e)
        count[tag] = count.get(tag, 0) + 1
        if e.inline:
            frames[-1][tag] = frames[-1].get(tag, 0) + 1
        else:
            frames.append({})
    flush()
    return blocks, elements


def _weigh(blocks: list[Block], elements: list[Element]) -> None:
    """Gives elements their weights and marks the blocks that a heading like `Comments` leaves behind it."""
    for b in blocks:
        b.owner.words += b.words
    for e in reversed(elements[1:]):
        p = e.parent
        p.words += e.words
        p.most = max(p.most, e.most, e.words if e.core else 0)
        p.last = max(p.last, e.last)
    largest = elements[0].most
    for e in elements[1:]:
        p = e.parent
        e.bad, e.good, e.clean = p.bad, p.good, p.clean
        own = e.own
        if e.voidable and e.most and e.most == largest and 2 * e.most >= e.words:
            own = 0
        if e.header:
            own = max(own, INNER_HEADER if p.good and p.clean else PAGE_HEADER)
        if own:
            e.bad = min(HIDDEN, max(p.bad, own) + (own if own < MARKED and p.bad else 0))
            if own >= PAGE_HEADER:
                e.good = 0
                e.clean = e.clean and e.voidable
        if e.core and e.clean and (e.bad < PAGE_HEADER or e.words == largest):
            e.good = max(e.good, e.core)
    scope, level = None, 0
    for b in blocks:
        e = b.owner
        rank = int(e.tag[1]) if e.tag in HEADINGS else 7
        if scope is not None and (e.order > scope.last or e.order < scope.order or rank <= min(level, 6)):
            scope = None
        if b.words <= 6 and not b.linked and LEAVES.fullmatch(b.text):
            scope, level = e.parent or e, rank
            while scope.parent and scope.words == b.words:
                scope = scope.parent
            b.left = LEFT
        elif scope is not None:
            b.left = LEFT


def costs(block: Block) -> tuple[int, int]:
    """What calling the block content costs, what calling it boilerplate costs."""
    owner, tag = block.owner, block.owner.tag
    content, boilerplate = owner.bad + block.left, owner.good
    ended = block.text[-1] in ".!?…。！？:"
    boilerplate += min(MOST_FOR_WORDS, block.words // 2) + ENDED * ended
    if tag == "p":
        boilerplate += PARAGRAPH
    elif tag in HEADINGS:
        boilerplate += HEADING
    elif tag == "li":
        content += LISTED
    if 2 * block.linked > len(block.text):
        content += LINKED
    if block.words < 5 and not ended and tag not in HEADINGS:
        content += SHORT
    if block.words < 40:
        content += COPYRIGHT if RIGHTS.match(block.text) else PHRASE if PHRASES.search(block.text) else 0
    return content, boilerplate


def edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Ties between neighbours and between each block and the last one before it with the same parent."""
    out = []
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        parent = b.owner if b.owner.tag == "" else b.owner.parent
        if k:
            before = blocks[k - 1].owner
            weight = NEXT_TO
            if before is b.owner or before.parent is b.owner.parent:
                weight += SAME_PARENT
            elif before.parent and b.owner.parent and before.parent.parent is b.owner.parent.parent:
                weight += SAME_GRANDPARENT
            out.append((k - 1, k, weight))
        near = last.get(id(parent))
        if near is not None and near != k - 1:
            out.append((near, k, SAME_PARENT))
        last[id(parent)] = k
    return out


def minimum_cut(terminals: list[tuple[int, int]], ties: list[tuple[int, int, int]]) -> list[bool]:
    """terminals: of each node the capacity to the sink and from the source. True: on the source's side of a minimum cut
    (of several, the one with the fewest nodes there). Dinic's algorithm."""
    n = len(terminals)
    # What source and sink share through a node flows at once.
    excess = [source - sink for sink, source in terminals]
    if all(x <= 0 for x in excess):
        return [False] * n
    if all(x >= 0 for x in excess):
        return _reached(excess, ties)
    heads: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    left: list[int] = []
    for a, b, weight in ties:
        heads[a].append(len(to))
        to.append(b)
        left.append(weight)
        heads[b].append(len(to))
        to.append(a)
        left.append(weight)
    while True:
        level = [-1] * n
        queue = deque(k for k in range(n) if excess[k] > 0)
        for k in queue:
            level[k] = 0
        met = False
        while queue:
            k = queue.popleft()
            for e in heads[k]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[k] + 1
                    met = met or excess[to[e]] < 0
                    queue.append(to[e])
        if not met:
            return [x >= 0 for x in level]
        arc = [0] * n
        for start in range(n):
            while excess[start] > 0 and level[start] == 0:
                path: list[int] = []
                k = start
                while excess[k] >= 0 or k == start:
                    while arc[k] < len(heads[k]):
                        e = heads[k][arc[k]]
                        if left[e] and level[to[e]] == level[k] + 1:
                            break
                        arc[k] += 1
                    if arc[k] < len(heads[k]):
                        path.append(heads[k][arc[k]])
                        k = to[path[-1]]
                    elif path:
                        k = to[path.pop() ^ 1]
                        arc[k] += 1
                    else:
                        break
                if not path:
                    break
                flow = min(excess[start], -excess[k], *(left[e] for e in path))
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                excess[start] -= flow
                excess[k] += flow


def _reached(excess: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Nothing flows: all that a source-side node is tied to is on its side."""
    near: list[list[int]] = [[] for _ in excess]
    for a, b, weight in ties:
        if weight:
            near[a].append(b)
            near[b].append(a)
    todo = [k for k, x in enumerate(excess) if x > 0]
    seen = set(todo)
    while todo:
        for k in near[todo.pop()]:
            if k not in seen:
                seen.add(k)
                todo.append(k)
    return [k in seen for k in range(len(excess))]


def labelled(html: str | None) -> list[tuple[Block, bool]]:
    """The blocks of a page in page order, each with whether it is content."""
    blocks, elements = parsed(html or "")
    if not blocks:
        return []
    _weigh(blocks, elements)
    return list(zip(blocks, minimum_cut([costs(b) for b in blocks], edges(blocks)), strict=True))


def main_text(html: str | None) -> str:
    """The content blocks in page order, joined by a space. Null and empty pages, and pages without content, give an empty text."""
    return " ".join(b.text for b, is_content in labelled(html) if is_content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: id, url, text, n_chars. Each page is labelled whole and alone, so nothing is shuffled. Repeated rows are
    repeated, null ids and urls stay null, an empty table gives no rows, further columns are ignored."""

    def run(batches):
        for batch in bounded_batches(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"]
            )

    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
