"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A linear classifier of each block (its tag, ancestors, class names, length, links) gives the
costs of calling it content or boilerplate: the capacities of its edges from the source and to the sink. Edges between
neighbours in the page, and between blocks of one parent, cost what separating them costs. The minimum cut labels all
blocks of a page at once.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Names that say what an element has or lacks, not what it is.
_STATE = re.compile(r"(?:has|no|not|with|without|show|hide)[-_]", re.I)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "iframe", "noframes", "template", "svg", "select")}
#: Of these, the ones that swallow the rest of the page when their end tag is missing.
_ENDLESS = frozenset("script style textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of the kind closes when they are open just above it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
#: Class, id and role words that speak against or for content; tags that rule it out or speak for it.
_AGAINST = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside complementary contentinfo widget ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register form search comment comments commentlist reply replies respond disqus discussion "
    "related recommended recommendations share sharing social pagination pager copyright legal disclaimer skip toolbar tooltip hidden paywall teaser outbrain taboola tracking".split()
)
_FOR = frozenset("article content main post entry story text body".split())
_AGAINST_TAGS = frozenset("nav footer aside button menu dialog fieldset label legend head".split())
_FOR_TAGS = frozenset("article main".split())
#: Classifier weights and smoothness; HARD outweighs all else that can meet in a block.
HARD, NEAR, SIBLING = 40.0, 0.8, 0.8
WEIGHTS = {"bias": -0.5, "inside": 5.0, "named": 2.5, "paragraph": 1.2, "heading": 0.6, "item": -0.6, "long": 1.6, "longer": 1.0, "sentence": 0.6, "links": -5.0}
#: Cost of an element's words, or of a form or header; on article and main themselves it is this share of that.
AGAINST, OWN = 14.0, 0.25


class Block:
    __slots__ = ("cost", "inside", "links", "mark", "named", "parent", "parts", "tag", "text", "veto")

    def __init__(self, tag: str, parent: int, veto: bool, inside: bool, named: bool, mark: int):
        self.tag, self.parent, self.veto, self.inside, self.named, self.mark = tag, parent, veto, inside, named, mark
        self.cost = 0.0
        self.parts: list[str] = []
        self.links, self.text = 0, ""


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order, with white space collapsed."""
    # open elements: tag; what counts for all text below: ruled out, inside article or main, named as content, the last mark;
    # of the nearest block: its tag, its number, and the number of the block around it
    stack: list[tuple[str, bool, bool, bool, int, str, int, int]] = [("", False, False, False, 0, "", 0, 0)]
    # marks: elements that speak against their text, with the mark around each and its cost
    marks: list[tuple[int, float]] = [(0, 0.0)]
    opened: Counter[str] = Counter()
    out: list[Block] = []
    number, links, at, end = 0, 0, 0, len(page)
    current: Block | None = None
    unended: set[str] = set()  # tags that have no end tag any more

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            _, veto, inside, named, mark, tag, _, around = stack[-1]
            current = Block(tag, around, veto, inside, named, mark)
            out.append(current)
        current.parts.append(text)
        if links:
            current.links += len(text)

    def close(k: int) -> None:
        opened.subtract([e[0] for e in stack[k:]])
        del stack[k:]

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in _BLOCK and stack[k][0] in _BLOCK:
                    break  # an inline end tag closes nothing beyond its block
            if tag in _BLOCK:
                current = None
            continue
        if tag in _END:
            if not m[3].endswith("/>"):
                over = None if tag in unended else _END[tag].search(page, at)
                if over is None and tag not in _ENDLESS:
                    unended.add(tag)
                    continue
                at = over.end() if over else end
            if tag != "svg":
                current = current if tag in ("script", "style", "noscript", "template") else None
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in _BLOCK:
            current = None
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    links = 0
                    break
                if stack[k][0] in _BLOCK:
                    break
        while stack[-1][0] in _CLOSES.get(tag, ()):
            close(len(stack) - 1)
        if tag in _VOID or m[3].endswith("/>") and tag not in _BLOCK:
            continue
        if tag == "a":
            links = 1  # links don't nest
        top, number = stack[-1], number + 1
        words: set[str] = set()
        gone = False
        for a in _ATTRIBUTE.finditer(m[3]):
            name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if name == "style":
                gone = gone or "display:none" in value.replace(" ", "").lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                gone = True
            elif name in ("class", "id", "role"):
                words.update(w.lower() for part in value.split() if not _STATE.match(part) for w in _WORD.findall(part))
        wide = tag in ("html", "body")  # page-wide names say nothing of a part
        good = not wide and bool(words & _FOR)
        bad = set() if wide else words & _AGAINST
        if good or top[2]:
            bad.discard("header")  # an article's own
        mark = top[4]
        if bad or tag == "form" or tag == "header" and not top[2]:
            marks.append((mark, AGAINST * (OWN if tag in _FOR_TAGS else 1.0)))
            mark = len(marks) - 1
        block = (tag, number, top[6]) if tag in _BLOCK else top[5:]
        stack.append((tag, top[1] or gone or tag in _AGAINST_TAGS, top[2] or tag in _FOR_TAGS, top[3] or good, mark, *block))
        opened[tag] += 1
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    out = [b for b in out if b.text]
    price(out, marks)
    return out


def price(blocks: list[Block], marks: list[tuple[int, float]]) -> None:
    """Sum up the marks around each block. The more of the page's text a marked element holds, the less its mark costs."""
    mass = [0] * len(marks)
    for b in blocks:
        mass[b.mark] += 0 if b.veto else max(0, len(b.text) - b.links)
    for k in range(len(marks) - 1, 0, -1):
        mass[marks[k][0]] += mass[k]
    sums = [0.0] * len(marks)
    for k in range(1, len(marks)):
        around, cost = marks[k]
        sums[k] = sums[around] + cost * (1 - (mass[k] / max(1, mass[0])) ** 2)
    for b in blocks:
        b.cost = sums[b.mark]


def evidence(b: Block) -> float:
    """The classifier: over 0 for content. Blocks in hidden elements, and in those of _AGAINST_TAGS, are decided by them."""
    if b.veto:
        return -HARD
    w, n = WEIGHTS, len(b.text)
    x = w["bias"] - b.cost + w["inside"] * bool(b.inside) + w["named"] * bool(b.named) + w["links"] * min(1.0, b.links / n) * (1.0 if b.links > 0.5 * n else 0.2)
    x += w["paragraph"] * (b.tag in ("", "p", "blockquote", "pre")) + w["heading"] * (b.tag in _HEADING) + w["item"] * (b.tag in ("li", "td", "th", "dt", "dd"))
    return x + w["long"] * (n >= 80) + w["longer"] * (n >= 200) + w["sentence"] * (b.text[-1] in ".!?:…\"'”»。")


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: node i is tied to it by cost[i] if over 0, else to the sink by -cost[i].

    Shortest augmenting paths in level graphs, one blocking flow after another, without recursion.
    """
    n = len(cost)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to)), to.append(b), room.append(forth)
        out[b].append(len(to)), to.append(a), room.append(back)

    for i, c in enumerate(cost):
        if c > 0:
            tie(source, i, c, 0.0)
        elif c < 0:
            tie(i, sink, -c, 0.0)
    for a, b, c in edges:
        tie(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_edge, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            own = out[a]
            while next_edge[a] < len(own):
                e = own[next_edge[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                next_edge[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def extract(page: str | None) -> str:
    """Main text of a page: its content blocks, one a line; empty if it has none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    cost = [evidence(b) for b in blocks]
    # where the page marks its article, text outside is no content of its own accord
    if any(b.inside and not b.veto and b.cost < AGAINST / 2 for b in blocks):
        cost = [c if b.inside or b.veto else min(c, 0.0) - 3.0 for b, c in zip(blocks, cost, strict=True)]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEAR if bool(b.inside) == bool(blocks[i - 1].inside) else NEAR / 4))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING))
        elif b.parent in last:
            edges.append((i - 1, i, SIBLING))
        last[b.parent] = i
    content = minimum_cut(cost, edges)
    return "\n".join([b.text for b, c in zip(blocks, content, strict=True) if c])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Null or empty html, or html without content, gives an empty text.

    Rows are taken as they come: null ids and urls stay, repeated rows are repeated; an empty table gives none; other
    columns are ignored.
    """
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
