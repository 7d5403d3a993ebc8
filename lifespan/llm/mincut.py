"""Main text of web pages by a minimum cut over their blocks.

A page is cut into blocks of text.  A small classifier gives each block a cost for being called
content or boilerplate; these are the capacities from the source and to the sink.  Neighbours in
the page, and blocks close together in the element tree, are tied by edges whose capacity is the
price of telling them apart.  The blocks on the source's side of a minimum cut are the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lifespan.llm.common import free_names, pieces_of

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|aria-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
#: Elements that hold no markup: their end tag is the next one of their name.
RAW = frozenset("script style noscript iframe textarea title xmp noframes noembed".split())
#: Elements that hold others, none of it text of the page; they may close themselves, and without an end tag hold nothing.
SKIPPED = frozenset("template svg object canvas math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub "
    "sup time tt u var wbr img".split()
)
#: Elements that hold boilerplate by their meaning; a header only outside of the article.
NOISE_TAGS = frozenset("nav aside footer form button select menu dialog fieldset".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside footer foot ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies "
    "respond discussion feedback widget toolbar pagination pager copyright masthead topbar skip search form contentinfo complementary hidden".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
#: Elements that hold the whole page; their names speak of its layout.
WHOLE = frozenset(["html", "body"])
CONTENT_WORDS = frozenset("article content main post entry story body text prose".split())


@dataclass(frozen=True)
class Costs:
    """Weights of the classifier and of the edges; whole numbers, so cuts are exact.

    ``noise`` is the cost of each mark of noise around a block, ``hidden`` of one that is not shown;
    edges between blocks of different such costs have one part in ``border`` of their capacity.
    """

    prior: int = -40
    words: int = 6
    words_most: int = 120
    paragraph: int = 30
    heading: int = 10
    sentence: int = 20
    links: int = 120
    content: int = 90
    noise: int = 150
    hidden: int = 400
    next_block: int = 10
    same_parent: int = 15
    border: int = 2


PRODUCTION = Costs()


@dataclass(eq=False)
class Mark:
    """An element that looks like noise: not shown, or an article by its tag; the next mark around it."""

    above: Mark | None
    hidden: bool
    article: bool


@dataclass
class Block:
    """``mark``: the innermost one around the block.  ``core``: the innermost one around the article or
    main that holds the block; ``False`` if none does."""

    text: str
    tag: str
    parent: int
    linked: int
    mark: Mark | None
    core: Mark | None | bool
    content: bool

    def words(self) -> int:
        """Words outside of links."""
        n = self.text.count(" ") + 1
        return n - n * self.linked // len(self.text)


@dataclass
class _Element:
    """``holder``: tag and number of the nearest element that is not inline, ``parent`` the number of the one around that."""

    tag: str
    holder: tuple[str, int]
    parent: int
    mark: Mark | None
    core: Mark | None | bool
    content: bool
    link: bool
    skipped: bool


_PAGE = _Element("", ("", 0), 0, None, False, False, False, False)


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    marks: list[Mark] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    opened: Counter[str] = field(default_factory=Counter)
    linked: int = 0
    made: int = 0

    def text(self, data: str) -> None:
        if self.stack and self.stack[-1].skipped:
            return
        if "&" in data:
            data = entities.unescape(data)
        self.parts.append(data)
        if self.stack and self.stack[-1].link:
            self.linked += len(data)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1] if self.stack else _PAGE
                self.blocks.append(Block(text, top.holder[0], top.parent, min(self.linked, len(text)), top.mark, top.core, top.content))
            self.parts, self.linked = [], 0

    def cut(self, k: int) -> None:
        """End the elements from the k-th on."""
        for e in self.stack[k:]:
            self.opened[e.tag] -= 1
        del self.stack[k:]

    def open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            # a block inside an open paragraph or of the same list ends it, as browsers do
            ends = {"p"} if tag not in ("li", "td", "th", "tr", "dt", "dd", "option") else {"p", tag}
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in ends:
                    self.cut(k)
                    break
                if self.stack[k].tag not in INLINE and self.stack[k].tag not in ("p",):
                    break
        above = self.stack[-1] if self.stack else _PAGE
        mark, core, content = above.mark, above.core, above.content
        # the names of an article may be those of its subject, so parts of them say nothing
        words = _names(attributes, whole=tag == "article") if attributes and tag not in WHOLE else frozenset()
        main = tag == "main" or "role=main" in words
        marked = tag in NOISE_TAGS or (tag == "header" and not content) or bool(words & NOISE_WORDS)
        if "not shown" in words or (marked and not main):
            mark = Mark(mark, "not shown" in words, tag == "article")
            self.marks.append(mark)
        if main or (tag == "article" and mark is above.mark):
            core = mark
        content = content or main or tag in CONTENT_TAGS or (tag not in INLINE and bool(words & CONTENT_WORDS))
        self.made += 1
        self.opened[tag] += 1
        inline = tag in INLINE
        holder, parent = (above.holder, above.parent) if inline else ((tag, self.made), above.holder[1])
        skipped = above.skipped or tag in SKIPPED
        self.stack.append(_Element(tag, holder, parent, mark, core, content, above.link or tag == "a", skipped))

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if not self.opened[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                self.cut(k)
                return
            # an inline end tag does not close the blocks around it
            if tag in INLINE and self.stack[k].tag not in INLINE:
                return


def _names(attributes: str, whole: bool = False) -> frozenset[str]:
    """Words of the class, id and role (whole names only, if ``whole``), and whether it is shown."""
    found: set[str] = set()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            found.update(w for w in (value.split() if whole else re.split(r"[^a-z]+", value)) if w)
            if key == "role" and value.strip() == "main":
                found.add("role=main")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            found.add("not shown")
    return frozenset(found)


def blocks_of(page: str) -> tuple[list[Block], list[Mark]]:
    """Blocks of the whole page in order, white space folded, character references decoded; its marks
    from the outside in."""
    reader, at, n = _Reader(), 0, len(page)
    unclosed: set[str] = set()  # names without an end tag in the rest of the page

    def end_of(tag: str, at: int) -> re.Match | None:
        end = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
        if end is None:
            unclosed.add(tag)
        return end

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            reader.text(page[at:])
            break
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            reader.close(tag)
        elif tag in RAW and not (reader.stack and reader.stack[-1].skipped and m[3].endswith("/")):
            end = end_of(tag, at)
            # code without an end goes to the end of the page; of others without an end only the tag goes
            at = end.end() if end else n if tag in ("script", "style") else at
        elif tag in SKIPPED and (m[3].endswith("/") or not end_of(tag, at)):
            continue
        elif reader.stack and reader.stack[-1].skipped and m[3].endswith("/"):
            continue
        else:
            reader.open(tag, m[3])
    reader.flush()
    return reader.blocks, reader.marks


def noise_costs(blocks: list[Block], marks: list[Mark], costs: Costs = PRODUCTION) -> list[int | None]:
    """Per block the cost of the marks around it, which depends on what else the page has.

    A mark is lifted if it is around an article or main (a fifth or more of the words of all
    of them), or is an article with more words than the unmarked content.  If it has over four
    times the words of the unmarked content, it costs less from a third of the page's words on,
    and nothing from half of them on, though its border stays.  None: all marks are lifted.
    """
    size = [b.words() for b in blocks]
    total, core = sum(size), sum(n for b, n in zip(blocks, size) if b.core is not False)
    inside, around = dict.fromkeys(marks, 0), dict.fromkeys(marks, 0)
    for b, n in zip(blocks, size):
        if b.mark:
            inside[b.mark] += n
        if b.core:
            around[b.core] += n
    for m in reversed(marks):  # a mark comes behind those around it
        if m.above:
            inside[m.above] += inside[m]
            around[m.above] += around[m]
    cost = {m: costs.hidden if m.hidden else costs.noise for m in marks if not around[m] or 5 * around[m] < core}

    def summed() -> dict[Mark | None, int | None]:
        """The costs of a mark and of those around it; None if all are lifted."""
        out: dict[Mark | None, int | None] = {None: None}
        for m in marks:
            out[m] = (out[m.above] or 0) + cost[m] if m in cost else out[m.above]
        return out

    before = summed()
    rival = sum(n for b, n in zip(blocks, size) if b.content and before[b.mark] is None)
    for m in list(cost):
        n = inside[m]
        if m.article and n > rival:
            del cost[m]
        elif n > 4 * rival:
            cost[m] = max(0, min(cost[m], cost[m] * (3 * total - 6 * n) // total))
    after = summed()
    return [after[b.mark] for b in blocks]


def capacities(blocks: list[Block], noise: list[int | None], costs: Costs = PRODUCTION) -> list[int]:
    """Per block: what it costs to call it boilerplate (positive) or content (negative)."""
    out = []
    for b, against in zip(blocks, noise):
        n, against = b.text.count(" ") + 1, against or 0
        score = costs.prior + min(costs.words * n, costs.words_most) - costs.links * b.linked // len(b.text)
        score += costs.paragraph * (b.tag == "p") + costs.heading * (len(b.tag) == 2 and b.tag[0] == "h")
        score += costs.sentence * (b.text[-1] in ".!?…:;\"'”»)")
        # an article inside of noise counts as content, plain noise inside of an article does not
        out.append(score + costs.content * (b.content and (against < costs.content or b.core is b.mark)) - against)
    return out


def edges(blocks: list[Block], noise: list[int | None], costs: Costs = PRODUCTION) -> list[tuple[int, int, int]]:
    """Ties between neighbours in the page and in the tree; weaker ones across a border of noise."""
    last: dict[int, int] = {}
    out = []

    def tie(i: int, j: int, price: int) -> None:
        out.append((i, j, price if noise[i] == noise[j] else price // costs.border))

    for i, b in enumerate(blocks):
        if i:
            tie(i - 1, i, costs.next_block)
        j = last.get(b.parent)
        if j is not None:
            tie(j, i, costs.same_parent)
        last[b.parent] = i
    return out


def source_side(terminal: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut, by maximum flow in levels (Dinic's method)."""
    n = len(terminal)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def tie(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, c in enumerate(terminal):
        if c > 0:
            tie(source, i, c, 0)
        elif c < 0:
            tie(i, sink, -c, 0)
    for a, b, c in ties:
        tie(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, a = [], source
                continue
            while following[a] < len(head[a]):
                e = head[a][following[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                following[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None, costs: Costs = PRODUCTION) -> str:
    blocks, marks = blocks_of(page or "")
    noise = noise_costs(blocks, marks, costs)
    terminal, ties = capacities(blocks, noise, costs), edges(blocks, noise, costs)
    for i, j, price in ties:
        # content may draw noise to its side, and is not drawn to the other side by it
        if noise[i] != noise[j]:
            terminal[min(i, j, key=lambda k: -1 if noise[k] is None else noise[k])] += price
    kept = source_side(terminal, ties)
    return " ".join(b.text for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame, costs: Costs = PRODUCTION, html: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text``: the main text of the whole page.

    Null and empty pages, and pages without content, give an empty text.  A column named ``text``
    stays; the new one then gets an underscore.  One row in, one row out, nothing is shuffled.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    (name,) = free_names(pages, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, html):
            texts = [main_text(p, costs) for p in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), name])

    return pages.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.StringType())]))
