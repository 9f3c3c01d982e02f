"""HTML extraction: blocks of a page are labelled content or boilerplate by a minimum cut.

A page is read once, tolerating unclosed and crossing tags, into blocks: the text between two borders of block elements,
with its open elements. Text of comments, scripts, styles, the head and hidden or control elements is never part of a block. A
linear classifier over a block's elements, their class, id and role words, its length, punctuation and share of link text gives
the cost of either label, which is the capacity to one terminal. Blocks next to each other on the page, and
consecutive blocks under the same parent, are joined by smoothness edges, heavier the closer they
are in the tree. The maximum flow saturates the cheapest cut between the terminals; blocks on the source's side are
content. So a short line between paragraphs goes with them, and one between menu entries does not.

Character references are decoded, white space in a block becomes one space, and content blocks are joined by one space
in page order. Nothing is cut or capped: every block of the whole page takes part. Null and empty pages, and pages
without content, have an empty text. Repeated rows are read each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import batches_of

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math)\b[^>]*(?:/>|>.*?(?:</\1\s*[^>]*>|\Z))"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>",
    re.S | re.I,
)
_attribute = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_word = re.compile(r"[a-z]+|[0-9]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark meter object progress q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: a start tag closes an open element of these
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
SCOPE = frozenset("table ul ol dl div section article aside nav header footer main form body td th".split())
#: elements whose text is no part of the page; they end with their parent at the latest
DROPPED = frozenset("button canvas object select title".split())
#: short names that a comparison in a text may look like
LETTER_TAGS = frozenset("a b i p q s u".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset head datalist".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist "
    "consent cookie cookies copyright discussion disqus donate footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination paywall popup privacy promo promoted promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar tracking widget widgets alert "
    "complementary contentinfo dialog adbox adslot sidenav topbar"
    .split()
)
#: words that with a listed one make a compound name, such as `comment-list`
PART_WORDS = frozenset(
    "area article aside bar block bottom box button center col column container content entry first form group holder icon inner item items last left link "
    "links list main mobile module new outer page panel post posts primary right row secondary section site slot small story sub text title top user "
    "view wrap wrapper zone".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: smoothness between neighbours on the page, and more for those under the same parent
NEXT, SIBLING = 0.4, 0.8


def _names_boilerplate(name: str) -> bool:
    """Whether a class, id or role is a listed word, or made of listed words and words for parts of a page.

    A listed word in a longer name, as in `comment-free-post` or `search-theory`, says nothing.
    """
    if name in BOILERPLATE_WORDS:
        return True
    words = [w for w in _word.findall(name) if not w.isdigit()]
    return any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in PART_WORDS for w in words)


def _context(tag: str, attributes: str) -> float:
    """What an element says about the blocks within it; far below zero for hidden ones."""
    score = -8.0 if tag in BOILERPLATE_TAGS else 4.0 if tag in CONTENT_TAGS else -4.5 if tag == "header" else 0.0
    if not attributes:
        return score
    for name, a, b, c in _attribute.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            score -= 30
        elif name in ("class", "id", "role") and tag not in ("body", "html"):
            if any(map(_names_boilerplate, value.split())):
                score -= 9
            elif CONTENT_WORDS.intersection(_word.findall(value)):
                score += 1.5
    return score


class Block:
    __slots__ = ("context", "heading", "link", "parent", "pieces", "text")

    def __init__(self, parent: int, context: float, heading: bool):
        self.parent, self.context, self.heading = parent, context, heading
        self.pieces: list[str] = []
        self.link = 0
        self.text = ""


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page with text, in page order."""
    out: list[Block] = []
    # open elements: tag, number, summed context, inside a link, inside a dropped element
    stack: list[tuple[str, int, float, bool, bool]] = [("", 0, 0.0, False, False)]
    number, at = 0, 0
    block: Block | None = None

    def finish() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join("".join(block.pieces).split())
            if block.text:
                out.append(block)
            block = None

    def write(text: str) -> None:
        nonlocal block
        if not text or stack[-1][4] or (block is None and text.isspace()):
            return
        if block is None:
            owner = next(e for e in reversed(stack) if e[0] not in INLINE)
            block = Block(owner[1], owner[2], owner[0] in ("h1", "h2", "h3", "h4", "h5", "h6"))
        text = unescape(text)
        block.pieces.append(text)
        if stack[-1][3]:
            block.link += len(text)
        block.context = min(block.context, stack[-1][2])

    for m in _token.finditer(html):
        write(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() not in ("svg", "math"):
                finish()
            continue
        tag = tag.lower()
        if tag in LETTER_TAGS and not m[2] and "=" not in m[4] and m[4].strip(" /\t\n\r\f").lower() not in ("", "hidden"):
            write(m[0])  # less than and greater than, not a tag
            continue
        if tag == "br":
            write(" ")
            continue
        if tag not in INLINE:
            finish()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] in SCOPE:
                    break
            continue
        if tag in VOID or (tag in DROPPED and m[0].endswith("/>")):
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag not in INLINE and tag not in DROPPED else ())
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE and stack[k][0] not in closes:
                    break
        if tag == "body":  # what a head has left open does not count in the body
            del stack[1:]
        number += 1
        top = stack[-1]
        own = _context(tag, m[4])
        if tag == "header" and top[2] > 0:  # a header within the article
            own = -1.0
        # within boilerplate nothing turns into content again, and content words count once
        context = top[2] + own if own < 0 or top[2] < 0 else max(top[2], own)
        if top[2] < -6:
            context = min(context, top[2])
        stack.append((tag, number, context, top[3] or tag == "a", top[4] or tag in DROPPED))
    write(html[at:])
    finish()
    return out


def evidence(block: Block) -> float:
    """Log odds that a block is content."""
    n = len(block.text)
    marks = sum(block.text.count(c) for c in ".,;:!?")
    score = block.context - 1.0 + min(n / 60, 3.0) + min(marks / 2, 1.5)
    if block.link:
        score -= 5.0 * min(1.0, block.link / n)
    if block.heading:
        score += 1.5
    if "\N{COPYRIGHT SIGN}" in block.text[:3]:
        score -= 4.0
    return score


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side. `cost` is the capacity from the source if positive, to the sink if negative."""
    rest = list(cost)
    near: list[dict[int, float]] = [{} for _ in cost]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    for a, b, _ in edges:  # paths of one edge
        if rest[a] < 0 < rest[b]:
            a, b = b, a
        if rest[a] > 0 > rest[b]:
            push = min(rest[a], -rest[b], near[a][b])
            rest[a] -= push
            rest[b] += push
            near[a][b] -= push
            near[b][a] += push
    while True:
        came: dict[int, int] = {k: k for k, x in enumerate(rest) if x > 1e-12}
        queue, end = deque(came), -1
        while queue and end < 0:
            a = queue.popleft()
            for b, w in near[a].items():
                if w > 1e-12 and b not in came:
                    came[b] = a
                    if rest[b] < -1e-12:
                        end = b
                        break
                    queue.append(b)
        if end < 0:
            return [k in came for k in range(len(cost))]
        path = [end]
        while came[path[-1]] != path[-1]:
            path.append(came[path[-1]])
        path.reverse()
        push = min(rest[path[0]], -rest[end], *(near[a][b] for a, b in zip(path, path[1:], strict=False)))
        rest[path[0]] -= push
        rest[end] += push
        for a, b in zip(path, path[1:], strict=False):
            near[a][b] -= push
            near[b][a] += push


def main_text(html: str | None) -> str:
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    edges = []
    last_under: dict[int, int] = {}
    for k, block in enumerate(blocks):
        before = last_under.get(block.parent)
        if k:
            edges.append((k - 1, k, NEXT))
        if before is not None:
            edges.append((before, k, SIBLING))
        last_under[block.parent] = k
    keep = minimum_cut([evidence(b) for b in blocks], edges)
    return " ".join(b.text for b, kept in zip(blocks, keep, strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    batches_of(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
