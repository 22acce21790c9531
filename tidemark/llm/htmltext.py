"""Operator 4: main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A small classifier gives each block a cost for being called content and one for being
called boilerplate; these are the capacities to the two terminals. Neighbouring blocks, and blocks under one parent, are
tied by edges that are stronger the closer they stand in the element tree. The minimum cut separates content from the
rest, and content blocks are joined in page order.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes; repeated rows give one
row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is dropped, those that never close, and those that stand inside a line, as all inside ``FOREIGN`` do.
DROPPED = frozenset("script style template title select textarea datalist option optgroup".split())
FOREIGN = frozenset("math svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math svg".split())
#: Elements and words of class, id or role that mark what is not the article.
CHROME_TAGS = frozenset("nav aside footer button dialog menu".split())
FORM_TAGS = frozenset("form fieldset".split())
CHROME_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs
sidebar widget footer masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing
social related recommended recommendations comment comments commentlist respond reply replies disqus search pagination pager skip copyright legal disclaimer""".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: A word after one of these, as in ``has-sidebar``, tells of what the element has, not what it is.
QUALIFIERS = frozenset("has have with without no not non show hide hidden".split())
#: An opening element closes these, up to the boundary elements.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "body": {"head"}}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
BOUNDARY = frozenset("article main section div table ul ol dl nav aside header footer form body html".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Weights of the classifier and of the ties between blocks; unlinked characters from which an element's text is strong.
STRONG = 200
CHROME, ARTICLE, HEADER, TIE = 12.0, 4.0, 6.0, 1.5


class Block:
    __slots__ = ("text", "links", "path", "chrome", "marks", "articles", "article", "header", "tag")

    def __init__(self, path, chrome, marks, articles, article, header, tag):
        self.text, self.links, self.path, self.chrome, self.marks, self.articles, self.article, self.header, self.tag = [], 0, path, chrome, marks, articles, article, header, tag


def marked(value: str) -> set[str]:
    """Words of a class, id or role that name its element."""
    found = set()
    for token in value.split():
        for w in map(str.lower, _WORDS.findall(token)):
            if w in QUALIFIERS:
                break
            found.add(w)
    return found


class _Reader(HTMLParser):
    """Text blocks of a page, each with the elements it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        # tag, number, chrome elements and comment marks, numbers of elements marked by a word, numbers of article elements, in article, in page header
        self.stack: list[tuple[str, int, int, tuple, tuple, bool, bool]] = []
        self.number, self.open, self.dropped = 0, None, 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            elif tag not in ("wbr", "img"):
                self.open = None
            return
        if self._inline(tag):
            self._push(tag, attrs)
            return
        self.open = None
        closes = CLOSES.get(tag, {"p"} if tag in BLOCKS_CLOSE_P else ())
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in closes:
                del self.stack[i:]
                break
            if self.stack[i][0] in BOUNDARY and self.stack[i][0] not in closes:
                break
        self._push(tag, attrs)

    def _inline(self, tag) -> bool:
        return tag in INLINE or any(x[0] in FOREIGN for x in self.stack)

    def _push(self, tag, attrs):
        _, _, chrome, marks, articles, article, header = self.stack[-1] if self.stack else ("", 0, 0, (), (), False, False)
        self.number += 1
        if tag not in ("html", "body", "head"):
            words = set().union(*(marked(v) for k, v in attrs if k in ("class", "id", "role") and v))
            commented = bool(words & COMMENT_WORDS)
            chrome += commented or tag in CHROME_TAGS
            plain = tag in ("article", "main", "p", "h1", "h2", "h3")
            if not commented and (not plain and words & CHROME_WORDS or tag in FORM_TAGS or tag == "noscript" and not article):
                marks += (self.number,)
            if tag in ("article", "main"):
                articles += (self.number,)
            article = article or tag in ("article", "main") or "main" in words and tag == "div"
            header = header or tag == "header" and not article
        self.stack.append((tag, self.number, chrome, marks, articles, article, header))

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        inline = self._inline(tag)
        if not inline:
            self.open = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if inline and tag not in FOREIGN and self.stack[i][0] not in INLINE:
                return

    def handle_startendtag(self, tag, attrs):
        foreign = any(x[0] in FOREIGN for x in self.stack)
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (foreign or tag in FOREIGN or tag in ("iframe", "object")):
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not any(s[0] in DROPPED or s[0] == "head" for s in self.stack):
            self._text(data)

    def _text(self, data):
        if self.open is None:
            if not data.strip():
                return
            outer = [s for s in self.stack if s[0] not in INLINE]
            _, _, chrome, marks, articles, article, header = self.stack[-1] if self.stack else ("", 0, 0, (), (), False, False)
            self.open = Block([s[1] for s in outer], chrome, marks, articles, article, header, outer[-1][0] if outer else "")
            self.blocks.append(self.open)
        self.open.text.append(data)
        if any(s[0] == "a" for s in self.stack):
            self.open.links += len(data.strip())


def read_blocks(html: str) -> list[tuple[str, Block]]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    found = ((" ".join("".join(b.text).split()), b) for b in reader.blocks)
    return [(text, b) for text, b in found if text]


def weigh_marks(blocks: list[tuple[str, Block]]) -> dict[int, float]:
    """What the word marks of each block cost, by the block's place.

    A mark outside an article says nothing of that article, unless it is a short one beside a longer. A mark around most
    of the page's strong text is the page's own wrapper, and costs less the more of it is inside.
    """
    own: dict[int, int] = {}
    total = 0
    for text, b in blocks:
        if not b.chrome:
            plain = max(0, len(text) - b.links)
            total += plain
            for e in b.marks + b.articles:
                own[e] = own.get(e, 0) + plain
    longest = max((own.get(a, 0) for _, b in blocks for a in b.articles), default=0)
    part = {e: min(1.0, (1 - n / total) / 0.4) if n >= STRONG else 1.0 for e, n in own.items()}
    out = {}
    for i, (_, b) in enumerate(blocks):
        inside = max((a for a in b.articles if 2 * own.get(a, 0) >= longest), default=0)
        out[i] = sum(part.get(m, 1.0) for m in b.marks if m > inside)
    return out


def costs(text: str, b: Block, marks: float = 0.0) -> tuple[float, float]:
    """Cost of calling a block boilerplate, and of calling it content."""
    n, linked = len(text), b.links / max(1, len(text))
    content = 0.3 + min(2.0, n / 100) + 0.5 * min(3, sum(text.count(c) for c in ".!?;,")) + (ARTICLE if b.article else 0) + (0.5 if b.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") else 0)
    other = CHROME * (b.chrome + marks) + (HEADER if b.header else 0) + (3.0 if linked > 0.6 else 0) + (0.5 if n < 25 and b.tag not in ("p", "h1", "h2", "h3") else 0)
    return content, other


def minimum_cut(content: list[float], other: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it stays with the content terminal, by shortest augmenting paths from all nodes with a surplus."""
    n = len(content)
    surplus = [c - o for c, o in zip(content, other)]  # what flows straight through a node is taken off first
    out: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in ties:
        out[i][j] = out[i].get(j, 0.0) + w
        out[j][i] = out[j].get(i, 0.0) + w
    while True:
        before: dict[int, int] = {i: i for i in range(n) if surplus[i] > 1e-9}
        queue, end = deque(before), -1
        while queue and end < 0:
            i = queue.popleft()
            for j, w in out[i].items():
                if w > 1e-9 and j not in before:
                    before[j] = i
                    if surplus[j] < -1e-9:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [i in before for i in range(n)]
        path = [end]
        while before[path[-1]] != path[-1]:
            path.append(before[path[-1]])
        flow = min(surplus[path[-1]], -surplus[end], *(out[i][j] for j, i in zip(path, path[1:])))
        for j, i in zip(path, path[1:]):
            out[i][j] -= flow
            out[j][i] = out[j].get(i, 0.0) + flow
        surplus[path[-1]] -= flow
        surplus[end] += flow


def main_text(html: str | None) -> str:
    blocks = read_blocks(html or "")
    marks = weigh_marks(blocks)
    pairs = [costs(text, b, marks[i]) for i, (text, b) in enumerate(blocks)]
    ties, last = [], {}
    for i, (_, b) in enumerate(blocks):
        parent = b.path[-2] if len(b.path) > 1 else 0
        if i:
            before = blocks[i - 1][1].path
            shared = 0
            for x, y in zip(before, b.path):
                if x != y:
                    break
                shared += 1
            ties.append((i - 1, i, TIE / (1 + len(before) + len(b.path) - 2 * shared)))
        if parent in last and last[parent] != i - 1:
            ties.append((last[parent], i, TIE / 3))
        last[parent] = i
    keep = minimum_cut([c for c, _ in pairs], [o for _, o in pairs], ties)
    return " ".join(text for (text, _), k in zip(blocks, keep) if k)


OUT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` to ``page_id, url, text, n_chars``."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, OUT)
