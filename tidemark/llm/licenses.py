"""Operator 5: license scans by patience alignment.

Templates are whole licenses, their notices and short statements (``license_templates``). Where enough of a template is in
a text, so are enough of its rarer words, at about the same distance; around such a place the text is aligned with the
template: words that occur once in both are anchors, the longest run of anchors in the same order stays, and the gaps
between them are aligned in the same way. Coverage is the share of the template's words aligned. Phrases that tell a
license from its siblings must be there word for word, and so must templates of under ``SHORT`` words.

Defined results: null and empty texts have no license; each copy of a license in a text is reported; where matches
overlap the one with most words aligned, less those left out and those put in, stays, then the name that sorts first;
repeated rows give one row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_ALNUM, raw
from tidemark.llm.license_templates import TEMPLATES

#: Least share of a template's words; a template of fewer than ``SHORT`` words must be there word for word.
LEAST, SHORT = 0.75, 15


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first part, whose second parts rise (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[k] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j), at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words of ``a`` and ``b``, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = rising([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
            out += anchors
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text.encode("utf-8"))
        self.names, self.without = ([b" ".join([b"", *words_of(x.encode("utf-8")), b""]) for x in getattr(text, kind, ())] for kind in ("names", "without"))
        n = len(self.words)
        self.least = n if n < SHORT else int(-(-n * LEAST // 1))
        # of so many places at least ``votes`` are met where enough of the template is
        self.votes = 1 if n < SHORT else max(1, n // 8)
        often = Counter(self.words)
        places = sorted(range(n), key=lambda i: (often[self.words[i]] if n >= SHORT else 0, -len(self.words[i]), i))[:n - self.least + self.votes]
        self.keys: dict[bytes, list[int]] = {}
        for i in places:
            self.keys.setdefault(self.words[i], []).append(i)
        self.slack = max(2, n // 4)

    def scan(self, words: list[bytes], starts: list[int]) -> Iterator[tuple[int, int, int]]:
        """(words aligned, first word, end) of each place of the template in a text; ``starts`` are where its key words put it."""
        n, done = len(self.words), 0
        starts = sorted(starts)
        if n < SHORT:
            for s in starts:
                if s >= done and words[s:s + n] == self.words:
                    done = s + n
                    yield n, s, done
            return
        margin = self.slack + n - self.least  # how far words left out and put in can move a key word
        k = 0
        while k + self.votes <= len(starts):
            first = starts[k]
            if starts[k + self.votes - 1] - first > margin + n - self.least:
                k += 1
                continue
            near = Counter(starts[k:bisect_right(starts, first + margin + n - self.least)])
            best = min(near, key=lambda s: (-near[s], s))
            lo, got = self.place(words, best, margin, done)
            past = best + self.slack
            if len(got) >= self.least and got[-1][0] - got[0][0] < n + self.slack:
                start, end = lo + got[0][0], lo + got[-1][0] + 1
                done = past = end
                if self.named(words[start:end]):
                    yield len(got), start, end
            k = max(k + 1, bisect_left(starts, past))

    def place(self, words: list[bytes], at: int, margin: int, done: int) -> tuple[int, list[tuple[int, int]]]:
        """The best alignment of windows as long as the template or longer, moved to where most of its words were found."""
        n, tried, seen = len(self.words), [], set()
        while at not in seen and len(seen) < 3:
            seen.add(at)
            for room in (0, self.slack, margin):
                lo = max(0, at - room, done)
                got = align(words[lo:max(lo, at + n + room)], self.words)
                tried.append((3 * len(got) - (got[-1][0] - got[0][0] if got else 0), -room, lo, got))
                if len(got) == n and got[-1][0] - got[0][0] == n - 1:
                    return lo, got
            _, _, lo, got = max(tried)
            if len(got) < self.votes:
                break
            moved = Counter(lo + i - j for i, j in got)
            at = min(moved, key=lambda s: (-moved[s], s))
        return max(tried)[2:]

    def named(self, words: list[bytes]) -> bool:
        text = b" ".join([b"", *words, b""])
        return all(x in text for x in self.names) and not any(x in text for x in self.without)


def by_word(templates: list[Template]) -> dict[bytes, list[tuple[int, list[int]]]]:
    """Of each key word the templates it belongs to, and its places there."""
    out: dict[bytes, list[tuple[int, list[int]]]] = {}
    for k, t in enumerate(templates):
        for w, places in t.keys.items():
            out.setdefault(w, []).append((k, places))
    return out


def find(text: bytes, templates: list[Template], keys: dict[bytes, list[tuple[int, list[int]]]]) -> list[tuple[str, int, int, float]]:
    words = words_of(text)
    where: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in keys:
            where.setdefault(w, []).append(i)
    met: dict[int, list[tuple[list[int], list[int]]]] = {}
    for w, at in where.items():
        for k, places in keys[w]:
            if templates[k].least <= len(words):
                met.setdefault(k, []).append((at, places))
    spans = []
    for k, pairs in met.items():
        t = templates[k]
        if sum(len(at) * len(places) for at, places in pairs) >= t.votes:
            starts = [p - i for at, places in pairs for p in at for i in places]
            # words aligned, less those left out and those put in
            spans += ((-(3 * n - len(t.words) - (end - start)), -n, t.name, start, end, n / len(t.words)) for n, start, end in t.scan(words, starts))
    taken: list[tuple[str, int, int, float]] = []
    firsts: list[int] = []
    for _, _, name, start, end, cover in sorted(spans):
        k = bisect_left(firsts, start)
        if (k == 0 or taken[k - 1][2] <= start) and (k == len(taken) or taken[k][1] >= end):
            firsts.insert(k, start)
            taken.insert(k, (name, start, end, cover))
    return taken


OUT = "doc_id long, n_words long, licenses array<string>, n_spans long, coverage double, spans array<struct<license:string,start:long,end:long,coverage:double>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id, text`` to the licenses of every document; spans count words."""
    templates = TEMPLATES if templates is None else templates
    span = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = [Template(name, text) for name, texts in templates.items() for text in texts]
        keys = by_word(all_)
        for batch in batches:
            texts = raw(batch.column(1))
            got = [find(t, all_, keys) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array([sorted({s[0] for s in g}) for g in got], pa.list_(pa.string())), pa.array([len(g) for g in got], pa.int64()),
                pa.array([max((s[3] for s in g), default=0.0) for g in got], pa.float64()), pa.array([[dict(zip(("license", "start", "end", "coverage"), s)) for s in g] for g in got], pa.list_(span))],
                names=["doc_id", "n_words", "licenses", "n_spans", "coverage", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)
