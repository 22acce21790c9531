"""Operator 6: benchmark decontamination with a positional inverted index of the corpus.

The index is split by documents, as search engines do: a row holds some documents and, for every word in them, the
ascending list of its positions. It is stored, so any number of benchmarks can be asked. A window of the benchmark is
looked up from its rarest word (by counts over the whole corpus) on: the lists, each less its word's offset, are
intersected until the starts of the exact phrase remain. Benchmarks are read in blocks of bounded size, each broadcast
and held against every row of the index; no list is ever moved.

Defined results: null or empty texts have no words and are not contaminated; items without words or id are left out;
repeated rows and repeated ids give one row each; empty tables give no rows, or rows without hits; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_ALNUM, U64, WordHashes, raw, stored

#: Words of documents in one row of the index, so its size is bounded (a longer document is a row of its own).
ROW_WORDS = 1 << 20
#: Windows broadcast at a time.
BLOCK_WINDOWS = 1 << 16

INDEX = "docs array<long>, no_id binary, n_words array<long>, words binary, counts binary, positions binary, gap int"
_INDEX = pa.schema([("docs", pa.list_(pa.int64())), ("no_id", pa.binary()), ("n_words", pa.list_(pa.int64())), ("words", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary()), ("gap", pa.int32())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


def _index(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, lengths, found, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal total
            n = np.array(lengths, dtype=np.int64)
            # documents stand `gap` places apart, so no window reaches from one into the next
            place = np.arange(n.sum(), dtype=np.int64) + np.repeat(np.arange(len(n)) * gap, n)
            word = np.concatenate(found) if found else np.empty(0, U64)
            order = np.argsort(word, kind="stable")
            word, place = word[order], place[order].astype(np.uint32)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
            step = np.diff(place, prepend=np.uint32(0)).astype(np.uint32)  # wraps at the start of a list, and back when summed
            row = ([[x if x is not None else 0 for x in ids]], [bytes(x is None for x in ids)], [lengths[:]], [word[first].tobytes()], [np.diff(first, append=len(word)).astype("<u4").tobytes()], [step.tobytes()], [gap])
            ids.clear(), lengths.clear(), found.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _INDEX.types)], schema=_INDEX)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                word = hashes.of(words_of(text))
                ids.append(doc), lengths.append(len(word)), found.append(word)
                total += len(word) + gap
                if total >= ROW_WORDS:
                    yield flush()
        if ids:
            yield flush()
    return run


def build_index(docs: DataFrame, gap: int = 64) -> DataFrame:
    """The stored positional index of ``doc_id, text``. ``gap`` bounds the windows it can answer."""
    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_index(gap), INDEX), "postings")


class Windows:
    """A block of the benchmark: its distinct windows, each with its words from the rarest on."""

    def __init__(self, size: int):
        self.size, self.of = size, {}

    def add(self, item: str, text: str | None) -> None:
        h = WordHashes().of(words_of((text or "").encode("utf-8"))).tolist()
        for i in range(max(1, len(h) - self.size + 1) if h else 0):
            self.of.setdefault(tuple(h[i:i + self.size]), set()).add(item)


def _lists(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = np.frombuffer(row["words"], dtype=U64)
    edge = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], dtype="<u4"), dtype=np.int64)])
    return words, edge, np.cumsum(np.frombuffer(row["positions"], dtype="<u4"), dtype=np.uint32).astype(np.int64)


def _counts(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = asked.value
        total = np.zeros(len(want), dtype=np.int64)
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, counts = np.frombuffer(words, dtype=U64), np.frombuffer(counts, dtype="<u4")
                if len(words):
                    at = np.minimum(np.searchsorted(words, want), len(words) - 1)
                    total += np.where(words[at] == want, counts[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["word", "n"])
    return run


def _search(blocks, near: int):
    """Per document: hits of exact windows, the items they belong to, and items met only nearly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, edge, place = _lists(row)
                n = np.array(row["n_words"], dtype=np.int64)
                start_of = np.concatenate([[0], np.cumsum(n)])[:-1] + np.arange(len(n)) * row["gap"]
                size = int(start_of[-1] + n[-1]) + 2
                change = np.zeros(size, dtype=np.int32)
                items: list[set] = [set() for _ in n]
                close: list[set] = [set() for _ in n]
                for block in blocks:
                    _match(block.value, words, edge, place, start_of, change, items, close, near)
                hit = np.cumsum(change)[:-1] > 0
                sums = np.concatenate([[0], np.cumsum(hit)])
                hits = sums[start_of + n] - sums[start_of]
                ids = [None if none else doc for doc, none in zip(row["docs"], row["no_id"])]
                names = [sorted(s) for s in items]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(n), pa.array(hits.astype(np.int64)), pa.array([len(s) for s in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(s).encode("utf-8")).hexdigest() for s in names]), pa.array(hits > 0), pa.array(names, pa.list_(pa.string())),
                    pa.array([sorted(c - s) for c, s in zip(close, items)], pa.list_(pa.string()))], names=FOUND_NAMES)
    return run


FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, near_items array<string>"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _match(block, words, edge, place, start_of, change, items, close, near) -> None:
    vocabulary, window_words, offsets, lengths, owners = block
    if not len(words) or not len(lengths):
        return
    at = np.minimum(np.searchsorted(words, vocabulary), len(words) - 1)
    at = np.where(words[at] == vocabulary, at, -1)  # of each asked word, its list here
    lists = at[window_words]
    there = lists >= 0
    real = np.arange(lists.shape[1]) < lengths[:, None]
    enough = 5 * (there & real).sum(axis=1) >= 4 * lengths if near else np.zeros(len(lists), dtype=bool)
    for w in np.flatnonzero(there.all(axis=1) | enough):
        k, starts, exact = lengths[w], None, True
        for j in range(k):
            if lists[w, j] < 0:
                exact = False
                break
            mine = place[edge[lists[w, j]]:edge[lists[w, j] + 1]] - offsets[w, j]
            if starts is None:
                starts = mine
            else:
                spot = np.minimum(np.searchsorted(mine, starts), len(mine) - 1)
                starts = starts[mine[spot] == starts]
            if not len(starts):
                exact = False
                break
        if exact:
            starts = starts[starts >= 0]
            np.add.at(change, starts, 1)
            np.add.at(change, starts + k, -1)
            for d in np.unique(np.searchsorted(start_of, starts, side="right") - 1):
                items[d] |= owners[w]
        if near and k > 2:  # also beside an exact hit, which may be in another document
            _near(w, k, lists, offsets, edge, place, start_of, close, owners, near)


def _near(w, k, lists, offsets, edge, place, start_of, close, owners, near) -> None:
    """Proximity: a start from which at least four fifths of a window's words stand within ``near`` places of their own.

    Of any so many words one is there, if only a fifth may be missing: each of the rarest is tried as the anchor.
    """
    need = -(-4 * k // 5)
    at = [place[edge[lists[w, j]]:edge[lists[w, j] + 1]] if lists[w, j] >= 0 else place[:0] for j in range(k)]
    anchors = sorted(range(k), key=lambda j: len(at[j]))[:k - need + 1]
    starts = np.concatenate([(at[j] - offsets[w, j])[:, None] + np.arange(-near, near + 1) for j in anchors]).ravel()
    doc = np.concatenate([np.repeat(np.searchsorted(start_of, at[j], side="right") - 1, 2 * near + 1) for j in anchors])
    if not len(starts):
        return
    starts, first = np.unique(starts, return_index=True)
    doc = doc[first]  # documents stand further apart than a window reaches, so a start has one document
    met = np.zeros(len(starts), dtype=np.int64)
    for rank, j in enumerate(sorted(range(k), key=lambda j: len(at[j])), 1):
        mine = at[j]
        if len(mine):
            want = starts + offsets[w, j]
            spot = np.minimum(np.searchsorted(mine, want - near), len(mine) - 1)
            met += (np.abs(mine[spot] - want) <= near) & (np.searchsorted(start_of, mine[spot], side="right") - 1 == doc)
        keep = met + k - rank >= need
        starts, met, doc = starts[keep], met[keep], doc[keep]
        if not len(starts):
            return
    for d in np.unique(doc):
        close[d] |= owners[w]


def _blocks(benchmark: DataFrame, size: int) -> Iterator[Windows]:
    """Distinct items one by one through the driver's iterator, put together to blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    block = Windows(size)
    for row in rows.toLocalIterator():
        block.add(row["item"], row["text"])
        if len(block.of) >= BLOCK_WINDOWS:
            yield block
            block = Windows(size)
    if block.of:
        yield block


def find(index: DataFrame, benchmark: DataFrame, size: int = 10, near: int = 0) -> DataFrame:
    """Every document of ``index`` with its hits of ``size``-word windows of ``benchmark`` (``item_id, text``).

    ``near`` over 0 also gives, in ``near_items``, the items not met exactly that have a window of which four fifths of the
    words stand within so many places of their own; a window and three times ``near`` must not exceed the gap of the index.
    """
    spark = index.sparkSession
    ready = []
    for block in _blocks(benchmark, size):
        windows = list(block.of)
        vocabulary = np.unique(np.array([x for w in windows for x in w], dtype=U64))
        counts = np.zeros(len(vocabulary), dtype=np.int64)
        asked = spark.sparkContext.broadcast(vocabulary)
        for word, n in index.select("words", "counts").mapInArrow(_counts(asked), "word long, n long").groupBy("word").agg(F.sum("n")).collect():
            counts[word] = n  # one row per asked word at most
        width = max(map(len, windows))
        ids, offsets, lengths = np.full((len(windows), width), 0, np.int64), np.zeros((len(windows), width), np.int64), np.zeros(len(windows), np.int64)
        for i, w in enumerate(windows):
            at = np.searchsorted(vocabulary, np.array(w, dtype=U64))
            order = np.argsort(counts[at], kind="stable")
            ids[i, :len(w)], offsets[i, :len(w)], lengths[i] = at[order], order, len(w)
            ids[i, len(w):] = at[order[0]]
        ready.append(spark.sparkContext.broadcast((vocabulary, ids, offsets, lengths, [block.of[w] for w in windows])))
    return index.mapInArrow(_search(ready, near), FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, near: int = 0) -> DataFrame:
    return find(build_index(docs, max(64, size + 3 * near)), benchmark, size, near)
