"""Operator 7: quality classifier from overlapping heuristic labellers.

Each labeller calls a text good, bad or abstains. Expectation-maximisation over the counts of vote patterns (their number
is bounded by the labellers, not by the texts) estimates how often each labeller is right and gives every pattern a
posterior. Posteriors of a bounded sample, half of it spread over the rows and half over the patterns, train a hashed
linear scorer over word shapes, which scores every whole text. A text is read once: its votes and counted features are
stored, and patterns, sample and scores come from there.

Where blanks are rare, as in Chinese or Thai, repetition is looked for in runs of four characters in place of words.

Defined results: null, empty and blank texts get score 0 and are rejected; other texts are kept at a score of
``THRESHOLD`` or more; repeated rows get the same score; empty tables give no rows; other columns stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm.common import U64, mixed, stored

#: Rows that the scorer is fitted on at most, by hash of the row; everything else covers all rows.
SAMPLE = 6000
#: Buckets of hashed features; rounds of expectation-maximisation and of the scorer's descent.
BUCKETS, EM_ROUNDS, FIT_ROUNDS = 1 << 13, 60, 300
#: Least score of a kept text.
THRESHOLD = 0.5
#: Words of a piece in which distinct words are counted, at most; words of a phrase that may come again.
PIECE, PHRASE = 2000, 8
#: Characters a word, from which on blanks are rare; characters of a run that stands for a word there; letters of an unbroken word.
RARE, RUN, UNBROKEN = 32, 4, 100
#: (name, measure, bad at or over, good under) of each labeller; between the two it abstains.
LABELLERS = [("symbols", "symbols", 0.12, 0.03), ("marked_words", "marked", 0.5, 0.1), ("shouting", "upper", 0.5, 0.25), ("exclaiming", "exclaim", 0.3, 0.05),
             ("stuttering", "same", 0.35, 0.1), ("poor_words", "poverty", 0.7, 0.55), ("tables", "bars", 0.15, 0.03), ("table_lines", "bar_lines", 0.5, 0.1), ("loops", "loops", 0.5, 0.1),
             ("unbroken", "unbroken", 0.5, 0.05)]


class Shapes(dict):
    """Word to its number; ``hash`` and ``kind`` by number. Words of a kind have one shape and count alike.

    Forgets everything at a fixed size, so memory is bounded.
    """

    LIMIT, KINDS = 1 << 18, 1 << 13

    def __init__(self):
        super().__init__()
        self.hash, self.kind = np.zeros(self.LIMIT, dtype=U64), np.zeros(self.LIMIT, dtype=np.int64)
        self.kinds: dict[tuple, int] = {}
        self.shape, self.counts = np.zeros(self.KINDS, dtype=U64), np.zeros((self.KINDS, 8))

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        n = len(word)
        same = n > 6 and len(set(word)) < n / 3
        if word.isalpha() and word[1:].islower():
            key = ("a" if word[0].islower() else "Aa", same, n, 0 if word[0].islower() else 1, 0, 0, 0, False, n, n if n > UNBROKEN and word.isascii() else 0)
        else:
            odd = sum(1 for c in word if not c.isalnum() and c not in ".,;:?!'\"()-|" and (c.isascii() or unicodedata.category(c)[0] not in "PM"))
            key = ("".join(dict.fromkeys("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))[:8], same,
                   sum(map(str.isalpha, word)), sum(map(str.isupper, word)), odd, word.count("!"), word.count("|"), odd > 1, n, n if n > UNBROKEN and word.isascii() else 0)
        kind = self.kinds.get(key)
        if kind is None:
            kind = self.kinds[key] = len(self.kinds)
            self.shape[kind] = xxhash.xxh64_intdigest(f"{key[0]}={key[1]}")
            self.counts[kind] = key[2:]
        self.hash[at], self.kind[at] = xxhash.xxh64_intdigest(word.lower()), kind
        return at

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and shapes of the words, and the sums of what is counted."""
        hashes, shapes, total, step = [], [], np.zeros(8), self.KINDS // 2
        for i in range(0, len(words), step):
            piece = words[i:i + step]
            if len(self) + len(piece) > self.LIMIT or len(self.kinds) + len(piece) > self.KINDS:
                self.clear(), self.kinds.clear()
            at = np.fromiter(map(self.__getitem__, piece), dtype=np.int64, count=len(piece))
            kind = self.kind[at]
            hashes.append(self.hash[at]), shapes.append(self.shape[kind])
            total += np.bincount(kind, minlength=len(self.kinds)) @ self.counts[:len(self.kinds)]
        return np.concatenate(hashes), np.concatenate(shapes), total


def runs(words: list[str]) -> np.ndarray:
    """Hashes of every ``RUN`` characters in a row, blanks left out."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64)
    out = np.zeros(len(c) - RUN + 1, dtype=U64)
    for k in range(RUN):
        out = out * U64(1 << 21) ^ c[k:len(c) - RUN + 1 + k]
    return mixed(out)


def repetition(hashes: np.ndarray) -> dict[str, float]:
    """Share of words that are not new in their piece, as mean and worst of the pieces, and of phrases not new in the text.

    Texts under 40 words are too short to call good by this.
    """
    n = len(hashes)
    poor = [1 - len(np.unique(piece)) / len(piece) for piece in np.array_split(hashes, -(-n // PIECE))]
    mean, worst = float(np.mean(poor)), max(poor)
    loops = 0.3
    if n >= 40:
        phrase = np.zeros(n - PHRASE + 1, dtype=U64)
        for k in range(PHRASE):
            phrase = phrase * U64(0x9E3779B97F4A7C15) + hashes[k:n - PHRASE + 1 + k]
        loops = 1 - len(np.unique(phrase)) / len(phrase)
    return {"poverty": mean if n >= 40 or n >= PHRASE and mean >= 0.7 else 0.6, "worst": worst, "loops": loops, "long": float(n >= 40)}


def _level(name: str, at: int) -> int:
    return int(xxhash.xxh64_intdigest(f"{name}={at}") & (BUCKETS - 1))


#: Buckets of the measures of repetition, in tenths.
LEVELS = {(name, at): _level(name, at) for name in ("poverty", "worst", "loops", "unbroken") for at in range(11)}


def measures(text: str, shapes: Shapes) -> tuple[dict[str, float], np.ndarray]:
    """What the labellers look at, and the words' (hash, shape) pairs."""
    words = text.split()
    hashes, shape, total = shapes.rows(words)
    n = len(words)
    letters, upper, odd, exclaim, bars, marked, chars, unbroken = total.tolist()
    lines = [line for line in text.split("\n") if line.strip()] if bars > 2 else [""]
    return {"symbols": odd / max(1, chars), "marked": marked / n, "upper": upper / max(1, letters), "exclaim": exclaim / n, "same": float((hashes[1:] == hashes[:-1]).sum()) / n,
            **repetition(hashes if chars <= RARE * n else runs(words)), "unbroken": unbroken / max(1, chars), "bars": bars / n, "bar_lines": sum(line.count("|") > 2 for line in lines) / len(lines)}, np.stack([hashes, shape], axis=1)


def votes(measured: dict[str, float]) -> str:
    """One letter per labeller: ``b`` bad, ``g`` good, ``-`` abstains."""
    return "".join("b" if measured[m] >= bad else "g" if measured[m] < good else "-" for _, m, bad, good in LABELLERS)


def features(words: np.ndarray, measured: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of word shapes, pairs of shapes and repeats of the word before; levels of repetition count as often as there are words."""
    shape = mixed(words[:, 1])
    pair = mixed(shape[:-1] * U64(3) + shape[1:])
    same = np.where(words[1:, 0] == words[:-1, 0], U64(1), U64(2))
    bucket = (np.concatenate([shape, pair, mixed(same)]) & U64(BUCKETS - 1)).astype(np.int64)
    count = np.bincount(bucket, minlength=BUCKETS)
    for name in ("poverty", "worst", "loops", "unbroken") if measured["long"] else ():
        count[LEVELS[name, int(10 * measured[name] + 1e-9)]] += len(words)
    at = np.flatnonzero(count)
    return at.astype("<u2"), count[at].astype("<u4")


def _read(texts: pd.Series) -> pd.DataFrame:
    shapes, rows = Shapes(), []
    for t in texts:
        if t is None or not t.split():
            rows.append((None, 0, b"", b""))
            continue
        m, words = measures(t, shapes)
        at, count = features(words, m)
        rows.append((votes(m), len(words), at.tobytes(), count.tobytes()))
    return pd.DataFrame(rows, columns=["votes", "words", "at", "count"])


def prepared(docs: DataFrame, row: Column) -> DataFrame:
    """``row, pick, votes, words, at, count`` of every row, stored: what a text's labellers say, and its features.

    Texts are read here and nowhere else. Without a word, ``votes`` is null.
    """
    # not deterministic to the optimizer, which else copies a Python column into filters and computes it twice
    read = pandas_udf(_read, "votes string, words int, at binary, count binary").asNondeterministic()
    text = F.col("text").cast("string")
    pick = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text), F.lit(1 << 30))
    return stored(docs.select(row.alias("row"), pick.alias("pick"), read(text).alias("m")), "votes").select("row", "pick", "m.*")


def estimate(patterns: dict[str, int]) -> dict[str, float]:
    """Posterior of ``good`` for every vote pattern, by expectation-maximisation over labellers taken as independent.

    It starts from "bad if any labeller says so"; abstentions say nothing.
    """
    names = sorted(patterns)
    if not names:
        return {}
    n = np.array([patterns[p] for p in names], dtype=float)
    bad, good = (np.array([[c == k for c in p] for p in names], dtype=float) for k in "bg")
    post = np.where(bad.any(axis=1), 0.1, 0.9)
    for _ in range(EM_ROUNDS):
        logit = np.log((post @ n + 1) / ((1 - post) @ n + 1))
        for sign, weight in ((1, post * n), (-1, (1 - post) * n)):
            p_bad = (weight @ bad + (0.02 if sign > 0 else 0.5)) / (weight @ (bad + good) + 1)
            logit = logit + sign * (bad @ np.log(p_bad) + good @ np.log(1 - p_bad))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(names, post.tolist()))


def fit(ready: DataFrame) -> dict:
    """Model of ``prepared`` rows: posteriors by vote pattern and the scorer's weights."""
    ready = ready.where("votes is not null")
    patterns = {r["votes"]: r["n"] for r in ready.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, total = estimate(patterns), sum(patterns.values())
    if not patterns:
        return {"posterior": posterior, "weights": _descend([], posterior)}
    # half of the sample falls on rows alike, half on patterns alike, so that the scorer meets rare ones too
    share = [(v, (1 << 30) * min(1.0, SAMPLE / 2 / total + SAMPLE / 2 / len(patterns) / n)) for v, n in sorted(patterns.items())]
    chosen = ready.join(F.broadcast(ready.sparkSession.createDataFrame(share, "votes string, upto double")), "votes").where(F.col("pick") < F.col("upto"))
    rows = chosen.select("votes", "words", "at", "count").limit(2 * SAMPLE).collect()
    return {"posterior": posterior, "weights": _descend(sorted(rows), posterior)}


def _shares(at: list[bytes], count: list[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and share of a word's count in its text, over all rows."""
    row = np.repeat(np.arange(len(at)), [len(x) // 2 for x in at])
    return row, np.frombuffer(b"".join(at), dtype="<u2").astype(np.int64), np.frombuffer(b"".join(count), dtype="<u4") / words[row]


def _descend(rows: list, posterior: dict[str, float]) -> tuple[np.ndarray, float]:
    """Logistic regression of the posteriors on the features, each side with half of the weight."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    y = np.array([posterior.get(r["votes"], 0.5) for r in rows])
    row, at, share = _shares([bytes(r["at"]) for r in rows], [bytes(r["count"]) for r in rows], np.array([r["words"] for r in rows], dtype=float))
    each = np.where(y >= 0.5, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    speed, push = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(FIT_ROUNDS):
        z = bias + np.bincount(row, weights[at] * share, minlength=len(rows))
        gap = each * (y - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        step = np.bincount(at, gap[row] * share, minlength=BUCKETS) - 1e-6 * weights
        speed, push = speed + step ** 2, push + gap.sum() ** 2
        weights += step / np.sqrt(speed)
        bias += gap.sum() / np.sqrt(push)
    return weights, bias


def judge(ready: DataFrame, model: dict) -> Column:
    """``struct(weak, score)`` of ``prepared`` rows, to be used in ``ready`` itself."""
    shared = ready.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("weak double, score double")
    def apply(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        posterior, (weights, bias) = shared.value["posterior"], shared.value["weights"]
        for said, words, at, count in parts:
            row, bucket, share = _shares(list(at), list(count), words.to_numpy().astype(float))
            z = bias + np.bincount(row, weights[bucket] * share, minlength=len(said))
            score = np.where(words.to_numpy() > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pd.DataFrame({"weak": [None if v is None else posterior.get(v, 0.5) for v in said], "score": score})
    return apply.asNondeterministic()("votes", "words", "at", "count")


def classify(docs: DataFrame) -> DataFrame:
    """``doc_id, votes, weak_label, score, kept`` of every row."""
    ready = prepared(docs, F.col("doc_id"))
    return (ready.select(F.col("row").alias("doc_id"), "votes", judge(ready, fit(ready)).alias("j"))
            .select("doc_id", "votes", F.col("j.weak").alias("weak_label"), F.col("j.score").alias("score"), (F.col("j.score") >= THRESHOLD).alias("kept")))
