"""Operator 9: language by multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket are summed over all training texts; the matrix of log-probabilities has a fixed number of
buckets and one column per language, so it is broadcast. Texts are scored in numpy, a batch of sparse rows at a time.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no training row every text is
``und``; ties go to the language that sorts first; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Buckets of hashed n-grams, and the lengths of the n-grams in characters.
BUCKETS, LENGTHS = 1 << 14, (1, 2, 3)
#: A text may be so much less probable per n-gram than its language's own, and so many deviations of a mean of as many n-grams.
BELOW, DEVIATIONS = 1.2, 2.0
#: Cells of one partial sum, of which the reduce step handles one row per task and language.
SLICE = 1 << 10
#: Groups of tasks whose sums are added before the last step.
SALTS = 64
#: Characters hashed at a time.
PIECE = 1 << 20
_ODD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 14)
#: Keeps n-grams of different lengths apart.
_ADD = [np.uint64(n * 0xBF58476D1CE4E5B9 % 2 ** 64) for n in range(max(LENGTHS) + 1)]
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def held_out(doc_id: Column) -> Column:
    """One document in five, by the checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(text: str) -> np.ndarray:
    """Counts by bucket of the n-grams of a text in lower case, runs of anything but letters as one blank."""
    plain = " " + _NOT_LETTERS.sub(" ", unicodedata.normalize("NFC", text).lower()).strip() + " "
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(plain), PIECE):  # a long text piece by piece; n-grams across a border belong to the earlier piece
        code = np.frombuffer(plain[at:at + PIECE + max(LENGTHS) - 1].encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        h = np.zeros(len(code), dtype=np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            if len(code) < n:
                break
            h = (h[:len(code) - n + 1] << np.uint64(21)) | code[n - 1:]
            if n in LENGTHS:
                total += np.bincount(((h[:PIECE] * _ODD + _ADD[n]) >> _SHIFT).astype(np.int64), minlength=BUCKETS)
    return total


COUNTS = "lang string, part int, salt int, texts long, counts binary"
_COUNTS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("salt", pa.int32()), ("texts", pa.int64()), ("counts", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    salt = TaskContext.get().partitionId() % SALTS
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if _LETTER.search(text):
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, dtype=np.int64)
                total[lang] += grams(text)
                texts[lang] = texts.get(lang, 0) + 1
    for lang, counts in total.items():
        rows = [(lang, i, salt, texts[lang], part.tobytes()) for i, part in enumerate(counts.reshape(-1, SLICE))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COUNTS.types)], schema=_COUNTS)


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, dtype=np.int64)
    for x in table["counts"].to_pylist():
        total += np.frombuffer(x, dtype=np.int64)
    first = table.slice(0, 1).to_pylist()[0]
    return pa.Table.from_pylist([first | {"salt": 0, "texts": sum(table["texts"].to_pylist()), "counts": total.tobytes()}], schema=_COUNTS)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, log-probabilities (bucket, language), log-priors of ``lang, text``, and what is usual; all rows count.

    Usual are the mean and the deviation of a language's own n-grams' log-probability, each n-gram left out once.
    """
    parts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null").mapInArrow(_count, COUNTS)
    rows = parts.groupBy("lang", "part", "salt").applyInArrow(_sum, COUNTS).groupBy("lang", "part").applyInArrow(_sum, COUNTS).collect()
    langs = sorted({r["lang"] for r in rows})
    counts, texts = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for r in rows:  # one row per language and slice: its number does not grow with the texts
        i = langs.index(r["lang"])
        counts[r["part"] * SLICE:(r["part"] + 1) * SLICE, i] = np.frombuffer(r["counts"], dtype=np.int64)
        texts[i] = r["texts"]
    smooth = counts + 0.1
    share = counts / np.maximum(1, counts.sum(axis=0))
    without = np.log(np.maximum(smooth - 1, 0.1) / np.maximum(smooth.sum(axis=0) - 1, 0.1))
    mean = (share * without).sum(axis=0)
    usual = np.stack([mean, np.sqrt(np.maximum(0, (share * without ** 2).sum(axis=0) - mean ** 2))])
    return langs, np.log(smooth / smooth.sum(axis=0)), np.log(np.maximum(texts, 1) / max(1, texts.sum())), usual


def predictor(docs: DataFrame, model):
    """A column function ``text -> struct(lang, score, margin)``; it keeps rows aligned, so any other column stays with its row.

    ``margin`` is how much the text's log-probability per n-gram is above the least that is still the language's own.
    The posterior cannot tell, as it is about 1 for any text of some length; ``margin`` does not grow with the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang string, score double, margin double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, logp, prior, (mean, deviation) = shared.value
        names, scores, margins = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        for i, text in enumerate(texts):
            if langs and text is not None and _LETTER.search(text):
                n = grams(text)
                bucket = np.flatnonzero(n)
                own = n[bucket] @ logp[bucket]
                s = prior + own
                s = np.exp(s - s.max())
                best = int(s.argmax())
                names[i], scores[i] = langs[best], s[best] / s.sum()
                margins[i] = own[best] / n.sum() - mean[best] + BELOW + DEVIATIONS * deviation[best] / np.sqrt(n.sum())
        return pd.DataFrame({"lang": names, "score": scores, "margin": margins})
    return predict.asNondeterministic()  # else the optimizer may compute it once more for a filter


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learned from the rows that are not held out."""
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").alias("lang"))
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    got = predictor(docs, model)(F.col("text"))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), got.alias("got"))
            .select("doc_id", "held_out", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score")))
