"""Helpers shared by the corpus operators: tables, stored steps, words, stable hashes."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import checkpoint_dir

U64 = np.uint64
#: ASCII letters to lower case, ASCII white space to blanks; bytes of other characters stay.
LOWER_BLANK = bytes(32 if b in b" \t\n\r\x0b\x0c" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As above, and all ASCII but letters and digits to blanks.
LOWER_ALNUM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before; forgets everything at a fixed size, so memory is bounded."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter sequence is one shingle, none gives none."""
    if len(words) == 0:
        return words
    m = min(n, len(words))
    h = np.full(len(words) - m + 1, m, dtype=U64)
    for k in range(m):
        h = h * U64(0x9E3779B97F4A7C15) + mixed(words[k:len(words) - m + 1 + k] + U64(k))
    return np.unique(mixed(h))
