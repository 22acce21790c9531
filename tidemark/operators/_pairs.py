"""Block products behind the correlation matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE
from tidemark.session import stored

#: Blocks to aim at, so that block pairs keep a cluster busy; codes of a block, which two at a time must fit a task.
BLOCKS, WIDEST = 14, 6000
#: Pairs of one batch of the result.
BATCH = 250_000


def block_count(n_codes: int, block: int) -> int:
    """Blocks of at least ``block`` codes. A task reads two, so blocks grow with the codes, up to ``WIDEST``."""
    width = max(block, min(WIDEST, -(-n_codes // BLOCKS)))
    return max(1, -(-n_codes // width))


class _Block:
    """One side of a product: codes, the days and returns of their rows, and what the days without a return leave of both moments."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, n_days: int):
        def values(c: str) -> pa.Array:
            return batch.column(f"{c}_{side}")[row].values
        self.codes, self.d, self.r = np.array(values("code").to_pylist(), dtype=str), values("d").to_numpy(zero_copy_only=False), values("r").to_numpy()
        size = values("n").to_numpy()
        starts = np.r_[0, np.cumsum(size)[:-1]]
        self.row, self.days = np.repeat(np.arange(len(size)), size), np.unique(self.d)
        self.mean = np.add.reduceat(self.r, starts) / n_days
        # days without a return are zeros: what they add to the squares is the mean's own
        squares = np.add.reduceat((self.r - self.mean[self.row]) ** 2, starts) + (n_days - size) * self.mean * self.mean
        self.norm = np.sqrt(squares)
        self.norm[self.norm == 0] = np.nan

    def dense(self, days: np.ndarray) -> np.ndarray:
        m = np.zeros((len(self.codes), len(days)))
        m[self.row, np.searchsorted(days, self.d)] = self.r
        return m


def block_pairs(packed: DataFrame) -> DataFrame:
    """Every two blocks once, and each with itself. They meet by reading the stored rows again: nothing is sent, whatever the number of blocks."""
    a, b = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "ab")
    x, y = F.col("b_a"), F.col("b_b")
    return a.crossJoin(b).where((x == y) | ((x < y) == (F.pmod(x + y, F.lit(2)) == 1)))  # by parity, so that tasks share the pairs evenly


def block_correlations(r: DataFrame, coverage: float, block: int) -> DataFrame:
    """``code_a, code_b, corr`` from ``code, trade_date, r``."""
    day = F.datediff(DATE, F.lit("1970-01-01").cast("date"))
    per = r.groupBy(CODE).agg(F.collect_list(F.struct(day.alias("d"), "r")).alias("v"))
    per = stored(per.select(CODE, F.col("v.d").alias("d"), F.col("v.r").alias("r")))
    n_days = per.select(F.explode("d").alias("d")).distinct().count()
    per = per.where(F.size("d") >= coverage * n_days)
    n_blocks = block_count(per.count(), block)
    side = per.withColumn("b", F.pmod(F.xxhash64(CODE), F.lit(n_blocks)).cast("int"))
    # a block is a row, and few of them share a file
    rows = side.repartition(4 * n_blocks, "b").groupBy("b").agg(F.collect_list(F.struct(F.col(CODE).alias("code"), "d", "r")).alias("v"))
    packed = stored(rows.select("b", F.col("v.code").alias("code"), F.transform("v", lambda x: F.size(x["d"])).alias("n"),
                                F.flatten("v.d").alias("d"), F.flatten("v.r").alias("r")))

    def corr(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from product(batch, k)

    def product(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        same = batch.column("b_a")[k] == batch.column("b_b")[k]
        a = _Block(batch, k, "a", n_days)
        b = a if same else _Block(batch, k, "b", n_days)
        days = a.days if same else np.union1d(a.days, b.days)
        ma = a.dense(days)
        mb = ma if same else b.dense(days)
        codes = a.codes if same else np.r_[a.codes, b.codes]
        order = np.argsort(codes)
        place = np.empty(len(codes), np.int64)
        place[order] = np.arange(len(codes))
        names, place_a, place_b = pa.array(codes[order]), place[:len(a.codes)], place[-len(b.codes):]
        step = max(1, BATCH // max(1, len(place_b)))
        for s in range(0, len(place_a), step):
            i = slice(s, s + step)
            c = (ma[i] @ mb.T - n_days * np.outer(a.mean[i], b.mean)) / np.outer(a.norm[i], b.norm)
            pa_, pb = np.repeat(place_a[i], len(place_b)), np.tile(place_b, len(place_a[i]))
            keep = (pa_ < pb) if same else np.ones(len(pa_), bool)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(np.minimum(pa_, pb)[keep])), names.take(pa.array(np.maximum(pa_, pb)[keep])), pa.array(c.ravel()[keep], from_pandas=True)],
                ["code_a", "code_b", "corr"])

    return block_pairs(packed).mapInArrow(corr, "code_a string, code_b string, corr double")
