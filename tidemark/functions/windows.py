"""Per-code window building blocks.

A panel is keyed by ``(code, trade_date)``, so one code never holds more rows
than there are trading days.  Windows partitioned by ``code`` are bounded by
the calendar, not by the volume of data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CODE = "code"
DATE = "trade_date"
UNB = Window.unboundedPreceding
FOL = Window.unboundedFollowing


def wc() -> WindowSpec:
    """Rows of a code in date order."""
    return Window.partitionBy(CODE).orderBy(DATE)


def wc_desc() -> WindowSpec:
    return Window.partitionBy(CODE).orderBy(F.col(DATE).desc())


def close() -> Column:
    return F.col("close")


def high() -> Column:
    return F.col("high")


def low() -> Column:
    return F.col("low")


def open_() -> Column:
    return F.col("open")


def vol() -> Column:
    return F.col("volume")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def roll(
    fn: Callable[[Column], Column],
    x: str | Column,
    n: int,
    w: WindowSpec | None = None,
    min_rows: int | None = None,
) -> Column:
    """``fn`` over the last ``n`` rows; null until ``n`` non-null values exist."""
    x = col(x)
    frame = (w or wc()).rowsBetween(-(n - 1), 0)
    need = n if min_rows is None else min_rows
    return F.when(F.count(x).over(frame) >= need, fn(x).over(frame))


def rmean(x, n, w: WindowSpec | None = None, min_rows=None) -> Column:
    return roll(F.avg, x, n, w, min_rows)


def rsum(x, n, w: WindowSpec | None = None, min_rows=None) -> Column:
    return roll(F.sum, x, n, w, min_rows)


def rmin(x, n, w: WindowSpec | None = None, min_rows=None) -> Column:
    return roll(F.min, x, n, w, min_rows)


def rmax(x, n, w: WindowSpec | None = None, min_rows=None) -> Column:
    return roll(F.max, x, n, w, min_rows)


def rstd(x, n, w: WindowSpec | None = None, min_rows=None) -> Column:
    return roll(F.stddev_samp, x, n, w, min_rows)


def lag(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(x), k).over(w or wc())


def lead(x, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(col(x), k).over(w or wc())


def safe_div(a: Column, b: Column, otherwise: Column | float | None = None) -> Column:
    """``a / b``, or ``otherwise`` (null by default) where ``b`` is zero."""
    out = F.when(b != 0, a / b)
    if otherwise is None:
        return out
    other = otherwise if isinstance(otherwise, Column) else F.lit(float(otherwise))
    return F.when(b == 0, other).otherwise(a / b)


def div(a: str | Column, b: str | Column) -> Column:
    """``a / b``, null where ``b`` is zero (plain ``/`` raises in ANSI mode)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def corr(a: str, b: str) -> Column:
    """Pearson correlation, null without spread (the built-in raises there in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b))))


def band(x: Column, cuts: list[tuple[float, float]], otherwise: float, null: float | None = None,
         above: bool = False) -> Column:
    """Step score: the first ``(cut, score)`` with ``x < cut`` (``x > cut`` if ``above``)."""
    out = None
    if null is not None:
        out = F.when(x.isNull(), F.lit(float(null)))
    for cut, score in cuts:
        cond = x > cut if above else x < cut
        out = (F.when(cond, F.lit(float(score))) if out is None
               else out.when(cond, F.lit(float(score))))
    return out.otherwise(F.lit(float(otherwise)))


def latest_rows(df: DataFrame, *cols: str, by: str = CODE, date: str = DATE) -> DataFrame:
    """Newest row per key by a map-side ``max_by``: no sort, one small shuffle."""
    keep = [c for c in (cols or df.columns) if c != by]
    agg = F.max_by(F.struct(*keep), F.col(date)).alias("_last")
    return df.groupBy(by).agg(agg).select(by, "_last.*")


#: Rows of a task whose code windows sort a panel several times over.
TASK_ROWS = 200_000


def spread(df: DataFrame, rows: int, key: str = CODE) -> DataFrame:
    """``df`` dealt out by key, to more tasks than the session's where ``rows`` ask for it; windows by key need no other shuffle.

    A sort holds its task's rows, and a chain of windows sorts several times: tasks must grow in number, not in size.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(n, key)


def newest_rank(df: DataFrame, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(wc_desc()))


# --------------------------------------------------------------------------
# exponential averages


@dataclass(frozen=True)
class Ema:
    """One exponential average: its input column, decay and weighting."""

    source: str
    span: float | None = None
    alpha: float | None = None
    adjust: bool = False

    @property
    def a(self) -> float:
        return self.alpha if self.alpha is not None else 2.0 / (self.span + 1.0)


def with_ema(df: DataFrame, specs: Mapping[str, Ema], key: str = CODE, date: str = DATE) -> DataFrame:
    """Add exponential averages without leaving the JVM and without recursion.

    Rows of a key are cut into blocks.  Inside a block the decayed sum is a
    prefix sum of ``x * w**-pos``; earlier blocks enter as their decayed
    totals, as many as still matter in double precision.  One shuffle by key
    serves all passes.
    """
    now = {name: s for name, s in specs.items() if s.a >= 1.0}  # no memory: the newest value itself
    if now:
        newest = Window.partitionBy(key).orderBy(date).rowsBetween(UNB, 0)
        df = df.withColumns({name: F.last(s.source, ignorenulls=True).over(newest).cast("double") for name, s in now.items()})
        specs = {name: s for name, s in specs.items() if name not in now}
        if not specs:
            return df
    names = list(df.columns)
    widest = max(-math.log1p(-s.a) for s in specs.values())
    block = int(max(8, min(512, 650 // widest)))
    wkey = Window.partitionBy(key).orderBy(date)
    sources = sorted({s.source for s in specs.values()})
    idx = {src: f"_n{i}" for i, src in enumerate(sources)}
    out = df
    for src, n in idx.items():
        out = out.withColumn(n, F.count(F.col(src)).over(wkey.rowsBetween(UNB, 0)))
    for src, n in idx.items():
        blk, pos = f"{n}_b", f"{n}_p"
        out = (out.withColumn(blk, F.floor((F.col(n) - 1) / F.lit(block)).cast("int"))
                  .withColumn(pos, F.pmod(F.col(n) - 1, F.lit(block)).cast("double")))
        win = Window.partitionBy(key, blk).orderBy(date).rowsBetween(UNB, 0)
        mine = {name: s for name, s in specs.items() if s.source == src}
        adds = {}
        for name, s in mine.items():
            x = F.col(src)
            if not s.adjust:
                x = F.when(F.col(n) == 1, x / F.lit(s.a)).otherwise(x)
            w = 1.0 - s.a
            adds[f"_s_{name}"] = F.sum(x * F.pow(F.lit(w), -F.col(pos))).over(win)
        out = out.withColumns(adds)
        prior = {}
        for name, s in mine.items():
            w = 1.0 - s.a
            depth = max(1, math.ceil(37.0 / (block * -math.log(w))))
            tail = F.when((F.col(pos) == block - 1) & F.col(src).isNotNull(),
                          F.col(f"_s_{name}") * F.lit(w ** (block - 1)))
            for j in range(1, depth + 1):
                frame = Window.partitionBy(key).orderBy(blk).rangeBetween(-j, -j)
                prior[f"_t_{name}_{j}"] = F.sum(tail).over(frame)
        out = out.withColumns(prior)
        done = {}
        for name, s in mine.items():
            w = 1.0 - s.a
            total = F.col(f"_s_{name}") * F.pow(F.lit(w), F.col(pos))
            for j in range(1, len([p for p in prior if p.startswith(f"_t_{name}_")]) + 1):
                decay = F.pow(F.lit(w), F.col(pos) + 1 + (j - 1) * block)
                total = total + F.coalesce(F.col(f"_t_{name}_{j}"), F.lit(0.0)) * decay
            if s.adjust:
                value = total * s.a / (1.0 - F.pow(F.lit(w), F.col(n).cast("double")))
            else:
                value = total * s.a
            done[name] = F.when(F.col(n) > 1, value).when(F.col(n) == 1, F.last(src, ignorenulls=True).over(win))
        out = out.withColumns(done)
    return out.select(*names, *specs.keys())


# --------------------------------------------------------------------------
# runs, fills, as-of


def with_runs(df: DataFrame, flag: str, name: str = "run", key: str = CODE, date: str = DATE) -> DataFrame:
    """Length of the current run of true ``flag`` rows; 0 where it is false."""
    w = Window.partitionBy(key).orderBy(date)
    isle = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(UNB, 0))
    out = df.withColumn("_isle", isle)
    inner = Window.partitionBy(key, "_isle").orderBy(date).rowsBetween(UNB, 0)
    run = F.when(F.col(flag), F.sum(F.when(F.col(flag), 1).otherwise(0)).over(inner)).otherwise(F.lit(0))
    return out.withColumn(name, run.cast("long")).drop("_isle")


def forward_fill(x: str, w: WindowSpec | None = None) -> Column:
    return F.last(F.col(x), ignorenulls=True).over((w or wc()).rowsBetween(UNB, 0))


def asof_backward(left: DataFrame, right: DataFrame, values: list[str], key: str = CODE,
                  left_date: str = DATE, right_date: str = DATE, max_age: int | None = None) -> DataFrame:
    """Each left row with the newest right row on or before its date.

    Union of both sides and one window: linear, no range join.  ``right`` is
    unique on ``(key, right_date)``.
    """
    lcols = left.columns
    tag = right.select(
        F.col(key), F.col(right_date).alias("_d"), F.lit(0).alias("_side"),
        F.struct(F.col(right_date).alias("_on"), *values).alias("_r"))
    rows = left.select(F.col(key), F.col(left_date).alias("_d"), F.lit(1).alias("_side"),
                       F.struct(*lcols).alias("_l"))
    both = rows.unionByName(tag, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_d", "_side").rowsBetween(UNB, 0)
    hit = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    picked = F.col("_r")
    if max_age is not None:
        picked = F.when(F.datediff(F.col("_d"), F.col("_r._on")) <= max_age, F.col("_r"))
    hit = hit.withColumn("_r", picked)
    return hit.select("_l.*", F.col("_r._on").alias("asof_date"), *[F.col(f"_r.{v}").alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, values: list[str], key: str = CODE,
                 left_date: str = DATE, right_date: str = DATE) -> DataFrame:
    """Each left row with the first right row on or after its date. Read from the newest row back, a window keeps one value."""
    lcols = left.columns
    tag = right.select(
        F.col(key), F.col(right_date).alias("_d"), F.lit(1).alias("_side"),
        F.struct(F.col(right_date).alias("_on"), *values).alias("_r"))
    rows = left.select(F.col(key), F.col(left_date).alias("_d"), F.lit(0).alias("_side"),
                       F.struct(*lcols).alias("_l"))
    both = rows.unionByName(tag, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col("_d").desc(), F.col("_side").desc()).rowsBetween(UNB, 0)
    hit = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 0")
    return hit.select("_l.*", F.col("_r._on").alias("asof_date"), *[F.col(f"_r.{v}").alias(v) for v in values])
