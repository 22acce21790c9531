"""A code's newest bars as one bounded array, and folds over it that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, newest_rank

BARS = "_bars"


def newest_bars(bars: DataFrame, n: int, fields: list[str], as_of=None) -> DataFrame:
    """``code, _bars``: the last ``n`` bars up to ``as_of`` in date order. Ranks are cut before the shuffle."""
    if as_of is not None:
        bars = bars.where(F.col(DATE) <= F.lit(as_of).cast("date"))
    kept = newest_rank(bars.select(CODE, DATE, *fields), "_rn").where(F.col("_rn") <= n)
    return kept.groupBy(CODE).agg(F.array_sort(F.collect_list(F.struct(DATE, *fields))).alias(BARS))


def size() -> Column:
    return F.size(BARS)


def series(field: str) -> Column:
    return F.col(f"{BARS}.{field}")


def at(field: str, back: int = 0) -> Column:
    """Value ``back`` bars before the newest; null where there are fewer."""
    return F.try_element_at(series(field), F.lit(-1 - back))


def tail(field: str, n: int | Column) -> Column:
    n = F.least(n if isinstance(n, Column) else F.lit(n), size())
    return F.slice(series(field), size() - n + 1, n)


def mean(xs: Column) -> Column:
    """Mean of the non-null values, null without any."""
    known = F.filter(xs, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(known))


def deviation(xs: Column, less: int = 1) -> Column:
    """Standard deviation over ``n - less``."""
    m = mean(xs)
    known = F.filter(xs, lambda x: x.isNotNull())
    squares = F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.sqrt(F.try_divide(squares, (F.size(known) - less).cast("double")))


def macd(field: str, fast: Column, slow: Column, signal: Column) -> Column:
    """``line, signal``: averages that start at the first bar held."""
    xs = series(field)

    def step(s: Column, x: Column) -> Column:
        f = s["fast"] + (x - s["fast"]) * (2.0 / (fast + 1))
        g = s["slow"] + (x - s["slow"]) * (2.0 / (slow + 1))
        return F.struct(f.alias("fast"), g.alias("slow"), (s["sig"] + (f - g - s["sig"]) * (2.0 / (signal + 1))).alias("sig"))

    start = F.struct(xs[0].alias("fast"), xs[0].alias("slow"), F.lit(0.0).alias("sig"))
    return F.aggregate(xs, start, step, lambda s: F.struct((s["fast"] - s["slow"]).alias("line"), s["sig"].alias("signal")))
