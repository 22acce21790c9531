"""Panel joins, aggregates, ranks and top-k in the forms the other operators share."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.order_stats import with_rank
from tidemark.functions.windows import (
    CODE, DATE, UNB, asof_forward, close, corr, div, lag, latest_rows, wc, wc_desc, with_runs)


def with_daily(panel: DataFrame, aggs: Mapping[str, Column], by: Sequence[str] = (DATE,)) -> DataFrame:
    """Panel with aggregates per date (or date and group).

    Aggregated with map-side combine and joined back, so no task holds a whole
    date; the small side is broadcast by its measured size.
    """
    small = panel.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()])
    return panel.join(small, list(by), "left")


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that drops the right side's copies of columns the left side has."""
    dup = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.drop(*dup), list(keys), "left")


def last_n_stats(bars: DataFrame, stats: Mapping[str, tuple[Callable, str]], windows: Sequence[int]) -> DataFrame:
    """Aggregates over each code's newest n rows, all windows in one conditional aggregate."""
    x = bars.withColumn("_rn", F.row_number().over(wc_desc())).where(F.col("_rn") <= max(windows))
    aggs = [fn(F.when(F.col("_rn") <= n, F.col(c))).alias(f"{name}_{n}") for name, (fn, c) in stats.items() for n in windows]
    return x.groupBy(CODE).agg(*aggs)


def entry_exit(picks: DataFrame, bars: DataFrame, hold_days: int, pick_date: str = "pick_date") -> DataFrame:
    """First bar on or after the pick, and on or after pick + ``hold_days``; else the last bar and ``is_open``."""
    bars = bars.join(picks.select(CODE).distinct(), CODE, "left_semi")
    a = asof_forward(picks, bars, ["close"], left_date=pick_date).withColumnsRenamed(
        {"asof_date": "entry_date", "close": "entry_price"}).withColumn("_due", F.date_add(pick_date, hold_days))
    b = asof_forward(a, bars, ["close"], left_date="_due").withColumnsRenamed({"asof_date": "_x", "close": "_xp"})
    last = latest_rows(bars, DATE, "close").withColumnsRenamed({DATE: "_ld", "close": "_lp"})
    out = b.join(last, CODE, "left")
    return out.withColumns({
        "is_open": F.col("_x").isNull(), "exit_date": F.coalesce("_x", "_ld"),
        "exit_price": F.coalesce("_xp", "_lp")}).drop("_due", "_x", "_xp", "_ld", "_lp")


def range_aggregate(picks: DataFrame, bars: DataFrame, days: int, aggs: Mapping[str, Column],
                    pick_date: str = "pick_date") -> DataFrame:
    """Aggregates over the bars in ``(pick, pick + days]`` of each pick.

    The range join is an equi join on code and a date bucket of ``days`` length:
    a pick meets at most two buckets, so a code with many bars or picks spreads
    over its buckets.
    """
    keys = picks.columns
    bucket = F.floor(F.datediff(DATE, F.lit("1970-01-01").cast("date")) / days).cast("int")
    right = bars.withColumn("_b", bucket)
    first = F.floor((F.datediff(pick_date, F.lit("1970-01-01").cast("date")) + 1) / days).cast("int")
    last = F.floor((F.datediff(pick_date, F.lit("1970-01-01").cast("date")) + days) / days).cast("int")
    left = picks.withColumn("_b", F.explode(F.sequence(first, last)))
    hit = left.join(right.withColumn("_hit", F.lit(1)), [CODE, "_b"], "left")
    inside = (F.col(DATE) > F.col(pick_date)) & (F.col(DATE) <= F.date_add(pick_date, days))
    names = [c for c in bars.columns if c not in keys]
    hit = hit.select(*keys, *[F.when(inside, F.col(c)).alias(c) for c in names])
    return hit.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])


def with_names(df: DataFrame, stocks: DataFrame, cols: Sequence[str] = ("name", "industry")) -> DataFrame:
    """Names and industries by code; the stock list is broadcast only if its measured size allows."""
    return df.join(stocks.select(CODE, *cols), CODE, "left")


def stock_index_stats(bars: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Correlation and beta of each code with an index (equal-weight mean close by default)."""
    if index is None:
        index = bars.groupBy(DATE).agg(F.avg("close").alias("index_close"))
    ir = index.select(DATE, (div("index_close", F.lag("index_close").over(Window.orderBy(DATE))) - 1).alias("_ri"))
    sr = bars.select(CODE, DATE, (div(close(), lag("close")) - 1).alias("_rs"))
    x = sr.join(ir, DATE).where(F.col("_rs").isNotNull() & F.col("_ri").isNotNull())
    return x.groupBy(CODE).agg(F.count(F.lit(1)).alias("n"), corr("_rs", "_ri").alias("corr"),
                               div(F.covar_samp("_rs", "_ri"), F.var_samp("_ri")).alias("beta"))


def child_counts(parent: DataFrame, child: DataFrame, key: str, counts: Mapping[str, Column]) -> DataFrame:
    """Counts of children per parent (0 where none); children are aggregated before the join."""
    agg = child.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return parent.select(key).join(agg, key, "left").fillna(0, list(counts))


def round_trips(trades: DataFrame) -> DataFrame:
    """Each sell paired with the latest earlier buy of its code: return, win flag, holding days.

    ``trades``: ``code, trade_date, id, side ('buy' | 'sell'), price``.
    """
    w = Window.partitionBy(CODE).orderBy(DATE, "id").rowsBetween(UNB, -1)
    buy = F.when(F.col("side") == "buy", F.struct(F.col(DATE).alias("d"), F.col("price").alias("p")))
    x = trades.withColumn("_b", F.last(buy, ignorenulls=True).over(w))
    x = x.where((F.col("side") == "sell") & F.col("_b").isNotNull())
    return x.select(CODE, "id", DATE, (div("price", "_b.p") - 1).alias("ret"), (F.col("price") > F.col("_b.p")).alias("win"),
                    F.datediff(DATE, "_b.d").alias("days"))


def conditional_counts(df: DataFrame, by: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for n, c in flags.items():
        aggs += [F.count_if(c).alias(n), (F.count_if(c) / F.count(F.lit(1)) * 100).alias(f"{n}_pct")]
    return df.groupBy(*by).agg(*aggs)


def date_coverage(bars: DataFrame, more_than: int = 100) -> DataFrame:
    """Dates on which more than the given number of codes trade."""
    return bars.groupBy(DATE).agg(F.countDistinct(CODE).alias("codes")).where(F.col("codes") > more_than)


def skew_sample(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def kurt_sample(c: str) -> Column:
    n = F.count(c).cast("double")
    return ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))


def topk_strings(df: DataFrame, by: str, item: str, score: str, k: int, name: str) -> DataFrame:
    """Best ``k`` items per group joined into one string; ranks are limited before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), item)
    top = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    packed = F.array_sort(F.collect_list(F.struct("_k", item)))
    return top.groupBy(by).agg(F.array_join(F.transform(packed, lambda s: s[item]), ",").alias(name))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).count()


def compound(df: DataFrame, by: str, ret: str, name: str = "total") -> DataFrame:
    """``prod(1 + r) - 1`` per group through logs; a return of -100 % or less gives -1."""
    lost = F.max(F.when(F.col(ret) <= -1, 1).otherwise(0))
    logs = F.sum(F.when(F.col(ret) > -1, F.log1p(ret)))
    return df.groupBy(by).agg(F.when(lost == 1, F.lit(-1.0)).otherwise(F.exp(logs) - 1).alias(name))


def bucket_stats(df: DataFrame, col: str, cuts: Sequence[tuple[float, str]], otherwise: str) -> DataFrame:
    label = None
    for cut, name in cuts:
        cond = F.col(col) < cut
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return df.groupBy(label.otherwise(otherwise).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"))


def score_statistics(df: DataFrame, score: str, grades: Mapping[str, tuple[float, float | None]]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for n, (lo, hi) in grades.items():
        p = F.col(score) >= lo
        aggs.append(F.count_if(p if hi is None else p & (F.col(score) < hi)).alias(n))
    return df.agg(*aggs, F.avg(score).alias("avg_score"), F.max(score).alias("max_score"))


def longest_runs(df: DataFrame, ret: str, key: str = CODE, date: str = DATE) -> DataFrame:
    x = df.withColumns({"_w": F.coalesce(F.col(ret) > 0, F.lit(False)), "_l": F.coalesce(F.col(ret) < 0, F.lit(False))})
    x = with_runs(with_runs(x, "_w", "_rw", key, date), "_l", "_rl", key, date)
    return x.groupBy(key).agg(F.max("_rw").alias("longest_win"), F.max("_rl").alias("longest_loss"))


def zscore(df: DataFrame, col: str, name: str, scope: str = "date", date: str = DATE) -> DataFrame:
    """Cross-section z-score (sample deviation) per date, or over the whole frame; null without spread."""
    if scope not in ("date", "all"):
        raise ValueError(f"unknown scope {scope!r}")
    by = [date] if scope == "date" else ["_one"]
    x = df if scope == "date" else df.withColumn("_one", F.lit(1))
    x = with_daily(x, {"_m": F.avg(col), "_s": F.stddev_samp(col)}, by)
    return x.withColumn(name, F.when(F.col("_s") > 0, (F.col(col) - F.col("_m")) / F.col("_s"))).drop("_m", "_s", "_one")


def rank_label(df: DataFrame, target: str, by: Sequence[str] = (DATE,), name: str = "label") -> DataFrame:
    """``(average rank - 1) / n`` per group: the ranking target of a model."""
    n = df.where(F.col(target).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    x = with_rank(df, by, target, "_r").join(n, list(by), "left")
    return x.withColumn(name, (F.col("_r") - 1) / F.col("_n")).drop("_r", "_n")


def top_per_group(df: DataFrame, by: Sequence[str], score: str, k: int, name: str = "k") -> DataFrame:
    """Best ``k`` rows per group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), CODE)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def local_extrema(bars: DataFrame, back: int = 4) -> DataFrame:
    w = wc().rowsBetween(-back, -1)
    return bars.withColumns({"is_low": F.col("low") <= F.min("low").over(w), "is_high": F.col("high") >= F.max("high").over(w)})


def top_bottom(df: DataFrame, score: str, n: int) -> DataFrame:
    top = df.orderBy(F.col(score).desc_nulls_last(), CODE).limit(n).withColumn("side", F.lit("top"))
    low = df.orderBy(F.col(score).asc_nulls_last(), CODE).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)
