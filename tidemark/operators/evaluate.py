"""Factor evaluation in long form: all factors of a panel in one job.

A panel is stored once and sent to its dates once, one row for all factors;
ranks, quantiles and top shares of a date are then windows without another
shuffle.  Dates of more than ``PIECE`` rows take the exact, skew-safe order
statistics instead, so a date with very many codes spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.order_stats import PIECE, quantile_bucket, share_ends, with_rank
from tidemark.functions.stats import t_p_value
from tidemark.functions.windows import CODE, DATE, UNB, close, corr, div, lead
from tidemark.operators.relational import zscore
from tidemark.session import stored
from tidemark.sources.bars import day_index

GRP = ["factor", DATE]


def forward_returns(bars: DataFrame, days: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    return bars.withColumns({f"forward_return_{n}d": div(lead("close", n), close()) - 1 for n in days})


def tradable_forward_returns(bars: DataFrame, days: int = 5) -> DataFrame:
    """Forward return, null when the exit bar is suspended or locked at a limit."""
    c, v, h, lo, o = (lead(x, days) for x in ("close", "volume", "high", "low", "open"))
    bad = (v == 0) | ((h == lo) & ((h > o * 1.095) | (lo < o * 0.905)))
    return bars.withColumn(f"forward_return_{days}d", F.when(c.isNotNull() & ~bad, div(c - close(), close())))


def is_stored(df: DataFrame) -> bool:
    return getattr(df, "_tidemark_done", False)


def materialize(df: DataFrame) -> DataFrame:
    """Store a frame that several passes read, unless it is stored already."""
    if is_stored(df):
        return df
    out = stored(df)
    out._tidemark_done = True
    return out


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def to_long(panel: DataFrame, factors: Sequence[str], ret: str) -> DataFrame:
    """``code, trade_date, ret, factor, value``; rows without a finite value or return drop out."""
    x = panel.select(CODE, DATE, F.col(ret).alias("ret"), *[F.col(f).cast("double").alias(f) for f in factors])
    x = materialize(x.where(_finite(F.col("ret"))))

    def form(wide: DataFrame) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors]))
        return wide.select(CODE, DATE, "ret", pairs.alias("_p")).select(CODE, DATE, "ret", "_p.factor", "_p.value").where(_finite(F.col("value")))
    long = _divided(form(x), x, form)
    long._tidemark_wide = (x, list(factors))
    return long


def _divided(long: DataFrame, source: DataFrame, form: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``long`` with its two parts: ordinary dates, each whole in one partition, and dates of more than ``PIECE`` rows."""
    hot = [r[0] for r in source.groupBy(DATE).count().where(F.col("count") > PIECE).collect()]
    far = F.coalesce(F.col(DATE).isin(hot), F.lit(False))
    calm = form((source.where(~far) if hot else source).repartition(DATE))
    long._tidemark_parts = (calm, form(source.where(far)) if hot else None)
    return long


def _parts(long: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    if not hasattr(long, "_tidemark_parts"):
        kept = materialize(long)
        _divided(long, kept, lambda x: x)
    return long._tidemark_parts


def _both(long: DataFrame, calm: Callable[[DataFrame], DataFrame], hot: Callable[[DataFrame], DataFrame]) -> DataFrame:
    ordinary, large = _parts(long)
    return calm(ordinary) if large is None else calm(ordinary).unionByName(hot(large))


def by_dates(rows: DataFrame, calm: Callable[[DataFrame], DataFrame], hot: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``calm`` over the ordinary dates, each whole in one partition, and ``hot`` over those of more than ``PIECE`` rows."""
    return _both(_divided(rows.select("*"), rows, lambda x: x), calm, hot)


def _places(long: DataFrame) -> DataFrame:
    """Rows with ``_n``, doubled average ranks ``_a`` (value) and ``_b`` (return), places ``_up`` and ``_down`` by value, ties by code."""
    g = Window.partitionBy(*GRP)

    def low(c: str) -> Column:
        return F.rank().over(g.orderBy(c)).cast("long")

    def ties(c: str) -> Column:
        return F.count(F.lit(1)).over(g.orderBy(c).rangeBetween(Window.currentRow, Window.currentRow))
    x = long.withColumns({"_n": F.count(F.lit(1)).over(g), "_up": F.row_number().over(g.orderBy("value", CODE)).cast("long"),
                          "_l": low("value"), "_t": ties("value"), "_b": 2 * low("ret") + ties("ret") - 1})
    return x.withColumns({"_a": 2 * F.col("_l") + F.col("_t") - 1,
                          "_down": F.col("_n") - F.col("_t") + F.col("_up") - 2 * (F.col("_l") - 1)}).drop("_l", "_t")


def _rank_sums(number: str) -> list[Column]:
    """Whole-number sums of products of doubled ranks about their mean: a correlation of zero comes out as zero."""
    n = F.count(F.lit(1)).cast("long" if number == "long" else "decimal(10,0)")

    def about(a: str, b: str) -> Column:
        return F.sum((F.col(a) * F.col(b)).cast(number)) - n * (n + 1) * (n + 1)
    return [about("_a", "_b").cast("double").alias("_ab"), about("_a", "_a").cast("double").alias("_aa"), about("_b", "_b").cast("double").alias("_bb")]


def _ends_means() -> list[Column]:
    return [F.avg(F.when(F.col("in_top"), F.col("ret"))).alias("top"), F.avg(F.when(F.col("in_bottom"), F.col("ret"))).alias("bottom")]


def _ends(long: DataFrame, top: float, bottom: float) -> DataFrame:
    """``in_top`` / ``in_bottom`` beside the places of ordinary dates."""
    def first(place: str, share: float) -> Column:
        return F.col(place) <= F.floor(F.col("_n") * F.lit(float(share)))
    return _places(long).withColumns({"in_top": first("_down", top), "in_bottom": first("_up", bottom)})


def _daily(long: DataFrame, top: float = 0.2, bottom: float = 0.2) -> DataFrame:
    """``n``, rank sums and mean returns of both ends per factor and date; what is not asked for is not computed."""
    def calm(x: DataFrame) -> DataFrame:
        return _ends(x, top, bottom).groupBy(*GRP).agg(F.count(F.lit(1)).alias("n"), *_rank_sums("long"), *_ends_means())

    def hot(x: DataFrame) -> DataFrame:
        r = with_rank(with_rank(x, GRP, "value", "_a"), GRP, "ret", "_b").withColumns({c: (F.col(c) * 2).cast("long") for c in ("_a", "_b")})
        r = r.groupBy(*GRP).agg(F.count(F.lit(1)).alias("n"), *_rank_sums("decimal(20,0)"))
        return r.join(share_ends(x, GRP, "value", top, bottom, CODE).groupBy(*GRP).agg(*_ends_means()), GRP)
    return _both(long, calm, hot)


def _ic_of(daily: DataFrame, min_rows: int) -> DataFrame:
    ok = (F.col("n") >= min_rows) & (F.col("_aa") > 0) & (F.col("_bb") > 0)
    return daily.select(*GRP, "n", F.when(ok, F.try_divide("_ab", F.sqrt("_aa") * F.sqrt("_bb"))).alias("ic"))


def daily_ic(long: DataFrame, method: str = "spearman", min_rows: int = 10) -> DataFrame:
    """Rank or linear correlation per factor and date; null under ``min_rows`` or without spread."""
    if method == "spearman":
        return _ic_of(_daily(long), min_rows)
    if method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    g = long.groupBy(*GRP).agg(F.count(F.lit(1)).alias("n"), corr("value", "ret").alias("_c"),
                               F.min("value").alias("_a0"), F.max("value").alias("_a1"), F.min("ret").alias("_b0"), F.max("ret").alias("_b1"))
    ok = (F.col("n") >= min_rows) & (F.col("_a0") < F.col("_a1")) & (F.col("_b0") < F.col("_b1"))
    return g.select(*GRP, "n", F.when(ok, F.col("_c")).alias("ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    """Mean, population std, IR, positive share, t statistic per factor."""
    g = ic.where(F.col("ic").isNotNull()).groupBy("factor").agg(
        F.count(F.lit(1)).alias("n_dates"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"),
        (F.count_if(F.col("ic") > 0) / F.count(F.lit(1))).alias("ic_positive_ratio"), F.stddev_samp("ic").alias("_s"))
    return g.withColumns({
        "ic_ir": F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")).otherwise(0.0),
        "t_statistic": F.when(F.col("_s") > 0, F.col("ic_mean") / (F.col("_s") / F.sqrt(F.col("n_dates").cast("double"))))}).drop("_s")


def _full_dates(long: DataFrame, min_rows: int) -> DataFrame:
    full = long.groupBy(*GRP).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(*GRP)
    return long.join(full, GRP, "left_semi")


def quantile_returns(long: DataFrame, n: int = 5, min_rows: int | None = None) -> DataFrame:
    """Mean return and count per factor, date and quantile; dates under ``10 n`` rows drop out."""
    least = min_rows if min_rows is not None else n * 10
    g = Window.partitionBy(*GRP)

    def cut(i: int) -> Column:
        h = (F.col("_n") - 1) * F.lit(i / n)
        h = F.when(F.abs(h - F.round(h)) < 1e-9, F.round(h)).otherwise(h)  # 35 * 0.2 is not quite 7
        lo, hi = (F.max(F.when(F.col("_up") - 1 == k, F.col("value"))).over(g) for k in (F.floor(h), F.ceil(h)))
        return lo + (hi - lo) * (h - F.floor(h))

    def calm(x: DataFrame) -> DataFrame:
        x = _places(x).where(F.col("_n") >= least).withColumns({f"_q{i}": cut(i) for i in range(1, n)})
        return x.withColumn("quantile", sum((F.when(F.col("value") > F.col(f"_q{i}"), 1).otherwise(0) for i in range(1, n)), F.lit(1)))

    def means(x: DataFrame) -> DataFrame:
        return x.groupBy(*GRP, "quantile").agg(F.avg("ret").alias("avg_return"), F.count(F.lit(1)).alias("count"))
    return _both(long, lambda x: means(calm(x)),
                 lambda x: means(quantile_bucket(_full_dates(x, least), GRP, "value", n, "quantile", closed="right")))


def _long_short_of(daily: DataFrame, min_rows: int) -> DataFrame:
    return daily.where(F.col("n") >= min_rows).select(*GRP, "top", "bottom", (F.col("top") - F.col("bottom")).alias("long_short"))


def long_short(long: DataFrame, top: float = 0.2, bottom: float = 0.2, min_rows: int = 20) -> DataFrame:
    """Top minus bottom mean return per factor and date."""
    return _long_short_of(_daily(long, top, bottom), min_rows)


def long_short_summary(ls: DataFrame) -> DataFrame:
    a = ls.groupBy("factor").agg(
        (F.avg("long_short") * 252).alias("long_short_return"), (F.stddev_pop("long_short") * F.sqrt(F.lit(252.0))).alias("_v"),
        (F.avg("top") * 252).alias("top_quantile_return"), (F.avg("bottom") * 252).alias("bottom_quantile_return"))
    return a.withColumn("long_short_sharpe", F.when(F.col("_v") > 0, F.col("long_short_return") / F.col("_v")).otherwise(0.0)).drop("_v")


def max_drawdown(series: DataFrame, ret: str, by: Sequence[str] = ("factor",), date: str = DATE) -> DataFrame:
    """Deepest fall of the compounded series per group (one row per day: bounded by the calendar).

    Compounding through logs; a return of -100 % or less makes the fall -1.
    """
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(UNB, 0)
    x = series.where(F.col(ret).isNotNull()).withColumn("_l", F.sum(F.when(F.col(ret) > -1, F.log1p(ret))).over(w))
    x = x.withColumn("_m", F.max("_l").over(w))
    fall = F.min(F.exp(F.col("_l") - F.col("_m")) - 1)
    return x.groupBy(*by).agg(F.when(F.max(F.when(F.col(ret) <= -1, 1)) == 1, F.lit(-1.0)).otherwise(fall).alias("max_drawdown"))


def top_turnover(long: DataFrame, share: float = 0.2) -> DataFrame:
    """Mean share of the top set that leaves by the next date, per factor."""
    top = _both(long, lambda x: _ends(x, share, 0.0).where("in_top").select(*GRP, CODE),
                lambda x: share_ends(x, GRP, "value", share, 0.0, CODE).where("in_top").select(*GRP, CODE))
    days = day_index(long)
    top = top.join(F.broadcast(days), DATE).select("factor", CODE, "day_no")
    w = Window.partitionBy("factor", CODE).orderBy("day_no")  # at most one row per day
    x = top.withColumn("_stay", F.when(F.col(CODE).isNotNull() & (F.lead("day_no").over(w) == F.col("day_no") + 1), 1))
    last = days.agg(F.max("day_no")).first()[0]
    g = x.where(F.col("day_no") < F.lit(last)).groupBy("factor", "day_no").agg((1 - F.count("_stay") / F.count(F.lit(1))).alias("_t"))
    return g.groupBy("factor").agg(F.avg("_t").alias("turnover"))


def evaluate(panel: DataFrame, factors: Sequence[str], ret: str, p_values: bool = True) -> DataFrame:
    """One row of all metrics per factor."""
    return _evaluate_long(to_long(panel, factors, ret), p_values)


def _evaluate_long(long: DataFrame, p_values: bool = True) -> DataFrame:
    daily = materialize(_daily(long))
    ic, ls = ic_summary(_ic_of(daily, 10)), _long_short_of(daily, 20)
    out = (ic.join(long_short_summary(ls), "factor", "left").join(max_drawdown(ls, "long_short"), "factor", "left")
             .join(top_turnover(long), "factor", "left"))
    if p_values:
        out = out.withColumn("p_value", t_p_value()(F.col("t_statistic"), (F.col("n_dates") - 1).cast("double")))
    return out


def effective(metrics: DataFrame, min_ir: float = 0.3, min_ic: float = 0.02, max_p: float = 0.05) -> DataFrame:
    return metrics.where((F.abs("ic_ir") >= min_ir) & (F.abs("ic_mean") >= min_ic) & (F.col("p_value") <= max_p))


WINDOWS = 120  # most windows of one block; a block holds the rows of its windows + lookback - 1 dates
BLOCK_ROWS = 12_000_000
PACK = 3  # factors of one row of a block


def _places_of(values: np.ndarray, missing: bool) -> np.ndarray:
    """Place of each value among the distinct ones; NaN is the last of them, or -1 where it stands for a ``missing`` value."""
    nan, order = np.isnan(values), np.argsort(values)
    values = values[order]
    step = np.zeros(len(values), bool)
    step[1:] = (values[1:] != values[:-1]) & ~nan[order[:-1]]
    del values
    out = np.empty(len(step), np.int32)
    out[order] = np.cumsum(step, dtype=np.int32)
    if missing:
        out[nan] = -1
    return out


def _window_ics(lookback: int, min_rows: int, width: int, last: int, pack: int) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pooled rank correlations of the windows of one block; ranks come from running counts of the block's sorted values."""
    def of(block: int, d: np.ndarray, codes: list[np.ndarray]) -> tuple[list[int], list[float]]:
        counts = [np.zeros(c.max() + 1, np.int32) for c in codes]
        lo, hi = max(int(d[0]) + 1, lookback + 1, block * width), min(int(d[-1]) + lookback, last, block * width + width - 1)
        days, out = [], []
        a = b = 0
        for w in range(lo, hi + 1):
            na, nb = np.searchsorted(d, [w - lookback, w])
            for c, k in zip(codes, counts):
                if na < b:
                    np.subtract.at(k, c[a:na], 1)
                else:
                    k[:] = 0
                np.add.at(k, c[max(b, na):nb], 1)
            a, b = na, nb
            n = b - a
            if n == 0:
                continue
            ic = 0.0
            if n >= min_rows:
                ra, rb = (np.cumsum(k, dtype=np.int32)[c[a:b]] * 2.0 for c, k in zip(codes, counts))
                for r, c, k in zip((ra, rb), codes, counts):
                    r -= k[c[a:b]]
                    r -= n
                spread = np.sqrt(np.dot(ra, ra)) * np.sqrt(np.dot(rb, rb))
                ic = float(np.dot(ra, rb) / spread) if spread > 0 else 0.0
            days.append(w)
            out.append(ic)
        return days, out

    def ics(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d", "ret", *[f"v{i}" for i in range(pack)]]
        parts: dict[str, list[np.ndarray]] = {c: [] for c in names}
        few: dict[str, list[np.ndarray]] = {c: [] for c in names}
        for batch in batches:
            for c in names:
                few[c].append(np.array(batch.column(c).to_numpy(zero_copy_only=False)))  # a copy, or the whole batch stays
                if len(few[c]) == 100:  # large pieces go back to the system when freed
                    parts[c].append(np.concatenate(few[c]))
                    few[c].clear()
        parts = {c: parts[c] + few.pop(c) for c in names}
        d = np.concatenate(parts.pop("d"))
        order = np.argsort(d, kind="stable").astype(np.int32)
        d = d[order]

        def column(c: str) -> np.ndarray:
            values = np.concatenate(parts.pop(c))
            values = values[order]
            values += 0.0  # -0.0 is 0.0
            return values
        ret = _places_of(column("ret"), False)
        values = [_places_of(column(c), pack > 1) for c in names[2:]]  # a pack of one has no row without its value
        del order
        for i in range(pack):
            there = values[i] >= 0
            if there.any():
                days, out = of(key[1].as_py(), *((d, [values[i], ret]) if there.all() else (d[there], [values[i][there], ret[there]])))
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py() * pack + i] * len(days), pa.int32()), pa.array(days, pa.int64()), pa.array(out, pa.float64())],
                                                 ["f", "day_no", "rolling_ic"])
            values[i] = None
    return ics


def _packed(long: DataFrame) -> tuple[DataFrame, list[str], int]:
    """Rows ``p, trade_date, ret, v0..``: pack ``p`` holds the values of that many factors, null where a row has none; their names; the size of a pack."""
    if not hasattr(long, "_tidemark_wide"):
        names = [r["factor"] for r in long.where(F.col("factor").isNotNull()).select("factor").distinct().orderBy("factor").collect()]
        number = F.array_position(F.array(*[F.lit(f) for f in names]), F.col("factor")) - 1
        return long.where(F.col("factor").isNotNull()).select(number.cast("int").alias("p"), DATE, "ret", F.col("value").cast("double").alias("v0")), names, 1
    wide, names = long._tidemark_wide
    size = min(PACK, len(names))
    value = {f: F.when(_finite(F.col(f)), F.col(f)) for f in names}
    packs = [[value[f] for f in names[i:i + size]] for i in range(0, len(names), size)]
    rows = [F.struct(F.lit(p).alias("p"), *[(vs[i] if i < len(vs) else F.lit(None).cast("double")).alias(f"v{i}") for i in range(size)]) for p, vs in enumerate(packs)]
    rows = wide.select(DATE, "ret", F.explode(F.array(*rows)).alias("_p")) if len(rows) > 1 else wide.select(DATE, "ret", rows[0].alias("_p"))
    rows = rows.select("_p.p", DATE, "ret", *[f"_p.v{i}" for i in range(size)])
    return rows.where(F.coalesce(*[F.col(f"v{i}") for i in range(size)]).isNotNull()), names, size


def rolling_ic(long: DataFrame, lookback: int = 60, min_rows: int = 100) -> DataFrame:
    """Pooled rank correlation over the ``lookback`` dates before each date; 0 under ``min_rows``.

    Windows go to tasks in blocks of up to ``WINDOWS``, fewer where dates are
    large, so a row is sent to few blocks, not to ``lookback`` windows, and
    with the values of up to ``PACK`` factors at a time.  Blocks of more than
    ``BLOCK_ROWS`` rows are ranked window by window in Spark, where one window
    spreads over tasks.
    """
    x, names, pack = _packed(long)
    days = materialize(day_index(long))
    x = x.join(F.broadcast(days), DATE).withColumn("d", F.col("day_no").cast("int"))
    sizes = x.groupBy("p", "d").count().collect()  # by day: bounded by the calendar
    last = days.agg(F.max("day_no")).first()[0] or 0
    width = min(WINDOWS, max(1, BLOCK_ROWS // max((r["count"] for r in sizes), default=1) - lookback))
    rows_of: dict[tuple[int, int], int] = {}
    for r in sizes:
        for b in range(max(r["d"] + 1, lookback + 1) // width, min(r["d"] + lookback, last) // width + 1):
            rows_of[r["p"], b] = rows_of.get((r["p"], b), 0) + r["count"]
    large = sorted(k for k, n in rows_of.items() if n > BLOCK_ROWS)
    lo, hi = F.greatest(F.col("d") + 1, F.lit(lookback + 1)), F.least(F.col("d") + lookback, F.lit(last))
    blocks = F.sequence(F.floor(lo / width).cast("int"), F.floor(hi / width).cast("int"))
    values = [f"v{i}" for i in range(pack)]
    x = x.where(lo <= hi).select("p", "d", "ret", *values, F.explode(blocks).alias("_b"))
    hot = F.struct("p", "_b").isin([F.struct(F.lit(p), F.lit(b)) for p, b in large]) if large else F.lit(False)
    out = x.where(~hot).groupBy("p", "_b").applyInArrow(_window_ics(lookback, min_rows, width, last, pack), "f int, day_no long, rolling_ic double")
    if large:
        first, final = F.greatest(F.col("d") + 1, F.lit(lookback + 1), F.col("_b") * width), F.least(F.col("d") + lookback, F.lit(last), F.col("_b") * width + width - 1)
        pairs = F.explode(F.array(*[F.struct((F.col("p") * pack + i).alias("f"), F.col(v).alias("value")) for i, v in enumerate(values)]))
        y = x.where(hot & (first <= final)).select(pairs.alias("_v"), "ret", first.alias("_first"), final.alias("_final")).where("_v.value is not null")
        y = y.select("_v.f", "_v.value", "ret", F.explode(F.sequence("_first", "_final").cast("array<bigint>")).alias("day_no"))
        y = with_rank(with_rank(y, ["f", "day_no"], "value", "_a"), ["f", "day_no"], "ret", "_b")
        g = y.groupBy("f", "day_no").agg(F.count(F.lit(1)).alias("n"), corr("_a", "_b").alias("_c"))
        out = out.unionByName(g.select("f", "day_no", F.when(F.col("n") >= min_rows, F.coalesce("_c", F.lit(0.0))).otherwise(0.0).alias("rolling_ic")))
    factor = F.element_at(F.array(*[F.lit(f) for f in names]), F.col("f") + 1) if names else F.lit(None).cast("string")
    return out.join(F.broadcast(days), "day_no").select(factor.alias("factor"), DATE, "rolling_ic")


def dynamic_weights(rolling: DataFrame) -> DataFrame:
    """Weights from mean |IC| over its deviation, normalised over the factors."""
    g = rolling.groupBy("factor").agg((F.avg(F.abs("rolling_ic")) / (F.stddev_pop("rolling_ic") + 0.001)).alias("_s"))
    total, n = F.sum("_s").over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy())
    w = F.when(total == 0, 1.0 / n).otherwise(F.greatest(F.col("_s"), F.lit(0.0)) / total)
    return g.withColumn("weight", w).select("factor", "weight")


def composite(panel: DataFrame, weights: Mapping[str, float], scope: str = "all", name: str = "composite_score") -> DataFrame:
    """Weighted z-scores, weights scaled by the sum of their absolute values."""
    total = sum(abs(w) for w in weights.values())
    x, keep = panel, panel.columns
    for f in weights:
        x = zscore(x, f, f"_z_{f}", scope)
    score = sum((F.coalesce(F.col(f"_z_{f}"), F.lit(0.0)) * (w / total) for f, w in weights.items()), F.lit(0.0))
    return x.select(*keep, score.alias(name))


def sweep(panel: DataFrame, combos: Mapping[str, Mapping[str, float]], ret: str, scope: str = "all") -> DataFrame:
    """Evaluate many weightings at once: each row carries one score per combination, then long form."""
    factors = sorted({f for c in combos.values() for f in c})
    x = materialize(panel.select(CODE, DATE, ret, *factors))  # every factor's mean and deviation read it
    for f in factors:
        x = zscore(x, f, f"_z_{f}", scope)
    cols = {}
    for cid, c in combos.items():
        total = sum(abs(w) for w in c.values())
        cols[cid] = sum((F.coalesce(F.col(f"_z_{f}"), F.lit(0.0)) * (w / total) for f, w in c.items()), F.lit(0.0))
    m = _evaluate_long(to_long(x.withColumns(cols), list(combos), ret), p_values=False).withColumnRenamed("factor", "combo")

    def part(c: Column, top: float) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)) / top, F.lit(1.0))

    score = (F.least(F.abs("ic_ir") / 0.5, F.lit(1.0)) * 0.4 + part(F.col("long_short_return"), 0.5) * 0.3
             + part(F.col("long_short_sharpe"), 2.0) * 0.2
             + (1 - F.least(F.abs(F.least("max_drawdown", F.lit(0.0))) / 0.3, F.lit(1.0))) * 0.1)
    return m.withColumn("total_score", score)
