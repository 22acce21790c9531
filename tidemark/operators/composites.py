"""Scores of many dimensions: multi-factor and rotation strategies, dimension scores, diagnosis, sector and period statistics.

A null input gives no points where a rule looks at it; a null factor makes a sum of factors null, which sorts last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.order_stats import quantile_bucket
from tidemark.functions.windows import CODE, DATE, div, lag, latest_rows, lead, rmean, rstd

#: Weight of each factor.
FACTOR_WEIGHTS = {
    "pe": 0.15,
    "pb": 0.15,
    "ps": 0.10,
    "revenue_growth": 0.15,
    "profit_growth": 0.15,
    "roe": 0.15,
    "debt_ratio": 0.10,
    "momentum_20d": 0.05,
}

#: What a market regime changes in the weights above.
REGIME_WEIGHTS = {
    "bull": {"revenue_growth": 0.25, "profit_growth": 0.20, "momentum_20d": 0.15, "pe": 0.10, "pb": 0.10},
    "bear": {"pe": 0.25, "pb": 0.20, "roe": 0.20, "debt_ratio": 0.15, "revenue_growth": 0.10, "momentum_20d": 0.00},
}

#: Least and greatest allowed value; market value in 1e8.
FACTOR_LIMITS = {
    "market_cap": (50.0, 500.0),
    "roe": (0.10, None),
    "pe": (None, 50.0),
    "pb": (None, 5.0),
    "debt_ratio": (None, 0.70),
}

#: How much a regime favours a sector; others count 1.
SECTOR_PREFERENCES = {
    "bull": {"technology": 1.5, "consumption": 1.3, "manufacturing": 1.2, "cyclical": 1.0, "finance": 0.8, "infrastructure": 0.7, "energy": 0.8, "medicine": 1.0},
    "bear": {"medicine": 1.5, "consumption": 1.3, "finance": 1.2, "infrastructure": 1.0, "energy": 0.9, "technology": 0.6, "cyclical": 0.5, "manufacturing": 0.7},
    "recovery": {"cyclical": 1.5, "finance": 1.3, "manufacturing": 1.2, "infrastructure": 1.1, "technology": 1.0, "consumption": 0.9, "energy": 1.0, "medicine": 0.8},
    "volatile": {"medicine": 1.3, "consumption": 1.2, "finance": 1.1, "technology": 0.9, "cyclical": 0.8, "manufacturing": 0.9, "infrastructure": 1.0, "energy": 0.9},
}

#: Weight of each dimension.
DIMENSION_WEIGHTS = {
    "macro": 0.10,
    "fundamental": 0.20,
    "technical": 0.25,
    "sentiment": 0.10,
    "fund_behavior": 0.20,
    "ai_catalyst": 0.15,
}

#: Bars from the last one back to the one that a return of 20 or 60 days starts at; trading days of a year.
BACK_20, BACK_60, YEAR = 19, 59, 252


def _factor(name: str) -> Column:
    """Low valuation and debt, high growth, return and momentum are good."""
    if name in ("pe", "pb", "ps"):
        return div(F.lit(1.0), F.col(name) + 1)
    return 1 - F.col(name) if name == "debt_ratio" else F.col(name)


def multi_factor(df: DataFrame, weights: Mapping[str, float | Column] = FACTOR_WEIGHTS,
                 limits: Mapping[str, tuple[float | None, float | None]] = FACTOR_LIMITS, top: int | None = None) -> DataFrame:
    """Rows within the limits and their ``composite_score`` over the factors that are there; the best ``top`` if asked for."""
    x = df
    for name, (lo, hi) in limits.items():
        if name in df.columns:
            x = x if lo is None else x.where(F.col(name) >= lo)
            x = x if hi is None else x.where(F.col(name) <= hi)
    parts = [_factor(name) * weight for name, weight in weights.items() if name in df.columns]
    x = x.withColumn("composite_score", sum(parts, F.lit(0.0)))
    return x if top is None else x.orderBy(F.col("composite_score").desc_nulls_last(), CODE).limit(top)


def factor_exposure(df: DataFrame) -> DataFrame:
    """One row: mean valuation, growth, quality and momentum of a selection."""
    names = {"value": "pe", "growth": "revenue_growth", "quality": "roe", "momentum": "momentum_20d"}
    return df.agg(*[F.avg(col).alias(name) for name, col in names.items() if col in df.columns])


def factor_correlation(df: DataFrame, factors: Sequence[str] = tuple(FACTOR_WEIGHTS)) -> DataFrame:
    """``factor_a, factor_b, correlation`` of the factors that are there, each pair once, in one aggregate.

    A pair uses the rows where both are known.
    """
    have = [f for f in factors if f in df.columns]
    pairs = [(a, b) for i, a in enumerate(have) for b in have[i + 1:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.agg(*[F.corr(F.when(both(a, b), F.col(a).cast("double")), F.when(both(a, b), F.col(b).cast("double"))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])))


def market_regime(trend: str | Column, volatility: str | Column) -> Column:
    """``bull`` on a calm rise of over 5 %, ``bear`` on such a fall, else ``neutral``."""
    t, v = (F.col(c) if isinstance(c, str) else c for c in (trend, volatility))
    return F.when((t > 0.05) & (v < 0.2), "bull").when(t < -0.05, "bear").otherwise("neutral")


def factor_rotation(df: DataFrame, market: DataFrame, top: int | None = None) -> DataFrame:
    """``multi_factor`` with the weights of each row's day; ``market``: ``trade_date, index_trend, volatility``, a row a day.

    Days without a market row are neutral.
    """
    x = df.join(market.select(DATE, market_regime("index_trend", "volatility").alias("regime")), DATE, "left")
    x = x.withColumn("regime", F.coalesce("regime", F.lit("neutral")))
    weights = {}
    for name, base in FACTOR_WEIGHTS.items():
        of = F.lit(base)
        for regime, changed in REGIME_WEIGHTS.items():
            of = F.when(F.col("regime") == regime, changed.get(name, base)).otherwise(of)
        weights[name] = of
    return multi_factor(x, weights, top=top)


def _path(df: DataFrame, key: str) -> DataFrame:
    """Newest row per key with 20- and 60-day returns and the mean and deviation of the last 20 daily returns, per year."""
    w = Window.partitionBy(key).orderBy(DATE)
    x = df.withColumn("_ret", div(F.col("close"), lag("close", 1, w)) - 1)
    x = x.withColumns({"_n": F.row_number().over(w), "returns_20d": div(F.col("close"), lag("close", BACK_20, w)) - 1, "returns_60d": div(F.col("close"), lag("close", BACK_60, w)) - 1,
                       "_mean": rmean("_ret", 20, w) * YEAR, "volatility": rstd("_ret", 20, w) * YEAR ** 0.5})
    return latest_rows(x, "_n", DATE, "returns_20d", "returns_60d", "_mean", "volatility", by=key)


def sector_rotation(sectors: DataFrame, index: DataFrame, top: int = 3, least: float = 0.05, lookback: int = 60, weight: tuple[float, float] = (0.10, 0.40),
                    preferences: Mapping[str, Mapping[str, float]] = SECTOR_PREFERENCES) -> DataFrame:
    """The ``top`` sectors by momentum and Sharpe ratio times the regime's preference, with weights cut to ``weight``.

    ``sectors``: ``sector, trade_date, close``; ``index``: ``index_code, trade_date, close`` of one index. Weights are shares
    of the score, cut one by one, so they need not add to 1. Sectors under ``lookback`` bars or ``least`` drop out.
    """
    m, f = F.col("returns_60d"), F.col("returns_20d")
    regime = (_path(index, "index_code").agg(
        F.first(F.when((m > 0.15) & (f > 0), "bull").when((m < -0.15) & (f < 0), "bear").when((m > 0) & (f < 0), "recovery").otherwise("volatile")).alias("regime"))
        .select(F.coalesce("regime", F.lit("volatile")).alias("regime")))
    x = _path(sectors, "sector").where((F.col("_n") >= lookback) & (m > least))
    x = x.withColumn("sharpe", F.when(F.col("volatility") > 0, (F.col("_mean") - 0.03) / F.col("volatility")).otherwise(0.0))
    liked = F.create_map(*[F.lit(v) for r, by in preferences.items() for s, p in by.items() for v in (f"{r}|{s}", p)])
    # one row per sector, and a regime of one row
    x = x.crossJoin(regime).withColumn("preference", F.coalesce(F.try_element_at(liked, F.concat_ws("|", "regime", "sector")), F.lit(1.0)))
    x = x.withColumn("score", (f * 0.4 + m * 0.4 + F.col("sharpe") * 0.2) * F.col("preference"))
    best = x.orderBy(F.col("score").desc(), "sector").limit(top)
    total = F.sum("score").over(Window.partitionBy("regime"))
    share = F.when(total > 0, F.col("score") / total).otherwise(0.0)
    return best.withColumns({"weight": F.greatest(F.lit(weight[0]), F.least(F.lit(weight[1]), share)), "confidence": F.least(F.abs("score") * 2, F.lit(1.0))}).drop("_n", "_mean")


def _points(*rules: tuple[Column, float]) -> Column:
    """50 and the points of every rule that holds, within 0 and 100."""
    total = sum((F.when(cond, float(p)).otherwise(0.0) for cond, p in rules), F.lit(50.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def dimension_scores(df: DataFrame, weights: Mapping[str, float] = DIMENSION_WEIGHTS) -> DataFrame:
    """Six dimensions of 0 to 100 around 50, their weighted total, confidence, and a label at 80, 70, 60 and 50.

    Reads ``shibor, volume, volume_20_avg, volume_5_avg, roe, gross_margin, profit_growth, close, ma5, ma10, ma20,
    bullish_ratio, news_score, main_net_inflow, super_large_ratio, policy_score, sector_heat, news_catalyst``; columns that are
    missing count as null, and zero rates count as unknown.
    """
    c = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("double")
    close, a, b, d = (c(n) for n in ("close", "ma5", "ma10", "ma20"))
    known = d.isNotNull()
    catalyst = F.col("news_catalyst") if "news_catalyst" in df.columns else F.lit(False)
    x = df.withColumns({
        "macro": _points(((c("shibor") < 2) & (c("shibor") != 0), 15), (c("shibor") > 3, -15), (c("volume") > c("volume_20_avg") * 1.2, 10)),
        "fundamental": _points((c("roe") > 15, 20), ((c("roe") < 5) & (c("roe") != 0), -15), (c("gross_margin") > 30, 10), (c("profit_growth") > 20, 15), (c("profit_growth") < -10, -20)),
        "technical": _points((known & (close > a) & (a > b) & (b > d), 25), (known & (close < a) & (a < b) & (b < d), -20), (known & (a > b), 10)),
        "sentiment": _points((c("bullish_ratio") > 0.7, 20), (c("bullish_ratio") < 0.3, -15), (c("news_score") > 0.5, 10)),
        "fund_behavior": _points((c("main_net_inflow") > 5e7, 25), (c("main_net_inflow") < -5e7, -20), (c("super_large_ratio") > 0.3, 15), (c("volume") > c("volume_5_avg") * 2, 10)),
        "ai_catalyst": _points((c("policy_score") > 0.7, 25), (c("sector_heat") > 0.6, 15), (catalyst, 10))})
    # sums of fixed weights miss a label's border by rounding error
    total = F.round(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)), 9)
    x = x.withColumn("total_score", total)
    t = F.col("total_score")
    return x.withColumns({"confidence": t / 100, "label": F.when(t >= 80, "strong_buy").when(t >= 70, "buy").when(t >= 60, "watch").when(t >= 50, "caution").otherwise("avoid")})


def diagnosis(df: DataFrame) -> DataFrame:
    """Technical, fund, sentiment and risk scores with labels, confidence, and key prices of a bar with its indicators.

    Reads ``close, change_pct, rsi_14, macd, macd_signal, ema5, ema10, ema20, boll_upper, boll_middle, boll_lower, atr_14,
    volume_ratio``. Scores are whole numbers, cut toward zero. A null indicator gives null scores, or the middle case of a label.
    """
    c = F.col
    whole = lambda x: x.cast("int")
    part, macd, signal = whole(c("macd") * 100), c("macd"), c("macd_signal")
    base = (F.when((macd > 0) & (signal > 0), F.least(F.lit(100), 60 + part)).when(macd > 0, F.least(F.lit(100), 50 + part))
            .when((macd < 0) & (signal < 0), F.greatest(F.lit(0), 40 + part)).otherwise(50))
    label = F.when((macd > 0) & (signal > 0), "strong").when(macd > 0, "rather_strong").when((macd < 0) & (signal < 0), "weak").otherwise("neutral")
    up = (c("ema5") > c("ema10")) & (c("ema10") > c("ema20"))
    down = (c("ema5") < c("ema10")) & (c("ema10") < c("ema20"))
    above, below = c("close") > c("boll_upper"), c("close") < c("boll_lower")
    x = df.withColumns({
        "sentiment_score": whole(F.greatest(F.lit(0.0), 100 - F.abs(c("rsi_14") - 50) * 2)) + F.lit(0) * whole(c("rsi_14")),
        "sentiment_label": F.when(c("rsi_14") > 70, "overbought").when(c("rsi_14") < 30, "oversold").otherwise("normal"),
        "technical_score": F.when(up, F.least(F.lit(100), base + 15)).when(down, F.greatest(F.lit(0), base - 15)).otherwise(base),
        "technical_label": F.when(up, "rising_averages").when(down, "falling_averages").otherwise(label),
        "fund_score": F.when(c("volume_ratio").isNotNull(), whole(F.least(F.lit(100.0), c("volume_ratio") * 40))),
        "risk_score": F.when(above, 75).when(below, 60).otherwise(45),
        "risk_level": F.when(above, "high").otherwise("medium")})
    return x.withColumns({
        "confidence_score": whole((c("sentiment_score") + c("fund_score")) / 2), "support": F.round("boll_lower", 2), "resistance": F.round("boll_upper", 2),
        "stop_loss": F.round(F.when(c("change_pct") > 5, c("boll_middle")).otherwise(c("close") - c("atr_14") * 2), 2), "take_profit": F.round(c("close") + c("atr_14") * 3, 2)})


def factor_panel(bars: DataFrame, ahead: int = 20) -> DataFrame:
    """Momentum, volatility, liquidity, trend and the return of the next ``ahead`` bars, for every bar of enough history."""
    close = F.col("close")
    x = bars.select(CODE, DATE, "close", "volume").withColumns({"_ret": div(close, lag("close")) - 1, "_ma20": rmean("close", 20), "_ma60": rmean("close", 60)})
    x = x.withColumns({
        "momentum_20d": div(close, lag("close", BACK_20)) - 1, "momentum_60d": div(close, lag("close", BACK_60)) - 1, "volatility": rstd("_ret", 20) * YEAR ** 0.5,
        "liquidity": rmean("volume", 20), "future_return": div(lead("close", ahead), close) - 1,
        "trend_score": F.when((close > F.col("_ma20")) & (F.col("_ma20") > F.col("_ma60")), 1.0).when((close < F.col("_ma20")) & (F.col("_ma20") < F.col("_ma60")), -1.0).otherwise(0.0)})
    return x.where("_ma60 is not null").drop("_ret", "_ma20", "_ma60")


FACTORS = ("momentum_20d", "momentum_60d", "volatility", "trend_score")


def factor_statistics(panel: DataFrame, factors: Sequence[str] = FACTORS, ret: str = "future_return") -> DataFrame:
    """``factor, n, mean, std, min, max, correlation`` with the return, all factors in one aggregate."""
    stats = lambda f: F.struct(F.lit(f).alias("factor"), F.count(f).alias("n"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("std"), F.min(f).alias("min"), F.max(f).alias("max"),
                               F.corr(F.when(F.col(ret).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(ret))).alias("correlation"))
    return panel.agg(*[stats(f).alias(f"_{f}") for f in factors]).select(F.inline(F.array(*[F.col(f"_{f}") for f in factors])))


def sector_factors(panel: DataFrame, sectors: DataFrame, factors: Sequence[str] = FACTORS, ret: str = "future_return") -> DataFrame:
    """Rows and means of the factors and the return per ``sector``; ``sectors``: ``code, sector``."""
    return panel.join(sectors.select(CODE, "sector"), CODE).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in (*factors, ret)])


def quintile_returns(panel: DataFrame, factor: str, ret: str = "future_return", n: int = 5) -> DataFrame:
    """``bucket, n, mean_return`` by the day's quantile buckets of a factor; every row has a bucket."""
    return (quantile_bucket(panel.where(F.col(factor).isNotNull()), [DATE], factor, n, "bucket").where(F.col(ret).isNotNull())
            .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean_return")))


def period_performance(daily: DataFrame, period: str = "month", key: Sequence[str] = ()) -> DataFrame:
    """Return, drawdown, win rate, profit against loss and commonest state of each week (from Monday) or month.

    ``daily``: ``trade_date, position, ret, state`` and the ``key`` columns, a row a day. Days without position do not
    count as returns; periods of one day drop out; the state that sorts first wins a tie.
    """
    per_year = {"week": 52, "month": 12}[period]
    group = [*key, "period_start"]
    x = daily.withColumn("period_start", F.date_trunc(period, F.col(DATE)).cast("date"))
    x = x.withColumn("_r", F.when(F.col("position") > 0, F.col("ret")))
    # a period has at most 31 rows, so its windows are bounded
    so_far = Window.partitionBy(*group).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_value", F.product(1 + F.coalesce("_r", F.lit(0.0))).over(so_far))
    x = x.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_value").over(so_far)))
    r = F.col("_r")
    total = F.max_by("_value", DATE) - 1
    g = x.groupBy(*group).agg(
        F.count(F.lit(1)).alias("days"), total.alias("total_return"), F.max((F.col("_peak") - F.col("_value")) / F.col("_peak")).alias("max_drawdown"),
        F.coalesce(div(F.count(F.when(r > 0, 1)), F.count(r)), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_profit"), F.coalesce(F.avg(F.when(r < 0, -r)), F.lit(0.0)).alias("avg_loss"),
        F.mode("state", True).alias("dominant_state")).where("days >= 2")
    return g.withColumns({"annual_return": F.pow(1 + F.col("total_return"), F.lit(float(per_year)) / F.col("days")) - 1,
                          "profit_loss_ratio": F.coalesce(div("avg_profit", "avg_loss"), F.lit(0.0))})
