"""Market-wide readings: one value per date, from one aggregation by date.

Daily tables hold one row per trading day, so an ordered window over them is
bounded by the calendar.  ``on_panel`` joins a reading back to the bars.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.order_stats import quantiles
from tidemark.functions.windows import (
    CODE, DATE, UNB, close, div, lag, open_, rmax, rmean, rmin, rstd, safe_div, vol, wc)
from tidemark.registry import FACTORS
from tidemark.session import stored
from tidemark.sources.bars import board, board_limit


def wd() -> WindowSpec:
    return Window.orderBy(DATE)


def on_panel(panel: DataFrame, daily: DataFrame, *cols: str, fill: float | None = None) -> DataFrame:
    """Join daily readings to the panel; the optimizer broadcasts the day table when it is small."""
    out = panel.join(daily.select(DATE, *cols), DATE, "left")
    return out.fillna(fill, list(cols)) if fill is not None else out


def _zscore(x: str, point_in_time: bool) -> Column:
    frame = wd().rowsBetween(UNB, 0) if point_in_time else Window.partitionBy()
    return (F.col(x) - F.avg(x).over(frame)) / (F.stddev_samp(x).over(frame) + 0.001)


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def market_breadth(df: DataFrame, period: int = 10) -> DataFrame:
    day = df.groupBy(DATE).agg(((F.sum(_flag(close() > open_())) - F.sum(_flag(close() < open_())))
                                / F.count(F.lit(1))).alias("breadth"))
    return day.withColumn("market_breadth", rmean("breadth", period, wd()))


def market_temperature(df: DataFrame, period: int = 20, span: int = 52) -> DataFrame:
    x = df.withColumns({"_hi": rmax(close(), span), "_lo": rmin(close(), span)})
    day = x.groupBy(DATE).agg(((F.sum(_flag(close() >= F.col("_hi"))) - F.sum(_flag(close() <= F.col("_lo"))))
                               / F.count(F.lit(1))).alias("raw"))
    return day.withColumn("market_temperature", rmean("raw", period, wd()))


@FACTORS.register("market_sentiment", "market", "market_sentiment")
def market_sentiment(df: DataFrame, period: int = 10) -> DataFrame:
    keep = df.columns
    x = df.withColumn("_s", (div(vol(), lag("volume")) - 1) * (div(close(), open_()) - 1))
    return x.withColumn("market_sentiment", rmean("_s", period)).select(*keep, "market_sentiment")


@FACTORS.register("market_trend", "market", "market_trend")
def market_trend(df: DataFrame, period: int = 20) -> DataFrame:
    return df.withColumn("market_trend", safe_div(rmean(close(), period), rstd(close(), period)))


@FACTORS.register("market_health", "market", "market_health")
def market_health(df: DataFrame, short: int = 5, long: int = 10, t_short: float = 0.0, t_long: float = 0.0) -> DataFrame:
    keep = df.columns
    x = df.withColumns({"_a": rmean(close(), short), "_b": rmean(close(), long)})
    x = x.withColumns({"_sa": (F.col("_a") - lag("_a")) / close() * 100, "_sb": (F.col("_b") - lag("_b")) / close() * 100})
    a, b = F.col("_sa"), F.col("_sb")
    score = (F.when((a > t_short) & (b > t_long), 2.0).when((a > t_short) | (b > t_long), 1.0)
             .when((a < -t_short) & (b < -t_long), -1.0).otherwise(0.0))
    return x.select(*keep, score.alias("market_health"))


def limit_counts(df: DataFrame) -> DataFrame:
    """Limit-up / limit-down counts and score per date; the limit depends on the board of the code."""
    base = F.col("preclose") if "preclose" in df.columns else open_()
    base = F.when(base == 0, 1.0).otherwise(base)
    change, rate = (close() - base) / base * 100, board_limit()
    day = df.groupBy(DATE).agg(F.sum(_flag(change >= rate)).alias("total_limit_up"),
                               F.sum(_flag(change <= -rate)).alias("total_limit_down"))
    height = F.least(F.lit(10.0), F.col("total_limit_up") / 50)
    return day.withColumn("limit_up_score", F.col("total_limit_up") - F.col("total_limit_down") + height)


def pioneer_status(df: DataFrame, codes: Sequence[str] = ("300255",)) -> DataFrame:
    return (df.where(F.col(CODE).isin(*codes)).groupBy(DATE)
              .agg(F.avg((div(close(), open_()) - 1) * 100).alias("pioneer_status")))


@FACTORS.register("cost_peak", "market", "cost_peak")
def _fullest(bins: int):
    """Column function from the bars of a window to the middle of its fullest bin, many windows at a time."""
    @F.arrow_udf("double")
    def peak(bars: pa.Array) -> pa.Array:
        sizes = np.diff(bars.offsets.to_numpy())
        flat = bars.flatten()
        n, most, total = len(sizes), int(sizes.max(initial=1)), int(sizes.sum())
        row = np.repeat(np.arange(n), sizes)
        at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        c, v = np.full((n, most), np.nan), np.zeros((n, most))
        c[row, at] = flat.field("c").to_numpy(zero_copy_only=False)
        v[row, at] = flat.field("v").to_numpy(zero_copy_only=False)
        lo, hi = np.fmin.reduce(c, axis=1), np.fmax.reduce(c, axis=1)
        width = (hi - lo) / bins
        with np.errstate(invalid="ignore", divide="ignore"):
            k = np.minimum(np.floor((c - lo[:, None]) / width[:, None]), bins - 1)
        d = np.empty_like(v)
        for j in range(most):
            d[:, j] = np.where(k == k[:, j:j + 1], v, 0.0).sum(axis=1)
        d[np.isnan(d)] = -1.0  # a bin with an unknown volume comes last
        d[np.isnan(k)] = -2.0
        first = np.where(d == d.max(axis=1, keepdims=True), k, np.inf).min(axis=1)
        out = np.where(width == 0, hi, lo + (first + 0.5) * width)
        return pa.array(out, mask=np.isnan(out))
    return peak


def cost_peak(df: DataFrame, window: int = 20, bins: int = 50) -> DataFrame:
    """Price of the fullest volume-at-price bin over the last bars; under five bars, the close.

    The bars of a window travel as one bounded array, so the histogram needs no
    shuffle beyond the one by code.  Ties go to the lowest bin.
    """
    keep = df.columns
    x = df.withColumn("_bars", F.collect_list(F.struct(close().cast("double").alias("c"), vol().cast("double").alias("v")))
                      .over(wc().rowsBetween(-(window - 1), 0)))
    value = F.when(F.size("_bars") < 5, close()).otherwise(F.col("_peak"))
    return x.withColumn("_peak", _fullest(bins)("_bars")).select(*keep, value.alias("cost_peak"))


def macro_interest_rate(df: DataFrame, period: int = 20) -> DataFrame:
    day = df.withColumn("_v", rstd(close(), period)).groupBy(DATE).agg(F.avg("_v").alias("mv"))
    prev = F.lag("mv").over(wd())
    return day.withColumn("interest_rate_change", (F.col("mv") - prev) / (prev + 0.001))


def macro_market_liquidity(df: DataFrame, period: int = 20, legacy: bool = False) -> DataFrame:
    """Z-score of market volume over its average; ``legacy`` uses statistics of the whole sample."""
    day = df.withColumn("_m", rmean(vol(), period)).groupBy(DATE).agg(
        (F.sum(vol()) / (F.coalesce(F.sum("_m"), F.lit(0.0)) + 1)).alias("liquidity_ratio"))
    return day.withColumn("liquidity_score", _zscore("liquidity_ratio", not legacy))


def macro_industry_cycle(df: DataFrame, period: int = 60) -> DataFrame:
    """60-day sum of the mean return of each industry (code prefix where none is given)."""
    industry = F.col("industry") if "industry" in df.columns else F.substring(CODE, 1, 2)
    day = (df.withColumn("_r", div(close(), lag("close")) - 1).groupBy(DATE, industry.alias("industry"))
             .agg(F.avg("_r").alias("industry_return")))
    w = Window.partitionBy("industry").orderBy(DATE)
    return day.withColumn("industry_momentum", F.sum("industry_return").over(w.rowsBetween(-(period - 1), 0))).withColumn(
        "industry_momentum", F.when(F.count("industry_return").over(w.rowsBetween(-(period - 1), 0)) >= period,
                                    F.col("industry_momentum")))


def macro_market_sentiment(df: DataFrame, period: int = 20) -> DataFrame:
    day = df.withColumn("_r", div(close(), lag("close")) - 1).groupBy(DATE).agg(
        (F.sum(_flag(F.col("_r") > 0)) / F.count(F.lit(1))).alias("advance_ratio"))
    return day.withColumn("sentiment_change", F.col("advance_ratio") - rmean("advance_ratio", period, wd()))


def macro_risk_appetite(df: DataFrame, period: int = 20, legacy: bool = False) -> DataFrame:
    x = df.withColumn("_r", div(close(), lag("close")) - 1)
    day = x.withColumn("_v", rstd("_r", period)).groupBy(DATE).agg(
        (F.avg("_r") / (F.avg("_v") + 0.001)).alias("risk_appetite"))
    return day.withColumn("risk_appetite_score", _zscore("risk_appetite", not legacy))


# Default thresholds of the market state.
STATE = {"strong_v_total": 1800.0, "osc_min": 1200.0, "osc_max": 2000.0, "temp_strong": 50.0, "temp_overheat": 80.0,
         "cost_peak_support": 0.995, "pivot_v_ratio": 1.1, "pivot_price": 15.0}


def market_state(df: DataFrame, codes: Sequence[str] = ("300255",), th: Mapping[str, float] = STATE) -> DataFrame:
    """Temperature, inertia signal and state (risk / strong / oscillating / weak) per date.

    ``df`` carries ``cost_peak``.  The cost-peak base is the mean over all days.
    """
    th = {**STATE, **th}
    day = df.groupBy(DATE).agg((F.sum(vol() * close()) / 1e8).alias("v_total"), F.avg("cost_peak").alias("avg_cost_peak"),
                               F.avg("close").alias("avg_close"), F.avg("open").alias("avg_open"))
    day = day.join(limit_counts(df), DATE).join(pioneer_status(df, codes), DATE, "left")
    temp = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("limit_up_score") + 100) / 4))
    day = day.withColumn("temperature", temp)
    pio = F.coalesce(F.col("pioneer_status"), F.lit(0.0))
    day = day.withColumns({
        "delta_temperature": F.col("temperature") - F.lag("temperature").over(wd()),
        "multiplier": F.when(pio < -5, 0.5).otherwise(1.0), "_base": F.avg("avg_cost_peak").over(Window.partitionBy())})
    day = day.withColumn("adjusted_temperature", F.col("temperature") * F.col("multiplier"))
    state = (F.when((pio < -5) | (F.col("adjusted_temperature") > th["temp_overheat"]), "risk")
             .when((F.col("v_total") > th["strong_v_total"]) & (F.col("adjusted_temperature") > th["temp_strong"]), "strong")
             .when((F.col("v_total") > th["osc_min"]) & (F.col("v_total") < th["osc_max"])
                   & (F.col("avg_cost_peak") > F.col("_base") * th["cost_peak_support"]), "oscillating").otherwise("weak"))
    inertia = F.when((F.col("delta_temperature") < -30) & (F.col("avg_open") > F.col("avg_close") * 0.97),
                     "inertia_sell").otherwise("normal")
    return day.withColumns({"market_state": state, "inertia_signal": inertia}).drop("_base")


def pivot_10am(df: DataFrame, th: Mapping[str, float] = STATE) -> DataFrame:
    th = {**STATE, **th}
    x = df.withColumns({"_v": F.coalesce(safe_div(vol(), lag("volume")), F.lit(1.0)),
                        "_b": safe_div(close() - rmean(close(), 5), rmean(close(), 5))})
    day = x.groupBy(DATE).agg(F.avg("_v").alias("v"), F.avg("close").alias("c"), F.avg("_b").alias("b"))
    up = (F.col("v") > th["pivot_v_ratio"]) & (F.col("c") > th["pivot_price"]) & (F.col("b") > 0)
    return day.select(DATE, F.coalesce(up, F.lit(False)).alias("upward_pivot"))


def exit_lines(df: DataFrame) -> DataFrame:
    day = df.groupBy(DATE).agg(div(F.sum(vol() * close()), F.sum(vol())).alias("vwap"),
                               F.avg("open").alias("o"), F.avg("close").alias("c"))
    limit = div(F.col("c"), F.col("o")) > 1.095
    return day.select(DATE, limit.alias("opening_limit"), (F.col("c") < F.col("vwap")).alias("break_vwap"),
                      (limit | (F.col("c") < F.col("o"))).alias("closing_condition"))


def data_thresholds(df: DataFrame) -> DataFrame:
    """One row of thresholds from the data: daily value and close quantiles, cost-peak mean."""
    day = stored(df.groupBy(DATE).agg((F.sum(vol() * close()) / 1e8).alias("v_total"), F.sum("cost_peak").alias("_s"), F.count("cost_peak").alias("_n")))
    q = quantiles(day, [], "v_total", {"q75": 0.75})
    m = quantiles(df, [], "close", {"median": 0.5})
    means = day.agg(F.avg("v_total").alias("mean"), F.try_divide(F.sum("_s"), F.sum("_n")).alias("peak"))
    one = q.drop("n").withColumn("_k", F.lit(1))
    for t in (m.drop("n"), means):
        one = one.join(t.withColumn("_k", F.lit(1)), "_k")
    return one.select(
        (F.col("q75") * 0.9).alias("strong_v_total"), (F.col("mean") * 0.8).alias("osc_min"),
        (F.col("mean") * 1.2).alias("osc_max"), F.col("median").alias("pivot_price"),
        (F.col("peak") * 0.98).alias("cost_peak_support"))


def rate_readings(rates: DataFrame, window: int = 5) -> DataFrame:
    """Liquidity, term spread, credit impulse, trend and policy stance per date.

    ``rates``: ``trade_date, shibor_1w, deposit_rate, loan_rate, long_rate, short_rate,
    m2_growth, gdp_growth, rrr_change, policy_change``.  The trend compares the
    newest ``window`` rows with the first ones of the table.
    """
    n = F.row_number().over(wd())
    head = F.avg(F.when(F.col("_n") <= window, F.col("shibor_1w"))).over(Window.partitionBy())
    x = rates.withColumn("_n", n).withColumns({"_head": head, "_tail": rmean("shibor_1w", window, wd())})
    chg = (F.col("_tail") - F.col("_head")) / F.col("_head")
    trend = F.when(F.col("_n") < 2 * window, "neutral").when(chg < -0.02, "down").when(chg > 0.02, "up").otherwise("neutral")
    spread = F.col("long_rate") - F.col("short_rate")
    x = x.withColumns({
        "shibor_trend": trend, "liquidity_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("shibor_1w") * 25)),
        "funding_cost": F.when(F.col("shibor_1w") < 2, "low").when(F.col("shibor_1w") < 3, "medium").otherwise("high"),
        "loan_spread": F.col("loan_rate") - F.col("deposit_rate"), "term_spread": spread,
        "curve": F.when(spread > 1, "steep").when(spread > 0.3, "normal").when(spread > 0, "flat").otherwise("inverted"),
        "credit_impulse": F.col("m2_growth") - F.col("gdp_growth")})

    def sign(c: str) -> Column:
        return F.when(F.col(c) < 0, 1).when(F.col(c) > 0, -1).otherwise(0)

    points = (F.when(F.col("shibor_trend") == "down", 1).when(F.col("shibor_trend") == "up", -1).otherwise(0)
              + sign("rrr_change") + sign("policy_change"))
    x = x.withColumn("policy_stance", F.when(points >= 2, "easing").when(points <= -2, "tightening").otherwise("neutral"))
    return x.drop("_n", "_head", "_tail")


def macro_timing(readings: DataFrame, bullish: float = 60.0, bearish: float = 40.0) -> DataFrame:
    """Timing signal from :func:`rate_readings`, and the blended liquidity score."""
    t = F.col("shibor_trend")
    s = F.col("liquidity_score") + F.when(t == "down", 10).when(t == "up", -10).otherwise(0)
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), s))
    signal = (F.when((s >= bullish) & t.isin("down", "neutral"), "bullish")
              .when((s <= bearish) | (t == "up"), "bearish").otherwise("neutral"))
    m2 = F.col("m2_growth")
    m2s = (F.when(m2.between(8, 12), 100.0).when(m2 < 8, F.greatest(F.lit(0.0), 50 + (m2 - 5) * 10))
           .otherwise(F.greatest(F.lit(0.0), 100 - (m2 - 12) * 5)))
    sh = F.greatest(F.lit(0.0), 100 - F.col("shibor_1w") * 30)
    return readings.withColumns({"timing_signal": signal,
                                 "timing_score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), sh * 0.6 + m2s * 0.4))})


def market_overview(df: DataFrame) -> DataFrame:
    day = df.groupBy(DATE).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("v"))
    codes = df.agg(F.countDistinct(CODE).alias("total_stocks")).withColumn("_k", F.lit(1))
    return day.agg(
        F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.max_by("n", DATE).alias("latest_active"),
        F.max_by("v", DATE).alias("latest_volume"), F.avg("v").alias("avg_daily_volume"), F.max("v").alias("max_volume"),
        F.min_by(DATE, F.struct(-F.col("v"), F.col(DATE))).alias("busiest_date")).withColumn("_k", F.lit(1)).join(codes, "_k").drop("_k")


def sector_performance(df: DataFrame, min_rows: int = 20) -> DataFrame:
    """Return, volatility and Sharpe per code, then per board."""
    x = df.withColumn("_r", div(close(), lag("close")) - 1)
    per = x.groupBy(CODE).agg(
        F.count(F.lit(1)).alias("n"), (div(F.max_by("close", DATE), F.min_by("close", DATE)) - 1).alias("ret"),
        (F.stddev_samp("_r") * F.sqrt(F.lit(252.0))).alias("vola"), (F.avg("_r") * 252).alias("mean"))
    per = per.where(F.col("n") >= min_rows).withColumns({
        "sector": board(), "sharpe": F.when(F.col("vola") > 0, (F.col("mean") - 0.03) / F.col("vola")).otherwise(0.0)})
    out = per.groupBy("sector").agg(
        F.count(F.lit(1)).alias("stock_count"), F.avg("ret").alias("avg_return"), F.avg("vola").alias("avg_volatility"),
        F.avg("sharpe").alias("avg_sharpe"), F.max("ret").alias("best_return"), F.min("ret").alias("worst_return"),
        (F.sum(_flag(F.col("ret") > 0)) / F.count(F.lit(1))).alias("positive_ratio"))
    med = quantiles(per, ["sector"], "ret", {"median_return": 0.5}).drop("n")
    return out.join(med, "sector")


def trading_patterns(df: DataFrame, min_rows: int = 60) -> DataFrame:
    """Moments of daily returns, extreme shares and high-volume days; codes with enough rows.

    Skewness and kurtosis carry the small-sample correction.
    """
    x = df.withColumns({"_r": div(close(), lag("close")) - 1, "_vr": div(vol(), rmean(vol(), 20)),
                        "_n": F.count(F.lit(1)).over(Window.partitionBy(CODE))}).where(F.col("_n") >= min_rows)
    r = F.col("_r")
    a = x.agg(F.count(r).cast("double").alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"),
              F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"),
              F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("positive_days"),
              F.avg(F.when(r.isNotNull(), (r > 0.099).cast("double"))).alias("up_10pct"),
              F.avg(F.when(r.isNotNull(), (r < -0.099).cast("double"))).alias("down_10pct"),
              F.sum(_flag(F.col("_vr") > 2)).alias("high_volume_days"))
    n = F.col("n")
    return a.select(
        "mean", "std", (F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        (((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
        "positive_days", "up_10pct", "down_10pct", "high_volume_days")
