"""Key price levels and cumulative volume delta.

Readings at a date use one conditional aggregate over each code's newest 60
bars (a bounded set), not one scan and join per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, close, div, high, lag, low, open_, rmean, vol, wc, wc_desc


def _newest(bars: DataFrame, as_of: str | None, n: int) -> DataFrame:
    b = bars.where(F.col(DATE) <= F.lit(as_of).cast("date")) if as_of else bars
    return b.withColumn("_rn", F.row_number().over(wc_desc())).where(F.col("_rn") <= n)


def _in(n: int, c: Column | str) -> Column:
    return F.when(F.col("_rn") <= n, F.col(c) if isinstance(c, str) else c)


def _at(k: int, c: str) -> Column:
    return F.max(F.when(F.col("_rn") == k, F.col(c)))


def key_levels(bars: DataFrame, as_of: str | None = None, zones: bool = False) -> DataFrame:
    """Averages, supports, resistances, bands and pivots per code at a date.

    Statistics use the rows available.  ``zones`` adds demand and supply zones,
    the consolidation flag, strong-candle volume and the volume ratio.
    """
    x = _newest(bars, as_of, 60)
    body = F.when(high() != low(), F.abs(close() - open_()) / (high() - low())).otherwise(0.0)
    x = x.withColumn("_body", body)
    aggs = [F.max(F.when(F.col("_rn") == 1, F.col(DATE))).alias(DATE)]
    aggs += [_at(1, c).alias(n) for c, n in (("open", "open"), ("close", "price"), ("high", "high"), ("low", "low"), ("volume", "volume"))]
    aggs += [F.avg(_in(n, "close")).alias(f"ma{n}") for n in (5, 10, 20, 60)]
    aggs += [F.min(_in(n, "low")).alias(f"support_{n}d") for n in (5, 20, 60)]
    aggs += [F.max(_in(n, "high")).alias(f"resistance_{n}d") for n in (5, 20, 60)]
    aggs += [F.percentile("low", 0.1).alias("support_strong"), F.percentile("high", 0.9).alias("resistance_strong"),
             F.coalesce(F.stddev_samp(_in(20, "close")), F.lit(0.0)).alias("std_20"), F.avg(_in(5, "volume")).alias("_vol5"),
             *[_at(2, c).alias(f"prev_{c}") for c in ("high", "low", "close")]]
    if zones:
        strong = (F.col("_body") > 0.7) & (F.abs(div(close() - open_(), open_())) > 0.03)
        aggs += [F.min(F.when(strong, low())).alias("demand_zone"), F.max(F.when(strong, high())).alias("supply_zone"),
                 F.avg(F.when(F.col("_body") > 0.6, vol())).alias("strong_candle_vol"),
                 F.when(div(F.stddev_samp(_in(20, "close")), F.avg(_in(20, "close"))) < 0.05, 1).otherwise(0).alias("is_consolidating"),
                 F.avg(_in(20, high() - low())).alias("avg_daily_range")]
    r = x.groupBy(CODE).agg(*aggs)
    p = (F.col("high") + F.col("low") + F.col("price")) / 3.0
    r = r.withColumns({
        "bb_upper": F.col("ma20") + 2 * F.col("std_20"), "bb_lower": F.col("ma20") - 2 * F.col("std_20"),
        "pivot": p, "pivot_r1": 2.0 * p - F.col("low"), "pivot_s1": 2.0 * p - F.col("high"),
        "change_pct": div(F.col("price") - F.col("prev_close"), "prev_close") * 100})
    if zones:
        r = r.withColumns({
            "demand_zone": F.coalesce("demand_zone", "low"), "supply_zone": F.coalesce("supply_zone", "high"),
            "strong_candle_vol": F.coalesce("strong_candle_vol", F.col("volume").cast("double")), "vol_ratio": div("volume", "_vol5")})
    return r.drop("_vol5")


def level_changes(today: DataFrame, previous: DataFrame, band: float = 2.0) -> DataFrame:
    """Change of the strong levels against the previous day's levels, with up / down / flat status."""
    prev = previous.select(CODE, *[F.col(c).alias(f"prev_{c}") for c in ("support_strong", "resistance_strong", "ma20", "ma60")])
    x = today.join(prev, CODE, "left")
    for n in ("support", "resistance"):
        chg = div(F.col(f"{n}_strong") - F.col(f"prev_{n}_strong"), f"prev_{n}_strong") * 100
        x = x.withColumn(f"{n}_change", chg)
        c = F.col(f"{n}_change")
        x = x.withColumn(f"{n}_status", F.when(c > band, "up").when(c < -band, "down").otherwise("flat"))
    return x


def level_history(history: DataFrame, levels: DataFrame, min_codes: int = 100) -> DataFrame:
    """History with one day's levels upserted; dates covering too few codes drop out."""
    from tidemark.sources.bars import upsert
    merged = upsert(history, levels)
    full = merged.groupBy(DATE).agg(F.countDistinct(CODE).alias("_n")).where(F.col("_n") > min_codes).select(DATE)
    return merged.join(full, DATE, "left_semi")


# Fibonacci levels.
FIBONACCI = [0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]


def extended_levels(bars: DataFrame, as_of: str | None = None, lookback: int | None = None) -> DataFrame:
    """Swing levels, pivots R1-R3 / S1-S3, Fibonacci levels, zones and the price position per code.

    A shorter series falls back from the 60- to the 20-, 10- and 5-bar average;
    codes under five bars drop out.  ``lookback`` limits the series.
    """
    b = bars.where(F.col(DATE) <= F.lit(as_of).cast("date")) if as_of else bars
    w = wc()
    prior = F.row_number().over(w) - 1
    x = b.withColumns({
        "_i": prior, "_rn": F.row_number().over(wc_desc()), "_pl": F.min("low").over(w.rowsBetween(-4, -1)),
        "_ph": F.max("high").over(w.rowsBetween(-4, -1))})
    x = x.where(F.col("_rn") <= lookback) if lookback else x
    swing = F.col("_i") >= 5
    aggs = [F.count(F.lit(1)).alias("_n"), F.max(DATE).alias(DATE)]
    aggs += [_at(1, c).alias(f"_{c}") for c in ("open", "high", "low", "close")]
    aggs += [F.avg(_in(n, "close")).alias(f"_ma{n}") for n in (5, 10, 20, 60)]
    aggs += [F.min(_in(20, "low")).alias("support_low"), F.max(_in(20, "high")).alias("resistance_high"),
             F.min(F.when(swing & (F.col("low") <= F.col("_pl")), low())).alias("_sr"),
             F.max(F.when(swing & (F.col("high") >= F.col("_ph")), high())).alias("_rr"),
             F.max(_in(60, "close")).alias("_ch"), F.min(_in(60, "close")).alias("_cl"), F.stddev_pop(_in(20, "close")).alias("_sd"),
             F.percentile(_in(60, "low"), 0.1).alias("_ss"), F.percentile(_in(60, "high"), 0.9).alias("_rs"),
             F.max(_in(5, "high")).alias("pressure_5day"), F.min(_in(5, "low")).alias("support_5day"),
             *[_at(2, c).alias(f"prev_{c}") for c in ("high", "low", "close")]]
    r = x.groupBy(CODE).agg(*aggs).where(F.col("_n") >= 5)
    n, c, h, lo = F.col("_n"), F.col("_close"), F.col("_high"), F.col("_low")
    r = r.withColumn("ma5", F.col("_ma5")).withColumn("ma10", F.when(n >= 10, F.col("_ma10")).otherwise(F.col("ma5")))
    r = r.withColumn("ma20", F.when(n >= 20, F.col("_ma20")).otherwise(F.col("ma10")))
    r = r.withColumn("ma60", F.when(n >= 60, F.col("_ma60")).otherwise(F.col("ma20")))
    p, rng = (h + lo + c) / 3, h - lo
    r = r.withColumns({
        "support_recent": F.coalesce("_sr", "support_low"), "resistance_recent": F.coalesce("_rr", "resistance_high"),
        "pivot": p, "pivot_r1": 2 * p - lo, "pivot_r2": p + rng, "pivot_r3": p + 2 * rng,
        "pivot_s1": 2 * p - h, "pivot_s2": p - rng, "pivot_s3": p - 2 * rng,
        "_ssz": F.when(n >= 60, F.col("_ss")).otherwise(F.col("support_low")),
        "_srz": F.when(n >= 60, F.col("_rs")).otherwise(F.col("resistance_high")),
        "bb_upper": F.when(n >= 20, F.col("ma20") + 2 * F.col("_sd")).otherwise(c),
        "bb_lower": F.when(n >= 20, F.col("ma20") - 2 * F.col("_sd")).otherwise(c)})
    fib = F.create_map(*[v for f in FIBONACCI for v in (
        F.lit(f"fib_{int(f * 1000)}"), F.round(F.col("_cl") + (F.col("_ch") - F.col("_cl")) * f, 2))])
    zone = (F.col("_srz") - F.col("_ssz")) * 0.1
    r = r.withColumns({
        "fibonacci": F.when(n >= 60, fib), "core_zone_low": F.round(F.col("pivot") - zone, 2), "core_zone_high": F.round(F.col("pivot") + zone, 2),
        "price_position": (F.when(c > F.col("_srz"), "above_resistance").when(c < F.col("_ssz"), "below_support")
                           .when(c > F.col("pivot_r1"), "strong_uptrend").when(c < F.col("pivot_s1"), "strong_downtrend").otherwise("neutral"))})
    r = r.withColumn("in_core_zone", (c >= F.col("core_zone_low")) & (c <= F.col("core_zone_high")))
    return r.withColumnsRenamed({"_close": "close", "_high": "high", "_low": "low", "_open": "open", "_ssz": "strong_support_zone",
                                 "_srz": "strong_resistance_zone"}).drop(*[f"_ma{k}" for k in (5, 10, 20, 60)], "_n", "_sr", "_rr", "_ch", "_cl", "_sd", "_ss", "_rs")


def session_levels(levels: DataFrame) -> DataFrame:
    """Today's pressures, supports, triggers and distances from :func:`extended_levels`; previous bar is the last one traded."""
    c, h, lo, o = (F.col(x) for x in ("close", "high", "low", "open"))
    ph = F.coalesce("prev_high", h)
    x = levels.withColumns({
        "strong_pressure": F.greatest(h, ph), "strong_support": F.least(lo, o), "limit_up_price": c * 1.1,
        "day_fib_382": lo + (h - lo) * 0.382, "day_fib_500": lo + (h - lo) * 0.5, "day_fib_618": lo + (h - lo) * 0.618})
    return x.withColumns({f"dist_to_{k}": div(c - F.col(k), k) * 100 for k in ("strong_pressure", "strong_support", "ma20", "ma60")})


# -- cumulative volume delta --------------------------------------------------


def cvd_series(bars: DataFrame, lookback: int = 60) -> DataFrame:
    """Daily delta by body and by close position, their running sums over ``lookback`` + 1 bars, and changes."""
    rng = high() - low()
    body = F.when(rng == 0, 0.0).otherwise((close() - open_()) / rng)
    pos = F.when(rng == 0, 0.5).otherwise((close() - low()) / rng)
    x = bars.select(CODE, DATE, "close", "volume", (vol() * body).alias("delta_body"), (vol() * (2 * pos - 1)).alias("delta_position"))
    x = x.withColumn("delta_combined", (F.col("delta_body") + F.col("delta_position")) / 2)
    frame = wc().rowsBetween(-lookback, 0)
    x = x.withColumns({f"cvd_{n}": F.sum(f"delta_{n}").over(frame) for n in ("body", "position", "combined")})
    lags = {f"_c{k}": lag("cvd_body", k) for k in (1, 5, 10)} | {f"_p{k}": lag("close", k) for k in (5, 10)}
    x = x.withColumns(lags)
    c = F.col("cvd_body")
    x = x.withColumns({f"cvd_change_{k}d": c - F.coalesce(F.col(f"_c{k}"), c) for k in (1, 5, 10)})

    def divergence(k: int) -> Column:
        up, dn = F.col("close") > F.col(f"_p{k}"), F.col("close") < F.col(f"_p{k}")
        return (F.when(up & (c < F.col(f"_c{k}")), "top_divergence").when(dn & (c > F.col(f"_c{k}")), "bottom_divergence")
                .otherwise("no_divergence"))

    ch5 = F.col("cvd_change_5d")
    return x.withColumns({
        "cvd_signal": F.when(c > 0, "buy_dominant").when(c < 0, "sell_dominant").otherwise("neutral"),
        "cvd_trend": (F.when((c > 0) & (ch5 > 0), "strong_buy").when(c > 0, "weak_buy").when((c < 0) & (ch5 < 0), "strong_sell")
                      .when(c < 0, "weak_sell").otherwise("neutral")),
        "divergence_5d": divergence(5), "divergence_10d": divergence(10)}).drop("_c1", "_c5", "_c10", "_p5", "_p10")


def cvd_short(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Short form per code over the last ``lookback`` + 10 bars: sums, 5- and 10-day parts, trend and signal."""
    x = _newest(bars, None, lookback + 10)
    rng = high() - low()
    x = x.withColumn("_d", F.when(rng == 0, 0.0).otherwise(vol() * ((close() - open_()) / rng)))

    def part(a: int, b: int) -> Column:
        return F.sum(F.when(F.col("_rn").between(a, b), F.col("_d")))

    g = x.groupBy(CODE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_d").alias("cvd_cumsum"), F.avg("_d").alias("cvd_mean"), part(1, 5).alias("_5"),
        part(1, 10).alias("_10"), part(1, 3).alias("_r"), part(4, 6).alias("_p"))
    n = F.col("n")
    prev = F.when(n >= 6, F.col("_p")).otherwise(F.col("_r"))
    return g.select(
        CODE, "cvd_cumsum", "cvd_mean", F.when(n >= 5, F.col("_5")).otherwise(0.0).alias("cvd_5d"),
        F.when(n >= 10, F.col("_10")).otherwise(0.0).alias("cvd_10d"),
        F.when(n < 5, "neutral").when(F.col("_r") > prev, "up").otherwise("down").alias("cvd_trend"),
        F.when(F.col("cvd_cumsum") > 0, "buy_dominant").when(F.col("cvd_cumsum") < 0, "sell_dominant").otherwise("neutral").alias("signal"))


def stance(levels: DataFrame, cvd: DataFrame) -> DataFrame:
    """Position score + CVD score → conclusion; inputs :func:`key_levels` and :func:`cvd_short`."""
    x = levels.join(cvd, CODE)
    p = F.col("price")

    def one(c: Column) -> Column:
        return F.when(c, 1).otherwise(0)

    pos = sum((one(p > F.col(m)) for m in ("ma5", "ma20", "ma60")), F.lit(0)) + one((F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")))
    flow = (F.when(F.col("signal") == "buy_dominant", 2).when(F.col("signal") == "sell_dominant", -2).otherwise(0)
            + F.when(F.col("cvd_trend") == "up", 1).when(F.col("cvd_trend") == "down", -1).otherwise(0))
    x = x.withColumns({"position_score": pos, "cvd_score": flow}).withColumn("total_score", F.col("position_score") + F.col("cvd_score"))
    t = F.col("total_score")
    return x.withColumns({
        "conclusion": (F.when(t >= 4, "bullish").when(t >= 2, "leaning_bullish").when(t >= 0, "neutral").when(t >= -2, "leaning_bearish")
                       .otherwise("bearish")),
        "distance_to_resistance": div(F.col("resistance_20d") - p, p) * 100, "distance_to_support": div(p - F.col("support_20d"), p) * 100})


def _join_texts(*parts: Column, otherwise: str) -> Column:
    text = F.concat_ws(" | ", *parts)
    return F.when(text == "", otherwise).otherwise(text)


def conclusions(df: DataFrame) -> DataFrame:
    """Text conclusions from levels with changes and CVD columns joined."""
    p, s, r = F.col("price"), F.col("support_strong"), F.col("resistance_strong")
    levels = _join_texts(
        F.when(p <= s * 1.05, "near strong support"), F.when(p >= r * 0.95, "near strong resistance"),
        F.when(F.col("support_status") == "up", "support moved up").when(F.col("support_status") == "down", "support moved down"),
        F.when((F.col("ma20") > F.col("ma60")) & (p > F.col("ma20")), "averages bullish")
        .when((F.col("ma20") < F.col("ma60")) & (p < F.col("ma20")), "averages bearish"), otherwise="levels normal")
    cvd = _join_texts(
        F.when(F.col("cvd_signal") == "buy_dominant", "buyers dominate").when(F.col("cvd_signal") == "sell_dominant", "sellers dominate"),
        F.when(F.col("cvd_trend") != "neutral", F.col("cvd_trend")),
        F.when(F.col("divergence_5d") != "no_divergence", F.col("divergence_5d")),
        F.when(F.col("cvd_change_5d") > 0, "5d inflow").when(F.col("cvd_change_5d") < 0, "5d outflow"), otherwise="cvd neutral")
    return df.withColumns({"levels_conclusion": levels, "cvd_conclusion": cvd})


def trend_and_position(bars: DataFrame, period: int = 60) -> DataFrame:
    """Trend class, and the close inside the range of closes of the last ``period`` bars."""
    x = bars.withColumns({f"_m{n}": rmean(close(), n) for n in (5, 10, 20)})
    f = wc().rowsBetween(-(period - 1), 0)
    x = x.withColumns({"_n": F.count("close").over(f), "_lo": F.min("close").over(f), "_hi": F.max("close").over(f)})
    a, b, c = F.col("_m5"), F.col("_m10"), F.col("_m20")
    trend = (F.when(c.isNull(), "unknown").when((a > b) & (b > c), "uptrend").when((a < b) & (b < c), "downtrend")
             .when(a > c, "weak_uptrend").otherwise("weak_downtrend"))
    full = F.col("_n") >= period
    pos = F.when(F.col("_hi") > F.col("_lo"), (close() - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return x.select(CODE, DATE, trend.alias("trend"), F.when(full, F.col("_lo")).alias("support"), F.when(full, F.col("_hi")).alias("resistance"),
                    F.when(full, pos).alias("position"), F.when(full, div(close() - F.col("_lo"), close()) * 100).alias("distance_to_support"),
                    F.when(full, div(F.col("_hi") - close(), close()) * 100).alias("distance_to_resistance"))
