"""Swing signals: trend, pullback after a burst of volume, entry, stop and target at each code's newest bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import tails as T
from tidemark.functions.windows import CODE, DATE, div

FAST, SLOW, SIGNAL = 12, 26, 9


def _ema(xs: Column, n: int) -> Column:
    """Average that starts at the first value held."""
    return F.aggregate(xs, xs[0], lambda s, x: s + (x - s) * (2.0 / (n + 1)))


def _macd(xs: Column) -> Column:
    """``dif, dea``; both lines start at the mean of their first span, and fewer values than slow and signal span give zeros."""
    def step(s: Column, x: Column) -> Column:
        f, g = s["f"] + (x - s["f"]) * (2.0 / (FAST + 1)), s["g"] + (x - s["g"]) * (2.0 / (SLOW + 1))
        return F.struct(f.alias("f"), g.alias("g"), (s["d"] + (f - g - s["d"]) * (2.0 / (SIGNAL + 1))).alias("d"))

    f = F.aggregate(F.slice(xs, FAST + 1, SLOW - FAST), T.mean(F.slice(xs, 1, FAST)), lambda s, x: s + (x - s) * (2.0 / (FAST + 1)))
    g = T.mean(F.slice(xs, 1, SLOW))
    start = F.struct(f.alias("f"), g.alias("g"), (f - g).alias("d"))
    rest = F.slice(xs, SLOW + 1, F.greatest(F.size(xs) - SLOW, F.lit(0)))
    none = F.struct(F.lit(0.0).alias("dif"), F.lit(0.0).alias("dea"))
    return F.when(F.size(xs) < SLOW + SIGNAL, none).otherwise(F.aggregate(rest, start, step, lambda s: F.struct((s["f"] - s["g"]).alias("dif"), s["d"].alias("dea"))))


def _month_closes() -> Column:
    month = lambda d: F.trunc(d, "MM")
    dates = T.series(DATE)
    last = F.filter(F.col(T.BARS), lambda x, i: F.coalesce(month(F.try_element_at(dates, i + 2)) != month(x[DATE]), F.lit(True)))
    return F.transform(last, lambda x: x["close"])


def swing_signals(bars: DataFrame, as_of=None, keep: int = 250, least: int = 120, tolerance: float = 0.02) -> DataFrame:
    """One row per code with ``least`` bars or more, over its newest ``keep`` bars up to ``as_of``.

    The automaton's states are ``step1_passed`` (above the 60-day average, short averages in order), ``step2_passed`` (a pullback
    of 8 to 15 % on at most half the volume since a bar of more than twice its forerunner's volume among the last four; without
    such a bar, support at the 20-day average) and ``step3_passed`` (both); prices are 0 unless both hold. Monthly averages need
    35 months in the bars kept, and give no cross with fewer.

    The five bars of the volume ratio hold the burst itself, which is at most three bars back, so with a burst the ratio stays above 0.5
    and ``step2_passed`` false; kept as it is, since results must agree.
    """
    b = T.newest_bars(bars, keep, ["high", "close", "volume"], as_of).where(T.size() >= least)
    c = T.series("close")
    b = b.withColumns({DATE: T.at(DATE), "close": T.at("close"), "pct_chg": F.coalesce(div(T.at("close") - T.at("close", 1), T.at("close", 1)) * 100, F.lit(0.0)),
                       **{f"ema{n}": _ema(c, n) for n in (5, 10, 20, 60, 120)}, "_months": _month_closes(), "_day": _macd(c),
                       "_burst": F.coalesce(*[F.when((T.at("volume", k + 1) > 0) & (div(T.at("volume", k), T.at("volume", k + 1)) > 2.0), F.lit(k)) for k in range(4)])})
    months = F.col("_months")
    b = b.withColumns({"_month": _macd(months), "_before": _macd(F.slice(months, 1, F.size(months) - 1))})
    back, after = F.col("_burst"), F.col("_burst") > 0
    top = F.array_max(T.tail("high", back + 1))
    b = b.withColumns({
        "macd_dif": F.col("_day.dif"), "macd_dea": F.col("_day.dea"), "macd_hist": (F.col("_day.dif") - F.col("_day.dea")) * 2,
        "macd_golden_cross": (F.col("_before.dif") <= F.col("_before.dea")) & (F.col("_month.dif") > F.col("_month.dea")), "macd_above_zero": F.col("_month.dif") > 0,
        "price_vs_ema60": F.coalesce(div(F.col("close") - F.col("ema60"), "ema60") * 100, F.lit(0.0)),
        "pullback_pct": F.when(after, F.coalesce(div(top - T.at("high"), top) * 100, F.lit(0.0))).otherwise(0.0),
        "volume_shrink_ratio": F.when(after, F.coalesce(div(T.mean(T.tail("volume", 5)), T.mean(T.tail("volume", back))), F.lit(0.0))).otherwise(0.0),
        "ema20_support": F.array_min(T.tail("close", 5)).between(F.col("ema20") * (1 - tolerance), F.col("ema20") * (1 + tolerance)),
        "_target": F.when(back.isNotNull(), F.try_element_at(T.series("high"), -1 - back)).otherwise(T.at("close") * 1.08), "burst": back.isNotNull()})
    burst, p, ratio = F.col("burst"), F.col("pullback_pct"), F.col("volume_shrink_ratio")
    order = (F.col("ema5") > F.col("ema10")) & (F.col("ema10") > F.col("ema20"))
    b = b.withColumns({"step1_passed": (F.col("close") > F.col("ema60")) & order,
                       "step2_passed": F.when(burst, p.between(8.0, 15.0) & (ratio <= 0.5)).otherwise(F.col("ema20_support"))})
    one, two = F.col("step1_passed"), F.col("step2_passed")
    three = one & two
    num = lambda test, yes: F.when(test, F.lit(float(yes))).otherwise(0.0)
    b = b.withColumns({
        "step3_passed": three,
        "trend_score": F.when(one, 40.0 + num(F.col("ema20") > F.col("ema60"), 10) + F.when(F.col("macd_golden_cross"), 20.0).otherwise(num(F.col("macd_above_zero"), 5))).otherwise(0.0),
        "pullback_score": F.when(two & burst, 30.0 + num(p.between(10.0, 12.0), 5) + num(ratio <= 0.3, 5)).when(two, 15.0).otherwise(0.0), "volume_score": num(three, 20)})
    total = F.col("trend_score") + F.col("pullback_score") + F.col("volume_score")
    price = lambda v: F.when(F.col("step3_passed"), v).otherwise(0.0)
    return b.select(CODE, DATE, "close", "pct_chg", "ema5", "ema10", "ema20", "ema60", "ema120", "price_vs_ema60", "macd_dif", "macd_dea", "macd_hist", "macd_golden_cross", "macd_above_zero",
                    "burst", "pullback_pct", "volume_shrink_ratio", "ema20_support", "step1_passed", "step2_passed", "step3_passed", "trend_score", "pullback_score", "volume_score",
                    total.alias("total_score"), F.least(total, F.lit(100.0)).alias("confidence"), price(F.col("close")).alias("entry_price"), price(F.col("close") * 0.97).alias("stop_loss"),
                    price(F.col("_target")).alias("target_price"), price(F.lit(50.0)).alias("position_size"))
