"""Seven-part limit-up score of each code's newest bar and the probability that goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import tails as T
from tidemark.functions.interpolation import interpolate
from tidemark.functions.windows import DATE, div, lag, rmax, rmin

# fixed values: score, probability in percent
PROBABILITY = [(90, 18), (85, 14), (80, 10), (75, 7), (70, 5), (65, 3), (60, 2), (55, 1), (50, 0.5), (45, 0.3), (40, 0.2), (35, 0.1),
               (30, 0.05), (25, 0.02), (20, 0.01), (15, 0.005), (10, 0.002), (5, 0.001), (0, 0)]
PARTS = ("ma_score", "rsi_score", "macd_score", "kdj_score", "boll_score", "volume_score", "momentum_score")


def _rsi(n: int) -> Column:
    d = T.tail("_delta", n)
    gain, loss = T.mean(F.transform(d, lambda x: F.greatest(x, F.lit(0.0)))), T.mean(F.transform(d, lambda x: F.greatest(-x, F.lit(0.0))))
    return F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))


def _kdj() -> Column:
    """``k, d`` from 50 on: ``k`` from the ninth bar held, ``d`` from the third ``k``."""
    def step(s: Column, x: Column) -> Column:
        k = s["k"] * (2 / 3) + x * (1 / 3)
        return F.struct((s["i"] + 1).alias("i"), k.alias("k"), F.when(s["i"] >= 2, s["d"] * (2 / 3) + k * (1 / 3)).otherwise(s["d"]).alias("d"))
    return F.aggregate(F.slice(T.series("_rsv"), 9, F.greatest(T.size() - 8, F.lit(0))), F.struct(F.lit(0).alias("i"), F.lit(50.0).alias("k"), F.lit(50.0).alias("d")), step)


def _whole(c: Column, by: int, most: int) -> Column:
    return F.least(F.lit(most), F.floor(c / by).cast("int"))


def limit_up_indicators(bars: DataFrame, as_of=None, keep: int = 120) -> DataFrame:
    """Indicators of each code's newest bar over its last ``keep`` bars; codes with fewer than 30 are left out."""
    span_low, span = rmin("low", 9), rmax("high", 9) - rmin("low", 9)
    b = bars.withColumns({"_delta": F.col("close") - lag("close"), "_log": F.log("close") - F.log(lag("close")),
                          "_rsv": F.when(span == 0, 50.0).otherwise(div(F.col("close") - span_low, span) * 100)})
    t = T.newest_bars(b, keep, ["close", "volume", "_delta", "_log", "_rsv"], as_of).where(T.size() >= 30)
    n = T.size()
    middle, width = T.tail("close", _whole(n, 2, 20)), T.tail("volume", 5)
    flow = F.transform(F.arrays_zip(T.tail("_delta", 4).alias("d"), T.tail("volume", 4).alias("v")), lambda x: F.signum(x["d"]) * x["v"])
    t = t.withColumns({
        DATE: T.at(DATE), "close": T.at("close"), **{f"ma{k}": T.mean(T.tail("close", k)) for k in (5, 10, 20, 60)},
        "rsi6": _rsi(6), "rsi12": _rsi(12), "rsi24": _rsi(24), "_macd": T.macd("close", _whole(n, 3, 12), _whole(n, 2, 26), _whole(n, 4, 9)), "_kdj": _kdj(),
        "bb_middle": T.mean(middle), "_dev": T.deviation(middle, 0), "volume_ratio": (div(T.at("volume"), T.mean(width)) - 1) * 100,
        "obv_trend": F.when(F.forall(flow, lambda x: x >= 0), "rising").when(F.forall(flow, lambda x: x <= 0), "falling").otherwise("neutral"),
        **{f"momentum_{k}": (div(T.at("close"), T.at("close", k)) - 1) * 100 for k in (5, 10, 20)},
        "volatility": T.deviation(T.tail("_log", 20), 0) * (252 ** 0.5) * 100})
    t = t.withColumns({"macd": F.col("_macd.line"), "macd_signal": F.col("_macd.signal"), "kdj_k": F.col("_kdj.k"), "kdj_d": F.col("_kdj.d"),
                       "bb_upper": F.col("bb_middle") + 2 * F.col("_dev"), "bb_lower": F.col("bb_middle") - 2 * F.col("_dev")})
    t = t.withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d"),
                       "bb_position": F.when(F.col("_dev") > 0, (F.col("close") - F.col("bb_lower")) / (4 * F.col("_dev"))).otherwise(0.5)})
    return t.drop(T.BARS, "_macd", "_kdj", "_dev")


def _first(*cases: tuple[Column, float], other: float = 0) -> Column:
    out = F.when(F.lit(False), 0.0)
    for test, score in cases:
        out = out.when(test, F.lit(float(score)))
    return out.otherwise(F.lit(float(other)))


def limit_up_score(rows: DataFrame) -> DataFrame:
    """The seven parts, their sum ``total_score`` (0 to 100) and ``probability`` in percent, from the indicators."""
    c = F.col
    p, m5, m10, m20, m60 = c("close"), c("ma5"), c("ma10"), c("ma20"), c("ma60")
    short, long_ = (m5 > m10) & (m10 > m20), (m5 > m10) & (m10 > m20) & (m20 > m60)
    r, line, sig, hist, k, d, j = c("rsi6"), c("macd"), c("macd_signal"), c("macd_hist"), c("kdj_k"), c("kdj_d"), c("kdj_j")
    pos, ratio, trend, vol = c("bb_position"), c("volume_ratio"), c("obv_trend"), c("volatility")
    up = _first((ratio > 200, 18), (ratio > 150, 15), (ratio > 100, 12), (ratio > 50, 8), (ratio > 20, 5), (ratio > 0, 3))
    five, ten = c("momentum_5"), c("momentum_10")
    pace = (_first((five > 15, 12), (five > 10, 10), (five > 5, 7), (five > 2, 4), (five > 0, 2)) + _first((ten > 10, 3), (ten > 5, 2), (ten > 2, 1))
            + _first((vol > 70, -3), (vol > 50, -1), (vol < 10, -2)))
    rows = rows.withColumns({
        "ma_score": _first((long_ & (p > m5 * 1.02), 15), (long_ & (p > m5), 13), (short & (p > m5), 10), ((m5 > m10) & (p > m5 * 1.01), 7), (m5 > m10, 5), (p > m20, 3), other=1),
        "rsi_score": _first((r == 0, 0), (r.between(58, 65), 15), ((r > 65) & (r <= 72), 12), ((r >= 50) & (r < 58), 9), ((r > 72) & (r <= 80), 8), ((r >= 40) & (r < 50), 5), (r < 30, 3), other=2),
        "macd_score": _first(((hist > 0) & (line > 0) & (hist > sig * 0.1), 15), ((hist > 0) & (line > 0), 12), (hist > 0, 9), (F.abs(hist) < 0.001, 2)),
        "kdj_score": _first((k == 0, 0), (k.between(55, 68) & (k > d) & (j > k), 10), (k.between(55, 70) & (k > d), 8), (k.between(50, 65), 6), ((k > d) & (k > 45), 5), (k.between(30, 50), 3), (k < 20, 2), other=1),
        "boll_score": _first((pos >= 0.90, 10), (pos >= 0.80, 8), (pos >= 0.65, 6), (pos >= 0.50, 4), (pos >= 0.35, 2)),
        "volume_score": F.greatest(F.least(up + _first((trend == "rising", 2), (trend == "falling", -3)), F.lit(20.0)), F.lit(0.0)),
        "momentum_score": F.greatest(F.least(pace, F.lit(15.0)), F.lit(0.0))})
    rows = rows.withColumn("total_score", sum((F.col(x) for x in PARTS[1:]), F.col(PARTS[0])))
    return rows.withColumn("probability", F.round(interpolate(F.col("total_score"), PROBABILITY), 2))
