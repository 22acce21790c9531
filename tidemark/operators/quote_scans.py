"""Nine scans of live quotes against daily history; stateless, so a batch and a stream of quotes use the same code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, latest_rows, rmean, rmax, wc

#: Share of the limit from which a quote counts as at its limit.
AT_LIMIT = 0.98


def history_features(bars: DataFrame) -> DataFrame:
    """Per code at its newest bar: bars known (at most 60), averages, 60-day high, mean volume of the 5 bars before the last.

    The 60-day average falls back to the one of 20 days; the high is that of the bars there are.
    """
    x = bars.select(CODE, DATE, "high", "close", F.col("volume").cast("double").alias("volume"))
    before = wc().rowsBetween(-5, -1)
    x = x.withColumns({
        "n_bars": F.least(F.lit(60), F.row_number().over(wc())), "ma5": rmean("close", 5), "ma10": rmean("close", 10), "ma20": rmean("close", 20),
        "ma60": F.coalesce(rmean("close", 60), rmean("close", 20)), "high_60d": rmax("high", 60, min_rows=1),
        "avg_vol_5": F.when(F.count("volume").over(before) == 5, F.avg("volume").over(before))})
    return latest_rows(x, "n_bars", "ma5", "ma10", "ma20", "ma60", "high_60d", "avg_vol_5")


def _steps(*cases: tuple[Column, float]) -> Column:
    """Points of the first case that holds, else 0."""
    out = F.lit(0.0)
    for cond, points in reversed(cases):
        out = F.when(cond, points).otherwise(out)
    return out


def quote_scans(quotes: DataFrame, features: DataFrame) -> DataFrame:
    """A row per quote and scan that it passes: all columns of the quote, ``signal`` and ``signal_score``.

    ``quotes``: ``code, price, change_pct, turnover_rate, volume, volume_ratio, amplitude, limit_pct, in_pool,
    consecutive_limit``. Optional in ``features``: ``key_level_score`` (50), ``is_breakout`` and ``near_support`` (false).
    Quotes without history pass only the scans that need none. A null fails the test that reads it.
    """
    c, keep = F.col, quotes.columns
    extra = {"key_level_score": F.lit(50.0), "is_breakout": F.lit(False), "near_support": F.lit(False)}
    known = {name: F.coalesce(c(name), default) if name in features.columns else default for name, default in extra.items()}
    x = quotes.join(features, CODE, "left")
    change, price, turnover = c("change_pct"), c("price"), c("turnover_rate")
    limit_up = F.coalesce(c("in_pool") & (change >= c("limit_pct") * AT_LIMIT), F.lit(False))
    rising = F.coalesce((c("ma5") > c("ma10")) & (c("ma10") > c("ma20")), F.lit(False))
    usual = F.coalesce("avg_vol_5", "volume")
    surge = F.when(usual > 0, c("volume") / usual).otherwise(0.0)
    left, level = c("limit_pct") - change, known["key_level_score"] - 50
    near_limit = (F.least(change, F.lit(9.0)) * 8 + _steps((left < 2, 30.0), (left < 5, 20.0), (left < 8, 10.0)) + _steps((rising, 15.0)) + _steps((price > c("ma20"), 10.0))
                  + _steps((surge > 2, 15.0), (surge > 1.5, 10.0)) + level * 0.2 + F.least(turnover, F.lit(15.0)) * 1.5)
    quality = (_steps((rising, 25.0)) + _steps((price > c("ma20"), 15.0)) + _steps((price < c("ma20") * 1.15, 10.0)) + _steps((surge > 1.5, 20.0))
               + _steps((known["near_support"], 15.0)) + level * 0.3 + F.least(change, F.lit(10.0)) * 2)
    scans = {
        "limit_up": (limit_up, 90.0 + F.coalesce("consecutive_limit", F.lit(1)) * 5),
        "fast_rise": ((change >= 5) & (change < c("limit_pct") * AT_LIMIT), change * 10),
        "volume_price": ((change >= 3) & (turnover >= 5) & (c("volume_ratio") >= 2), turnover * 20),
        "breakout_high": ((price > 0) & (change > 3) & (c("n_bars") >= 30) & (price >= c("high_60d") * 0.98), 80 + change * 5),
        "near_limit": (~limit_up & (price > 0) & (change > 5) & (turnover >= 5) & (c("n_bars") >= 20), near_limit),
        "reversal": (change.between(-3, 2) & (turnover >= 5) & (c("n_bars") >= 30) & (price < c("ma20") * 1.1) & (price > c("ma5")), 70 + change * 5),
        "high_turnover": ((turnover >= 10) & (change > 0), turnover * 5),
        "strong_signal": ((c("volume_ratio") > 2.5) & (c("amplitude") > 6.5) & (change > 2.44) & (c("n_bars") >= 30) & rising,
                          85 + c("volume_ratio") * 3 + level * 0.5 + _steps((known["is_breakout"], 15.0))),
        "quality_non_limit": (~limit_up & (price > 0) & (change > 0) & (turnover >= 3) & (c("amplitude") > 3) & (c("n_bars") >= 20), quality),
    }
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("signal"), score.cast("double").alias("signal_score"))) for name, (cond, score) in scans.items()]))
    return x.select(*[c(k) for k in keep], F.explode(found).alias("_s")).select(*keep, "_s.signal", "_s.signal_score")
