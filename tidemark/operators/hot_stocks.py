"""Hot-stock classes of each code's newest bar and the score that ranks them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, div, lag, latest_rows, rmean, with_runs
from tidemark.sources.bars import board_limit

# fixed values: points of the hot score
WEIGHTS = {"pct_change": 2.0, "pct_5d": 1.5, "pct_10d": 1.0, "pct_20d": 0.5, "vol_ratio": 5.0, "turnover_bonus": 3.0, "ma_bonus": 15.0, "limit_up_bonus": 30.0, "limit_up_20_bonus": 50.0}
CHANGES = {"pct_change": 1, "pct_5d": 5, "pct_10d": 10, "pct_20d": 20}
FIELDS = ["close", *CHANGES, "vol_ratio", "amplitude", "ma_bullish", "limit_pct", "turnover_rate", "consecutive_limit_days"]


def hot_stocks(bars: DataFrame, names: DataFrame, as_of, max_age: int = 30, weights: Mapping[str, float] = WEIGHTS, turnover: str = "turnover") -> DataFrame:
    """One row per valid code: the classes ``is_limit_up``, ``is_hot``, ``is_leading``, ``is_breakout`` and ``hot_score``.

    Valid are codes with 20 bars before, a price over 1.5, a change of at most 50 percent, a newest such bar at most ``max_age`` days
    before ``as_of``, and a name in ``names`` (``code, name``; none is fine) without a risk mark. A code's own board sets its limit.
    """
    c, limit, change = F.col("close"), F.col("limit_pct"), F.col("pct_change")
    x = bars.where(F.col(DATE) <= F.lit(as_of).cast("date")).withColumns({
        **{name: div(c - lag("close", k), lag("close", k)) * 100 for name, k in CHANGES.items()},
        "vol_ratio": div("volume", rmean("volume", 20)), "amplitude": div(F.col("high") - F.col("low"), lag("close")) * 100, **{f"_ma{n}": rmean("close", n) for n in (5, 10, 20)},
        "limit_pct": board_limit(), "turnover_rate": F.col(turnover).cast("double")})
    x = x.withColumns({"ma_bullish": F.coalesce((c > F.col("_ma5")) & (F.col("_ma5") > F.col("_ma10")) & (F.col("_ma10") > F.col("_ma20")), F.lit(False)),
                       "_limit": F.coalesce(change >= limit * 0.98, F.lit(False))})
    x = with_runs(x, "_limit", "consecutive_limit_days")
    x = x.where(F.col("pct_20d").isNotNull() & F.col("pct_10d").isNotNull() & F.col("pct_5d").isNotNull() & change.isNotNull() & F.col("vol_ratio").isNotNull() & (c > 1.5))
    x = latest_rows(x, DATE, *FIELDS).where(F.col(DATE) >= F.date_sub(F.lit(as_of).cast("date"), max_age))
    x = x.join(names.select(CODE, "name"), CODE, "left").where((~F.coalesce("name", F.lit("")).rlike("ST|退市")) & (F.abs("pct_change") <= 50))
    up = (change >= limit * 0.98) & (change > 0)
    ratio, w = F.col("vol_ratio"), weights
    gain = sum((F.greatest(F.col(k), F.lit(0.0)) * w[k] for k in CHANGES), F.lit(0.0)) + F.greatest(ratio - 1, F.lit(0.0)) * w["vol_ratio"]
    score = (gain + F.col("ma_bullish").cast("double") * w["ma_bonus"] + up.cast("double") * w["limit_up_bonus"] + (change >= limit * 0.99).cast("double") * w["limit_up_20_bonus"]
             + F.greatest(F.least(F.coalesce("turnover_rate", F.lit(0.0)), F.lit(20.0)), F.lit(0.0)) * w["turnover_bonus"] + F.col("consecutive_limit_days") * 10)
    return x.withColumns({"is_limit_up": up, "is_hot": (F.col("pct_5d") > 10) & (ratio > 1.5), "is_leading": F.col("pct_20d") > 30, "is_breakout": (ratio > 3) & (change > 5), "hot_score": score})


def top_hot(hot: DataFrame, top: int = 30) -> DataFrame:
    """The ``top`` codes by score."""
    return hot.orderBy(F.col("hot_score").desc(), CODE).limit(top)
