"""What became of picks: fall since the pick, its market and own part, shared falls, and factors that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, div, lag

FACTORS = ("momentum", "volume", "fund_flow", "technical")


def pick_drawdowns(picks: DataFrame, bars: DataFrame) -> DataFrame:
    """Each pick with a bar on its date and a code of two bars at least: change to the newest close, in percent, and reasons.

    ``market_part`` is the code's slope on the mean return of all codes times the market's returns since the pick, ``own_part``
    the rest. The slope comes from sums that merge, so a code's bars never meet in one place; a flat market or a single
    return gives slope 0.
    """
    held = [f for f in FACTORS if f in picks.columns]
    b = bars.select(CODE, DATE, "close").withColumn("_ret", div(F.col("close"), lag("close")) - 1)
    market = b.groupBy(DATE).agg(F.avg("_ret").alias("_mkt"))
    level = market.select(F.col(DATE).alias("_day"), "_mkt", F.sum("_mkt").over(Window.orderBy(DATE)).alias("_level"))  # one row per date
    paired = b.join(level, b[DATE] == level["_day"])
    codes = paired.groupBy(CODE).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("close", DATE).alias("current_price"), F.max_by("_level", DATE).alias("_end"),
        F.coalesce(F.regr_slope("_ret", "_mkt"), F.lit(0.0)).alias("beta")).where("_n >= 2")
    entry = paired.select(CODE, F.col(DATE).alias("pick_date"), F.col("close").alias("pick_price"), F.col("_level").alias("_start"))
    out = picks.join(entry, [CODE, "pick_date"]).join(codes, CODE)
    out = out.withColumn("drawdown", div(F.col("current_price") - F.col("pick_price"), F.col("pick_price")) * 100)
    out = out.withColumn("market_part", F.col("beta") * (F.coalesce("_end", F.lit(0.0)) - F.coalesce("_start", F.lit(0.0))) * 100)
    fall = F.col("drawdown")
    reasons = [F.when(fall < -9, "at_or_near_limit_down").when(fall < -5, "large_fall")]
    if "momentum" in held:
        reasons.append(F.when((F.col("momentum") > 80) & (fall < -5), "momentum_failed"))
    if held:
        thin = F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) if "volume" in held else F.lit(0.0)
        reasons.append(F.when(thin < 30, "illiquid"))
    return out.withColumns({"own_part": fall - F.col("market_part"), "reasons": F.concat_ws(",", *reasons)}).drop("_n", "_end", "_start")


def shared_falls(drawdowns: DataFrame) -> DataFrame:
    """Per pick date: mean change, share of falls over 5 %, and the systematic share that goes with it."""
    g = drawdowns.groupBy("pick_date").agg(F.count("drawdown").alias("n"), F.avg("drawdown").alias("average_drawdown"),
                                           F.count_if(F.col("drawdown") < -5).alias("large_drawdown_count"))
    share = div(F.col("large_drawdown_count"), F.col("n"))
    return g.withColumns({
        "large_drawdown_ratio": share,
        "systematic_ratio": F.when(share > 0.5, 0.7).when(share > 0.3, 0.5).otherwise(0.3),
        "idiosyncratic_ratio": F.when(share > 0.5, 0.3).when(share > 0.3, 0.5).otherwise(0.7),
        "conclusion": F.when(share > 0.5, "systematic").when(share > 0.3, "both").otherwise("idiosyncratic")})


def failed_factors(drawdowns: DataFrame, high: float = 70.0, fail: float = -3.0) -> DataFrame:
    """Per pick date and factor: picks that scored over ``high``, their mean change, and whether it is below ``fail``."""
    held = [f for f in FACTORS if f in drawdowns.columns]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("score")) for f in held])).alias("f")
    rows = drawdowns.select("pick_date", "drawdown", each).where(F.col("f.score") > high)
    g = rows.groupBy("pick_date", F.col("f.factor").alias("factor")).agg(F.count(F.lit(1)).alias("high_score_count"), F.avg("drawdown").alias("average_drawdown"))
    return g.withColumn("failure_detected", F.col("average_drawdown") < fail)
