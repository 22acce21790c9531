"""Selections by fund behaviour, the four-step exit rule, hedge flag and defence signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, div, lag

#: Thresholds of the hedge flag and of the defence signals.
HEDGE_VOLUME_RATIO, SUPPORT_LEVEL, RESISTANCE_LEVELS = 1.1, 4067.0, (4117.0, 4140.0)
VOLUME_SHRINK, OPEN_AUCTION_MIN, SUPPORT_BREAK, OVERHEATED, NEAR = 0.6, 500.0, -0.02, 85.0, 0.01


def _ranked(df: DataFrame, score: str, top: int | Column | None) -> DataFrame:
    """Rows of a day by falling score, ties by code; ranks up to ``top`` if asked for."""
    if top is None:
        return df
    rank = F.row_number().over(Window.partitionBy(DATE).orderBy(F.col(score).desc_nulls_last(), CODE))
    return df.withColumn("rank", rank).where(F.col("rank") <= top)


def trend_selection(df: DataFrame, top: int | None = None) -> DataFrame:
    """Rows above a rising 5-day average on growing volume, without codes of the science board, and ``composite_score``.

    ``df``: ``code, trade_date, close, factor_ma5_bias, factor_v_ratio10, factor_limit_up_score, factor_cost_peak``;
    ``ma5_slope`` is the change over five bars where the column is missing.
    """
    x = df if "ma5_slope" in df.columns else df.withColumn("ma5_slope", (div(F.col("close"), lag("close", 5)) - 1) * 100)
    bias, slope, ratio = F.col("factor_ma5_bias"), F.col("ma5_slope"), F.col("factor_v_ratio10")
    x = x.where((bias > 0) & (slope > 0) & (ratio > 1) & ~F.col(CODE).startswith("688"))
    x = x.withColumn("composite_score", bias * 0.3 + slope * 0.2 + ratio * 0.2 + F.col("factor_limit_up_score") * 0.15 + F.col("factor_cost_peak") * 0.15)
    return _ranked(x, "composite_score", top)


def short_term_selection(df: DataFrame, top: int | None = None) -> DataFrame:
    """Rows of limit-up mood or pioneers; where ``upward`` is not true, only strong ones on volume, and at most ten a day.

    ``df``: ``code, trade_date, upward, factor_limit_up_score, factor_pioneer_status, factor_ma5_bias, factor_v_ratio10``;
    ``is_limit_up`` is a limit-up score over 10 where the column is missing. The ten apply only where ``top`` is asked for.
    """
    up, mood, bias = F.coalesce("upward", F.lit(False)), F.col("factor_limit_up_score"), F.col("factor_ma5_bias")
    x = df.where(((mood > 0) | (F.col("factor_pioneer_status") > 0)) & ~F.col(CODE).startswith("688") & (up | ((bias > 0) & (F.col("factor_v_ratio10") > 1.5))))
    limit = (F.col("is_limit_up").cast("int") if "is_limit_up" in df.columns else (mood > 10).cast("int"))
    x = x.withColumn("short_term_score", limit * 100 + mood * 10 + F.least(F.lit(10.0), F.greatest(F.lit(0.0), bias)))
    return _ranked(x, "short_term_score", None if top is None else F.when(up, top).otherwise(min(top, 10)))


def four_step_exit(df: DataFrame) -> DataFrame:
    """``exit_ratio`` and ``action`` of a position at a time of day (``HH:MM``).

    ``df``: ``time, price, vwap, yesterday_close, is_limit_up_open, is_limit_up``. Unknown flags count as false, unknown
    prices never sell.
    """
    t = F.col("time")
    no = lambda flag: ~F.coalesce(flag, F.lit(False))
    action = (F.when((t == "09:26") & no("is_limit_up_open"), "sell_25").when((t > "10:00") & (t < "14:56") & (F.col("price") < F.col("vwap")), "sell_25_on_break")
              .when((t == "10:00") & no("is_limit_up"), "sell_25_at_10am").when((t == "14:56") & (no("is_limit_up") | (F.col("price") < F.col("yesterday_close"))), "clear_all").otherwise("hold"))
    x = df.withColumn("action", action)
    return x.withColumn("exit_ratio", F.when(F.col("action") == "hold", 0.0).when(F.col("action") == "clear_all", 1.0).otherwise(0.25))


def hedge_effect(df: DataFrame, support: float = SUPPORT_LEVEL, total: float = 2.8e12) -> DataFrame:
    """A row per day: means of volume ratio, market turnover and close, and whether all three are high enough."""
    g = df.groupBy(DATE).agg(F.avg("factor_v_ratio10").alias("avg_v_ratio10"), F.avg("factor_v_total").alias("avg_v_total"), F.avg("close").alias("avg_close"))
    holds = (F.col("avg_v_ratio10") > HEDGE_VOLUME_RATIO) & (F.col("avg_close") > support) & (F.col("avg_v_total") >= total)
    return g.withColumn("hedge", F.coalesce(holds, F.lit(False)))


def defense_signals(df: DataFrame, supports: Sequence[float] = (SUPPORT_LEVEL,), resistances: Sequence[float] = RESISTANCE_LEVELS) -> DataFrame:
    """``action`` (buy, defense, caution), ``reasons`` and nearness to levels of market rows.

    ``df``: ``v_total, avg_v_total, price, sentiment_temperature``. An overheated mood wins over the other reasons.
    """
    price = F.col("price")
    near = lambda levels: F.coalesce(F.greatest(*[F.abs(price - v) / v < NEAR for v in levels], F.lit(False)), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when((F.col("avg_v_total") > 0) & (div("v_total", "avg_v_total") < VOLUME_SHRINK), "volume_shrink"), F.when(F.col("v_total") < OPEN_AUCTION_MIN, "open_auction_low"),
        F.when(price < max(supports) * (1 + SUPPORT_BREAK), "support_break"), F.when(F.col("sentiment_temperature") > OVERHEATED, "sentiment_overheat")))
    x = df.withColumn("_r", reasons)
    return x.withColumns({"action": F.when(F.array_contains("_r", "sentiment_overheat"), "caution").when(F.size("_r") > 0, "defense").otherwise("buy"),
                          "reasons": F.array_join("_r", ","), "near_support": near(supports), "near_resistance": near(resistances)}).drop("_r")
