"""Scores, grades and rankings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_score(df: DataFrame, factors: Mapping[str, tuple[float, float]], min_score: float | None = None,
                   price: tuple[float, float] | None = None, change: tuple[float, float] | None = None,
                   top: int | None = None) -> DataFrame:
    """Sum of ``weight * factor`` over the factors at or above their threshold, then screen and rank.

    The sum is rounded to 9 digits so equal scores tie exactly; ``code`` breaks ties.
    """
    parts = [F.when(F.col(c) >= t, F.col(c) * w).otherwise(0.0) for c, (w, t) in factors.items()]
    df = df.withColumn("score", F.round(sum(parts, F.lit(0.0)), 9))
    if price:
        df = df.where(F.col("close").between(*price))
    if change:
        df = df.where(F.col("pct_chg").between(*change))
    if min_score is not None:
        df = df.where(F.col("score") >= min_score)
    return top_n(df, "score", top) if top else df


def top_n(df: DataFrame, by: str, n: int | None, ascending: bool = False) -> DataFrame:
    """Best ``n`` rows (a distributed take-ordered), ties by code; all rows in that order without a number."""
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    ranked = df.orderBy(key, "code")
    return ranked if n is None else ranked.limit(n)


def quality_rank(df: DataFrame) -> DataFrame:
    """Quality 0-100 from roe, gross margin, profit growth and PE; an absent column counts 50."""
    def clip(c: str, top: float):
        return F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(top)) if c in df.columns else None

    parts = {"roe": (30.0, 0.3), "gross_margin": (50.0, 0.2), "profit_growth": (50.0, 0.3), "pe": (50.0, 0.2)}
    total = F.lit(0.0)
    for c, (top, w) in parts.items():
        x = clip(c, top)
        s = F.lit(50.0) if x is None else ((top - x if c == "pe" else x) * 100 / top)
        total = total + s * w
    return df.withColumn("quality_score", total)
