"""Risk statistics of return series, portfolios and positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.order_stats import quantiles
from tidemark.functions.windows import CODE, DATE, UNB, div


def value_at_risk(returns: DataFrame, ret: str = "ret", by: Sequence[str] = (CODE,), confidence: float = 0.95) -> DataFrame:
    """Historical VaR (interpolated quantile) and CVaR (mean of the tail at or below it) per group."""
    by = list(by)
    x = returns.where(F.col(ret).isNotNull())
    q = quantiles(x, by, ret, {"var": 1 - confidence}).select(*by, "var")
    tail = x.join(q, by).where(F.col(ret) <= F.col("var")).groupBy(*by).agg(F.avg(ret).alias("cvar"))
    return q.join(tail, by, "left")


def drawdown_position(series: DataFrame, value: str, by: Sequence[str] = (CODE,), date: str = DATE) -> DataFrame:
    """Deepest fall from the running peak of a value series, and its date."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(UNB, 0)
    x = series.withColumn("_d", div(F.col(value), F.max(value).over(w)) - 1)
    return x.groupBy(*by).agg(F.min("_d").alias("max_drawdown"), F.min_by(date, F.struct("_d", date)).alias("trough_date"))


def ratios(returns: DataFrame, ret: str = "ret", index_ret: str = "index_ret", by: Sequence[str] = (CODE,), free: float = 0.03) -> DataFrame:
    """Beta (sample moments), annual Sharpe and Sortino per group."""
    r, d = F.col(ret), F.col(ret) - free / 252
    return returns.where(r.isNotNull()).groupBy(*by).agg(
        div(F.covar_samp(ret, index_ret), F.var_samp(index_ret)).alias("beta"),
        (div(F.avg(d), F.stddev_pop(r)) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        (div(F.avg(d), F.stddev_pop(F.when(r < 0, r))) * F.sqrt(F.lit(252.0))).alias("sortino"))


def covariance(returns: DataFrame, assets: Sequence[str], ret: str = "ret") -> DataFrame:
    """Long covariance table of the named assets (a bounded list) from one aggregate."""
    wide = returns.where(F.col(CODE).isin(*assets)).groupBy(DATE).pivot(CODE, list(assets)).agg(F.first(ret))
    pairs = [(a, b) for a in assets for b in assets]
    one = wide.agg(*[F.covar_samp(f"`{a}`", f"`{b}`").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("code_a"), F.lit(b).alias("code_b"), F.col(f"c{i}").alias("cov")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def risk_contribution(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """``w_i (Cov w)_i / vol`` per asset and the portfolio volatility; ``weights``: ``code, weight``."""
    a = weights.select(F.col(CODE).alias("code_a"), F.col("weight").alias("_wa"))
    b = weights.select(F.col(CODE).alias("code_b"), F.col("weight").alias("_wb"))
    x = cov.join(a, "code_a").join(b, "code_b").groupBy("code_a", "_wa").agg(F.sum(F.col("cov") * F.col("_wb")).alias("_cw"))
    x = x.withColumn("_v", F.sqrt(F.sum(F.col("_wa") * F.col("_cw")).over(Window.partitionBy())))
    return x.select(F.col("code_a").alias(CODE), F.col("_wa").alias("weight"), F.col("_v").alias("portfolio_volatility"),
                    div(F.col("_wa") * F.col("_cw"), "_v").alias("contribution"))


def position_limits(positions: DataFrame, max_weight: float = 0.10, bands: tuple[float, float] = (0.05, 0.15)) -> DataFrame:
    """Weights over the limit and a risk level by weight; ``positions``: ``code, value``."""
    total = positions.agg(F.sum("value").alias("_t")).withColumn("_k", F.lit(1))
    x = positions.withColumn("_k", F.lit(1)).join(total, "_k").drop("_k").withColumn("weight", div("value", "_t")).drop("_t")
    w = F.col("weight")
    return x.withColumns({"over_limit": w > max_weight, "risk_level": F.when(w < bands[0], "low").when(w < bands[1], "medium").otherwise("high")})


def stress(positions: DataFrame, scenarios: Mapping[str, float]) -> DataFrame:
    """Portfolio value per scenario, ``value * (1 + shock * beta)``; each position carries the short scenario list."""
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(x)).alias("shock")) for n, x in scenarios.items()]))
    x = positions.select("value", "beta", s.alias("s")).select("value", "beta", "s.*")
    g = x.groupBy("scenario", "shock").agg(F.sum("value").alias("value"), F.sum(F.col("value") * (1 + F.col("shock") * F.col("beta"))).alias("stressed_value"))
    return g.withColumn("loss", F.col("stressed_value") - F.col("value"))
