"""Screens with verdict and reasons: fundamentals, pullbacks of leaders and limit-ups, orders before trading."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, div, spread, wc_desc

#: Metric, lower and upper end of its range, weight.
FUNDAMENTAL_RANGES = {
    "pe": (0.0, 50.0, 0.15),
    "pb": (0.0, 10.0, 0.10),
    "roe": (10.0, 100.0, 0.20),
    "revenue_growth": (15.0, 200.0, 0.15),
    "profit_growth": (10.0, 200.0, 0.20),
    "debt_ratio": (0.0, 60.0, 0.20),
}


def _texts(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs])), ",")


def _in_range(metric: str, lo: float, hi: float) -> Column:
    """0-100: high is good, but a low debt ratio and the middle of a valuation range are."""
    v = F.col(metric)
    if metric in ("pe", "pb"):
        mid = (lo + hi) / 2
        return F.when((v > lo) & (v < hi), 100 - F.abs(v - mid) / mid * 50).otherwise(0.0)
    up = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (v - lo) / (hi - lo) * 100))
    return 100 - up if metric == "debt_ratio" else up


def fundamental_range_score(df: DataFrame, ranges: Mapping[str, tuple[float, float, float]] = FUNDAMENTAL_RANGES) -> DataFrame:
    """Weighted range score over the metrics a row has, pass flag, label at 70 and 50, and reasons.

    A missing valuation, return on equity or debt ratio fails; no metric at all scores 0.
    """
    points = [F.when(F.col(m).isNotNull(), _in_range(m, lo, hi) * w).otherwise(0.0) for m, (lo, hi, w) in ranges.items()]
    weight = [F.when(F.col(m).isNotNull(), w).otherwise(0.0) for m, (_, _, w) in ranges.items()]
    x = df.withColumn("score", F.coalesce(F.round(div(sum(points, F.lit(0.0)), sum(weight, F.lit(0.0))), 2), F.lit(0.0)))
    pe, roe = F.coalesce("pe", F.lit(999.0)), F.coalesce("roe", F.lit(0.0))
    debt, growth = F.coalesce("debt_ratio", F.lit(999.0)), F.coalesce("revenue_growth", F.lit(0.0))
    bad_pe, bad_roe, bad_debt = (pe <= 0) | (pe > 50), roe < 10, debt > 60
    return x.withColumns({
        "passed": ~(bad_pe | bad_roe | bad_debt),
        "label": F.when(F.col("score") >= 70, "excellent").when(F.col("score") >= 50, "good"),
        "reasons": _texts((bad_pe, "pe_out_of_range"), (bad_roe, "low_roe"), (bad_debt, "high_debt"), (growth < 15, "slow_growth"))})


def dragon_head(leaders: DataFrame, bars: DataFrame, min_limit_ups: int = 3, max_pullback: float = 0.15, days: int = 5, min_cap: float = 30.0) -> DataFrame:
    """Leaders of several limit-ups whose newest closes fell back little and no longer fall, with their buy zone.

    ``leaders``: ``code, consecutive_limitup, market_position, market_cap``. Codes under ``days`` bars drop out.
    """
    high_board = leaders.where((F.col("consecutive_limitup") >= min_limit_ups) & (F.col("market_position") == "leader") & (F.col("market_cap") >= min_cap))
    newest = bars.select(CODE, DATE, "close").withColumn("_rn", F.row_number().over(wc_desc())).where(F.col("_rn") <= days)
    at = lambda k: F.max(F.when(F.col("_rn") == k, F.col("close")))
    g = newest.groupBy(CODE).agg(F.count(F.lit(1)).alias("_n"), F.max("close").alias("high_price"), at(1).alias("current_price"), at(2).alias("_before"))
    x = high_board.join(g.where(F.col("_n") >= days), CODE)
    now, top = F.col("current_price"), F.col("high_price")
    x = x.withColumns({"pullback_pct": div(top - now, top), "buy_zone_low": top * 0.85, "buy_zone_high": top * 0.90})
    x = x.where((F.col("pullback_pct") <= max_pullback) & (now >= F.col("_before") * 0.99))
    return x.withColumns({"in_buy_zone": now.between(F.col("buy_zone_low"), F.col("buy_zone_high")),
                          "confidence": F.lit(0.7), "suggested_position": F.lit(0.15)}).drop("_n", "_before")


def limit_up_pullback(rows: DataFrame, max_limit_ups: int = 3, max_turnover: float = 20.0, min_roe: float = 0.0,
                      tolerance: float = 0.02, surge: float = 1.5) -> DataFrame:
    """Rising bars on surging volume at the 20-day average, in a monthly uptrend, with stop and two targets.

    ``rows``: ``open, close, volume, volume_20_avg, ema_20``; of ``limitup_days, turnover, roe, macd_monthly,
    ema_60_monthly`` those that are there are tested, and a null fails its test.
    """
    optional = {"limitup_days": F.col("limitup_days") <= max_limit_ups, "turnover": F.col("turnover") <= max_turnover, "roe": F.col("roe") > min_roe,
                "macd_monthly": F.col("macd_monthly") == "golden_cross", "ema_60_monthly": F.col("close") > F.col("ema_60_monthly")}
    x = rows
    for name, test in optional.items():
        x = x.where(test) if name in rows.columns else x
    price, mean = F.col("close"), F.col("ema_20")
    near = (mean > 0) & price.between(mean * (1 - tolerance), mean * (1 + tolerance))
    x = x.where(near & (F.col("volume") > F.col("volume_20_avg") * surge) & (price > F.col("open")))
    return x.withColumns({"trigger_price": price, "stoploss_price": mean * 0.97, "take_profit_1": price * 1.10, "take_profit_2": price * 1.20, "confidence": F.lit(0.8)})


def check_orders(orders: DataFrame, positions: DataFrame, accounts: DataFrame, stocks: DataFrame, single: float = 0.10, sector: float = 0.30,
                 daily: float = 0.05, total: float = 0.20, liquidity: float = 1e7, volatility: float = 5.0, rows: int = 0) -> DataFrame:
    """Rules of an order before trading: what blocks it, what warns, and whether it may run; each order on its own.

    ``orders``: ``account_id, code, quantity, price``; ``positions``: ``account_id, code, value``; ``accounts``:
    ``account_id, total_capital, daily_pnl, peak_capital``; ``stocks``: ``code, industry, amount, atr_pct``. Only losses
    count for the day. Unknown accounts are blocked; unknown turnover or volatility gives no warning. ``rows``, the number of
    orders where it is known, lets the tasks of accounts grow in number.
    """
    held = positions.groupBy("account_id", CODE).agg(F.sum("value").alias("_held"))
    rest = [c for c in orders.columns if c not in ("account_id", CODE)]
    # orders and holdings go the same way together: once by code for the stock's row, once by account for the sums
    both = orders.withColumns({"_value": F.col("quantity") * F.col("price"), "_order": F.lit(True)}).unionByName(
        held.withColumn("_order", F.lit(False)), allowMissingColumns=True)
    x = spread(both.join(stocks.select(CODE, "industry", "amount", "atr_pct"), CODE, "left"), rows, "account_id")
    known = F.col("account_id").isNotNull()
    x = x.withColumns({
        "_sector": F.when(known & F.col("industry").isNotNull(), F.sum("_held").over(Window.partitionBy("account_id", "industry"))),
        "_held": F.when(known & F.col(CODE).isNotNull(), F.max("_held").over(Window.partitionBy("account_id", CODE)))})
    x = x.where("_order").join(accounts, "account_id", "left").select(
        "account_id", "industry", CODE, *rest, "amount", "atr_pct", *[c for c in accounts.columns if c != "account_id"], "_held", "_sector", "_value")
    value = F.col("_value")
    x = x.withColumns({
        "stock_ratio": div(F.coalesce("_held", F.lit(0.0)) + value, "total_capital"), "sector_ratio": div(F.coalesce("_sector", F.lit(0.0)) + value, "total_capital"),
        "daily_loss": div(F.greatest(-F.col("daily_pnl"), F.lit(0.0)), "total_capital"), "drawdown": div(F.col("peak_capital") - F.col("total_capital"), "peak_capital")})
    x = x.withColumns({
        "blocks": _texts((F.col("total_capital").isNull(), "unknown_account"), (F.col("stock_ratio") > single, "single_stock_limit"), (F.col("sector_ratio") > sector, "sector_concentration"),
                         (F.col("daily_loss") > daily, "daily_drawdown"), (F.col("drawdown") > total, "total_drawdown")),
        "warnings": _texts((F.col("amount") <= liquidity, "liquidity_check"), (F.col("atr_pct") >= volatility, "volatility_check"))})
    return x.withColumn("can_execute", F.col("blocks") == "").drop("_held", "_sector", "_value")
