"""Pick tracking, cohort backtests, return statistics and attribution."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, UNB, close, corr, div, lag, lead, wc
from tidemark.operators.relational import entry_exit, longest_runs, range_aggregate
from tidemark.sources.bars import day_index

PERIODS = (1, 4, 7, 11, 21)


def multi_period(picks: DataFrame, bars: DataFrame, periods: Sequence[int] = PERIODS) -> DataFrame:
    """Return, high, low, max gain and drawdown (%) over the next n trading days of each pick.

    Trading days are the panel's dates.  A code silent on the end day counts to
    its last bar in the range; picks without a bar on the pick date drop out.
    """
    days = day_index(bars)
    b = bars.join(days, DATE).select(CODE, F.col("day_no").alias("_dn"), "high", "low", "close")
    start = b.select(CODE, F.col("_dn").alias("_s"), F.col("close").alias("_c0"))
    p = picks.join(days.withColumnRenamed(DATE, "pick_date"), "pick_date").withColumnRenamed("day_no", "_s").join(start, [CODE, "_s"])
    span = max(periods)
    left = p.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_s") + 1) / span), F.floor((F.col("_s") + span) / span))))
    hit = left.join(b.withColumn("_b", F.floor(F.col("_dn") / span)), [CODE, "_b"], "left")
    off = F.col("_dn") - F.col("_s")
    aggs = []
    for n in periods:
        inside = off.between(1, n)
        aggs += [F.max_by(F.when(inside, F.col("close")), F.when(inside, off)).alias(f"_e{n}"),
                 F.max(F.when(inside, F.col("high"))).alias(f"_h{n}"), F.min(F.when(inside, F.col("low"))).alias(f"_l{n}")]
    g = hit.groupBy(CODE, "pick_date", "_c0").agg(*aggs)

    def pct(c: str) -> Column:
        return div(F.col(c) - F.col("_c0"), "_c0") * 100

    out = []
    for n in periods:
        out += [pct(f"_e{n}").alias(f"day{n}_return"), pct(f"_h{n}").alias(f"day{n}_max_gain"), pct(f"_l{n}").alias(f"day{n}_max_drawdown")]
    return g.select(CODE, "pick_date", *out)


def track(picks: DataFrame, bars: DataFrame, as_of: str | dt.date, max_days: int = 30) -> DataFrame:
    """Outcome of each pick as known on ``as_of``: first close through take-profit or stop-loss, else expiry.

    ``picks``: ``pick_id, code, pick_date, price, take_profit, stop_loss`` (percent).
    Days are calendar days; a trigger on the last day overrides the expiry. A pick whose days have not passed is
    ``tracking`` and has no final profit; later picks drop out. Best and worst start at 0, without a day.
    """
    today = F.lit(str(as_of)).cast("date")
    picks, bars = picks.where(F.col("pick_date") <= today), bars.where(F.col(DATE) <= today)
    keys = ["pick_id", CODE, "pick_date", "price", "take_profit", "stop_loss"]
    day = F.datediff(DATE, "pick_date")
    profit = div(F.col("close") - F.col("price"), "price") * 100
    r = range_aggregate(picks.select(*keys), bars.select(CODE, DATE, "close"), max_days, {
        "_bars": F.collect_list(F.when(F.col("close").isNotNull(), F.struct(day.alias("d"), profit.alias("p"))))})
    r = r.withColumn("_bars", F.array_sort("_bars"))
    r = r.withColumn("_stop", F.try_element_at(
        F.filter("_bars", lambda b: (b["p"] >= F.col("take_profit")) | (b["p"] <= F.col("stop_loss"))), F.lit(1)))
    r = r.withColumn("_seen", F.filter("_bars", lambda b: F.col("_stop").isNull() | (b["d"] <= F.col("_stop.d"))))
    best = F.array_max(F.transform("_seen", lambda b: F.struct(b["p"].alias("p"), (-b["d"]).alias("d"))))
    worst = F.array_min(F.transform("_seen", lambda b: F.struct(b["p"].alias("p"), b["d"].alias("d"))))
    last = F.try_element_at("_seen", F.lit(-1))
    status = (F.when(F.col("_stop").isNotNull(), "stopped").when(F.datediff(today, "pick_date") >= max_days, "completed").otherwise("tracking"))
    reason = (F.when(F.col("_stop.p") >= F.col("take_profit"), "profit_triggered").when(F.col("_stop").isNotNull(), "loss_triggered")
              .when(status == "completed", "expired"))
    zero = F.lit(0.0)
    return r.select(*keys[:3], status.alias("status"), reason.alias("stop_reason"), F.col("_stop.d").alias("stop_day"),
                    F.when(status != "tracking", last["p"]).alias("final_profit"), F.greatest(best["p"], zero).alias("max_profit"),
                    F.when(best["p"] > 0, -best["d"]).alias("best_day"), F.least(worst["p"], zero).alias("max_loss"), F.when(worst["p"] < 0, worst["d"]).alias("worst_day"))


def outcome_statistics(tracked: DataFrame, by: str) -> DataFrame:
    p = F.col("final_profit")
    return tracked.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p > 0).alias("wins"), div(F.count_if(p > 0), F.count(p)).alias("win_rate"),
        F.avg(p).alias("avg_profit"), F.max(p).alias("best"), F.min(p).alias("worst"),
        F.count_if(F.col("stop_reason") == "profit_triggered").alias("n_take_profit"), F.count_if(F.col("stop_reason") == "loss_triggered").alias("n_stop_loss"))


def next_day_performance(picks: DataFrame, bars: DataFrame) -> DataFrame:
    """Next-bar return of each pick, per pick date: count, mean, win share, best and worst."""
    nxt = bars.select(CODE, F.col(DATE).alias("pick_date"), (div(lead("close"), close()) - 1).alias("r"))
    x = picks.join(nxt, [CODE, "pick_date"]).where(F.col("r").isNotNull())
    return x.groupBy("pick_date").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("avg_return"),
                                      (F.count_if(F.col("r") > 0) / F.count(F.lit(1))).alias("win_rate"), F.max("r").alias("best"), F.min("r").alias("worst"))


def rebalance_dates(days: DataFrame, frequency: str = "monthly") -> DataFrame:
    """First trading day of each period: daily, weekly, monthly or quarterly."""
    units = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter"}
    if frequency not in units:
        raise ValueError(f"unknown frequency {frequency!r}")
    d = days.select(DATE).distinct()
    return d.groupBy(F.date_trunc(units[frequency], DATE).alias("_p")).agg(F.min(DATE).alias(DATE)).select(DATE)


def cohort_backtest(scored: DataFrame, rebalance: DataFrame, top: int = 10, hold: int = 5, stop: float = 0.05, profit: float = 0.10,
                    cost: float = 0.001) -> DataFrame:
    """Per rebalance date: mean net return of the top codes over ``hold`` bars, and the equity curve.

    ``scored``: bars with ``score``.  Codes suspended or locked limit-up at entry
    are skipped.  The first close through a threshold exits: a stop at that
    bar's low, a profit at its high; otherwise the close of the last bar.
    """
    w = wc().rowsBetween(1, hold)
    b = F.struct(F.col("close").alias("c"), F.col("high").alias("h"), F.col("low").alias("l"))
    x = scored.withColumn("_next", F.collect_list(b).over(w)).join(rebalance.select(DATE), DATE, "left_semi")
    locked = (F.col("high") == F.col("low")) & (F.col("high") > F.col("open") * 1.095)
    x = x.where((F.col("volume") > 0) & ~locked & (F.size("_next") == hold) & F.col("score").isNotNull())
    r = Window.partitionBy(DATE).orderBy(F.col("score").desc(), CODE)
    x = x.withColumn("_k", F.row_number().over(r)).where(F.col("_k") <= top)
    x = x.withColumn("_hit", F.try_element_at(F.filter("_next", lambda n: (n["c"] / F.col("close") - 1 <= -stop) | (n["c"] / F.col("close") - 1 >= profit)), F.lit(1)))
    exit_price = (F.when(F.col("_hit").isNull(), F.try_element_at("_next", F.lit(-1))["c"])
                  .when(F.col("_hit.c") / F.col("close") - 1 <= -stop, F.col("_hit.l")).otherwise(F.col("_hit.h")))
    x = x.withColumn("_ret", div(exit_price, close()) - 1 - cost * (1 + div(exit_price, close())))
    g = x.groupBy(DATE).agg(F.count(F.lit(1)).alias("n"), F.avg("_ret").alias("period_return"))
    curve = F.exp(F.sum(F.log1p("period_return")).over(Window.orderBy(DATE).rowsBetween(UNB, 0)))
    return g.withColumn("equity", curve)


def return_statistics(returns: DataFrame, ret: str = "ret", by: Sequence[str] = (CODE,), date: str = DATE, per_year: float = 252.0) -> DataFrame:
    """Total and annual return, Sharpe, Sortino, Calmar, drawdown, win rate, profit/loss ratio, longest runs."""
    by = list(by)
    r = F.col(ret)
    x = returns.where(r.isNotNull())
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(UNB, 0)
    x = x.withColumn("_l", F.sum(F.when(r > -1, F.log1p(r))).over(w))
    x = x.withColumn("_m", F.greatest(F.max("_l").over(w), F.lit(0.0)))
    g = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.exp(F.sum(F.when(r > -1, F.log1p(r)))) - 1).alias("total_return"), F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("_sd"), F.stddev_pop(F.when(r < 0, r)).alias("_dn"), F.min(F.exp(F.col("_l") - F.col("_m")) - 1).alias("max_drawdown"),
        (F.count_if(r > 0) / F.count(F.lit(1))).alias("win_rate"),
        div(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r < 0, r)))).alias("profit_loss_ratio"))
    g = g.withColumn("annual_return", F.pow(1 + F.col("total_return"), per_year / F.col("n")) - 1)
    g = g.withColumns({
        "sharpe": div(F.col("mean") * per_year ** 0.5, "_sd"), "sortino": div(F.col("mean") * per_year ** 0.5, "_dn"),
        "calmar": div("annual_return", F.abs("max_drawdown"))}).drop("_sd", "_dn")
    runs = longest_runs(x, ret, by[0], date) if len(by) == 1 else None
    return g.join(runs, by[0]) if runs is not None else g


def stock_vs_index(bars: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Correlation, beta, summed returns, excess and label of each code against the index."""
    if index is None:
        index = bars.groupBy(DATE).agg(F.avg("close").alias("index_close"))
    ir = index.select(DATE, (div("index_close", F.lag("index_close").over(Window.orderBy(DATE))) - 1).alias("_ri"))
    x = bars.select(CODE, DATE, (div(close(), lag("close")) - 1).alias("_rs")).join(ir, DATE).where("_rs is not null and _ri is not null")
    g = x.groupBy(CODE).agg(corr("_rs", "_ri").alias("corr"), div(F.covar_samp("_rs", "_ri"), F.var_samp("_ri")).alias("beta"),
                            F.sum("_rs").alias("stock_return"), F.sum("_ri").alias("index_return"))
    e = F.col("stock_return") - F.col("index_return")
    return g.withColumns({"excess": e, "label": F.when(e > 0, "outperform").otherwise("underperform")})


def attribution(trades: DataFrame, market: DataFrame) -> DataFrame:
    """Split of each trade's percent result: market part by the index move, selection by score, timing the rest; dominant cause.

    ``trades``: ``id, code, entry_date, exit_date, pnl_pct, selection_score``;
    ``market``: ``trade_date, index_close``.
    """
    a = market.select(F.col(DATE).alias("entry_date"), F.col("index_close").alias("_i0"))
    b = market.select(F.col(DATE).alias("exit_date"), F.col("index_close").alias("_i1"))
    x = trades.join(a, "entry_date", "left").join(b, "exit_date", "left")
    m = (div("_i1", "_i0") - 1) * 100
    x = x.withColumn("market_part", F.coalesce(m, F.lit(0.0))).withColumn("_rest", F.col("pnl_pct") - F.col("market_part"))
    x = x.withColumn("selection_part", F.col("_rest") * F.col("selection_score") / 100).withColumn("timing_part", F.col("_rest") - F.col("selection_part"))
    parts = F.array(*[F.struct(F.abs(f"{n}_part").alias("v"), F.lit(n).alias("n")) for n in ("market", "selection", "timing")])
    return x.withColumn("dominant", F.array_max(parts)["n"]).drop("_i0", "_i1", "_rest")


def seat_pattern(seats: DataFrame) -> DataFrame:
    """Institution and other net buying, seat counts and the net side per code and date."""
    inst = F.col("is_institution")
    n = F.col("net_buy_amount")
    g = seats.groupBy(CODE, DATE).agg(
        F.sum(F.when(inst, n).otherwise(0.0)).alias("institution_net"), F.sum(F.when(~inst, n).otherwise(0.0)).alias("retail_net"),
        F.count_if(inst).alias("institution_seats"), F.countDistinct("broker_name").alias("seats"))
    return g.withColumn("pattern", F.when((F.col("institution_net") > 0) & (F.col("retail_net") > 0), "joint_buy")
                        .when(F.col("institution_net") > 0, "institution_buy").when(F.col("retail_net") > 0, "hot_money_buy").otherwise("sell"))


def flow_summary(flows: DataFrame, k: int = 5) -> DataFrame:
    """Per date: net inflow, codes in and out, and the best and worst ``k`` codes."""
    day = flows.groupBy(DATE).agg(F.sum("main_net").alias("total_net"), F.count_if(F.col("main_net") > 0).alias("n_in"), F.count_if(F.col("main_net") < 0).alias("n_out"))
    out = day
    for name, order in (("top_in", F.col("main_net").desc()), ("top_out", F.col("main_net").asc())):
        w = Window.partitionBy(DATE).orderBy(order, CODE)
        t = flows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
        s = t.groupBy(DATE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", CODE))), lambda r: r[CODE]), ",").alias(name))
        out = out.join(s, DATE, "left")
    return out


def period_rollup(states: DataFrame, unit: str = "month") -> DataFrame:
    """Weekly or monthly roll-up of daily market states: means, days per state, temperature trend (stable under 5)."""
    p = F.date_trunc(unit, F.col(DATE)).cast("date")
    g = states.groupBy(p.alias("period")).agg(
        F.count(F.lit(1)).alias("days"), F.avg("temperature").alias("avg_temperature"),
        *[F.count_if(F.col("market_state") == s).alias(f"{s}_days") for s in ("strong", "oscillating", "weak", "risk")],
        (F.max_by("temperature", DATE) - F.min_by("temperature", DATE)).alias("change"))
    c = F.col("change")
    return g.withColumn("trend", F.when(F.abs(c) < 5, "stable").when(c > 0, "rising").otherwise("falling"))


def correlation_pairs(bars: DataFrame, coverage: float = 0.8, block: int = 200) -> DataFrame:
    """Correlation of daily returns for every pair of well-covered codes (``code_a < code_b``), missing returns 0.

    The matrix is the result, so its pairs must be written; they are computed as
    products of blocks of ``block`` codes or more, stored once and read by the tasks of their pairs.
    """
    from tidemark.operators._pairs import block_correlations
    r = bars.select(CODE, DATE, (div(close(), lag("close")) - 1).alias("r")).where("r is not null")
    return block_correlations(r, coverage, block)


def market_summary(bars: DataFrame, flat: float = 0.5) -> DataFrame:
    """Rising, falling and flat counts (± ``flat`` %), turnover, limits and completeness per date; needs ``pct_chg``."""
    c = F.col("pct_chg")
    return bars.groupBy(DATE).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c > flat).alias("rising"), F.count_if(c < -flat).alias("falling"),
        F.count_if(F.abs(c) <= flat).alias("flat"), F.count_if(c >= 9.9).alias("limit_up"), F.count_if(c <= -9.9).alias("limit_down"),
        F.sum("amount").alias("amount"), (F.count(c) / F.count(F.lit(1))).alias("completeness"))


def flow_performance(picks: DataFrame, bars: DataFrame, hold_days: int = 10) -> DataFrame:
    """Entry, exit and return of each flow's picks, summed up by flow; ``picks``: ``flow, code, pick_date``."""
    x = entry_exit(picks, bars, hold_days).withColumn("_r", div(F.col("exit_price") - F.col("entry_price"), "entry_price") * 100)
    r = F.col("_r")
    return x.groupBy("flow").agg(F.count(F.lit(1)).alias("positions"), F.count_if("is_open").alias("open"), F.avg(r).alias("avg_return"),
                                 div(F.count_if(r > 0), F.count(r)).alias("win_rate"), F.max(r).alias("best"), F.min(r).alias("worst"))


# Grade per average return (%).
GRADES = [(5.0, "excellent"), (2.0, "good"), (0.0, "fair")]


def performance_grade(stats: DataFrame, value: str) -> DataFrame:
    out = None
    for cut, name in GRADES:
        cond = F.col(value) > cut
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return stats.withColumn("grade", out.otherwise("poor"))
