"""Selection strategies and position rules over panels and newest rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import (
    CODE, DATE, UNB, band, close, div, high, lag, latest_rows, low, rmean, rmin, rstd, vol, wc, wc_desc)
from tidemark.operators.relational import top_per_group, zscore
from tidemark.operators.scoring import top_n


def _steps(pairs: Sequence[tuple[Column, float]], otherwise: float) -> Column:
    out = None
    for cond, v in pairs:
        out = F.when(cond, float(v)) if out is None else out.when(cond, float(v))
    return out.otherwise(float(otherwise))


def enhanced_score(bars: DataFrame) -> DataFrame:
    """50 plus six banded parts at each code's newest bar; grade S >= 100, A >= 85, B >= 65, else C.

    ``range_rsi`` averages the ranges of up and down days over the newest 14
    bars.  All windows come from one conditional aggregate over 21 bars.
    """
    x = bars.withColumn("_rn", F.row_number().over(wc_desc())).where(F.col("_rn") <= 21)
    w = Window.partitionBy(CODE).orderBy(F.col("_rn").desc())
    pc = F.lag("close").over(w)
    x = x.withColumn("_pc", F.when(F.col("_rn") < 14, pc))
    rng = high() - low()

    def at(k: int) -> Column:
        return F.max(F.when(F.col("_rn") == k, close()))

    def upto(n: int, c: Column) -> Column:
        return F.when(F.col("_rn") <= n, c)

    g = x.groupBy(CODE).agg(
        F.max(DATE).alias(DATE), at(1).alias("price"), F.max(F.when(F.col("_rn") == 1, vol())).alias("_v"), at(2).alias("_c1"), at(11).alias("_c10"),
        *[F.avg(upto(n, close())).alias(f"ma{n}") for n in (5, 10, 20)], F.avg(upto(5, vol())).alias("_v5"),
        F.min(upto(20, low())).alias("_lo"), F.max(upto(20, high())).alias("_hi"),
        F.avg(upto(14, F.when(close() > F.col("_pc"), rng).otherwise(0.0))).alias("_up"),
        F.avg(upto(14, F.when(close() < F.col("_pc"), rng).otherwise(0.0))).alias("_dn"))
    p = F.col("price")

    def change(c: str) -> Column:
        return F.round(div(p - F.coalesce(c, "price"), F.coalesce(c, "price")) * 100, 2)

    g = g.withColumns({
        "change_pct": change("_c1"), "momentum_10d": change("_c10"), "volume_ratio": F.round(div("_v", "_v5"), 2),
        "range_rsi": F.when(F.col("_dn") == 0, 50.0).otherwise(F.round(100 - 100 / (1 + div("_up", "_dn")), 2)),
        "position": F.round(div(p - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 100, 2)})
    c, m, r, v, q = (F.col(n) for n in ("change_pct", "momentum_10d", "range_rsi", "volume_ratio", "position"))
    a, b, d = F.col("ma5"), F.col("ma10"), F.col("ma20")
    parts = [
        _steps([(c > 5, 20), (c > 3, 15), (c > 1, 10), (c > 0, 5), (c > -1, 0), (c > -3, -5)], -10),
        _steps([((p > a) & (a > b) & (b > d), 20), ((p > a) & (a > b), 15), (p > a, 10), (p > d, 5)], 0),
        _steps([(m > 15, 20), (m > 10, 15), (m > 5, 10), (m > 0, 5), (m > -5, 0)], -5),
        _steps([((r > 30) & (r < 70), 15), ((r > 20) & (r < 80), 10), (r < 30, 5)], 0),
        _steps([((v > 1.5) & (c > 0), 15), ((v > 1) & (c > 0), 10), (v > 0.8, 5)], 0),
        _steps([(q < 20, 15), (q < 40, 10), (q < 60, 5), (q > 80, -5)], 0)]
    g = g.withColumn("enhanced_score", sum(parts, F.lit(50.0)))
    s = F.col("enhanced_score")
    grade = F.when(s >= 100, "S").when(s >= 85, "A").when(s >= 65, "B").otherwise("C")
    return g.withColumn("grade", grade).drop("_v", "_c1", "_c10", "_v5", "_lo", "_hi", "_up", "_dn")


def momentum_features(bars: DataFrame, short: int = 20, medium: int = 60) -> DataFrame:
    x = bars.withColumns({"momentum_20d": div(close(), lag("close", short)) - 1, "momentum_60d": div(close(), lag("close", medium)) - 1,
                          "_r": div(close(), lag("close")) - 1, "volume_ratio": div(vol(), rmean(vol(), 20)), "ma20": rmean(close(), 20), "ma60": rmean(close(), 60)})
    return x.withColumns({
        "momentum_accel": F.col("momentum_20d") - lag("momentum_20d", 5), "volatility": rstd("_r", 20) * 252 ** 0.5,
        "uptrend": (close() > F.col("ma20")) & (F.col("ma20") > F.col("ma60"))}).drop("_r")


def momentum_select(bars: DataFrame, min_20: float = 0.05, max_20: float = 0.30, min_60: float = 0.0, min_ratio: float = 1.0,
                    max_vol: float = 0.5, require_uptrend: bool = True, top: int | None = None) -> DataFrame:
    """Momentum screen on the newest bar, scored 0.5 / 0.3 / 0.2 by momentum, volume and acceleration."""
    x = latest_rows(momentum_features(bars), DATE, "close", "momentum_20d", "momentum_60d", "momentum_accel", "volume_ratio", "volatility", "uptrend")
    x = x.where(F.col("momentum_20d").between(min_20, max_20) & (F.col("momentum_60d") >= min_60) & (F.col("volume_ratio") >= min_ratio) & (F.col("volatility") <= max_vol))
    x = x.where("uptrend") if require_uptrend else x
    acc = F.when(F.col("momentum_accel") > 0, F.least(F.col("momentum_accel") * 10, F.lit(1.0))).otherwise(0.0)
    s = (F.col("momentum_20d") * 0.6 + F.col("momentum_60d") * 0.4) * 0.5 + F.least(F.col("volume_ratio") / 3, F.lit(1.0)) * 0.3 + acc * 0.2
    return top_n(x.withColumn("total_score", F.round(s, 9)), "total_score", top)


def low_volatility_select(bars: DataFrame, max_vol: float = 0.30, max_drawdown: float = -0.10, top: int | None = None) -> DataFrame:
    """Calmest codes by 20-day volatility with a shallow drawdown from the running peak; codes under 60 bars drop out."""
    x = bars.withColumns({"_r": div(close(), lag("close")) - 1, "_d": div(close(), F.max("close").over(wc().rowsBetween(UNB, 0))) - 1, "_n": F.row_number().over(wc())})
    x = x.withColumns({"volatility_20d": rstd("_r", 20) * 252 ** 0.5, "volatility_60d": rstd("_r", 60) * 252 ** 0.5,
                       "downside_vol": rstd(F.when(F.col("_r") < 0, F.col("_r")).when(F.col("_r").isNotNull(), 0.0), 20) * 252 ** 0.5, "max_drawdown_20d": rmin("_d", 20)})
    x = x.withColumn("return_vol_ratio", div(rmean("_r", 20), "volatility_20d"))
    x = latest_rows(x, DATE, "close", "volatility_20d", "volatility_60d", "downside_vol", "max_drawdown_20d", "return_vol_ratio", "_n").where("_n >= 60").drop("_n")
    return top_n(x.where((F.col("volatility_20d") < max_vol) & (F.col("max_drawdown_20d") > max_drawdown)), "volatility_20d", top, ascending=True)


def blend_select(bars: DataFrame, min_ratio: float = 1.0, max_vol: float = 0.5, top: int | None = None) -> DataFrame:
    """Z-score blend over the newest rows: 0.3 and 0.2 momentum, -0.3 volatility, 0.2 trend."""
    x = latest_rows(momentum_features(bars), DATE, "close", "momentum_20d", "momentum_60d", "volume_ratio", "volatility", "uptrend").where("momentum_60d is not null")
    x = x.withColumn("trend_score", F.when(F.col("uptrend"), 1.0).otherwise(0.0))
    for c in ("momentum_20d", "momentum_60d", "volatility"):
        x = zscore(x, c, f"_z_{c}", "all")

    def z(c: str) -> Column:
        return F.coalesce(F.col(f"_z_{c}"), F.lit(0.0))
    s = z("momentum_20d") * 0.3 + z("momentum_60d") * 0.2 - z("volatility") * 0.3 + F.col("trend_score") * 0.2
    x = x.withColumn("total_score", F.round(s, 9)).where((F.col("momentum_20d") > 0) & (F.col("volatility") < max_vol) & (F.col("volume_ratio") > min_ratio))
    return top_n(x, "total_score", top).select(CODE, DATE, "close", "momentum_20d", "volatility", "trend_score", "total_score")


def best_sector_per_month(bars: DataFrame, sector: str = "industry") -> DataFrame:
    """Mean monthly return per sector, and the best sector of each month; needs a sector column."""
    m = bars.groupBy(sector, CODE, F.trunc(DATE, "month").alias("month")).agg((div(F.max_by("close", DATE), F.min_by("close", DATE)) - 1).alias("_r"))
    s = m.groupBy("month", sector).agg(F.avg("_r").alias("sector_return"))
    return s.groupBy("month").agg(F.max("sector_return").alias("best_return"), F.min_by(sector, F.struct(-F.round("sector_return", 12), F.col(sector))).alias("best_sector"))


def industry_cap(scored: DataFrame, cap: int, top: int, industry: str = "industry", score: str = "score") -> DataFrame:
    """At most ``cap`` codes per industry, then the best ``top``."""
    return top_n(top_per_group(scored, [industry], score, cap, "_k").drop("_k"), score, top)


def pick_stability(picks: DataFrame) -> DataFrame:
    """Turnover, new share and industry concentration of each pick date against the previous one.

    ``picks``: ``pick_date, code, industry``.  Dates are few, so their order is one small window.
    """
    dates = picks.select("pick_date").distinct().withColumn("_prev", F.lag("pick_date").over(Window.orderBy("pick_date")))
    x = picks.join(dates, "pick_date")
    before = picks.select(F.col("pick_date").alias("_prev"), CODE, F.lit(1).alias("_old"))
    x = x.join(before, ["_prev", CODE], "left")
    ind = picks.groupBy("pick_date", "industry").count().groupBy("pick_date").agg(F.max("count").alias("_m"))
    g = x.groupBy("pick_date", "_prev").agg(F.count(F.lit(1)).alias("n"), F.count("_old").alias("_common")).join(ind, "pick_date")
    t = F.when(F.col("_prev").isNull(), 0.0).otherwise(1 - F.col("_common") / F.col("n"))
    return g.select("pick_date", "n", t.alias("turnover_rate"), t.alias("new_picks_ratio"), (F.col("_m") / F.col("n")).alias("industry_concentration"))


def kelly(stats: DataFrame, fraction: float = 0.5, lowest: float = 0.05, highest: float = 0.25, total: int | None = None) -> DataFrame:
    """Kelly position per strategy row (``win_rate, profit_loss_ratio``), and the split of ``total`` picks."""
    p, b = F.col("win_rate"), F.col("profit_loss_ratio")
    bad = (p <= 0) | (p >= 1) | (b <= 0)
    k = F.greatest(F.lit(lowest), F.least(F.lit(highest), div(p * b - (1 - p), b) * fraction))
    x = stats.withColumn("kelly", F.when(bad, lowest).otherwise(k))
    if total is None:
        return x
    whole = x.agg(F.sum("kelly").alias("_sum"))  # one row
    return (x.crossJoin(F.broadcast(whole)).withColumn("allocation", F.greatest(F.lit(1), F.floor(F.col("kelly") * total / F.col("_sum")).cast("int"))).drop("_sum"))


def position_action(positions: DataFrame, take_1: float = 0.10, take_2: float = 0.20, stop: float = 0.03) -> DataFrame:
    """Next step per position (``current_price, entry_price, ema_20``): take profit 1 or 2, stop below the average, hold."""
    gain = div(F.col("current_price") - F.col("entry_price"), "entry_price")
    act = (F.when(gain >= take_2, "take_profit_2").when(gain >= take_1, "take_profit_1")
           .when((F.col("ema_20") > 0) & (F.col("current_price") <= F.col("ema_20") * (1 - stop)), "stop_loss").otherwise("hold"))
    x = positions.withColumns({"gain": gain, "action": act})
    left = F.create_map(*[F.lit(v) for kv in (("take_profit_2", 0.0), ("take_profit_1", 0.5), ("stop_loss", 0.0), ("hold", 1.0)) for v in kv])
    return x.withColumn("position_pct", left[F.col("action")])


def circuit_state(market: DataFrame) -> DataFrame:
    """Market action in priority order: close all at -5 %, pause at -2 %, pause on a death cross, else normal."""
    c = F.col("change_pct")
    return market.withColumn("circuit", F.when(c <= -5, "close_all").when(c <= -2, "pause_buy").when(F.col("macd_signal") == "death_cross", "pause_buy").otherwise("normal"))


def pre_limit_probability(quotes: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Limit-up probability 0-100 from price momentum, volume energy, seal strength and sector effect."""
    w = weights or {"price_momentum": 0.35, "volume_energy": 0.25, "seal_strength": 0.20, "sector_effect": 0.20}
    c, t = F.col("change_pct"), F.col("turnover_rate")
    momentum = F.when(c >= 9.9, 100.0).when(c >= 7, 80 + (c - 7) * 10).when(c >= 5, 50 + (c - 5) * 15).otherwise(c * 10)
    turn = F.when(t.between(3, 10), 100.0).when(t > 10, F.greatest(F.lit(0.0), 100 - (t - 10) * 5)).otherwise(0.0)
    seal = F.when(F.col("seal_amount") > 0, band(F.col("seal_ratio"), [(1, 40), (2, 60), (5, 80)], 100)).otherwise(50.0)
    sector = F.least(F.least(50 + F.col("sector_change") * 10, F.lit(100.0)) + F.least(F.col("sector_limit_count") * 5, F.lit(30)), F.lit(100.0))
    x = quotes.withColumns({"price_momentum": momentum, "volume_energy": (F.least(F.col("volume_ratio") * 30, F.lit(80.0)) + turn) / 2,
                            "seal_strength": seal, "sector_effect": sector})
    p = sum((F.col(k) * v for k, v in w.items()), F.lit(0.0))
    return x.withColumn("probability", p).withColumn("prediction", F.when(p >= 80, "very_high").when(p >= 60, "high").when(p >= 40, "medium").otherwise("low"))


def opening_probability(quotes: DataFrame) -> DataFrame:
    """Rule-form probability that a sealed board opens, clipped to 0.1-0.9."""
    r = F.coalesce(F.when(F.col("market_cap") > 0, div("seal_amount", "market_cap")), F.lit(0.0))
    n = F.col("limit_up_count")
    p = (0.5 + F.when(r > 0.1, -0.2).when(r < 0.01, 0.2).otherwise(0.0) + F.when(F.col("turnover_rate") > 0.1, 0.15).otherwise(0.0)
         + F.when(n > 3, (n - 3) * 0.1).otherwise(0.0))
    return quotes.withColumn("opening_probability", F.greatest(F.lit(0.1), F.least(F.lit(0.9), p)))


def limit_up_grade(pool: DataFrame, big_seal: float = 100000.0) -> DataFrame:
    """Seal strength, reasons, next-day label and level S/A/B/C of limit-up stocks, best level first."""
    ratio, opens, boards = F.col("seal_ratio"), F.col("open_count"), F.col("consecutive_limit")
    strength = (F.when((ratio >= 5) & (F.col("limit_time") < "10:00:00") & (opens == 0), "strong")
                .when((ratio >= 2) & (opens <= 2), "medium").otherwise("weak"))
    x = pool.withColumn("seal_strength", strength)
    s = F.col("seal_strength")
    reasons = F.array_join(F.array_compact(F.array(
        F.when(boards == 1, F.lit("first_board")).otherwise(F.concat(boards.cast("string"), F.lit("_boards"))),
        F.when(F.col("seal_amount") > big_seal, "big_seal"))), ",")
    level = (F.when((boards == 1) & (s == "strong") & (opens == 0), "S").when((boards == 1) & s.isin("strong", "medium"), "A")
             .when(s == "medium", "B").otherwise("C"))
    nxt = (F.when((s == "strong") & (boards == 1), "gap_or_one_word").when(s == "strong", "gap_and_rise").when(s == "medium", "gap_and_swing")
           .otherwise("flat_or_low"))
    return x.withColumns({"reasons": reasons, "level": level, "next_day": nxt})


def simple_score(bars: DataFrame) -> DataFrame:
    """Technical score 0-100 per code: 20 / 15 / 15 above MA 5 / 10 / 20, momentum up to 30, volume up to 20."""
    x = bars.withColumn("_rn", F.row_number().over(wc_desc())).where(F.col("_rn") <= 20)
    g = x.groupBy(CODE).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_rn") == 1, close())).alias("close"), F.max(F.when(F.col("_rn") == 2, close())).alias("_p"),
        F.max(F.when(F.col("_rn") == 1, vol())).alias("_v"), F.avg("volume").alias("_av"), *[F.avg(F.when(F.col("_rn") <= n, close())).alias(f"_m{n}") for n in (5, 10, 20)])
    n, c = F.col("_n"), F.col("close")
    trend = sum((F.when((n >= k) & (c > F.col(f"_m{k}")), float(pts)).otherwise(0.0) for k, pts in ((5, 20), (10, 15), (20, 15))), F.lit(0.0))
    ch = F.when(F.col("_p") > 0, (c - F.col("_p")) / F.col("_p") * 100).otherwise(0.0)
    mom = F.when(n < 2, 15.0).when(ch > 0, F.least(F.lit(30.0), ch * 3)).otherwise(F.greatest(F.lit(0.0), 15 + ch))
    volume = F.when((n >= 20) & (F.col("_av") > 0), F.least(F.lit(20.0), F.col("_v") / F.col("_av") * 10)).otherwise(10.0)
    return g.select(CODE, "close", F.greatest(F.lit(0.0), F.least(F.lit(100.0), trend + mom + volume)).alias("score"))


def snapshot_score(bars: DataFrame) -> DataFrame:
    """Grade and score from the newest change alone, where no precomputed score exists; needs ``pct_chg``."""
    x = latest_rows(bars, DATE, "close", "pct_chg").where("pct_chg is not null")
    c = F.col("pct_chg")
    return x.withColumns({
        "grade": F.when(c > 3, "S").when(c > 1, "A").when(c > 0, "B").otherwise("C"),
        "enhanced_score": F.when(c > 0, 60 + c * 2).otherwise(50 + c), "trend": F.when(c > 0, "up").otherwise("down")})


def end_of_day_select(quotes: DataFrame, change: tuple[float, float] = (3.0, 5.0), ratio: tuple[float, float] = (1.0, 5.0),
                      cap: tuple[float, float] = (50.0, 200.0), top: int | None = None) -> DataFrame:
    """Late-session screen and rank: closest to a 3.5 % change, a ratio of 2.5 and a cap of 100.

    ``quotes``: ``code, price_change, volume_ratio, market_cap`` and optionally ``above_ma``.
    """
    x = quotes.where(F.col("price_change").between(*change) & F.col("volume_ratio").between(*ratio) & F.col("market_cap").between(*cap))
    x = x.where("above_ma") if "above_ma" in x.columns else x
    s = ((100 - F.abs(F.col("volume_ratio") - 2.5) * 20) * 0.4 + (100 - F.abs(F.col("price_change") - 3.5) * 20) * 0.4
         + (100 - F.abs(F.col("market_cap") - 100) * 0.5) * 0.2)
    x = x.withColumn("total_score", F.round(s, 9))
    return top_n(x, "total_score", top) if top else x


def component_total(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted total of component scores; a missing component counts 0."""
    return df.withColumn("total_score", sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)))
