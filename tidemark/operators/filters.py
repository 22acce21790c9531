"""Stock filters.

A *predicate* filter is a function of the columns: it returns a ``Column`` or
``None`` when a column it needs is absent, in which case the input passes
unchanged.  A *table* filter compares with a side table by semi or anti join.
Null readings never pass a predicate.  ``as_of`` is always an argument.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, div, latest_rows, rmean, rstd, wc_desc
from tidemark.registry import Registry

PREDICATES = Registry("filter")
TABLES = Registry("table filter")

# Name marks and keywords of risk.
ST_NAMES = ["ST", "st", "*ST", "*st", "S*T", "S*st"]
DELISTING_NAMES = ["退", "退市", "终止上市", "暂停上市", "风险警示"]
RISK_KEYWORDS = ["减持计划", "减持公告", "退市", "终止上市", "财务造假", "立案调查", "行政处罚", "违规"]
SUSPENDED = "停牌"
ONE_WORD_BOARD = "一字板"
EXCLUDED_PREFIXES = ["688", "300", "430", "870"]


def _pattern(words: Sequence[str]) -> str:
    return "|".join(w.replace("*", r"\*") for w in words)


def _day(d: str | Column) -> Column:
    return F.lit(d).cast("date") if isinstance(d, str) else d


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def _pick(df: DataFrame, *cols: str) -> str | None:
    return next((c for c in cols if c in df.columns), None)


# -- names, listing, state ---------------------------------------------------


@PREDICATES.register("st_filter", "stock")
def st(df: DataFrame) -> Column | None:
    return ~F.col("name").rlike(_pattern(ST_NAMES)) if _has(df, "name") else None


@PREDICATES.register("new_stock_filter", "stock")
def new_stock(df: DataFrame, as_of: str, min_listing_days: int = 60) -> Column | None:
    if not _has(df, "list_date"):
        return None
    return F.col("list_date").cast("date") <= F.date_sub(_day(as_of), min_listing_days)


@PREDICATES.register("delisting_filter", "stock")
def delisting(df: DataFrame, patterns: Sequence[str] = tuple(DELISTING_NAMES)) -> Column | None:
    return ~F.col("name").rlike(_pattern(patterns)) if _has(df, "name") else None


@PREDICATES.register("market_cap_filter", "market")
def market_cap(df: DataFrame, min_market_cap: float = 5e9) -> Column | None:
    c = _pick(df, "market_cap", "total_market_cap")
    return F.col(c) >= min_market_cap if c else None


@PREDICATES.register("suspension_filter", "market")
def suspension(df: DataFrame) -> Column | None:
    if _has(df, "trade_status"):
        return F.col("trade_status") != SUSPENDED
    return F.col("volume") > 0 if _has(df, "volume") else None


@PREDICATES.register("price_filter", "market")
def price(df: DataFrame, min_price: float = 2.0, max_price: float = 300.0) -> Column | None:
    return F.col("close").between(min_price, max_price) if _has(df, "close") else None


@PREDICATES.register("volume_filter", "market")
def volume(df: DataFrame, min_volume: float = 1e6) -> Column | None:
    return F.col("volume") >= min_volume if _has(df, "volume") else None


@PREDICATES.register("data_freshness_filter", "market")
def data_freshness(df: DataFrame, as_of: str, max_age_days: int = 30) -> Column | None:
    return F.to_date(F.col(DATE)) >= F.date_sub(_day(as_of), max_age_days) if _has(df, DATE) else None


@PREDICATES.register("volume_ratio_filter", "liquidity")
def volume_ratio(df: DataFrame, min_ratio: float = 1.0, max_ratio: float = 5.0) -> Column | None:
    return F.col("volume_ratio").between(min_ratio, max_ratio) if _has(df, "volume_ratio") else None


@PREDICATES.register("turnover_rate_filter", "liquidity")
def turnover_rate(df: DataFrame, min_rate: float = 0.05, max_rate: float = 0.20) -> Column | None:
    return F.col("turnover_rate").between(min_rate, max_rate) if _has(df, "turnover_rate") else None


@PREDICATES.register("float_market_cap_filter", "valuation")
def float_market_cap(df: DataFrame, min_cap: float = 3e9, max_cap: float = 3e10) -> Column | None:
    c = _pick(df, "float_market_cap", "circ_mv")
    return F.col(c).between(min_cap, max_cap) if c else None


@PREDICATES.register("price_range_filter", "valuation")
def price_range(df: DataFrame, min_price: float = 5.0, max_price: float = 80.0) -> Column | None:
    return F.col("close").between(min_price, max_price) if _has(df, "close") else None


@PREDICATES.register("valuation_filter", "valuation")
def valuation(df: DataFrame, max_pe: float = 100.0, max_pb: float = 10.0, check_pe: bool = True,
              check_pb: bool = True) -> Column | None:
    out = None
    for c, top, on in (("pe_ttm", max_pe, check_pe), ("pb", max_pb, check_pb)):
        if on and _has(df, c):
            p = (F.col(c) > 0) & (F.col(c) <= top)
            out = p if out is None else out & p
    return out


@PREDICATES.register("trend_filter", "technical")
def trend(df: DataFrame) -> Column | None:
    return F.col("ma_short") > F.col("ma_long") if _has(df, "ma_short", "ma_long") else None


@PREDICATES.register("ma_position_filter", "technical")
def ma_position(df: DataFrame, ma_periods: Sequence[int] = (20, 60), require_all: bool = False) -> Column | None:
    conds = [F.col("close") > F.col(f"ma{n}") for n in ma_periods if _has(df, f"ma{n}")]
    out = None
    for c in conds:
        out = c if out is None else (out & c if require_all else out | c)
    return out


@PREDICATES.register("monthly_ma_filter", "technical")
def monthly_ma(df: DataFrame, ma_period: int = 60) -> Column | None:
    c = f"monthly_ma{ma_period}"
    return F.col("close") > F.col(c) if _has(df, c, "close") else None


@PREDICATES.register("macd_cross_filter", "technical")
def macd_cross(df: DataFrame, check_monthly: bool = True, check_daily: bool = True) -> Column | None:
    out = None
    for on, a, b in ((check_monthly, "monthly_macd_dif", "monthly_macd_dea"), (check_daily, "macd_dif", "macd_dea")):
        if on and _has(df, a, b):
            p = F.col(a) > F.col(b)
            out = p if out is None else out & p
    return out


@PREDICATES.register("limit_up_trap_filter", "pattern")
def limit_up_trap(df: DataFrame, max_turnover_on_limit: float = 0.20, exclude_one_word: bool = True) -> Column | None:
    out = None
    if exclude_one_word and _has(df, "limit_up_type"):
        out = F.col("limit_up_type") != ONE_WORD_BOARD
    if _has(df, "turnover_rate", "is_limit_up"):
        p = ~(F.col("is_limit_up") & (F.col("turnover_rate") > max_turnover_on_limit))
        out = p if out is None else out & p
    return out


@PREDICATES.register("over_hyped_filter", "pattern")
def over_hyped(df: DataFrame, max_limit_days: int = 3, max_gain_pct: float = 0.5) -> Column | None:
    out = None
    for c, top in (("continuous_limit_days", max_limit_days), ("gain_pct_20d", max_gain_pct)):
        if _has(df, c):
            p = F.col(c) <= top
            out = p if out is None else out & p
    return out


@PREDICATES.register("pullback_signal_filter", "pattern")
def pullback_signal(df: DataFrame, pullback_days: int = 3, ma_period: int = 5) -> Column | None:
    if not _has(df, "days_since_limit", "has_pullback", f"ma{ma_period}"):
        return None
    return ~((F.col("days_since_limit") >= pullback_days) & ~F.col("has_pullback"))


@PREDICATES.register("institution_signal_filter", "pattern")
def institution_signal(df: DataFrame) -> Column | None:
    return F.col("institution_buy_signal") if _has(df, "institution_buy_signal") else None


@PREDICATES.register("limit_up_after_filter", "pattern")
def limit_up_after(df: DataFrame, max_days_after_limit: int = 5, require_volume_shrink: bool = True) -> Column | None:
    out = F.col("days_since_limit") <= max_days_after_limit if _has(df, "days_since_limit") else None
    if require_volume_shrink and _has(df, "volume_shrink"):
        p = F.col("volume_shrink")
        out = p if out is None else out & p
    return out


@PREDICATES.register("illegal_filter", "fundamental")
def illegal(df: DataFrame, exclude_types: Sequence[str] = tuple(RISK_KEYWORDS)) -> Column | None:
    c = _pick(df, "risk_flag", "announcement")
    return ~F.col(c).rlike(_pattern(exclude_types)) if c else None


@PREDICATES.register("performance_filter", "fundamental")
def performance(df: DataFrame, min_profit_growth: float = -0.5) -> Column | None:
    out = F.col("net_profit") > 0 if _has(df, "net_profit") else None
    if _has(df, "profit_yoy"):
        p = F.col("profit_yoy") >= min_profit_growth
        out = p if out is None else out & p
    return out


@PREDICATES.register("price_change_filter", "strategy")
def price_change(df: DataFrame, price: tuple[float, float] | None = None,
                 change: tuple[float, float] | None = None) -> Column | None:
    out = F.lit(True)
    if price:
        out = out & F.col("close").between(*price)
    if change:
        out = out & F.col("pct_chg").between(*change)
    return out


@PREDICATES.register("suspended_pick_filter", "strategy")
def suspended_pick(df: DataFrame) -> Column | None:
    out = None
    for c, p in (("volume", F.col("volume") > 0), ("pct_chg", F.col("pct_chg").isNotNull()), ("turnover", F.col("turnover") > 0)):
        if _has(df, c):
            out = p if out is None else out & p
    return out


@PREDICATES.register("risky_pick_filter", "strategy")
def risky_pick(df: DataFrame, words: Sequence[str] = ("ST", "退"), max_change: float = 30.0) -> Column | None:
    return (~F.col("name").rlike(_pattern(words)) & (F.col("close") >= 1) & (F.col("close") < 300)
            & (F.abs("pct_chg") < max_change))


@PREDICATES.register("board_prefix_filter", "strategy")
def board_prefix(df: DataFrame, prefixes: Sequence[str] = tuple(EXCLUDED_PREFIXES)) -> Column | None:
    return ~F.col(CODE).rlike("^(" + "|".join(prefixes) + ")")


@PREDICATES.register("risk_control_filter", "strategy")
def risk_control(df: DataFrame, as_of: str, min_value: float = 0.0, new_days: int = 60,
                 st_words: Sequence[str] = ("ST", "退市")) -> Column | None:
    one_price = F.col("high") == F.col("low")
    return ((F.col("close") * F.col("volume") >= min_value) & ~F.col("name").rlike(_pattern(st_words))
            & (F.datediff(_day(as_of), F.col("list_date")) >= new_days)
            & ~(one_price & (F.col("high") > F.col("open") * 1.095)) & ~(one_price & (F.col("low") < F.col("open") * 0.905)))


# -- panels: the last rows decide -------------------------------------------


@TABLES.register("volume_stability_filter", "liquidity")
def volume_stability(bars: DataFrame, lookback: int = 10, threshold: float = 0.5) -> DataFrame:
    """Codes whose newest volume variation (std / mean) stays within the threshold."""
    cv = bars.withColumn("_cv", div(rstd("volume", lookback), rmean("volume", lookback)))
    last = latest_rows(cv.select(CODE, DATE, "_cv"))
    drop = last.where(F.col("_cv") > threshold).select(CODE)
    return bars.join(drop, CODE, "left_anti")


@TABLES.register("continuous_low_turnover_filter", "liquidity")
def continuous_low_turnover(bars: DataFrame, min_rate: float = 0.05, days: int = 2, col: str = "turnover") -> DataFrame:
    """Drop codes whose newest ``days`` readings are all low (codes with fewer rows stay)."""
    last = bars.select(CODE, DATE, col).withColumn("_rn", F.row_number().over(wc_desc())).where(F.col("_rn") <= days)
    bad = last.groupBy(CODE).agg(F.max(col).alias("_m"), F.count(F.lit(1)).alias("_n"))
    bad = bad.where((F.col("_m") < min_rate) & (F.col("_n") >= days)).select(CODE)
    return bars.join(bad, CODE, "left_anti")


@TABLES.register("min_history_filter", "strategy")
def min_history(bars: DataFrame, rows: int = 252) -> DataFrame:
    ok = bars.groupBy(CODE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows).select(CODE)
    return bars.join(ok, CODE, "left_semi")


@TABLES.register("market_crash_filter", "fundamental")
def market_crash(df: DataFrame, index_state: DataFrame, max_drop: float = -2.0) -> DataFrame:
    """Nothing passes while the newest index change is below ``max_drop`` percent."""
    calm = latest_rows(index_state.withColumn("_i", F.lit(1)), DATE, "change", by="_i").where(F.col("change") >= max_drop)
    return df.withColumn("_i", F.lit(1)).join(calm.select("_i"), "_i", "left_semi").drop("_i")


# -- statements --------------------------------------------------------------


def fresh_indicators(indicators: DataFrame, as_of: str, max_age_days: int = 120) -> DataFrame:
    """Newest indicator row per code, if not older than the limit."""
    seen = indicators.where(F.col("report_date") <= _day(as_of))
    last = latest_rows(seen, by=CODE, date="report_date")
    return last.where(F.datediff(_day(as_of), F.col("report_date")) <= max_age_days)


def _by_indicators(df: DataFrame, indicators: DataFrame, as_of: str, pred: Column, max_age_days: int) -> DataFrame:
    ok = fresh_indicators(indicators, as_of, max_age_days).where(pred).select(CODE)
    return df.join(ok, CODE, "left_semi")


@TABLES.register("roe_filter", "financial")
def roe(df, indicators, as_of, min_roe: float = 15.0, max_roe: float = 100.0, max_age_days: int = 120) -> DataFrame:
    return _by_indicators(df, indicators, as_of, F.col("roe").between(min_roe, max_roe), max_age_days)


@TABLES.register("profitability_filter", "financial")
def profitability(df, indicators, as_of, min_roe: float = 10.0, min_gross: float = 20.0, min_net: float = 5.0,
                  max_age_days: int = 120) -> DataFrame:
    p = (F.col("roe") >= min_roe) & (F.col("gross_margin") >= min_gross) & (F.col("net_margin") >= min_net)
    return _by_indicators(df, indicators, as_of, p, max_age_days)


@TABLES.register("solvency_filter", "financial")
def solvency(df, indicators, as_of, max_debt: float = 70.0, min_current: float = 1.0, max_age_days: int = 120) -> DataFrame:
    p = (F.col("debt_to_asset") <= max_debt) & (F.col("current_ratio") >= min_current)
    return _by_indicators(df, indicators, as_of, p, max_age_days)


@TABLES.register("growth_filter", "financial")
def growth(df, indicators, as_of, min_revenue: float = 10.0, min_profit: float = 10.0, max_age_days: int = 120) -> DataFrame:
    p = (F.col("revenue_growth") >= min_revenue) & (F.col("profit_growth") >= min_profit)
    return _by_indicators(df, indicators, as_of, p, max_age_days)


@TABLES.register("cashflow_filter", "financial")
def cashflow(df, indicators, as_of, min_ocf_to_profit: float = 0.5, max_age_days: int = 120) -> DataFrame:
    return _by_indicators(df, indicators, as_of, F.col("ocf_to_profit") >= min_ocf_to_profit, max_age_days)


def financial_score() -> Column:
    """Composite 0-100: profitability 40, solvency 20, growth 25, cash flow 15; only null counts as missing."""
    def v(c: str, default: float) -> Column:
        return F.coalesce(F.col(c), F.lit(default))

    def cap(x: Column) -> Column:
        return F.least(x, F.lit(1.0))

    def pos(x: Column) -> Column:
        return F.greatest(x, F.lit(0.0))

    profit = (cap(v("roe", 0) / 20) * 0.5 + cap(v("gross_margin", 0) / 40) * 0.3 + cap(v("net_margin", 0) / 20) * 0.2) * 40
    solv = (pos(1 - v("debt_to_asset", 50) / 100) * 0.6 + cap(v("current_ratio", 1.5) / 2) * 0.4) * 20
    grow = (cap(pos(v("revenue_growth", 0)) / 30) * 0.5 + cap(pos(v("profit_growth", 0)) / 30) * 0.5) * 25
    cash = cap(pos(v("ocf_to_profit", 0))) * 15
    return profit + solv + grow + cash


@TABLES.register("financial_composite_filter", "financial")
def financial_composite(df, indicators, as_of, min_score: float = 60.0, top_n: int | None = None,
                        max_age_days: int = 120) -> DataFrame:
    scored = fresh_indicators(indicators, as_of, max_age_days).withColumn("_score", financial_score())
    if top_n:
        ok = scored.orderBy(F.col("_score").desc(), CODE).limit(top_n)
    else:
        ok = scored.where(F.col("_score") >= min_score)
    return df.join(ok.select(CODE), CODE, "left_semi")


# -- events ------------------------------------------------------------------


def event_codes(events: DataFrame, as_of: str, days: int, pred: Column | None = None,
                date: str = "publish_date") -> DataFrame:
    """Distinct codes with a matching event in the window ending at ``as_of``."""
    hit = events.where(F.col(date).between(F.date_sub(_day(as_of), days), _day(as_of)))
    return (hit.where(pred) if pred is not None else hit).select(CODE).distinct()


def _semi_unless_empty(df: DataFrame, codes: DataFrame, events: DataFrame) -> DataFrame:
    """Semi join; when the event table has no row at all the input passes unchanged."""
    empty = events.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit(1).alias("_k"))
    keyed = df.withColumn("_k", F.lit(1))
    passed = keyed.join(empty, "_k", "left_semi").drop("_k")
    return df.join(codes, CODE, "left_semi").unionByName(passed)


@TABLES.register("performance_forecast_filter", "announcement")
def performance_forecast(df, events, as_of, types: Sequence[str] = ("预增", "扭亏"), days: int = 7,
                         min_change: float | None = None) -> DataFrame:
    p = F.col("subtype").isin(*types)
    if min_change is not None:
        p = p & (F.col("ratio") >= min_change)
    return _semi_unless_empty(df, event_codes(events, as_of, days, p), events)


@TABLES.register("major_event_filter", "announcement")
def major_event(df, events, as_of, types: Sequence[str], min_importance: int = 0, days: int = 3) -> DataFrame:
    p = F.col("subtype").isin(*types) & (F.col("importance") >= min_importance)
    return _semi_unless_empty(df, event_codes(events, as_of, days, p), events)


@TABLES.register("equity_change_filter", "announcement")
def equity_change(df, events, as_of, types: Sequence[str], min_ratio: float = 0.5, days: int = 7) -> DataFrame:
    p = F.col("subtype").isin(*types) & (F.col("ratio") >= min_ratio)
    return _semi_unless_empty(df, event_codes(events, as_of, days, p), events)


@TABLES.register("trading_resume_filter", "announcement")
def trading_resume(df, halts, as_of, days: int = 3) -> DataFrame:
    return df.join(event_codes(halts, as_of, days), CODE, "left_anti")


@TABLES.register("announcement_composite_filter", "announcement")
def announcement_composite(df, code_sets: Mapping[str, DataFrame], require: Sequence[str]) -> DataFrame:
    """Union of the code sets that are required."""
    out = None
    for name in require:
        s = code_sets[name].select(CODE)
        out = s if out is None else out.unionByName(s)
    return df.join(out.distinct(), CODE, "left_semi") if out is not None else df.limit(0)


@TABLES.register("dragon_tiger_filter", "behavior")
def dragon_tiger(df, seats, as_of, min_institution_net: float = 500.0, days: int = 3) -> DataFrame:
    """Institution seats net buying at least the given amount in one day of the window."""
    net = (seats.where(F.col("is_institution") & F.col(DATE).between(F.date_sub(_day(as_of), days), _day(as_of)))
                .groupBy(CODE, DATE).agg(F.sum("net_buy_amount").alias("_net")))
    return df.join(net.where(F.col("_net") >= min_institution_net).select(CODE).distinct(), CODE, "left_semi")


@TABLES.register("money_flow_filter", "behavior")
def money_flow(df, flows, min_main_net: float = 1000.0, min_main_ratio: float = 5.0) -> DataFrame:
    last = latest_rows(flows)
    ok = last.where((F.col("main_net") >= min_main_net) & (F.col("main_ratio") >= min_main_ratio))
    return df.join(ok.select(CODE), CODE, "left_semi")


@TABLES.register("northbound_filter", "behavior")
def northbound(df, holdings, min_hold_ratio: float = 1.0) -> DataFrame:
    return df.join(latest_rows(holdings).where(F.col("hold_ratio") >= min_hold_ratio).select(CODE), CODE, "left_semi")


@TABLES.register("main_force_filter", "behavior")
def main_force(df, seats, flows, holdings, as_of, require_northbound: bool = False, min_institution_net: float = 500.0,
               min_main_net: float = 1000.0, min_main_ratio: float = 5.0, days: int = 3) -> DataFrame:
    """(seat codes or flow codes), and northbound codes when required; all codes are checked."""
    base = df.select(CODE)
    codes = dragon_tiger(base, seats, as_of, min_institution_net, days).unionByName(
        money_flow(base, flows, min_main_net, min_main_ratio)).distinct()
    if require_northbound:
        codes = northbound(codes, holdings)
    return df.join(codes, CODE, "left_semi")


@TABLES.register("delisting_guard", "stock")
def delisting_guard(df, delisted: DataFrame, suspended: DataFrame | None = None, risk: DataFrame | None = None,
                    patterns: Sequence[str] = tuple(DELISTING_NAMES)) -> DataFrame:
    out = df.where(F.coalesce(~F.col("name").rlike(_pattern(patterns)), F.lit(True)))
    for t in (delisted, suspended, risk):
        if t is not None:
            out = out.join(t.select(CODE), CODE, "left_anti")
    return out


def suspected_delisted(codes: DataFrame, bars: DataFrame, as_of: str, days_back: int = 90) -> DataFrame:
    """Codes without any bar in the window, with their newest bar date."""
    newest = bars.groupBy(CODE).agg(F.max(DATE).alias("last_date"))
    recent = newest.where(F.col("last_date") >= F.date_sub(_day(as_of), days_back)).select(CODE)
    return codes.select(CODE).join(recent, CODE, "left_anti").join(newest, CODE, "left").withColumn(
        "reason", F.lit("no_recent_data"))


# -- screens -----------------------------------------------------------------


def _best(df: DataFrame, top: int | None) -> DataFrame:
    """By score, best first; all rows unless a number is asked for."""
    df = df.orderBy(F.col("enhanced_score").desc(), CODE)
    return df if top is None else df.limit(top)


def grade_screen(df: DataFrame, grade: str, min_score: float, max_score: float | None = None, top: int | None = None) -> DataFrame:
    out = df.where((F.col("grade") == grade) & (F.col("enhanced_score") >= min_score))
    out = out.where(F.col("enhanced_score") < max_score) if max_score is not None else out
    return _best(out, top)


def bullish_screen(df: DataFrame, trend: str, change_min: float, change_max: float, top: int | None = None) -> DataFrame:
    c = F.col("pct_chg")
    return _best(df.where((F.col("trend") == trend) & (c > change_min) & (c < change_max)), top)


def keyword_screen(df: DataFrame, keywords: Sequence[str], top: int | None = None, col: str = "reasons") -> DataFrame:
    for k in keywords:
        df = df.where(F.col(col).contains(k))
    return _best(df, top)


# Default fundamental screen.
SCREEN = {"roe_min": 10.0, "gross_margin_min": 20.0, "profit_growth_min": 20.0, "pe_max": 50.0, "pb_max": 10.0,
          "revenue_growth_min": 20.0}


def fundamental_screen(df: DataFrame, parts: Sequence[str] = ("base", "valuation", "growth"),
                       limits: Mapping[str, float] = SCREEN) -> DataFrame:
    rules = {"base": [("roe", "roe_min", 1), ("gross_margin", "gross_margin_min", 1), ("profit_growth", "profit_growth_min", 1)],
             "valuation": [("pe", "pe_max", -1), ("pb", "pb_max", -1)],
             "growth": [("revenue_growth", "revenue_growth_min", 1), ("profit_growth", "profit_growth_min", 1)]}
    lim = {**SCREEN, **limits}
    for part in parts:
        for c, k, sign in rules[part]:
            if c in df.columns:
                df = df.where(F.col(c) >= lim[k]) if sign > 0 else df.where(F.col(c) <= lim[k])
    return df


# -- engine ------------------------------------------------------------------

# Named presets of predicate filters.
PRESETS: dict[str, list[tuple[str, dict[str, Any]]]] = {
    "conservative": [("st_filter", {}), ("delisting_filter", {}), ("market_cap_filter", {"min_market_cap": 1e10}),
                     ("price_filter", {"min_price": 5.0, "max_price": 100.0}), ("valuation_filter", {"max_pe": 50.0, "max_pb": 5.0})],
    "standard": [("st_filter", {}), ("delisting_filter", {}), ("market_cap_filter", {}), ("price_filter", {})],
    "aggressive": [("st_filter", {}), ("price_filter", {"min_price": 1.0})],
}


def predicate(df: DataFrame, name: str, params: Mapping[str, Any] | None = None) -> Column | None:
    entry = PREDICATES.get(name)
    entry.check(params or {})
    return entry.fn(df, **(params or {}))


def apply(df: DataFrame, name: str, **params: Any) -> DataFrame:
    p = predicate(df, name, params)
    return df if p is None else df.where(p)


def apply_chain(df: DataFrame, chain: Sequence[tuple[str, Mapping[str, Any]]]) -> DataFrame:
    """All predicates in one ``where``: one pass over the input."""
    for name, params in chain:
        p = predicate(df, name, params)
        df = df if p is None else df.where(p)
    return df


def chain_stats(df: DataFrame, chain: Sequence[tuple[str, Mapping[str, Any]]]) -> DataFrame:
    """Rows removed by each filter on its own and in sequence, from one aggregate."""
    before, aggs, names = F.lit(True), [F.count(F.lit(1)).alias("n_0")], []
    for i, (name, params) in enumerate(chain, 1):
        p = predicate(df, name, params)
        p = F.lit(True) if p is None else F.coalesce(p, F.lit(False))
        before = before & p
        aggs += [F.count_if(p).alias(f"own_{i}"), F.count_if(before).alias(f"n_{i}")]
        names.append(name)
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(i).alias("step"), F.lit(n).alias("filter"), F.col(f"n_{i - 1}").alias("rows_in"),
        F.col(f"n_{i}").alias("rows_out"), (F.col("n_0") - F.col(f"own_{i}")).alias("removed_alone"))
        for i, n in enumerate(names, 1)])
    return one.select(F.explode(rows).alias("r")).select("r.*")
