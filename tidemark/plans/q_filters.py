"""Filter and fundamentals queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import lag, latest_rows, rmean, wc, with_runs
from tidemark.operators import filters as X
from tidemark.operators import fundamentals as N
from tidemark.operators import technical as T
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import lagx, macd_ctes, roll
from tidemark.sources.bars import with_change

AS_OF = "2001-10-30"
D = f"DATE '{AS_OF}'"
ST_RE = "ST|st"


def snap_query(name, pred_sql, flt, **params):
    """A predicate filter over the newest row of every code."""
    query(name, sql(f"SELECT code, round(close,4) AS close FROM snap WHERE {pred_sql}", "snap"))(
        lambda s, d: rounded(X.apply(I.snapshot(s, d), flt, **params).select("code", "close")))


snap_query("f01_st", f"NOT regexp_matches(name, '{ST_RE}')", "st_filter")
snap_query("f02_new_stock", f"list_date <= {D} - 900", "new_stock_filter", as_of=AS_OF, min_listing_days=900)
snap_query("f03_delisting", "NOT contains(name, '退')", "delisting_filter")
snap_query("f04_market_cap", "market_cap >= 2e10", "market_cap_filter", min_market_cap=2e10)
snap_query("f05_suspension", "volume > 0", "suspension_filter")
snap_query("f06_price", "close BETWEEN 2 AND 27", "price_filter", max_price=27.0)
snap_query("f07_volume", "volume >= 25", "volume_filter", min_volume=25)
snap_query("f08_freshness", f"trade_date >= {D} - 3", "data_freshness_filter", as_of=AS_OF, max_age_days=3)
snap_query("f13_float_cap", "float_market_cap BETWEEN 3e9 AND 2e10", "float_market_cap_filter", max_cap=2e10)
snap_query("f14_price_range", "close BETWEEN 5 AND 26", "price_range_filter", max_price=26.0)
snap_query("f15_valuation", "pe_ttm > 0 AND pe_ttm <= 60 AND pb > 0 AND pb <= 8", "valuation_filter", max_pe=60.0, max_pb=8.0)
snap_query("f43_price_change", "close BETWEEN 3 AND 100 AND pct_chg BETWEEN -5 AND 9", "price_change_filter", price=(3, 100), change=(-5, 9))
snap_query("f44_suspended_pick", "volume > 0 AND pct_chg IS NOT NULL AND turnover > 0", "suspended_pick_filter")
snap_query("f45_risky_pick", "NOT regexp_matches(name, 'ST|退') AND close >= 1 AND close < 300 AND abs(pct_chg) < 10", "risky_pick_filter", max_change=10.0)
snap_query("f46_board_prefix", "NOT regexp_matches(code, '^(00001|00002)')", "board_prefix_filter", prefixes=("00001", "00002"))
snap_query("f47_risk_control", f"close*volume >= 400 AND NOT regexp_matches(name,'ST|退市') AND date_diff('day', list_date, {D}) >= 200 AND NOT (high=low AND high > open*1.095) AND NOT (high=low AND low < open*0.905)",
           "risk_control_filter", as_of=AS_OF, min_value=400.0, new_days=200)

# panel rows with features


def featured(s, d):
    """Panel with the columns the technical and pattern filters read."""
    b = with_change(I.bars(s, d))
    b = b.withColumn("is_limit_up", F.coalesce(F.col("pct_chg") >= 9.0, F.lit(False)))
    b = with_runs(b, "is_limit_up", "continuous_limit_days")
    w = wc()
    last_limit = F.max(F.when(F.col("is_limit_up"), F.col("_rn"))).over(w.rowsBetween(-(10 ** 9), 0))
    b = b.withColumn("_rn", F.row_number().over(w)).withColumn("days_since_limit", F.col("_rn") - last_limit)
    return b.withColumns({
        "ma5": rmean("close", 5), "ma20": rmean("close", 20), "ma60": rmean("close", 60), "ma_short": rmean("close", 5),
        "ma_long": rmean("close", 20), "gain_pct_20d": F.try_divide(F.col("close"), lag("close", 20)) - 1,
        "turnover_rate": F.col("turnover") / 100, "volume_ratio": F.try_divide(F.col("volume"), rmean("volume", 5)),
        "volume_shrink": F.col("volume") < lag("volume"), "has_pullback": F.col("low") <= rmean("close", 5),
        "limit_up_type": F.when(F.col("is_limit_up") & (F.col("high") == F.col("low")), X.ONE_WORD_BOARD).otherwise(""),
        "institution_buy_signal": F.pmod("volume", F.lit(3)) == 0}).drop("_rn")


FEAT = f"""f0 AS (SELECT *, coalesce(pct_chg >= 9, false) AS is_limit_up, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS rn FROM chg),
f1 AS (SELECT *, max(CASE WHEN is_limit_up THEN rn END) OVER (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS ll, max(CASE WHEN NOT is_limit_up THEN rn ELSE 0 END) OVER (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS lb FROM f0),
feat AS (SELECT *, rn - lb AS continuous_limit_days, rn - ll AS days_since_limit, {roll('avg', 'close', 5)} AS ma5, {roll('avg', 'close', 20)} AS ma20, {roll('avg', 'close', 60)} AS ma60,
 close/{lagx('close', 20)} - 1 AS gain_pct_20d, turnover/100 AS turnover_rate, volume/({roll('avg', 'volume', 5)}) AS volume_ratio, volume < {lagx('volume')} AS volume_shrink FROM f1)"""


def panel_query(name, pred_sql, flt, **params):
    query(name, sql(f"WITH {FEAT} SELECT code, trade_date FROM feat WHERE {pred_sql}", "chg"))(
        lambda s, d: X.apply(featured(s, d), flt, **params).select("code", "trade_date"))


panel_query("f09_volume_ratio", "volume_ratio BETWEEN 1 AND 1.5", "volume_ratio_filter", max_ratio=1.5)
panel_query("f10_turnover_rate", "turnover_rate BETWEEN 0.02 AND 0.04", "turnover_rate_filter", min_rate=0.02, max_rate=0.04)
panel_query("f16_trend", "ma5 > ma20", "trend_filter")
panel_query("f17_ma_position_any", "close > ma20 OR close > ma60", "ma_position_filter")
panel_query("f17_ma_position_all", "close > ma20 AND close > ma60", "ma_position_filter", require_all=True)
panel_query("f20_limit_up_trap", "NOT (is_limit_up AND high = low) AND NOT (is_limit_up AND turnover_rate > 0.02)", "limit_up_trap_filter", max_turnover_on_limit=0.02)
panel_query("f21_over_hyped", "continuous_limit_days <= 1 AND gain_pct_20d <= 0.1", "over_hyped_filter", max_limit_days=1, max_gain_pct=0.1)
panel_query("f22_pullback_signal", "NOT (days_since_limit >= 3 AND NOT (low <= ma5))", "pullback_signal_filter")
panel_query("f23_institution_signal", "volume % 3 = 0", "institution_signal_filter")
panel_query("f24_limit_up_after", "days_since_limit <= 5 AND volume_shrink", "limit_up_after_filter")

query("f11_volume_stability", sql(f"""WITH v AS (SELECT code, trade_date, ({roll('stddev_samp', 'volume', 10)})/({roll('avg', 'volume', 10)}) AS cv FROM bars),
bad AS (SELECT code FROM v QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)=1 AND cv > 0.5)
SELECT code, count(*) AS n FROM bars WHERE code NOT IN (SELECT code FROM (SELECT code, cv, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) r FROM v) WHERE r=1 AND cv>0.5) GROUP BY 1""", "bars"))(
    lambda s, d: X.volume_stability(I.bars(s, d)).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
query("f12_low_turnover", sql("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS r FROM bars),
bad AS (SELECT code FROM r WHERE r<=2 GROUP BY 1 HAVING max(turnover) < 2.5 AND count(*)>=2)
SELECT code, count(*) AS n FROM bars WHERE code NOT IN (SELECT code FROM bad) GROUP BY 1""", "bars"))(
    lambda s, d: X.continuous_low_turnover(I.bars(s, d), 2.5).groupBy("code").agg(F.count(F.lit(1)).alias("n")))


def monthly(s, d):
    m = (I.bars(s, d).groupBy("code", F.trunc("trade_date", "month").alias("trade_date")).agg(F.max_by("close", "trade_date").alias("close")))
    return m.withColumn("monthly_ma60", rmean("close", 60))


query("f18_monthly_ma", sql(f"""WITH m AS (SELECT code, CAST(date_trunc('month', trade_date) AS DATE) AS trade_date, arg_max(close, trade_date) AS close FROM bars GROUP BY ALL),
x AS (SELECT *, {roll('avg', 'close', 60)} AS ma FROM m) SELECT code, trade_date FROM x WHERE close > ma""", "bars"))(
    lambda s, d: X.apply(monthly(s, d), "monthly_ma_filter").select("code", "trade_date"))
query("f19_macd_cross", sql("WITH " + macd_ctes(False) + " SELECT code, trade_date FROM e2 WHERE round(dif - dea, 9) > 0", "bars"))(
    lambda s, d: X.apply(T.macd(I.bars(s, d), adjust=False).withColumns({"macd_dif": F.round(F.col("dif") - F.col("dea"), 9), "macd_dea": F.lit(0.0)}),
                         "macd_cross_filter").select("code", "trade_date"))
# texts: documents as announcements
query("f25_illegal", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 'license|License|copyright|Copyright')")(
    lambda s, d: X.apply(I.table(s, d, "documents").withColumnRenamed("text", "announcement"), "illegal_filter",
                         exclude_types=("license", "License", "copyright", "Copyright")).select("doc_id"))


def indicators(s, d):
    return N.ratios(I.balance_sheet(s, d), I.income_statement(s, d), I.cash_flow(s, d))


IND = """j AS (SELECT * FROM bs JOIN inc USING (code, report_date) JOIN cf USING (code, report_date)),
ind AS (SELECT code, report_date, net_profit_parent/total_equity*100 AS roe, net_profit/total_assets*100 AS roa, (operating_revenue-operating_cost)/operating_revenue*100 AS gross_margin,
 net_profit/operating_revenue*100 AS net_margin, operating_profit/operating_revenue*100 AS operating_margin, total_current_assets/nullif(total_current_liabilities,0) AS current_ratio,
 (total_current_assets-inventory)/nullif(total_current_liabilities,0) AS quick_ratio, cash_and_deposits/nullif(total_current_liabilities,0) AS cash_ratio,
 total_liabilities/total_assets*100 AS debt_to_asset, total_liabilities/total_equity*100 AS debt_to_equity, total_assets/total_equity AS equity_multiplier,
 operating_cost/nullif(inventory,0) AS inventory_turnover, operating_revenue/nullif(accounts_receivable,0) AS receivable_turnover, operating_revenue/total_assets AS total_asset_turnover,
 operating_revenue/total_current_assets AS current_asset_turnover,
 (operating_revenue - lag(operating_revenue) OVER w)/abs(lag(operating_revenue) OVER w)*100 AS revenue_growth, (net_profit - lag(net_profit) OVER w)/nullif(abs(lag(net_profit) OVER w),0)*100 AS profit_growth,
 (net_profit_parent - lag(net_profit_parent) OVER w)/nullif(abs(lag(net_profit_parent) OVER w),0)*100 AS net_profit_growth, (total_assets - lag(total_assets) OVER w)/abs(lag(total_assets) OVER w)*100 AS asset_growth,
 (total_equity - lag(total_equity) OVER w)/abs(lag(total_equity) OVER w)*100 AS equity_growth, (accounts_receivable - lag(accounts_receivable) OVER w)/nullif(abs(lag(accounts_receivable) OVER w),0)*100 AS receivable_growth,
 operating_cash_flow/nullif(net_profit,0) AS ocf_to_profit, operating_cash_flow/operating_revenue AS ocf_to_revenue, operating_cash_flow-abs(cash_for_fixed_assets) AS free_cash_flow,
 (operating_cash_flow-abs(cash_for_fixed_assets))/nullif(net_profit,0) AS fcf_to_profit, basic_eps AS eps, total_equity/share_capital AS bps, operating_cash_flow/share_capital AS ocf_per_share
 FROM j WINDOW w AS (PARTITION BY code ORDER BY report_date))"""
ICOLS = ("roe roa gross_margin net_margin operating_margin current_ratio quick_ratio cash_ratio debt_to_asset debt_to_equity equity_multiplier inventory_turnover receivable_turnover "
         "total_asset_turnover current_asset_turnover revenue_growth profit_growth net_profit_growth asset_growth equity_growth receivable_growth ocf_to_profit ocf_to_revenue "
         "free_cash_flow fcf_to_profit eps bps ocf_per_share").split()
query("n01_n02_ratios", sql(f"WITH {IND} SELECT code, report_date, {', '.join(f'round({c},3) AS {c}' for c in ICOLS)} FROM ind", "stm"))(
    lambda s, d: rounded(indicators(s, d), 3))
FRESH = f"""fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY report_date DESC) AS r FROM ind WHERE report_date <= {D}) WHERE r=1 AND date_diff('day', report_date, {D}) <= 120)"""


def ind_query(name, pred, fn, **kw):
    query(name, sql(f"WITH {IND}, {FRESH} SELECT code, name FROM stocks WHERE code IN (SELECT code FROM fresh WHERE {pred})", "stm", "stocks"))(
        lambda s, d: fn(I.stocks(s, d).select("code", "name"), indicators(s, d), AS_OF, **kw))


ind_query("f28_roe", "roe BETWEEN 5 AND 100", X.roe, min_roe=5.0)
ind_query("f29_profitability", "roe >= 5 AND gross_margin >= 20 AND net_margin >= 5", X.profitability, min_roe=5.0)
ind_query("f30_solvency", "debt_to_asset <= 70 AND current_ratio >= 1", X.solvency)
ind_query("f31_growth", "revenue_growth >= -60 AND profit_growth >= -60", X.growth, min_revenue=-60.0, min_profit=-60.0)
ind_query("f32_cashflow", "ocf_to_profit >= 0.5", X.cashflow)
FSCORE = """(least(coalesce(roe,0)/20,1)*0.5+least(coalesce(gross_margin,0)/40,1)*0.3+least(coalesce(net_margin,0)/20,1)*0.2)*40
 + (greatest(1-coalesce(debt_to_asset,50)/100,0)*0.6+least(coalesce(current_ratio,1.5)/2,1)*0.4)*20
 + (least(greatest(coalesce(revenue_growth,0),0)/30,1)*0.5+least(greatest(coalesce(profit_growth,0),0)/30,1)*0.5)*25 + least(greatest(coalesce(ocf_to_profit,0),0),1)*15"""
ind_query("f33_financial_composite", f"{FSCORE} >= 45", X.financial_composite, min_score=45.0)
query("m05_financial_score", sql(f"WITH {IND} SELECT code, report_date, round(CAST({FSCORE} AS DOUBLE),3) AS financial_score FROM ind", "stm"))(
    lambda s, d: indicators(s, d).select("code", "report_date", F.round(X.financial_score(), 3).alias("financial_score")))
query("f26_performance", sql(f"WITH {IND} SELECT i.code, i.report_date FROM ind i JOIN inc USING (code, report_date) WHERE net_profit > 0 AND profit_growth/100 >= -0.5", "stm"))(
    lambda s, d: X.apply(indicators(s, d).join(I.income_statement(s, d).select("code", "report_date", "net_profit"), ["code", "report_date"])
                         .withColumn("profit_yoy", F.col("profit_growth") / 100), "performance_filter").select("code", "report_date"))
query("f27_market_crash", sql("""WITH ix AS (SELECT trade_date, avg(close) AS c FROM bars GROUP BY 1), c AS (SELECT trade_date, (c/lag(c) OVER (ORDER BY trade_date)-1)*100 AS change FROM ix),
l AS (SELECT change FROM c ORDER BY trade_date DESC LIMIT 1) SELECT code FROM stocks WHERE (SELECT change FROM l) >= -2""", "bars", "stocks"))(
    lambda s, d: X.market_crash(I.stocks(s, d).select("code"), index_change(s, d)))


def index_change(s, d):
    from pyspark.sql import Window
    day = I.bars(s, d).groupBy("trade_date").agg(F.avg("close").alias("c"))
    return day.select("trade_date", ((F.col("c") / F.lag("c").over(Window.orderBy("trade_date")) - 1) * 100).alias("change"))


# events
EV_OF = "2001-07-20"
E_D = f"DATE '{EV_OF}'"


def ev(s, d, kind):
    return I.events_table(s, d).where(F.col("kind") == kind)


def ev_codes(kind, pred, days):
    return f"SELECT code FROM ev WHERE kind='{kind}' AND {pred} AND publish_date BETWEEN {E_D} - {days} AND {E_D}"


def ev_query(name, inner, fn, neg=False):
    query(name, sql(f"SELECT code, name FROM stocks WHERE code {'NOT ' if neg else ''}IN ({inner})", "ev", "stocks"))(
        lambda s, d: fn(s, d, I.stocks(s, d).select("code", "name")))


ev_query("f34_forecast", ev_codes("forecast", "subtype IN ('HIGH','URGENT')", 30),
         lambda s, d, st: X.performance_forecast(st, ev(s, d, "forecast"), EV_OF, ("HIGH", "URGENT"), 30))
ev_query("f35_major_event", ev_codes("major", "subtype IN ('LOW','MEDIUM') AND importance >= 3", 20),
         lambda s, d, st: X.major_event(st, ev(s, d, "major"), EV_OF, ("LOW", "MEDIUM"), 3, 20))
ev_query("f36_equity_change", ev_codes("equity", "subtype IN ('LOW','HIGH') AND ratio >= 2.5", 40),
         lambda s, d, st: X.equity_change(st, ev(s, d, "equity"), EV_OF, ("LOW", "HIGH"), 2.5, 40))
ev_query("f37_trading_resume", ev_codes("halt", "true", 10), lambda s, d, st: X.trading_resume(st, ev(s, d, "halt"), EV_OF, 10), neg=True)
ev_query("f38_announcement_composite", ev_codes("forecast", "true", 7) + " UNION " + ev_codes("major", "true", 7),
         lambda s, d, st: X.announcement_composite(st, {k: X.event_codes(ev(s, d, k), EV_OF, 7) for k in ("forecast", "major", "equity")}, ("forecast", "major")))
query("f34_empty_events_pass", sql("SELECT code, name FROM stocks", "stocks"))(
    lambda s, d: X.performance_forecast(I.stocks(s, d).select("code", "name"), ev(s, d, "none"), EV_OF))

SEATQ = f"""sq AS (SELECT DISTINCT code FROM (SELECT code, trade_date, sum(net_buy_amount) AS net FROM seats WHERE is_institution AND trade_date BETWEEN {D} - 30 AND {D} GROUP BY ALL) WHERE net >= 500)"""
FLOWQ = "fq AS (SELECT code FROM flows QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)=1 AND main_net >= 200 AND main_ratio >= 5)"
FLOWQ = "fq AS (SELECT code FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS r FROM flows) WHERE r=1 AND main_net >= 200 AND main_ratio >= 5)"
HOLDQ = "hq AS (SELECT code FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS r FROM flows) WHERE r=1 AND hold_ratio >= 3)"
query("f39_dragon_tiger", sql(f"WITH {SEATQ} SELECT code, name FROM stocks WHERE code IN (SELECT code FROM sq)", "seats", "stocks"))(
    lambda s, d: X.dragon_tiger(I.stocks(s, d).select("code", "name"), I.seats(s, d), AS_OF, days=30))
query("f40_money_flow", sql(f"WITH {FLOWQ} SELECT code, name FROM stocks WHERE code IN (SELECT code FROM fq)", "flows", "stocks"))(
    lambda s, d: X.money_flow(I.stocks(s, d).select("code", "name"), I.flows(s, d), 200.0))
query("f41_northbound", sql(f"WITH {HOLDQ} SELECT code, name FROM stocks WHERE code IN (SELECT code FROM hq)", "flows", "stocks"))(
    lambda s, d: X.northbound(I.stocks(s, d).select("code", "name"), I.flows(s, d), 3.0))
query("f42_main_force", sql(f"WITH {SEATQ}, {FLOWQ}, {HOLDQ.replace('>= 3', '>= 1')} SELECT code, name FROM stocks WHERE (code IN (SELECT code FROM sq) OR code IN (SELECT code FROM fq)) AND code IN (SELECT code FROM hq)", "seats", "flows", "stocks"))(
    lambda s, d: X.main_force(I.stocks(s, d).select("code", "name"), I.seats(s, d), I.flows(s, d), I.flows(s, d), AS_OF, True, min_main_net=200.0, days=30))
query("f48_min_history", sql("SELECT code, trade_date FROM bars WHERE code IN (SELECT code FROM bars GROUP BY 1 HAVING count(*) >= 535)", "bars"))(
    lambda s, d: X.min_history(I.bars(s, d), 535).select("code", "trade_date"))
query("f49_delisting_guard", sql("SELECT code, name FROM stocks WHERE NOT contains(name,'退') AND acctbal >= 0 AND grade_no <> 6", "stocks"))(
    lambda s, d: X.delisting_guard(I.stocks(s, d), I.stocks(s, d).where("acctbal < 0"), I.stocks(s, d).where("grade_no = 6")).select("code", "name"))
query("f50_suspected_delisted", sql("""WITH l AS (SELECT code, max(trade_date) AS last_date FROM bars GROUP BY 1)
SELECT code, last_date, 'no_recent_data' AS reason FROM stocks LEFT JOIN l USING (code) WHERE last_date IS NULL OR last_date < DATE '2001-11-04' - 4""", "bars", "stocks"))(
    lambda s, d: X.suspected_delisted(I.stocks(s, d), I.bars(s, d), "2001-11-04", 4))


def graded(s, d):
    x = I.snapshot(s, d)
    g = F.when(F.col("grade_no") < 2, "S").when(F.col("grade_no") < 4, "A").otherwise("B")
    return x.select("code", "pct_chg", (F.col("acctbal") / 100).alias("enhanced_score"), g.alias("grade"),
                    F.when(F.col("pct_chg") > 0, "up").otherwise("down").alias("trend"), F.col("industry").alias("reasons"))


GR = "gr AS (SELECT code, pct_chg, acctbal/100 AS enhanced_score, CASE WHEN grade_no<2 THEN 'S' WHEN grade_no<4 THEN 'A' ELSE 'B' END AS grade, CASE WHEN pct_chg>0 THEN 'up' ELSE 'down' END AS trend, industry AS reasons FROM snap)"
query("f51_grade_screens", sql(f"""WITH {GR}, s AS (SELECT 'S' AS screen, code, enhanced_score FROM gr WHERE grade='S' AND enhanced_score>=20 ORDER BY enhanced_score DESC, code LIMIT 8),
a AS (SELECT 'A' AS screen, code, enhanced_score FROM gr WHERE grade='A' AND enhanced_score>=20 AND enhanced_score<80 ORDER BY enhanced_score DESC, code LIMIT 8),
b AS (SELECT 'bullish' AS screen, code, enhanced_score FROM gr WHERE trend='up' AND pct_chg>0.5 AND pct_chg<9 ORDER BY enhanced_score DESC, code LIMIT 8),
k AS (SELECT 'keyword' AS screen, code, enhanced_score FROM gr WHERE contains(reasons,'NATION') AND contains(reasons,'1') ORDER BY enhanced_score DESC, code LIMIT 8)
SELECT screen, code, round(enhanced_score,4) AS enhanced_score FROM (SELECT * FROM s UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM k)""", "snap"))(
    lambda s, d: rounded(_screens(graded(s, d))))


def _screens(g):
    parts = [("S", X.grade_screen(g, "S", 20, top=8)), ("A", X.grade_screen(g, "A", 20, 80, top=8)),
             ("bullish", X.bullish_screen(g, "up", 0.5, 9, top=8)), ("keyword", X.keyword_screen(g, ("NATION", "1"), top=8))]
    out = None
    for n, p in parts:
        p = p.select(F.lit(n).alias("screen"), "code", "enhanced_score")
        out = p if out is None else out.unionByName(p)
    return out


query("f52_fundamental_screen", sql(f"""WITH {IND} SELECT code, report_date FROM ind WHERE roe >= 5 AND gross_margin >= 20 AND profit_growth >= 20 AND revenue_growth >= 20""", "stm"))(
    lambda s, d: X.fundamental_screen(indicators(s, d), limits={"roe_min": 5.0}).select("code", "report_date"))
query("m08_quality_rank", sql(f"""WITH {IND} SELECT code, report_date, round(CAST(least(greatest(roe,0),30)*100/30*0.3 + least(greatest(gross_margin,0),50)*100/50*0.2 + least(greatest(profit_growth,0),50)*100/50*0.3 + (50-least(greatest(net_margin,0),50))*100/50*0.2 AS DOUBLE),3) AS quality_score FROM ind WHERE profit_growth IS NOT NULL""", "stm"))(
    lambda s, d: rounded(_quality(indicators(s, d).where("profit_growth is not null").withColumn("pe", F.col("net_margin"))).select("code", "report_date", "quality_score"), 3))


def _quality(df):
    from tidemark.operators.scoring import quality_rank
    return quality_rank(df)


CHAIN = [("st_filter", {}), ("delisting_filter", {}), ("price_filter", {"max_price": 28.0}), ("market_cap_filter", {"min_market_cap": 1e10}), ("valuation_filter", {"max_pe": 90.0})]
_P = ["NOT regexp_matches(name,'ST|st')", "NOT contains(name,'退')", "close BETWEEN 2 AND 28", "market_cap>=1e10", "(pe_ttm>0 AND pe_ttm<=90 AND pb>0 AND pb<=10)"]
query("f53_filter_statistics", sql("WITH c AS (SELECT " + ", ".join(f"{p} AS p{i}" for i, p in enumerate(_P, 1)) + " FROM snap) " + " UNION ALL ".join(
    f"SELECT {i} AS step, '{CHAIN[i - 1][0]}' AS filter, (SELECT count(*) FROM c WHERE {' AND '.join(['true'] + [f'p{j}' for j in range(1, i)])}) AS rows_in, "
    f"(SELECT count(*) FROM c WHERE {' AND '.join(f'p{j}' for j in range(1, i + 1))}) AS rows_out, (SELECT count(*) FROM c WHERE NOT p{i}) AS removed_alone" for i in range(1, 6)), "snap"))(
    lambda s, d: X.chain_stats(I.snapshot(s, d), CHAIN))

# statements
query("n03_validate_statements", sql("""WITH j AS (SELECT *, total_assets - total_current_assets AS nca, operating_profit*0.9 AS total_profit FROM bs JOIN inc USING (code, report_date) JOIN cf USING (code, report_date))
SELECT rule, count(*) AS n, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS n_passed FROM (
 SELECT 'accounting_equation' AS rule, abs(total_assets-total_liabilities-total_equity) <= total_assets*0.01 AS passed FROM j UNION ALL SELECT 'asset_composition', abs(total_assets-total_current_assets-nca) <= total_assets*0.01 FROM j
 UNION ALL SELECT 'liability_composition', NULL FROM j UNION ALL SELECT 'positive_assets', total_assets>0 FROM j UNION ALL SELECT 'debt_ratio_range', total_liabilities/total_assets*100 BETWEEN 0 AND 100 FROM j
 UNION ALL SELECT 'profit_order', (net_profit<=total_profit AND total_profit<=operating_profit) OR (operating_profit<=total_profit AND total_profit<=net_profit) FROM j UNION ALL SELECT 'positive_revenue', operating_revenue>0 FROM j
 UNION ALL SELECT 'eps_sign', CASE WHEN basic_eps<>0 THEN sign(net_profit_parent)=sign(basic_eps) END FROM j UNION ALL SELECT 'cash_reconciliation', NULL FROM j UNION ALL SELECT 'cash_composition', NULL FROM j) GROUP BY 1""", "stm"))(
    lambda s, d: N.validate_statements(I.balance_sheet(s, d).withColumn("total_non_current_assets", F.col("total_assets") - F.col("total_current_assets")),
                                       I.income_statement(s, d).withColumn("total_profit", F.col("operating_profit") * 0.9), I.cash_flow(s, d))
    .groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed")))
query("n04_risk_flags", sql(f"""WITH {IND}, x AS (SELECT *, (inventory_turnover - lag(inventory_turnover) OVER w)/nullif(abs(lag(inventory_turnover) OVER w),0)*100 AS it FROM ind WINDOW w AS (PARTITION BY code ORDER BY report_date)),
f AS (SELECT code, report_date, concat_ws(',', CASE WHEN receivable_growth>50 THEN 'receivable_surge' END, CASE WHEN it < -10 THEN 'inventory_slowdown' END, CASE WHEN debt_to_asset>70 THEN 'high_debt' END,
 CASE WHEN current_ratio<1 THEN 'low_liquidity' END, CASE WHEN ocf_to_profit<0.5 THEN 'weak_cash' END) AS flags, (CASE WHEN receivable_growth>50 THEN 1 ELSE 0 END + CASE WHEN it < -10 THEN 1 ELSE 0 END + CASE WHEN debt_to_asset>70 THEN 1 ELSE 0 END
 + CASE WHEN current_ratio<1 THEN 1 ELSE 0 END + CASE WHEN ocf_to_profit<0.5 THEN 1 ELSE 0 END) AS n_flags FROM x)
SELECT *, CASE WHEN n_flags>=3 THEN 'high' WHEN n_flags>=1 THEN 'medium' ELSE 'low' END AS risk_level FROM f""", "stm"))(lambda s, d: N.risk_flags(indicators(s, d)))
query("n05_valuation", sql("""WITH x AS (SELECT *, avg(pe_ttm) OVER (PARTITION BY industry) AS ipe, grade_no*8-10 AS growth FROM stocks),
y AS (SELECT *, CASE WHEN ipe>0 THEN (ipe-pe_ttm)/ipe END AS disc, CASE WHEN roe>0 THEN pb/roe END AS pr, CASE WHEN growth>0 THEN pe_ttm/growth END AS peg FROM x),
z AS (SELECT *, CASE WHEN disc>=0.2 THEN 'undervalued' WHEN disc<=-0.2 THEN 'overvalued' ELSE 'neutral' END AS pe_band, CASE WHEN pe_ttm<15 THEN 'cheap' WHEN pe_ttm<30 THEN 'fair' ELSE 'expensive' END AS pe_level,
 CASE WHEN pr<0.1 THEN 'undervalued' WHEN pr>0.2 THEN 'overvalued' ELSE 'neutral' END AS pb_band, CASE WHEN peg IS NULL THEN 'negative_growth' WHEN peg<1 THEN 'undervalued' WHEN peg<1.5 THEN 'fair' WHEN peg<2 THEN 'slightly_overvalued' ELSE 'overvalued' END AS peg_band FROM y),
s AS (SELECT *, greatest(0, least(100, 50 + CASE pe_band WHEN 'undervalued' THEN 20 WHEN 'overvalued' THEN -20 ELSE 0 END + CASE pb_band WHEN 'undervalued' THEN 15 WHEN 'overvalued' THEN -15 ELSE 0 END
 + CASE WHEN peg<1 THEN 15 WHEN peg>2 OR peg IS NULL THEN -15 ELSE 0 END)) AS valuation_score FROM z)
SELECT code, pe_band, pe_level, pb_band, peg_band, valuation_score, CASE WHEN valuation_score>=70 THEN 'buy' WHEN valuation_score>=50 THEN 'hold' ELSE 'watch' END AS valuation_label FROM s""", "stocks"))(
    lambda s, d: N.valuation(I.stocks(s, d).withColumnRenamed("pe_ttm", "pe").withColumn("growth", F.col("grade_no") * 8 - 10)).select(
        "code", "pe_band", "pe_level", "pb_band", "peg_band", "valuation_score", "valuation_label"))
query("n07_codes_meeting", sql(f"WITH {IND} SELECT report_date, code FROM ind WHERE roe >= 12", "stm"))(lambda s, d: N.codes_meeting(indicators(s, d), "roe", 12.0))


def adj_factors(s, d):
    """Growing adjustment factors on each code's first bar of a quarter."""
    q = F.trunc("trade_date", "quarter")
    f = I.bars(s, d).groupBy("code", q.alias("q")).agg(F.min("trade_date").alias("trade_date"))
    return f.select("code", "trade_date", (1 + F.months_between("q", F.lit("1995-01-01").cast("date")) / 300).alias("factor"))


for mode in ("backward", "forward"):
    query(f"n06_adjust_{mode}", sql(f"""WITH f AS (SELECT code, min(trade_date) AS trade_date, 1 + CAST((year(date_trunc('quarter', trade_date))-1995)*12 + month(date_trunc('quarter', trade_date))-1 AS DOUBLE)/300 AS factor FROM bars GROUP BY code, date_trunc('quarter', trade_date)),
a AS (SELECT b.*, f.factor FROM bars b ASOF LEFT JOIN f ON b.code=f.code AND b.trade_date>=f.trade_date), l AS (SELECT code, arg_max(factor, trade_date) AS lf FROM f GROUP BY 1)
SELECT code, trade_date, round(close*factor{'' if mode == 'backward' else '/lf'},4) AS adj_close, round(high*factor{'' if mode == 'backward' else '/lf'},4) AS adj_high FROM a JOIN l USING (code)""", "bars"))(
        lambda s, d, mode=mode: rounded(_adjust(I.bars(s, d), adj_factors(s, d), mode).select("code", "trade_date", "adj_close", "adj_high")))


def _adjust(b, f, mode):
    from tidemark.sources.bars import adjust_prices
    return adjust_prices(b, f, mode)
