"""Market and macro queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import market as M
from tidemark.operators import technical as T
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import lagx, roll
from tidemark.sources.bars import with_change


def rolld(fn, x, n):
    fr = f"OVER (ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {fr} >= {n} THEN {fn}({x}) {fr} END"


RET = f"ret AS (SELECT *, close / {lagx('close')} - 1 AS r FROM bars)"

query("k01_market_breadth", sql(f"""WITH d AS (SELECT trade_date, CAST(sum(CASE WHEN close>open THEN 1 WHEN close<open THEN -1 ELSE 0 END) AS DOUBLE)/count(*) AS breadth FROM bars GROUP BY 1)
SELECT trade_date, round(breadth,6) AS breadth, round({rolld('avg', 'breadth', 10)},6) AS market_breadth FROM d""", "bars"))(
    lambda s, d: rounded(M.market_breadth(I.bars(s, d)), 6))
query("k02_market_temperature", sql(f"""WITH x AS (SELECT *, {roll('max', 'close', 52)} AS hi, {roll('min', 'close', 52)} AS lo FROM bars),
d AS (SELECT trade_date, CAST(sum(CASE WHEN close>=hi THEN 1 ELSE 0 END) - sum(CASE WHEN close<=lo THEN 1 ELSE 0 END) AS DOUBLE)/count(*) AS raw FROM x GROUP BY 1)
SELECT trade_date, round(raw,6) AS raw, round({rolld('avg', 'raw', 20)},6) AS market_temperature FROM d""", "bars"))(
    lambda s, d: rounded(M.market_temperature(I.bars(s, d)), 6))
query("k03_k05_panel_market", sql(f"""WITH x AS (SELECT *, (CAST(volume AS DOUBLE)/{lagx('volume')} - 1)*(close/open - 1) AS sr, {roll('avg', 'close', 5)} AS a, {roll('avg', 'close', 10)} AS b FROM bars),
y AS (SELECT *, (a - {lagx('a')})/close*100 AS sa, (b - {lagx('b')})/close*100 AS sb FROM x)
SELECT code, trade_date, round({roll('avg', 'sr', 10)},6) AS market_sentiment, round(({roll('avg', 'close', 20)})/({roll('stddev_samp', 'close', 20)}),4) AS market_trend,
 CAST(CASE WHEN sa>0 AND sb>0 THEN 2 WHEN sa>0 OR sb>0 THEN 1 WHEN sa<0 AND sb<0 THEN -1 ELSE 0 END AS DOUBLE) AS market_health FROM y""", "bars"))(
    lambda s, d: M.market_health(M.market_trend(M.market_sentiment(I.bars(s, d)))).select(
        "code", "trade_date", F.round("market_sentiment", 6).alias("market_sentiment"), F.round("market_trend", 4).alias("market_trend"), "market_health"))
LIMITS = """lim AS (SELECT trade_date, CAST(sum(CASE WHEN pct_chg >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS total_limit_up, CAST(sum(CASE WHEN pct_chg <= -10 THEN 1 ELSE 0 END) AS BIGINT) AS total_limit_down FROM chg GROUP BY 1)"""
query("k06_limit_counts", sql(f"""WITH {LIMITS} SELECT *, round(total_limit_up - total_limit_down + least(10.0::DOUBLE, total_limit_up/50.0::DOUBLE),6) AS limit_up_score FROM lim""", "chg"))(
    lambda s, d: rounded(M.limit_counts(with_change(I.bars(s, d))), 6))
PIO = ("000003", "000005", "000007")
query("k07_pioneer_status", sql(f"SELECT trade_date, round(avg((close/open-1)*100),6) AS pioneer_status FROM bars WHERE code IN {PIO} GROUP BY 1", "bars"))(
    lambda s, d: rounded(M.pioneer_status(I.bars(s, d), PIO), 6))
PEAK = """pb AS (SELECT a.code, a.trade_date, a.close AS last, b.close AS c, b.volume AS v, a.n,
 min(b.close) OVER (PARTITION BY a.code, a.n) AS lo, max(b.close) OVER (PARTITION BY a.code, a.n) AS hi
 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS n FROM bars) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS n FROM bars) b ON a.code=b.code AND b.n BETWEEN a.n-19 AND a.n),
ph AS (SELECT code, trade_date, any_value(last) AS last, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, least(CAST(floor((c-lo)/((hi-lo)/50)) AS INTEGER),49) AS k, sum(v) AS d FROM pb WHERE hi>lo GROUP BY code, trade_date, least(CAST(floor((c-lo)/((hi-lo)/50)) AS INTEGER),49)),
peak AS (SELECT code, trade_date, CASE WHEN n<5 THEN last ELSE lo+(k+0.5)*((hi-lo)/50) END AS cost_peak FROM ph QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY d DESC, k)=1),
peaks AS (SELECT b.code, b.trade_date, coalesce(p.cost_peak, b.close) AS cost_peak FROM bars b LEFT JOIN peak p ON b.code=p.code AND b.trade_date=p.trade_date)"""
query("k08_cost_peak", sql(f"WITH {PEAK} SELECT code, trade_date, round(cost_peak,4) AS cost_peak FROM peaks", "bars"))(
    lambda s, d: rounded(M.cost_peak(I.bars(s, d)).select("code", "trade_date", "cost_peak")))
query("k09_macro_interest_rate", sql(f"""WITH x AS (SELECT *, {roll('stddev_samp', 'close', 20)} AS v FROM bars), d AS (SELECT trade_date, avg(v) AS mv FROM x GROUP BY 1)
SELECT trade_date, round(mv,6) AS mv, round((mv - lag(mv) OVER (ORDER BY trade_date))/(lag(mv) OVER (ORDER BY trade_date)+0.001),6) AS interest_rate_change FROM d""", "bars"))(
    lambda s, d: rounded(M.macro_interest_rate(I.bars(s, d)), 6))
for legacy in (False, True):
    fr = "OVER ()" if legacy else "OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)"
    suffix = "_legacy" if legacy else ""
    query("k10_market_liquidity" + suffix, sql(f"""WITH x AS (SELECT *, {roll('avg', 'volume', 20)} AS m FROM bars), d AS (SELECT trade_date, sum(volume)/(coalesce(sum(m),0)+1) AS liquidity_ratio FROM x GROUP BY 1)
SELECT trade_date, round(liquidity_ratio,6) AS liquidity_ratio, round((liquidity_ratio - avg(liquidity_ratio) {fr})/(stddev_samp(liquidity_ratio) {fr}+0.001),6) AS liquidity_score FROM d""", "bars"))(
        lambda s, d, legacy=legacy: rounded(M.macro_market_liquidity(I.bars(s, d), legacy=legacy), 6))
    query("k13_risk_appetite" + suffix, sql(f"""WITH {RET}, x AS (SELECT *, {roll('stddev_samp', 'r', 20)} AS v FROM ret), d AS (SELECT trade_date, avg(r)/(avg(v)+0.001) AS risk_appetite FROM x GROUP BY 1)
SELECT trade_date, round(risk_appetite,6) AS risk_appetite, round((risk_appetite - avg(risk_appetite) {fr})/(stddev_samp(risk_appetite) {fr}+0.001),6) AS risk_appetite_score FROM d""", "bars"))(
        lambda s, d, legacy=legacy: rounded(M.macro_risk_appetite(I.bars(s, d), legacy=legacy), 6))
query("k11_industry_cycle", sql(f"""WITH {RET}, d AS (SELECT trade_date, industry, avg(r) AS industry_return FROM ret JOIN stocks USING (code) GROUP BY ALL)
SELECT trade_date, industry, round(industry_return,6) AS industry_return, round(CASE WHEN count(industry_return) OVER w >= 60 THEN sum(industry_return) OVER w END,6) AS industry_momentum
FROM d WINDOW w AS (PARTITION BY industry ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""", "bars", "stocks"))(
    lambda s, d: rounded(M.macro_industry_cycle(I.bars(s, d).join(I.stocks(s, d).select("code", "industry"), "code")), 6))
query("k12_macro_sentiment", sql(f"""WITH {RET}, d AS (SELECT trade_date, CAST(sum(CASE WHEN r>0 THEN 1 ELSE 0 END) AS DOUBLE)/count(*) AS advance_ratio FROM ret GROUP BY 1)
SELECT trade_date, round(advance_ratio,6) AS advance_ratio, round(advance_ratio - ({rolld('avg', 'advance_ratio', 20)}),6) AS sentiment_change FROM d""", "bars"))(
    lambda s, d: rounded(M.macro_market_sentiment(I.bars(s, d)), 6))
TH = {"strong_v_total": 3e-6, "osc_min": 1e-6, "osc_max": 4e-6, "temp_strong": 20.0, "temp_overheat": 26.0}
query("k14_market_state", sql(f"""WITH {PEAK}, {LIMITS}, pio AS (SELECT trade_date, avg((close/open-1)*100) AS pioneer_status FROM bars WHERE code IN {PIO} GROUP BY 1),
a AS (SELECT trade_date, sum(volume*close)/1e8 AS v_total, avg(cost_peak) AS cp, avg(close) AS ac, avg(open) AS ao FROM bars JOIN peaks USING (code, trade_date) GROUP BY 1),
b AS (SELECT *, greatest(0, least(100, (total_limit_up - total_limit_down + least(10.0::DOUBLE, total_limit_up/50.0::DOUBLE)+100)/4)) AS temperature, coalesce(pioneer_status,0) AS ps, avg(cp) OVER () AS base FROM a JOIN lim USING (trade_date) LEFT JOIN pio USING (trade_date)),
c AS (SELECT *, temperature * CASE WHEN ps < -5 THEN 0.5 ELSE 1 END AS adj, temperature - lag(temperature) OVER (ORDER BY trade_date) AS delta FROM b)
SELECT trade_date, round(CAST(temperature AS DOUBLE),6) AS temperature, round(CAST(delta AS DOUBLE),6) AS delta_temperature, round(CAST(adj AS DOUBLE),6) AS adjusted_temperature,
 CASE WHEN ps < -5 OR adj > 26 THEN 'risk' WHEN v_total > 3e-6 AND adj > 20 THEN 'strong' WHEN v_total > 1e-6 AND v_total < 4e-6 AND cp > base*0.995 THEN 'oscillating' ELSE 'weak' END AS market_state,
 CASE WHEN delta < -30 AND ao > ac*0.97 THEN 'inertia_sell' ELSE 'normal' END AS inertia_signal FROM c""", "chg"))(
    lambda s, d: rounded(M.market_state(M.cost_peak(with_change(I.bars(s, d))), PIO, TH).select(
        "trade_date", "temperature", "delta_temperature", "adjusted_temperature", "market_state", "inertia_signal"), 6))
query("k15_k16_pivot_and_exit", sql(f"""WITH x AS (SELECT *, coalesce(CAST(volume AS DOUBLE)/{lagx('volume')},1) AS v, (close-({roll('avg', 'close', 5)}))/({roll('avg', 'close', 5)}) AS b FROM bars),
d AS (SELECT trade_date, avg(v) AS v, avg(close) AS c, avg(open) AS o, avg(b) AS b, sum(volume*close)/sum(volume) AS vwap FROM x GROUP BY 1)
SELECT trade_date, coalesce(v>1.1 AND c>15 AND b>0, false) AS upward_pivot, c/o>1.095 AS opening_limit, round(c-vwap,9)<0 AS break_vwap, (c/o>1.095 OR round(c-o,9)<0) AS closing_condition FROM d
WHERE (abs(c-vwap)>1e-9 OR c=vwap)""", "bars"))(
    lambda s, d: M.pivot_10am(I.bars(s, d)).join(M.exit_lines(I.bars(s, d)), "trade_date"))
query("k17_data_thresholds", sql(f"""WITH {PEAK}, d AS (SELECT trade_date, sum(volume*close)/1e8 AS v FROM bars GROUP BY 1)
SELECT round((SELECT quantile_cont(v,0.75) FROM d)*0.9*1e8,3) AS strong_v_total, round((SELECT avg(v) FROM d)*0.8*1e8,3) AS osc_min, round((SELECT avg(v) FROM d)*1.2*1e8,3) AS osc_max,
 round((SELECT quantile_cont(close,0.5) FROM bars),6) AS pivot_price, round((SELECT avg(cost_peak) FROM peaks)*0.98,6) AS cost_peak_support""", "bars"))(
    lambda s, d: M.data_thresholds(M.cost_peak(I.bars(s, d))).select(
        *[F.round(F.col(c) * 1e8, 3).alias(c) for c in ("strong_v_total", "osc_min", "osc_max")],
        *[F.round(c, 6).alias(c) for c in ("pivot_price", "cost_peak_support")]))


def rates(s, d):
    o = I.table(s, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("trade_date")).agg(
        (F.avg("o_totalprice") / 100000).alias("shibor_1w"), F.lit(1.5).alias("deposit_rate"), (F.max("o_totalprice") / 100000).alias("loan_rate"),
        (F.avg("o_custkey") / 300).alias("long_rate"), (F.min("o_custkey") / 100.0 + 1).alias("short_rate"), (F.count(F.lit(1)) * 1.5).alias("m2_growth"),
        F.lit(6.0).alias("gdp_growth"), F.avg(F.when(F.col("o_orderstatus") == "F", -1.0).otherwise(1.0)).alias("rrr_change"),
        F.avg(F.when(F.col("o_orderstatus") == "O", -1.0).otherwise(0.3)).alias("policy_change"))


RATES = """rates AS (SELECT CAST(o_orderdate AS DATE) AS trade_date, avg(o_totalprice)/100000 AS shibor_1w, max(o_totalprice)/100000 AS loan_rate, avg(o_custkey)/300 AS long_rate,
 min(o_custkey)/100.0::DOUBLE+1 AS short_rate, count(*)*1.5::DOUBLE AS m2_growth, avg(CASE WHEN o_orderstatus='F' THEN -1.0::DOUBLE ELSE 1 END) AS rrr, avg(CASE WHEN o_orderstatus='O' THEN -1.0::DOUBLE ELSE 0.3 END) AS pol FROM orders GROUP BY 1)"""
query("k18_k19_rates_and_timing", sql(f"""WITH {RATES}, n AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS n FROM rates),
h AS (SELECT *, avg(CASE WHEN n<=5 THEN shibor_1w END) OVER () AS head, {rolld('avg', 'shibor_1w', 5)} AS tail FROM n),
t AS (SELECT *, CASE WHEN n<10 THEN 'neutral' WHEN (tail-head)/head < -0.02 THEN 'down' WHEN (tail-head)/head > 0.02 THEN 'up' ELSE 'neutral' END AS shibor_trend, greatest(0, least(100, 100-shibor_1w*25)) AS ls, long_rate-short_rate AS ts FROM h),
u AS (SELECT *, greatest(0, least(100, ls + CASE shibor_trend WHEN 'down' THEN 10 WHEN 'up' THEN -10 ELSE 0 END)) AS sc,
 CASE shibor_trend WHEN 'down' THEN 1 WHEN 'up' THEN -1 ELSE 0 END - CASE WHEN round(rrr,9)<0 THEN -1 WHEN round(rrr,9)>0 THEN 1 ELSE 0 END - CASE WHEN pol<0 THEN -1 WHEN pol>0 THEN 1 ELSE 0 END AS pts FROM t)
SELECT trade_date, shibor_trend, round(CAST(ls AS DOUBLE),4) AS liquidity_score, CASE WHEN shibor_1w<2 THEN 'low' WHEN shibor_1w<3 THEN 'medium' ELSE 'high' END AS funding_cost, round(ts,6) AS term_spread,
 CASE WHEN ts>1 THEN 'steep' WHEN ts>0.3 THEN 'normal' WHEN ts>0 THEN 'flat' ELSE 'inverted' END AS curve, round(m2_growth-6,4) AS credit_impulse,
 CASE WHEN pts>=2 THEN 'easing' WHEN pts<=-2 THEN 'tightening' ELSE 'neutral' END AS policy_stance,
 CASE WHEN sc>=60 AND shibor_trend IN ('down','neutral') THEN 'bullish' WHEN sc<=40 OR shibor_trend='up' THEN 'bearish' ELSE 'neutral' END AS timing_signal,
 round(CAST(least(100, greatest(0, greatest(0, 100-shibor_1w*30)*0.6 + CASE WHEN m2_growth BETWEEN 8 AND 12 THEN 100 WHEN m2_growth<8 THEN greatest(0, 50+(m2_growth-5)*10) ELSE greatest(0, 100-(m2_growth-12)*5) END*0.4)) AS DOUBLE),4) AS timing_score FROM u"""))(
    lambda s, d: (M.macro_timing(M.rate_readings(rates(s, d))).select(
        "trade_date", "shibor_trend", "liquidity_score", "funding_cost", "term_spread", "curve", "credit_impulse", "policy_stance", "timing_signal", "timing_score").withColumn("term_spread", F.round(F.col("term_spread"), 6)).transform(
            lambda x: x.withColumns({c: F.round(c, 4) for c in ("liquidity_score", "credit_impulse", "timing_score")}))))
query("k20_market_overview", sql("""WITH d AS (SELECT trade_date, count(*) AS n, CAST(sum(volume) AS BIGINT) AS v FROM bars GROUP BY 1)
SELECT min(trade_date) AS first_date, max(trade_date) AS last_date, arg_max(n, trade_date) AS latest_active, arg_max(v, trade_date) AS latest_volume, round(avg(v),4) AS avg_daily_volume, max(v) AS max_volume,
 (SELECT trade_date FROM d ORDER BY v DESC, trade_date LIMIT 1) AS busiest_date, (SELECT count(DISTINCT code) FROM bars) AS total_stocks FROM d""", "bars"))(
    lambda s, d: rounded(M.market_overview(I.bars(s, d))))
query("k21_sector_performance", sql(f"""WITH {RET}, p AS (SELECT code, count(*) AS n, arg_max(close, trade_date)/arg_min(close, trade_date)-1 AS rt, stddev_samp(r)*sqrt(252) AS vola, avg(r)*252 AS m FROM ret GROUP BY 1 HAVING count(*)>=20),
q AS (SELECT *, CASE WHEN vola>0 THEN (m-0.03)/vola ELSE 0 END AS sh FROM p)
SELECT 'main' AS sector, count(*) AS stock_count, round(avg(rt),4) AS avg_return, round(avg(vola),4) AS avg_volatility, round(avg(sh),4) AS avg_sharpe, round(max(rt),4) AS best_return, round(min(rt),4) AS worst_return,
 round(CAST(sum(CASE WHEN rt>0 THEN 1 ELSE 0 END) AS DOUBLE)/count(*),4) AS positive_ratio, round(quantile_cont(rt,0.5),4) AS median_return FROM q""", "bars"))(
    lambda s, d: rounded(M.sector_performance(I.bars(s, d))))
query("k22_trading_patterns", sql(f"""WITH {RET}, x AS (SELECT *, volume/({roll('avg', 'volume', 20)}) AS vr, count(*) OVER (PARTITION BY code) AS n FROM ret), y AS (SELECT * FROM x WHERE n>=60)
SELECT round(avg(r),6) AS mean, round(stddev_pop(r),6) AS std, round(skewness(r),4) AS skewness, round(kurtosis(r),4) AS kurtosis, round(avg(CASE WHEN r IS NULL THEN NULL WHEN r>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS positive_days,
 round(avg(CASE WHEN r IS NULL THEN NULL WHEN r>0.099 THEN 1.0::DOUBLE ELSE 0 END),6) AS up_10pct, round(avg(CASE WHEN r IS NULL THEN NULL WHEN r<-0.099 THEN 1.0::DOUBLE ELSE 0 END),6) AS down_10pct,
 CAST(sum(CASE WHEN vr>2 THEN 1 ELSE 0 END) AS BIGINT) AS high_volume_days FROM y""", "bars"))(
    lambda s, d: M.trading_patterns(I.bars(s, d)).select(
        *[F.round(c, 4 if c in ("skewness", "kurtosis") else 6).alias(c) for c in ("mean", "std", "skewness", "kurtosis", "positive_days", "up_10pct", "down_10pct")], "high_volume_days"))
