"""Queries of the scores of many dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import lag, rmean, rstd
from tidemark.operators import composites as C
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import lagx, roll
from tidemark.sources.bars import with_change

FACTOR_COLUMNS = ["market_cap", "pe", "pb", "ps", "revenue_growth", "profit_growth", "roe", "debt_ratio", "momentum_20d"]
SECTORS = ["technology", "consumption", "manufacturing", "cyclical", "finance", "infrastructure", "energy"]

FACTOR_ROWS = """f AS (SELECT code, trade_date, market_cap/1e8 AS market_cap, pe_ttm AS pe, pb, pb/2 AS ps, pct_chg/10 AS revenue_growth, volume/100::DOUBLE AS profit_growth, roe/100 AS roe, grade_no/8 AS debt_ratio,
 CASE WHEN grade_no<>6 THEN turnover/50 END AS momentum_20d FROM snap)"""
FITS = "market_cap BETWEEN 50 AND 500 AND roe>=0.10::DOUBLE AND pe<=50 AND pb<=5 AND debt_ratio<=0.70::DOUBLE"


def factor_rows(s, d):
    return I.snapshot(s, d).select(
        "code", "trade_date", (F.col("market_cap") / 1e8).alias("market_cap"), F.col("pe_ttm").alias("pe"), "pb", (F.col("pb") / 2).alias("ps"),
        (F.col("pct_chg") / 10).alias("revenue_growth"), (F.col("volume") / 100.0).alias("profit_growth"), (F.col("roe") / 100).alias("roe"),
        (F.col("grade_no") / 8).alias("debt_ratio"), F.when(F.col("grade_no") != 6, F.col("turnover") / 50).alias("momentum_20d"))


query("m09_multi_factor", sql(f"""
WITH {FACTOR_ROWS}
SELECT code, round(0.15::DOUBLE/(pe+1)+0.15::DOUBLE/(pb+1)+0.10::DOUBLE/(ps+1)+revenue_growth*0.15::DOUBLE+profit_growth*0.15::DOUBLE+roe*0.15::DOUBLE+(1-debt_ratio)*0.10::DOUBLE+momentum_20d*0.05::DOUBLE,6) AS composite_score
FROM f WHERE {FITS}""", "snap"))(
    lambda s, d: rounded(C.multi_factor(factor_rows(s, d)).select("code", "composite_score"), 6))

query("m09_factor_exposure", sql(f"""
WITH {FACTOR_ROWS}
SELECT round(avg(pe),6) AS value, round(avg(revenue_growth),6) AS growth, round(avg(roe),6) AS quality, round(avg(momentum_20d),6) AS momentum FROM f WHERE {FITS}""", "snap"))(
    lambda s, d: rounded(C.factor_exposure(C.multi_factor(factor_rows(s, d))), 6))

PAIRS = [(a, b) for i, a in enumerate(C.FACTOR_WEIGHTS) for b in list(C.FACTOR_WEIGHTS)[i + 1:]]
query("m09_factor_correlation", sql(f"WITH {FACTOR_ROWS}\n" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, round(corr({a},{b}),6) AS correlation FROM f" for a, b in PAIRS), "snap"))(
    lambda s, d: rounded(C.factor_correlation(factor_rows(s, d)), 6))


def market_days(s, d):
    """Mean change of each day as trend, its share of the mean range as volatility."""
    return with_change(I.bars(s, d)).groupBy("trade_date").agg((F.avg("pct_chg") / 10).alias("index_trend"), F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("volatility"))


query("m10_factor_rotation", sql(f"""
WITH {FACTOR_ROWS},
md AS (SELECT trade_date, avg(pct_chg)/10 AS t, avg((high-low)/close) AS v FROM chg GROUP BY 1),
r AS (SELECT f.*, CASE WHEN t>0.05 AND v<0.2 THEN 'bull' WHEN t<-0.05 THEN 'bear' ELSE 'neutral' END AS regime FROM f LEFT JOIN md USING (trade_date) WHERE {FITS}),
w AS (SELECT *, CASE regime WHEN 'bull' THEN 0.10 WHEN 'bear' THEN 0.25 ELSE 0.15 END::DOUBLE AS w1, CASE regime WHEN 'bull' THEN 0.10 WHEN 'bear' THEN 0.20 ELSE 0.15 END::DOUBLE AS w2,
 CASE regime WHEN 'bull' THEN 0.25 WHEN 'bear' THEN 0.10 ELSE 0.15 END::DOUBLE AS w4, CASE regime WHEN 'bull' THEN 0.20 ELSE 0.15 END::DOUBLE AS w5, CASE regime WHEN 'bear' THEN 0.20 ELSE 0.15 END::DOUBLE AS w6,
 CASE regime WHEN 'bear' THEN 0.15 ELSE 0.10 END::DOUBLE AS w7, CASE regime WHEN 'bull' THEN 0.15 WHEN 'bear' THEN 0.0 ELSE 0.05 END::DOUBLE AS w8 FROM r)
SELECT code, regime, round(w1/(pe+1)+w2/(pb+1)+0.10::DOUBLE/(ps+1)+revenue_growth*w4+profit_growth*w5+roe*w6+(1-debt_ratio)*w7+momentum_20d*w8,6) AS composite_score FROM w""", "snap"))(
    lambda s, d: rounded(C.factor_rotation(factor_rows(s, d), market_days(s, d)).select("code", "regime", "composite_score"), 6))


def sector_of(s, d):
    return I.stocks(s, d).select("code", F.element_at(F.array(*[F.lit(x) for x in SECTORS]), F.col("grade_no").cast("int") + 1).alias("sector"))


def sector_bars(s, d):
    return I.bars(s, d).join(sector_of(s, d), "code").groupBy("sector", "trade_date").agg(F.avg("close").alias("close"))


def index_bars(s, d):
    return I.bars(s, d).groupBy("trade_date").agg(F.avg("close").alias("close")).withColumn("index_code", F.lit("all"))


PATH = """SELECT *, row_number() OVER w AS n, close/lag(close,19) OVER w-1 AS r20, close/lag(close,59) OVER w-1 AS r60, row_number() OVER (PARTITION BY k ORDER BY trade_date DESC) AS rn,
 CASE WHEN count(ret) OVER v=20 THEN avg(ret) OVER v END*252 AS m, CASE WHEN count(ret) OVER v=20 THEN stddev_samp(ret) OVER v END*sqrt(252) AS vol
 FROM (SELECT *, close/lag(close) OVER (PARTITION BY k ORDER BY trade_date)-1 AS ret FROM {src}) WINDOW w AS (PARTITION BY k ORDER BY trade_date), v AS (PARTITION BY k ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
SECTOR_CASE = "CASE grade_no " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SECTORS)) + " END"
LIKES = "CASE regime||'|'||k " + " ".join(f"WHEN '{r}|{x}' THEN {p}" for r, by in C.SECTOR_PREFERENCES.items() for x, p in by.items()) + " ELSE 1.0 END::DOUBLE"

query("m14_sector_rotation", sql(f"""
WITH sb AS (SELECT {SECTOR_CASE} AS k, trade_date, avg(close) AS close FROM bars JOIN stocks USING (code) GROUP BY 1, 2), ib AS (SELECT 'all' AS k, trade_date, avg(close) AS close FROM bars GROUP BY 2),
sp AS ({PATH.format(src="sb")}), ip AS ({PATH.format(src="ib")}),
rg AS (SELECT CASE WHEN r60>0.15 AND r20>0 THEN 'bull' WHEN r60<-0.15 AND r20<0 THEN 'bear' WHEN r60>0 AND r20<0 THEN 'recovery' ELSE 'volatile' END AS regime FROM ip WHERE rn=1),
x AS (SELECT *, CASE WHEN vol>0 THEN (m-0.03::DOUBLE)/vol ELSE 0 END AS sharpe FROM sp, rg WHERE rn=1 AND n>=60 AND r60>-0.5),
y AS (SELECT *, (r20*0.4::DOUBLE+r60*0.4::DOUBLE+sharpe*0.2::DOUBLE)*{LIKES} AS score FROM x ORDER BY score DESC, k LIMIT 3)
SELECT k AS sector, regime, round(r20,6) AS returns_20d, round(r60,6) AS returns_60d, round(vol,6) AS volatility, round(sharpe,6) AS sharpe, round(score,6) AS score,
 round(greatest(0.1::DOUBLE,least(0.4::DOUBLE,CASE WHEN sum(score) OVER ()>0 THEN score/sum(score) OVER () ELSE 0 END)),6) AS weight, round(least(abs(score)*2,1),6) AS confidence FROM y""", "bars", "stocks"))(
    lambda s, d: rounded(C.sector_rotation(sector_bars(s, d), index_bars(s, d), least=-0.5)
                         .select("sector", "regime", "returns_20d", "returns_60d", "volatility", "sharpe", "score", "weight", "confidence"), 6))


def dimension_rows(s, d):
    b = I.bars(s, d).withColumns({"volume_20_avg": rmean("volume", 20), "volume_5_avg": rmean("volume", 5), "ma5": rmean("close", 5), "ma10": rmean("close", 10), "ma20": rmean("close", 20)})
    x = b.join(I.stocks(s, d).select("code", "roe", "pb", "pe_ttm", "acctbal", "grade_no"), "code")
    return x.withColumns({
        "shibor": F.col("grade_no") / 2 + 1, "gross_margin": F.col("pb") * 4, "profit_growth": F.col("pe_ttm") - 20, "bullish_ratio": F.col("volume") / 60.0, "news_score": F.col("grade_no") / 7,
        "main_net_inflow": (F.col("close") - F.col("open")) * 1e8, "super_large_ratio": F.col("turnover") / 10, "policy_score": F.pmod("volume", F.lit(10)) / 10.0,
        "sector_heat": F.pmod("volume", F.lit(7)) / 7.0, "news_catalyst": F.pmod("volume", F.lit(3)) == 0})


query("m26_dimension_scores", sql(f"""
WITH b AS (SELECT *, {roll('avg', 'volume', 20)} AS v20, {roll('avg', 'volume', 5)} AS v5, {roll('avg', 'close', 5)} AS a, {roll('avg', 'close', 10)} AS m, {roll('avg', 'close', 20)} AS z FROM bars),
x AS (SELECT b.*, roe, pb*4 AS gm, pe_ttm-20 AS pg, grade_no/2+1 AS sh, grade_no/7 AS ns, volume/60::DOUBLE AS bu, (close-open)*1e8 AS mi, volume%10/10::DOUBLE AS po, volume%7/7::DOUBLE AS he FROM b JOIN stocks USING (code)),
y AS (SELECT code, trade_date, 50.0::DOUBLE+CASE WHEN sh<2 THEN 15 WHEN sh>3 THEN -15 ELSE 0 END+CASE WHEN volume>v20*1.2::DOUBLE THEN 10 ELSE 0 END AS macro,
 50.0::DOUBLE+CASE WHEN roe>15 THEN 20 WHEN roe<5 AND roe<>0 THEN -15 ELSE 0 END+CASE WHEN gm>30 THEN 10 ELSE 0 END+CASE WHEN pg>20 THEN 15 WHEN pg<-10 THEN -20 ELSE 0 END AS fundamental,
 50.0::DOUBLE+CASE WHEN z IS NULL THEN 0 WHEN close>a AND a>m AND m>z THEN 25 WHEN close<a AND a<m AND m<z THEN -20 ELSE 0 END+CASE WHEN z IS NOT NULL AND a>m THEN 10 ELSE 0 END AS technical,
 50.0::DOUBLE+CASE WHEN bu>0.7::DOUBLE THEN 20 WHEN bu<0.3::DOUBLE THEN -15 ELSE 0 END+CASE WHEN ns>0.5 THEN 10 ELSE 0 END AS sentiment,
 50.0::DOUBLE+CASE WHEN mi>5e7 THEN 25 WHEN mi<-5e7 THEN -20 ELSE 0 END+CASE WHEN turnover/10>0.3::DOUBLE THEN 15 ELSE 0 END+CASE WHEN volume>v5*2 THEN 10 ELSE 0 END AS fund_behavior,
 50.0::DOUBLE+CASE WHEN po>0.7::DOUBLE THEN 25 ELSE 0 END+CASE WHEN he>0.6::DOUBLE THEN 15 ELSE 0 END+CASE WHEN volume%3=0 THEN 10 ELSE 0 END AS ai_catalyst FROM x),
t AS (SELECT *, round(macro*0.10::DOUBLE+fundamental*0.20::DOUBLE+technical*0.25::DOUBLE+sentiment*0.10::DOUBLE+fund_behavior*0.20::DOUBLE+ai_catalyst*0.15::DOUBLE,9) AS total FROM y)
SELECT code, trade_date, macro, fundamental, technical, sentiment, fund_behavior, ai_catalyst, round(total,6) AS total_score, round(total/100,6) AS confidence,
 CASE WHEN total>=80 THEN 'strong_buy' WHEN total>=70 THEN 'buy' WHEN total>=60 THEN 'watch' WHEN total>=50 THEN 'caution' ELSE 'avoid' END AS label FROM t""", "bars", "stocks"))(
    lambda s, d: rounded(C.dimension_scores(dimension_rows(s, d)).select("code", "trade_date", *C.DIMENSION_WEIGHTS, "total_score", "confidence", "label"), 6))


def indicator_rows(s, d):
    b = with_change(I.bars(s, d)).withColumn("_up", (F.col("close") > lag("close")).cast("double"))
    mean, dev = rmean("close", 20), rstd("close", 20)
    b = b.withColumns({"ema5": rmean("close", 5), "ema10": rmean("close", 10), "ema20": mean, "boll_middle": mean, "boll_upper": mean + dev, "boll_lower": mean - dev,
                       "atr_14": rmean(F.col("high") - F.col("low"), 14), "rsi_14": rmean("_up", 14) * 100, "volume_ratio": rmean("volume", 5) / rmean("volume", 20), "change_pct": F.col("pct_chg")})
    return b.withColumns({"macd": (F.col("ema5") - F.col("ema10")) / 10, "macd_signal": (F.col("ema10") - F.col("ema20")) / 10}).where("ema20 is not null")


query("m27_diagnosis", sql(f"""
WITH b AS (SELECT *, (close>preclose)::INT::DOUBLE AS up, high-low AS hl FROM chg),
i AS (SELECT *, {roll('avg', 'close', 5)} AS e5, {roll('avg', 'close', 10)} AS e10, {roll('avg', 'close', 20)} AS e20, {roll('stddev_samp', 'close', 20)} AS sd, {roll('avg', 'hl', 14)} AS atr, {roll('avg', 'up', 14)}*100 AS rsi,
 {roll('avg', 'volume', 5)}/{roll('avg', 'volume', 20)} AS vr FROM b),
x AS (SELECT *, (e5-e10)/10 AS md, (e10-e20)/10 AS ms, trunc((e5-e10)/10*100)::INT AS p, e5>e10 AND e10>e20 AS ua, e5<e10 AND e10<e20 AS da FROM i WHERE e20 IS NOT NULL),
y AS (SELECT *, CASE WHEN md>0 AND ms>0 THEN least(100,60+p) WHEN md>0 THEN least(100,50+p) WHEN md<0 AND ms<0 THEN greatest(0,40+p) ELSE 50 END AS base,
 CASE WHEN md>0 AND ms>0 THEN 'strong' WHEN md>0 THEN 'rather_strong' WHEN md<0 AND ms<0 THEN 'weak' ELSE 'neutral' END AS lab, trunc(greatest(0,100-abs(rsi-50)*2))::INT AS ss, trunc(least(100,vr*40))::INT AS fs FROM x)
SELECT code, trade_date, ss AS sentiment_score, CASE WHEN rsi>70 THEN 'overbought' WHEN rsi<30 THEN 'oversold' ELSE 'normal' END AS sentiment_label,
 CASE WHEN ua THEN least(100,base+15) WHEN da THEN greatest(0,base-15) ELSE base END AS technical_score, CASE WHEN ua THEN 'rising_averages' WHEN da THEN 'falling_averages' ELSE lab END AS technical_label, fs AS fund_score,
 CASE WHEN close>e20+sd THEN 75 WHEN close<e20-sd THEN 60 ELSE 45 END AS risk_score, CASE WHEN close>e20+sd THEN 'high' ELSE 'medium' END AS risk_level, trunc((ss+fs)/2)::INT AS confidence_score,
 round(e20-sd,2) AS support, round(e20+sd,2) AS resistance, round(CASE WHEN pct_chg>5 THEN e20 ELSE close-atr*2 END,2) AS stop_loss, round(close+atr*3,2) AS take_profit FROM y""", "chg"))(
    lambda s, d: C.diagnosis(indicator_rows(s, d)).select("code", "trade_date", "sentiment_score", "sentiment_label", "technical_score", "technical_label", "fund_score", "risk_score", "risk_level",
                                                          "confidence_score", "support", "resistance", "stop_loss", "take_profit"))

PANEL = f"""q AS (SELECT *, close/{lagx('close')}-1 AS ret, {roll('avg', 'close', 20)} AS m20, {roll('avg', 'close', 60)} AS m60, close/{lagx('close', 19)}-1 AS momentum_20d, close/{lagx('close', 59)}-1 AS momentum_60d,
 {lagx('close', -20)}/close-1 AS future_return FROM bars),
pv AS (SELECT *, {roll('stddev_samp', 'ret', 20)}*sqrt(252) AS volatility, CASE WHEN close>m20 AND m20>m60 THEN 1.0 WHEN close<m20 AND m20<m60 THEN -1.0 ELSE 0.0 END::DOUBLE AS trend_score FROM q),
panel AS (SELECT * FROM pv WHERE m60 IS NOT NULL)"""

query("r12_factor_statistics", sql(f"WITH {PANEL}\n" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS factor, count({f}) AS n, round(avg({f}),6) AS mean, round(stddev_samp({f}),6) AS std, round(min({f}),6) AS min, round(max({f}),6) AS max, round(corr({f},future_return),6) AS correlation FROM panel" for f in C.FACTORS), "bars"))(
    lambda s, d: rounded(C.factor_statistics(C.factor_panel(I.bars(s, d))), 6))

query("r12_sector_factors", sql(f"""
WITH {PANEL}
SELECT {SECTOR_CASE} AS sector, count(*) AS n, {', '.join(f'round(avg({f}),6) AS {f}' for f in (*C.FACTORS, 'future_return'))} FROM panel JOIN stocks USING (code) GROUP BY 1""", "bars", "stocks"))(
    lambda s, d: rounded(C.sector_factors(C.factor_panel(I.bars(s, d)), sector_of(s, d)), 6))


def daily_book(s, d):
    """Mean change of each day, held where the day has an even number of bars."""
    g = with_change(I.bars(s, d)).where("pct_chg is not null").groupBy("trade_date").agg((F.avg("pct_chg") / 100).alias("ret"), F.count(F.lit(1)).alias("n"))
    return g.select("trade_date", "ret", F.when(F.col("n") % 2 == 0, 0.5).otherwise(0.0).alias("position"), F.when(F.col("n") % 3 == 0, "bull").when(F.col("n") % 3 == 1, "bear").otherwise("range").alias("state"))


PERIODS = """
WITH b AS (SELECT trade_date, avg(pct_chg)/100 AS r0, count(*) AS n FROM chg WHERE pct_chg IS NOT NULL GROUP BY 1),
d AS (SELECT trade_date, CAST(date_trunc('{p}', trade_date) AS DATE) AS period_start, CASE WHEN n%2=0 THEN r0 END AS r, CASE n%3 WHEN 0 THEN 'bull' WHEN 1 THEN 'bear' ELSE 'range' END AS st FROM b),
v AS (SELECT *, product(1+coalesce(r,0)) OVER (PARTITION BY period_start ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS val FROM d),
pk AS (SELECT *, greatest(1, max(val) OVER (PARTITION BY period_start ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS peak FROM v),
sc AS (SELECT period_start, st, row_number() OVER (PARTITION BY period_start ORDER BY count(*) DESC, st) AS rn FROM d GROUP BY 1, 2),
g AS (SELECT period_start, count(*) AS days, max_by(val, trade_date)-1 AS tr, max((peak-val)/peak) AS dd, coalesce(count(CASE WHEN r>0 THEN 1 END)/nullif(count(r),0)::DOUBLE,0) AS wr,
 coalesce(avg(CASE WHEN r>0 THEN r END),0) AS ap, coalesce(avg(CASE WHEN r<0 THEN -r END),0) AS al FROM pk GROUP BY 1 HAVING count(*)>=2)
SELECT g.period_start, days, round(tr,6) AS total_return, round(dd,6) AS max_drawdown, round(wr,6) AS win_rate, round(ap,6) AS avg_profit, round(al,6) AS avg_loss, st AS dominant_state,
 round(pow(1+tr,{n}.0/days)-1,6) AS annual_return, round(coalesce(ap/nullif(al,0),0),6) AS profit_loss_ratio FROM g JOIN sc ON sc.period_start=g.period_start AND rn=1"""

for _period, _n in (("week", 52), ("month", 12)):
    query(f"r18_{_period}_performance", sql(PERIODS.format(p=_period, n=_n), "chg"))(
        lambda s, d, p=_period: rounded(C.period_performance(daily_book(s, d), p), 6))
