"""Queries of the funnel, its accounting and picks, and of what became of picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import div
from tidemark.operators import drawdown as D
from tidemark.operators import funnel as N
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql

F12, F26 = "(2/13::DOUBLE)", "(2/27::DOUBLE)"
KEEP = "p <= greatest(floor(t*0.85::DOUBLE), 1)"
PLACE = "row_number() OVER (ORDER BY code) AS p, count(*) OVER () AS t"

FUNNEL = f"""
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM chg),
w AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS k, count(*) OVER (PARTITION BY code) AS n FROM r WHERE rn<=60),
e AS (SELECT a.code, a.k, a.n, sum(b.close*power(1-{F12}, a.k-b.k)*CASE WHEN b.k=1 THEN 1 ELSE {F12} END)
 - sum(b.close*power(1-{F26}, a.k-b.k)*CASE WHEN b.k=1 THEN 1 ELSE {F26} END) AS d FROM w a JOIN w b ON a.code=b.code AND b.k<=a.k GROUP BY ALL),
mc AS (SELECT code, CASE WHEN max(n)>=35 THEN max(CASE WHEN k=n THEN d END)-sum(CASE WHEN k>1 THEN d*power(0.8::DOUBLE, n-k)*0.2::DOUBLE ELSE 0 END) ELSE 0 END AS macd FROM e GROUP BY 1),
g AS (SELECT code, count(*) AS n, max(trade_date) AS data_date, max(CASE WHEN rn=1 THEN close END) AS close, max(CASE WHEN rn=1 THEN low END) AS low,
 max(CASE WHEN rn=1 THEN volume END) AS volume, max(CASE WHEN rn=1 THEN pct_chg END) AS pct_chg, max(CASE WHEN rn=1 THEN turnover END) AS turnover,
 max(high) FILTER (rn<=20) AS high_20, count(*) FILTER (rn<=20 AND pct_chg>=9.9) AS lu20, count(*) FILTER (pct_chg>=9.9) AS lu, stddev_samp(close) FILTER (rn<=20) AS sd,
 avg(close) FILTER (rn<=5) AS ma5, avg(close) FILTER (rn<=10) AS ma10, avg(close) FILTER (rn<=20) AS ma20,
 avg(volume) FILTER (rn<=5) AS v5, avg(volume) FILTER (rn<=10) AS v10, avg(volume) FILTER (rn<=20) AS v20 FROM w GROUP BY 1),
m AS (SELECT g.*, macd, volume/v20 AS vr, sd/ma20 AS vol, name FROM g JOIN mc USING (code) LEFT JOIN stocks USING (code)),
s1 AS (SELECT * FROM m WHERE NOT regexp_matches(upper(coalesce(name,'')), 'ST|退市') AND volume>0 AND pct_chg>-9.9 AND pct_chg<9.9),
x1 AS (SELECT *, {PLACE} FROM s1 WHERE data_date >= (SELECT max(data_date) FROM s1)-30), k1 AS (SELECT * EXCLUDE (p,t) FROM x1 WHERE {KEEP}),
x2 AS (SELECT *, {PLACE} FROM k1 WHERE turnover>0 OR (SELECT count(*) FROM k1 WHERE turnover>0)<=10), k2 AS (SELECT * EXCLUDE (p,t) FROM x2 WHERE {KEEP}),
x3 AS (SELECT *, {PLACE} FROM k2 WHERE n>=20 AND (vr>1 OR (ma5>ma10 AND ma10>ma20))), k3 AS (SELECT * EXCLUDE (p,t) FROM x3 WHERE {KEEP}),
x4 AS (SELECT *, {PLACE} FROM k3 WHERE v5>v10*0.8::DOUBLE), k4 AS (SELECT * EXCLUDE (p,t) FROM x4 WHERE {KEEP}),
q5 AS (SELECT *, row_number() OVER (ORDER BY code) AS q FROM k4),
x5 AS (SELECT * EXCLUDE (q), {PLACE} FROM q5 WHERE lu20>0 OR close>=high_20*0.98::DOUBLE OR (low<=ma5*1.02::DOUBLE AND close>=ma5*0.98::DOUBLE) OR q<=50), k5 AS (SELECT * EXCLUDE (p,t) FROM x5 WHERE {KEEP})"""

LEVELS = " + ".join(f"CAST(code IN (SELECT code FROM {{0}}{i}) AS INTEGER)" for i in range(1, 6))


def funnel(s, d):
    return N.funnel(I.bars(s, d), I.stocks(s, d).select("code", "name"))


query("m16_funnel", sql(f"WITH {FUNNEL} SELECT code, {LEVELS.format('x')} AS passed, {LEVELS.format('k')} AS reached, round(vr,6) AS volume_ratio, round(macd,6) AS macd FROM m", "chg", "stocks"))(
    lambda s, d: rounded(funnel(s, d).select("code", "passed", "reached", "volume_ratio", "macd"), 6))

query("m16_funnel_accounting", sql(f"""WITH {FUNNEL},
c AS ({" UNION ALL ".join(f"SELECT {i} AS layer, (SELECT count(*) FROM {'m' if i == 1 else f'k{i - 1}'}) AS n_in, (SELECT count(*) FROM x{i}) AS n_passed, (SELECT count(*) FROM k{i}) AS n_kept" for i in range(1, 6))})
SELECT layer, n_in, n_passed, n_kept, round(n_kept/n_in::DOUBLE,6) AS kept_share FROM c WHERE n_in>0""", "chg", "stocks"))(
    lambda s, d: rounded(N.accounting(funnel(s, d)), 6))

query("m42_funnel_picks", sql(f"""WITH {FUNNEL}
SELECT code, round(least(24+CASE WHEN pct_chg>=5 THEN 20 WHEN pct_chg>=3 THEN 15 WHEN pct_chg>=0 THEN 10 ELSE 0 END+CASE WHEN vr>=2 THEN 15 WHEN vr>=1.5 THEN 10 ELSE 0 END
 +CASE WHEN turnover>=5 THEN 10 WHEN turnover>=3 THEN 5 ELSE 0 END+CASE WHEN ma5>ma10 AND ma10>ma20 THEN 15 ELSE 0 END+CASE WHEN macd>0 THEN 10 ELSE 0 END+least(lu*3,15)+CASE WHEN vol<0.05 THEN 5 ELSE 0 END,100)::DOUBLE,4) AS rule_score,
 round(close,4) AS entry_price, round(close*0.95::DOUBLE,4) AS stoploss_price, round(close*1.1::DOUBLE,4) AS take_profit_1, round(close*1.2::DOUBLE,4) AS take_profit_2,
 round(ma20*0.98::DOUBLE,4) AS support_price, round(high_20*1.02::DOUBLE,4) AS resistance_price, CASE WHEN ma5>ma20 THEN 'up' ELSE 'sideways' END AS trend FROM k5 WHERE n>=30""", "chg", "stocks"))(
    lambda s, d: rounded(N.funnel_picks(funnel(s, d), turnover_scale=1.0).select(
        "code", "rule_score", "entry_price", "stoploss_price", "take_profit_1", "take_profit_2", "support_price", "resistance_price", "trend"), 4))


def drawdowns(s, d):
    """Every bar that closed above its open is a pick; its factors come from the bar."""
    b = I.bars(s, d)
    span = F.col("high") - F.col("low")
    picks = b.where("close > open").select(
        "code", F.col("trade_date").alias("pick_date"), (div(F.col("close") - F.col("low"), span) * 100).alias("momentum"), "volume",
        (F.col("turnover") * 10).alias("fund_flow"), (div(F.col("open") - F.col("low"), span) * 100).alias("technical"))
    return D.pick_drawdowns(picks, b)


DRAWDOWN = """
b AS (SELECT *, close/lag(close) OVER (PARTITION BY code ORDER BY trade_date)-1 AS ret FROM bars),
mk AS (SELECT trade_date, avg(ret) AS mkt FROM b GROUP BY 1),
lv AS (SELECT *, sum(mkt) OVER (ORDER BY trade_date) AS level FROM mk),
j AS (SELECT b.*, mkt, level FROM b JOIN lv USING (trade_date)),
cd AS (SELECT code, count(*) AS n, arg_max(close, trade_date) AS cur, max(trade_date) AS last_day, coalesce(regr_slope(ret, mkt), 0) AS beta FROM j GROUP BY 1 HAVING count(*)>=2),
dd AS (SELECT j.code, j.trade_date AS pick_date, (cur-close)/close*100 AS drawdown, beta*(coalesce(e.level,0)-coalesce(j.level,0))*100 AS market_part,
 (close-low)/nullif(high-low,0)*100 AS momentum, volume, turnover*10 AS fund_flow, (open-low)/nullif(high-low,0)*100 AS technical FROM j JOIN cd USING (code) JOIN lv e ON e.trade_date=last_day WHERE close>open)"""

query("r13_pick_drawdowns", sql(f"""WITH {DRAWDOWN}
SELECT code, pick_date, round(drawdown,4) AS drawdown, round(market_part,4) AS market_part, round(drawdown-market_part,4) AS own_part,
 concat_ws(',', CASE WHEN drawdown<-9 THEN 'at_or_near_limit_down' WHEN drawdown<-5 THEN 'large_fall' END, CASE WHEN momentum>80 AND drawdown<-5 THEN 'momentum_failed' END, CASE WHEN volume<30 THEN 'illiquid' END) AS reasons FROM dd""", "bars"))(
    lambda s, d: rounded(drawdowns(s, d).select("code", "pick_date", "drawdown", "market_part", "own_part", "reasons"), 4))

query("r13_shared_falls", sql(f"""WITH {DRAWDOWN},
a AS (SELECT pick_date, count(*) AS n, avg(drawdown) AS average_drawdown, count(*) FILTER (drawdown<-5) AS large_drawdown_count FROM dd GROUP BY 1), s AS (SELECT *, large_drawdown_count/n::DOUBLE AS r FROM a)
SELECT pick_date, n, round(average_drawdown,4) AS average_drawdown, large_drawdown_count, round(r,4) AS large_drawdown_ratio, CASE WHEN r>0.5 THEN 0.7::DOUBLE WHEN r>0.3 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS systematic_ratio,
 CASE WHEN r>0.5 THEN 0.3::DOUBLE WHEN r>0.3 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS idiosyncratic_ratio, CASE WHEN r>0.5 THEN 'systematic' WHEN r>0.3 THEN 'both' ELSE 'idiosyncratic' END AS conclusion FROM s""", "bars"))(
    lambda s, d: rounded(D.shared_falls(drawdowns(s, d)), 4))

query("r13_failed_factors", sql(f"""WITH {DRAWDOWN},
f AS (UNPIVOT (SELECT pick_date, drawdown, momentum::DOUBLE AS momentum, volume::DOUBLE AS volume, fund_flow::DOUBLE AS fund_flow, technical::DOUBLE AS technical FROM dd) ON momentum, volume, fund_flow, technical INTO NAME factor VALUE score)
SELECT pick_date, factor, count(*) AS high_score_count, round(avg(drawdown),4) AS average_drawdown, avg(drawdown)<-3 AS failure_detected FROM f WHERE score>70 GROUP BY 1, 2""", "bars"))(
    lambda s, d: rounded(D.failed_factors(drawdowns(s, d)), 4))
