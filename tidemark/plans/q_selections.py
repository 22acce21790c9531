"""Queries of the screens with verdict and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import lag, latest_rows, rmean
from tidemark.operators import selections as S
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import lagx, roll


def fundamentals(s, d):
    """Stock rows with growth and debt derived from the newest bar; some values are missing."""
    return I.snapshot(s, d).select(
        "code", F.col("pe_ttm").alias("pe"), "pb", F.when(F.col("grade_no") != 3, F.col("roe")).alias("roe"), (F.col("pct_chg") * 10).alias("revenue_growth"),
        (F.col("volume") * 2.0 - 20).alias("profit_growth"), F.when(F.col("grade_no") != 5, F.col("grade_no") * 10 + 5).alias("debt_ratio"))


query("m06_fundamental_range_score", sql("""
WITH f AS (SELECT code, pe_ttm AS pe, pb, CASE WHEN grade_no<>3 THEN roe END AS roe, pct_chg*10 AS rg, volume*2.0::DOUBLE-20 AS pg, CASE WHEN grade_no<>5 THEN grade_no*10+5 END AS dr FROM snap),
p AS (SELECT *, CASE WHEN pe>0 AND pe<50 THEN 100-abs(pe-25)/25*50 ELSE 0 END*0.15::DOUBLE AS s1, CASE WHEN pb>0 AND pb<10 THEN 100-abs(pb-5)/5*50 ELSE 0 END*0.10::DOUBLE AS s2,
 greatest(0,least(100,(roe-10)/90*100))*0.20::DOUBLE AS s3, greatest(0,least(100,(rg-15)/185*100))*0.15::DOUBLE AS s4, greatest(0,least(100,(pg-10)/190*100))*0.20::DOUBLE AS s5,
 (100-greatest(0,least(100,dr/60*100)))*0.20::DOUBLE AS s6 FROM f),
w AS (SELECT *, CASE WHEN pe IS NULL THEN 0 ELSE s1 END+CASE WHEN pb IS NULL THEN 0 ELSE s2 END+CASE WHEN roe IS NULL THEN 0 ELSE s3 END+CASE WHEN rg IS NULL THEN 0 ELSE s4 END+s5+CASE WHEN dr IS NULL THEN 0 ELSE s6 END AS t,
 CASE WHEN pe IS NULL THEN 0 ELSE 0.15::DOUBLE END+CASE WHEN pb IS NULL THEN 0 ELSE 0.10::DOUBLE END+CASE WHEN roe IS NULL THEN 0 ELSE 0.20::DOUBLE END+CASE WHEN rg IS NULL THEN 0 ELSE 0.15::DOUBLE END+0.20::DOUBLE+CASE WHEN dr IS NULL THEN 0 ELSE 0.20::DOUBLE END AS v FROM p),
x AS (SELECT *, round(t/v,2) AS score, coalesce(pe,999)<=0 OR coalesce(pe,999)>50 AS b1, coalesce(roe,0)<10 AS b2, coalesce(dr,999)>60 AS b3, coalesce(rg,0)<15 AS b4 FROM w)
SELECT code, score, NOT (b1 OR b2 OR b3) AS passed, CASE WHEN score>=70 THEN 'excellent' WHEN score>=50 THEN 'good' END AS label,
 concat_ws(',', CASE WHEN b1 THEN 'pe_out_of_range' END, CASE WHEN b2 THEN 'low_roe' END, CASE WHEN b3 THEN 'high_debt' END, CASE WHEN b4 THEN 'slow_growth' END) AS reasons FROM x""", "snap"))(
    lambda s, d: S.fundamental_range_score(fundamentals(s, d)).select("code", "score", "passed", "label", "reasons"))


def leaders(s, d):
    return I.stocks(s, d).select("code", F.col("grade_no").cast("int").alias("consecutive_limitup"), F.when(F.col("acctbal") > 0, "leader").otherwise("follower").alias("market_position"),
                                 (F.abs("acctbal") / 20).alias("market_cap"))


query("m18_dragon_head", sql("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM bars),
g AS (SELECT code, max(close) AS h, max(CASE WHEN rn=1 THEN close END) AS c, max(CASE WHEN rn=2 THEN close END) AS b FROM r WHERE rn<=5 GROUP BY 1 HAVING count(*)>=5)
SELECT code, CAST(grade_no AS INTEGER) AS consecutive_limitup, round(h,6) AS high_price, round(c,6) AS current_price, round((h-c)/h,6) AS pullback_pct, round(h*0.85::DOUBLE,6) AS buy_zone_low, round(h*0.90::DOUBLE,6) AS buy_zone_high,
 c BETWEEN h*0.85::DOUBLE AND h*0.90::DOUBLE AS in_buy_zone FROM g JOIN stocks USING (code) WHERE grade_no>=3 AND acctbal>0 AND abs(acctbal)/20>=30 AND (h-c)/h<=0.5 AND c>=b*0.99::DOUBLE""", "bars", "stocks"))(
    lambda s, d: rounded(S.dragon_head(leaders(s, d), I.bars(s, d), max_pullback=0.5)
                         .select("code", "consecutive_limitup", "high_price", "current_price", "pullback_pct", "buy_zone_low", "buy_zone_high", "in_buy_zone"), 6))


def pullback_rows(s, d):
    b = I.bars(s, d)
    x = b.withColumns({"volume_20_avg": rmean("volume", 20), "ema_20": rmean("close", 20), "ema_60_monthly": rmean("close", 60), "_up": F.col("close") > lag("close", 5),
                       "limitup_days": F.pmod("volume", F.lit(5)).cast("int")})
    x = x.withColumn("macd_monthly", F.when(F.col("_up"), "golden_cross").otherwise("none"))
    return x.drop("_up").join(I.stocks(s, d).select("code", "roe"), "code")


query("m19_limit_up_pullback", sql(f"""
WITH x AS (SELECT *, {roll('avg', 'volume', 20)} AS va, {roll('avg', 'close', 20)} AS e, {roll('avg', 'close', 60)} AS e60, {lagx('close', 5)} AS c5 FROM bars)
SELECT code, trade_date, round(close,6) AS trigger_price, round(e*0.97::DOUBLE,6) AS stoploss_price, round(close*1.1::DOUBLE,6) AS take_profit_1, round(close*1.2::DOUBLE,6) AS take_profit_2 FROM x JOIN stocks USING (code)
WHERE volume%5<=3 AND turnover<=20 AND roe>0 AND close>c5 AND close>e60 AND e>0 AND close BETWEEN e*0.9::DOUBLE AND e*1.1::DOUBLE AND volume>va*1.2::DOUBLE AND close>open""", "bars", "stocks"))(
    lambda s, d: rounded(S.limit_up_pullback(pullback_rows(s, d), tolerance=0.1, surge=1.2).select("code", "trade_date", "trigger_price", "stoploss_price", "take_profit_1", "take_profit_2"), 6))


def account_tables(s, d):
    """Line items as orders of customers; returned items as what they hold; capital from their orders."""
    o = I.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    li = I.table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("account_id"), I.code_of("l_suppkey").alias("code"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("value"), "l_returnflag")
    capital = (o.groupBy(F.col("o_custkey").alias("account_id")).agg(F.round(F.sum("o_totalprice")).alias("total_capital"))
               .withColumns({"daily_pnl": F.col("total_capital") * (F.pmod("account_id", F.lit(9)) - 6) / 100, "peak_capital": F.col("total_capital") * (1 + F.pmod("account_id", F.lit(5)) / 12)}))
    last = latest_rows(I.bars(s, d), "trade_date", "high", "low", "close", "amount")
    placed = last.join(I.stocks(s, d), "code").select("code", "industry", "amount", ((F.col("high") - F.col("low")) / F.col("close") * 100).alias("atr_pct"))
    return li, li.where("l_returnflag = 'R'").select("account_id", "code", "value"), capital, placed


query("m43_order_checks", sql("""
WITH li AS (SELECT o_custkey AS account_id, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, l_orderkey, l_linenumber, l_extendedprice AS v, l_returnflag AS rf FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
cap AS (SELECT o_custkey AS account_id, round(sum(o_totalprice)) AS k FROM orders GROUP BY 1), ac AS (SELECT account_id, k, k*(account_id%9-6)/100 AS pnl, k*(1+account_id%5/12::DOUBLE) AS peak FROM cap),
pl AS (SELECT code, industry, amount, (high-low)/close*100 AS atr FROM snap), h AS (SELECT account_id, code, sum(v) AS held FROM li WHERE rf='R' GROUP BY ALL),
se AS (SELECT account_id, industry, sum(held) AS sec FROM h JOIN pl USING (code) GROUP BY ALL),
x AS (SELECT li.*, (coalesce(held,0)+v)/k AS sr, (coalesce(sec,0)+v)/k AS sc, greatest(-pnl,0)/k AS dl, (peak-k)/peak AS dd, amount, atr FROM li LEFT JOIN pl USING (code) LEFT JOIN ac USING (account_id) LEFT JOIN h USING (account_id, code) LEFT JOIN se ON se.account_id=li.account_id AND se.industry=pl.industry),
y AS (SELECT *, concat_ws(',', CASE WHEN sr>0.1 THEN 'single_stock_limit' END, CASE WHEN sc>0.3 THEN 'sector_concentration' END, CASE WHEN dl>0.0501 THEN 'daily_drawdown' END, CASE WHEN dd>0.2 THEN 'total_drawdown' END) AS blocks,
 concat_ws(',', CASE WHEN amount<=40000 THEN 'liquidity_check' END, CASE WHEN atr>=5 THEN 'volatility_check' END) AS warnings FROM x)
SELECT account_id, l_orderkey, l_linenumber, code, round(sr,6) AS stock_ratio, round(sc,6) AS sector_ratio, round(dl,6) AS daily_loss, round(dd,6) AS drawdown, blocks, warnings, blocks='' AS can_execute FROM y""", "snap"))(
    lambda s, d: rounded(S.check_orders(*account_tables(s, d), daily=0.0501, liquidity=40000.0, rows=I.table(s, d, "lineitem").count())
                         .select("account_id", "l_orderkey", "l_linenumber", "code", "stock_ratio", "sector_ratio", "daily_loss", "drawdown", "blocks", "warnings", "can_execute"), 6))
