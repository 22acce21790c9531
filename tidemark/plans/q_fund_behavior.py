"""Queries of the selections by fund behaviour and of its exit, hedge and defence rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import div, rmean
from tidemark.operators import fund_behavior as B
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import lagx, roll


def factors(s, d):
    b = I.bars(s, d).withColumns({"_m5": rmean("close", 5), "_v10": rmean("volume", 10)})
    return b.select("code", "trade_date", "close", "volume", "amount", "open", "high", ((div("close", "_m5") - 1) * 100).alias("factor_ma5_bias"), div("volume", "_v10").alias("factor_v_ratio10"),
                    F.pmod("volume", F.lit(13)).cast("double").alias("factor_limit_up_score"), F.pmod("volume", F.lit(7)).cast("double").alias("factor_cost_peak"),
                    (F.pmod("volume", F.lit(5)) - 2).alias("factor_pioneer_status"), (F.pmod("volume", F.lit(2)) == 0).alias("upward"))


ROWS = f"""f AS (SELECT code, trade_date, close, volume, (close/{roll('avg', 'close', 5)}-1)*100 AS bias, volume/{roll('avg', 'volume', 10)} AS vr, (volume%13)::DOUBLE AS mood, (volume%7)::DOUBLE AS peak, volume%5-2 AS pio, volume%2=0 AS up,
 (close/{lagx('close', 5)}-1)*100 AS slope FROM bars)"""

query("m30_trend_selection", sql(f"""
WITH {ROWS}
SELECT code, trade_date, round(bias*0.3::DOUBLE+slope*0.2::DOUBLE+vr*0.2::DOUBLE+mood*0.15::DOUBLE+peak*0.15::DOUBLE,6) AS composite_score FROM f WHERE bias>0 AND slope>0 AND vr>1 AND code NOT LIKE '688%'""", "bars"))(
    lambda s, d: rounded(B.trend_selection(factors(s, d)).select("code", "trade_date", "composite_score"), 6))

query("m30_short_term_selection", sql(f"""
WITH {ROWS}
SELECT code, trade_date, round(CASE WHEN mood>10 THEN 100 ELSE 0 END+mood*10+least(10,greatest(0,bias)),6) AS short_term_score FROM f
WHERE (mood>0 OR pio>0) AND code NOT LIKE '688%' AND (up OR (bias>0 AND vr>1.5)) AND bias IS NOT NULL""", "bars"))(
    lambda s, d: rounded(B.short_term_selection(factors(s, d).where("factor_ma5_bias is not null")).select("code", "trade_date", "short_term_score"), 6))

query("m31_four_step_exit", sql("""
WITH x AS (SELECT *, CASE volume%4 WHEN 0 THEN '09:26' WHEN 1 THEN '10:00' WHEN 2 THEN '13:30' ELSE '14:56' END AS t, volume%3=0 AS lu FROM bars),
a AS (SELECT code, trade_date, CASE WHEN t='09:26' AND NOT lu THEN 'sell_25' WHEN t='13:30' AND close<(high+low)/2 THEN 'sell_25_on_break' WHEN t='10:00' AND NOT lu THEN 'sell_25_at_10am'
 WHEN t='14:56' AND (NOT lu OR close<open) THEN 'clear_all' ELSE 'hold' END AS action FROM x)
SELECT code, trade_date, action, CASE action WHEN 'hold' THEN 0.0 WHEN 'clear_all' THEN 1.0 ELSE 0.25 END::DOUBLE AS exit_ratio FROM a""", "bars"))(
    lambda s, d: B.four_step_exit(I.bars(s, d).select(
        "code", "trade_date", F.element_at(F.array(*[F.lit(t) for t in ("09:26", "10:00", "13:30", "14:56")]), (F.pmod("volume", F.lit(4)) + 1).cast("int")).alias("time"), F.col("close").alias("price"),
        ((F.col("high") + F.col("low")) / 2).alias("vwap"), F.col("open").alias("yesterday_close"), (F.pmod("volume", F.lit(3)) == 0).alias("is_limit_up_open"),
        (F.pmod("volume", F.lit(3)) == 0).alias("is_limit_up"))).select("code", "trade_date", "action", "exit_ratio"))

query("m31_hedge_effect", sql(f"""
WITH {ROWS}, g AS (SELECT trade_date, avg(vr) AS v, avg(volume) AS t, avg(close) AS c FROM f GROUP BY 1)
SELECT trade_date, round(v,6) AS avg_v_ratio10, round(t,6) AS avg_v_total, round(c,6) AS avg_close, coalesce(v>1.1::DOUBLE AND c>26 AND t>=26, false) AS hedge FROM g""", "bars"))(
    lambda s, d: rounded(B.hedge_effect(factors(s, d).withColumn("factor_v_total", F.col("volume")), 26.0, 26.0), 6))

query("m31_defense_signals", sql("""
WITH x AS (SELECT code, trade_date, volume*40 AS v, 1200 AS a, close AS p, volume%100 AS s FROM bars),
y AS (SELECT *, v/a::DOUBLE<0.6::DOUBLE AS b1, v<500 AS b2, p<26*0.98::DOUBLE AS b3, s>85 AS b4 FROM x)
SELECT code, trade_date, CASE WHEN b4 THEN 'caution' WHEN b1 OR b2 OR b3 THEN 'defense' ELSE 'buy' END AS action,
 concat_ws(',', CASE WHEN b1 THEN 'volume_shrink' END, CASE WHEN b2 THEN 'open_auction_low' END, CASE WHEN b3 THEN 'support_break' END, CASE WHEN b4 THEN 'sentiment_overheat' END) AS reasons,
 abs(p-26)/26<0.01::DOUBLE AS near_support, abs(p-27)/27<0.01::DOUBLE AS near_resistance FROM y""", "bars"))(
    lambda s, d: B.defense_signals(I.bars(s, d).select(
        "code", "trade_date", (F.col("volume") * 40).alias("v_total"), F.lit(1200).alias("avg_v_total"), F.col("close").alias("price"), F.pmod("volume", F.lit(100)).alias("sentiment_temperature")),
        (26.0,), (27.0,)).select("code", "trade_date", "action", "reasons", "near_support", "near_resistance"))
