"""Key level and volume-delta queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import latest_rows
from tidemark.operators import levels as G
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import lagx, roll

P = "PARTITION BY code ORDER BY trade_date"
AS_OF, PREV = "2001-10-30", "2001-08-30"


def base(day, cte="r"):
    return f"{cte} AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn, CASE WHEN high<>low THEN abs(close-open)/(high-low) ELSE 0 END AS br FROM bars WHERE trade_date <= DATE '{day}')"


def levels_cte(day, name="lv", b="r"):
    def st(n, what, alias):
        return f"{what.format(c=f'FILTER (WHERE rn<={n})')} AS {alias}"
    cols = [f"max(trade_date) FILTER (WHERE rn=1) AS trade_date"]
    cols += [f"max({c}) FILTER (WHERE rn=1) AS {a}" for c, a in (("close", "price"), ("high", "high"), ("low", "low"), ("open", "open"), ("volume", "volume"))]
    cols += [f"avg(close) FILTER (WHERE rn<={n}) AS ma{n}" for n in (5, 10, 20, 60)]
    cols += [f"min(low) FILTER (WHERE rn<={n}) AS support_{n}d, max(high) FILTER (WHERE rn<={n}) AS resistance_{n}d" for n in (5, 20, 60)]
    cols += ["quantile_cont(low,0.1) FILTER (WHERE rn<=60) AS support_strong, quantile_cont(high,0.9) FILTER (WHERE rn<=60) AS resistance_strong",
             "stddev_samp(close) FILTER (WHERE rn<=20) AS std_20, avg(volume) FILTER (WHERE rn<=5) AS v5", "max(close) FILTER (WHERE rn=2) AS prev_close, max(high) FILTER (WHERE rn=2) AS prev_high, max(low) FILTER (WHERE rn=2) AS prev_low",
             "min(low) FILTER (WHERE rn<=60 AND br>0.7 AND abs((close-open)/open)>0.03) AS demand_zone, max(high) FILTER (WHERE rn<=60 AND br>0.7 AND abs((close-open)/open)>0.03) AS supply_zone",
             "avg(volume) FILTER (WHERE rn<=60 AND br>0.6) AS strong_candle_vol, CASE WHEN stddev_samp(close) FILTER (WHERE rn<=20)/avg(close) FILTER (WHERE rn<=20)<0.05 THEN 1 ELSE 0 END AS is_consolidating, avg(high-low) FILTER (WHERE rn<=20) AS avg_daily_range"]
    return f"{name} AS (SELECT code, {', '.join(cols)} FROM {b} GROUP BY code)"


NUM = "price ma5 ma10 ma20 ma60 support_5d support_20d support_60d support_strong resistance_5d resistance_20d resistance_60d resistance_strong std_20".split()
query("g01_key_levels", sql(f"""WITH {base(AS_OF)}, {levels_cte(AS_OF)} SELECT code, trade_date, {', '.join(f'round({c},4) AS {c}' for c in NUM)}, round(ma20+2*std_20,4) AS bb_upper, round(ma20-2*std_20,4) AS bb_lower,
 round((high+low+price)/3,4) AS pivot, round(2*(high+low+price)/3-low,4) AS pivot_r1, round(2*(high+low+price)/3-high,4) AS pivot_s1, round(prev_close,4) AS prev_close, round((price-prev_close)/prev_close*100,4) AS change_pct FROM lv""", "bars"))(
    lambda s, d: rounded(G.key_levels(I.bars(s, d), AS_OF).select("code", "trade_date", *NUM, "bb_upper", "bb_lower", "pivot", "pivot_r1", "pivot_s1", "prev_close", "change_pct")))
query("g02_key_levels_zones", sql(f"""WITH {base(AS_OF)}, {levels_cte(AS_OF)} SELECT code, round(coalesce(demand_zone,low),4) AS demand_zone, round(coalesce(supply_zone,high),4) AS supply_zone, round(coalesce(strong_candle_vol,volume),4) AS strong_candle_vol,
 is_consolidating, round(avg_daily_range,4) AS avg_daily_range, round(volume/v5,4) AS vol_ratio, round(ma10,4) AS ma10 FROM lv""", "bars"))(
    lambda s, d: rounded(G.key_levels(I.bars(s, d), AS_OF, zones=True).select("code", "demand_zone", "supply_zone", "strong_candle_vol", "is_consolidating", "avg_daily_range", "vol_ratio", "ma10")))
CHG = f"{base(AS_OF)}, {levels_cte(AS_OF)}, {base(PREV, 'r2')}, {levels_cte(PREV, 'pv', 'r2')}, lc AS (SELECT lv.*, (lv.support_strong-pv.support_strong)/pv.support_strong*100 AS support_change, (lv.resistance_strong-pv.resistance_strong)/pv.resistance_strong*100 AS resistance_change FROM lv LEFT JOIN pv USING (code))"
ST = "CASE WHEN {0}_change>2 THEN 'up' WHEN {0}_change<-2 THEN 'down' ELSE 'flat' END"


def changes(s, d):
    b = I.bars(s, d)
    return G.level_changes(G.key_levels(b, AS_OF), G.key_levels(b, PREV))


query("g03_level_changes", sql(f"WITH {CHG} SELECT code, round(support_change,4) AS support_change, round(resistance_change,4) AS resistance_change, {ST.format('support')} AS support_status, {ST.format('resistance')} AS resistance_status FROM lc", "bars"))(
    lambda s, d: rounded(changes(s, d).select("code", "support_change", "resistance_change", "support_status", "resistance_status")))
query("g04_level_history", sql("WITH c AS (SELECT trade_date FROM bars GROUP BY 1 HAVING count(DISTINCT code)>25) SELECT code, trade_date, round(CASE WHEN volume>30 THEN close+1 ELSE close END,4) AS close FROM bars WHERE trade_date IN (SELECT trade_date FROM c)", "bars"))(
    lambda s, d: rounded(G.level_history(I.bars(s, d).select("code", "trade_date", "close"), I.bars(s, d).where("volume > 30").select("code", "trade_date", (F.col("close") + 1).alias("close")), 25)))
EXT = f"""x AS (SELECT *, row_number() OVER ({P})-1 AS i, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn, min(low) OVER ({P} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pl, max(high) OVER ({P} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ph FROM bars WHERE trade_date <= DATE '{AS_OF}'),
e AS (SELECT code, max(trade_date) AS trade_date, max(close) FILTER (WHERE rn=1) AS c, max(high) FILTER (WHERE rn=1) AS h, max(low) FILTER (WHERE rn=1) AS l, max(open) FILTER (WHERE rn=1) AS o, max(high) FILTER (WHERE rn=2) AS prev_high, avg(close) FILTER (WHERE rn<=20) AS ma20, avg(close) FILTER (WHERE rn<=60) AS ma60,
 min(low) FILTER (WHERE i>=5 AND low<=pl) AS support_recent, max(high) FILTER (WHERE i>=5 AND high>=ph) AS resistance_recent, max(close) FILTER (WHERE rn<=60) AS ch, min(close) FILTER (WHERE rn<=60) AS cl, stddev_pop(close) FILTER (WHERE rn<=20) AS sd,
 quantile_cont(low,0.1) FILTER (WHERE rn<=60) AS ss, quantile_cont(high,0.9) FILTER (WHERE rn<=60) AS rs, max(high) FILTER (WHERE rn<=5) AS pressure_5day, min(low) FILTER (WHERE rn<=5) AS support_5day FROM x GROUP BY 1),
f AS (SELECT *, (h+l+c)/3 AS p FROM e)"""
query("g05_extended_levels", sql(f"""WITH {EXT} SELECT code, trade_date, round(support_recent,4) AS support_recent, round(resistance_recent,4) AS resistance_recent, round(p+2*(h-l),4) AS pivot_r3, round(p-(h-l),4) AS pivot_s2, round(cl+(ch-cl)*0.618,2) AS fib_618, round(ma20+2*sd,4) AS bb_upper,
 CASE WHEN c>rs THEN 'above_resistance' WHEN c<ss THEN 'below_support' WHEN c>2*p-l THEN 'strong_uptrend' WHEN c<2*p-h THEN 'strong_downtrend' ELSE 'neutral' END AS price_position, round(p-(rs-ss)*0.1,2) AS core_zone_low, c>=round(p-(rs-ss)*0.1,2) AND c<=round(p+(rs-ss)*0.1,2) AS in_core_zone FROM f""", "bars"))(
    lambda s, d: rounded(G.extended_levels(I.bars(s, d), AS_OF).withColumn("fib_618", F.col("fibonacci")["fib_618"]).select(
        "code", "trade_date", "support_recent", "resistance_recent", "pivot_r3", "pivot_s2", "fib_618", "bb_upper", "price_position", "core_zone_low", "in_core_zone")))
query("g06_session_levels", sql(f"""WITH {EXT} SELECT code, round(pressure_5day,4) AS pressure_5day, round(support_5day,4) AS support_5day, round(greatest(h,prev_high),4) AS strong_pressure, round(least(l,o),4) AS strong_support, round(l+(h-l)*0.382,4) AS day_fib_382,
 round((c-greatest(h,prev_high))/greatest(h,prev_high)*100,4) AS dist_to_strong_pressure, round((c-ma20)/ma20*100,4) AS dist_to_ma20, round((c-ma60)/ma60*100,4) AS dist_to_ma60 FROM f""", "bars"))(
    lambda s, d: rounded(G.session_levels(G.extended_levels(I.bars(s, d), AS_OF)).select("code", "pressure_5day", "support_5day", "strong_pressure", "strong_support", "day_fib_382", "dist_to_strong_pressure", "dist_to_ma20", "dist_to_ma60")))
CV = f"""d0 AS (SELECT *, CASE WHEN high=low THEN 0 ELSE volume*((close-open)/(high-low)) END AS db, CASE WHEN high=low THEN 0 ELSE volume*(2*((close-low)/(high-low))-1) END AS dp FROM bars),
d1 AS (SELECT *, sum(db) OVER w AS cb, sum(dp) OVER w AS cp, sum((db+dp)/2) OVER w AS cc FROM d0 WINDOW w AS ({P} ROWS BETWEEN 60 PRECEDING AND CURRENT ROW)),
d2 AS (SELECT *, {lagx('cb', 1)} AS c1, {lagx('cb', 5)} AS c5, {lagx('cb', 10)} AS c10, {lagx('close', 5)} AS p5, {lagx('close', 10)} AS p10 FROM d1),
cvd AS (SELECT code, trade_date, round(cb,4) AS cvd_body, round(cp,4) AS cvd_position, round(cc,4) AS cvd_combined, round(cb-coalesce(c1,cb),4) AS cvd_change_1d, round(cb-coalesce(c5,cb),4) AS cvd_change_5d, round(cb-coalesce(c10,cb),4) AS cvd_change_10d,
 CASE WHEN cb>0 THEN 'buy_dominant' WHEN cb<0 THEN 'sell_dominant' ELSE 'neutral' END AS cvd_signal, CASE WHEN cb>0 AND cb-coalesce(c5,cb)>0 THEN 'strong_buy' WHEN cb>0 THEN 'weak_buy' WHEN cb<0 AND cb-coalesce(c5,cb)<0 THEN 'strong_sell' WHEN cb<0 THEN 'weak_sell' ELSE 'neutral' END AS cvd_trend,
 CASE WHEN close>p5 AND cb<c5 THEN 'top_divergence' WHEN close<p5 AND cb>c5 THEN 'bottom_divergence' ELSE 'no_divergence' END AS divergence_5d, CASE WHEN close>p10 AND cb<c10 THEN 'top_divergence' WHEN close<p10 AND cb>c10 THEN 'bottom_divergence' ELSE 'no_divergence' END AS divergence_10d FROM d2)"""
CVC = "code trade_date cvd_body cvd_position cvd_combined cvd_change_1d cvd_change_5d cvd_change_10d cvd_signal cvd_trend divergence_5d divergence_10d".split()
query("g07_cvd", sql(f"WITH {CV} SELECT * FROM cvd", "bars"))(lambda s, d: rounded(G.cvd_series(I.bars(s, d)).select(*CVC)))
CS = """s0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn, CASE WHEN high=low THEN 0 ELSE volume*((close-open)/(high-low)) END AS db FROM bars),
cs AS (SELECT code, sum(db) AS cvd_cumsum, avg(db) AS cvd_mean, sum(db) FILTER (WHERE rn<=5) AS cvd_5d, sum(db) FILTER (WHERE rn<=10) AS cvd_10d, CASE WHEN sum(db) FILTER (WHERE rn<=3) > sum(db) FILTER (WHERE rn BETWEEN 4 AND 6) THEN 'up' ELSE 'down' END AS cvd_trend,
 CASE WHEN sum(db)>0 THEN 'buy_dominant' WHEN sum(db)<0 THEN 'sell_dominant' ELSE 'neutral' END AS signal FROM s0 WHERE rn<=30 GROUP BY 1)"""
query("g08_cvd_short", sql(f"WITH {CS} SELECT code, round(cvd_cumsum,4) AS cvd_cumsum, round(cvd_mean,4) AS cvd_mean, round(cvd_5d,4) AS cvd_5d, round(cvd_10d,4) AS cvd_10d, cvd_trend, signal FROM cs", "bars"))(lambda s, d: rounded(G.cvd_short(I.bars(s, d))))
query("g09_stance", sql(f"""WITH {CS}, {base('2002-01-01')}, {levels_cte('2002-01-01')}, t AS (SELECT code, CASE WHEN price>ma5 THEN 1 ELSE 0 END+CASE WHEN price>ma20 THEN 1 ELSE 0 END+CASE WHEN price>ma60 THEN 1 ELSE 0 END+CASE WHEN ma5>ma10 AND ma10>ma20 THEN 1 ELSE 0 END AS position_score,
 CASE signal WHEN 'buy_dominant' THEN 2 WHEN 'sell_dominant' THEN -2 ELSE 0 END + CASE cvd_trend WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END AS cvd_score, (resistance_20d-price)/price*100 AS dr FROM lv JOIN cs USING (code))
SELECT code, position_score, cvd_score, position_score+cvd_score AS total_score, CASE WHEN position_score+cvd_score>=4 THEN 'bullish' WHEN position_score+cvd_score>=2 THEN 'leaning_bullish' WHEN position_score+cvd_score>=0 THEN 'neutral' WHEN position_score+cvd_score>=-2 THEN 'leaning_bearish' ELSE 'bearish' END AS conclusion, round(dr,4) AS distance_to_resistance FROM t""", "bars"))(
    lambda s, d: rounded(G.stance(G.key_levels(I.bars(s, d)), G.cvd_short(I.bars(s, d))).select("code", "position_score", "cvd_score", "total_score", "conclusion", "distance_to_resistance")))
query("g10_j13_conclusions", sql(f"""WITH {CHG}, {CV}, c AS (SELECT * FROM cvd QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)=1),
z AS (SELECT lc.*, {ST.format('support')} AS ss, cvd_signal, cvd_trend, divergence_5d, cvd_change_5d FROM lc JOIN c USING (code)),
y AS (SELECT code, concat_ws(' | ', CASE WHEN price<=support_strong*1.05 THEN 'near strong support' END, CASE WHEN price>=resistance_strong*0.95 THEN 'near strong resistance' END, CASE ss WHEN 'up' THEN 'support moved up' WHEN 'down' THEN 'support moved down' END,
 CASE WHEN ma20>ma60 AND price>ma20 THEN 'averages bullish' WHEN ma20<ma60 AND price<ma20 THEN 'averages bearish' END) AS l, concat_ws(' | ', CASE cvd_signal WHEN 'buy_dominant' THEN 'buyers dominate' WHEN 'sell_dominant' THEN 'sellers dominate' END, CASE WHEN cvd_trend<>'neutral' THEN cvd_trend END,
 CASE WHEN divergence_5d<>'no_divergence' THEN divergence_5d END, CASE WHEN cvd_change_5d>0 THEN '5d inflow' WHEN cvd_change_5d<0 THEN '5d outflow' END) AS v FROM z)
SELECT code, CASE WHEN l='' THEN 'levels normal' ELSE l END AS levels_conclusion, CASE WHEN v='' THEN 'cvd neutral' ELSE v END AS cvd_conclusion FROM y""", "bars"))(
    lambda s, d: G.conclusions(changes(s, d).join(latest_rows(G.cvd_series(I.bars(s, d))).drop("trade_date", "close", "volume"), "code")).select("code", "levels_conclusion", "cvd_conclusion"))
query("g11_trend_position", sql(f"""WITH m AS (SELECT *, {roll('avg', 'close', 5)} AS a, {roll('avg', 'close', 10)} AS b, {roll('avg', 'close', 20)} AS c, {roll('min', 'close', 60)} AS lo, {roll('max', 'close', 60)} AS hi FROM bars)
SELECT code, trade_date, CASE WHEN c IS NULL THEN 'unknown' WHEN a>b AND b>c THEN 'uptrend' WHEN a<b AND b<c THEN 'downtrend' WHEN a>c THEN 'weak_uptrend' ELSE 'weak_downtrend' END AS trend, round(lo,4) AS support, round(hi,4) AS resistance,
 round((close-lo)/nullif(hi-lo,0),4) AS position, round((close-lo)/close*100,4) AS distance_to_support, round((hi-close)/close*100,4) AS distance_to_resistance FROM m""", "bars"))(
    lambda s, d: rounded(G.trend_and_position(I.bars(s, d))))
