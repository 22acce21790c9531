"""Strategy and position-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import lag, latest_rows, rmean
from tidemark.operators import strategies as M
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import lagx, roll
from tidemark.sources.bars import with_change

P = "PARTITION BY code ORDER BY trade_date"
ES = """r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM bars), r2 AS (SELECT *, CASE WHEN rn<14 THEN lag(close) OVER (PARTITION BY code ORDER BY trade_date) END AS pc FROM r WHERE rn<=21),
g AS (SELECT code, max(trade_date) AS trade_date, max(CASE WHEN rn=1 THEN close END) AS price, max(CASE WHEN rn=1 THEN volume END) AS v, max(CASE WHEN rn=2 THEN close END) AS c1, max(CASE WHEN rn=11 THEN close END) AS c10, avg(CASE WHEN rn<=5 THEN close END) AS a, avg(CASE WHEN rn<=10 THEN close END) AS b, avg(CASE WHEN rn<=20 THEN close END) AS d,
 avg(CASE WHEN rn<=5 THEN volume END) AS v5, min(CASE WHEN rn<=20 THEN low END) AS lo, max(CASE WHEN rn<=20 THEN high END) AS hi, avg(CASE WHEN rn<=14 THEN CASE WHEN close>pc THEN high-low ELSE 0 END END) AS up, avg(CASE WHEN rn<=14 THEN CASE WHEN close<pc THEN high-low ELSE 0 END END) AS dn FROM r2 GROUP BY 1),
h AS (SELECT *, round((price-c1)/c1*100,2) AS c, round((price-c10)/c10*100,2) AS m, round(v/v5,2) AS vr, CASE WHEN dn=0 THEN 50 ELSE round(100-100/(1+up/dn),2) END AS rs, round((price-lo)/(hi-lo)*100,2) AS q FROM g),
s AS (SELECT *, 50 + CASE WHEN c>5 THEN 20 WHEN c>3 THEN 15 WHEN c>1 THEN 10 WHEN c>0 THEN 5 WHEN c>-1 THEN 0 WHEN c>-3 THEN -5 ELSE -10 END + CASE WHEN price>a AND a>b AND b>d THEN 20 WHEN price>a AND a>b THEN 15 WHEN price>a THEN 10 WHEN price>d THEN 5 ELSE 0 END
 + CASE WHEN m>15 THEN 20 WHEN m>10 THEN 15 WHEN m>5 THEN 10 WHEN m>0 THEN 5 WHEN m>-5 THEN 0 ELSE -5 END + CASE WHEN rs>30 AND rs<70 THEN 15 WHEN rs>20 AND rs<80 THEN 10 WHEN rs<30 THEN 5 ELSE 0 END + CASE WHEN vr>1.5 AND c>0 THEN 15 WHEN vr>1 AND c>0 THEN 10 WHEN vr>0.8 THEN 5 ELSE 0 END
 + CASE WHEN q<20 THEN 15 WHEN q<40 THEN 10 WHEN q<60 THEN 5 WHEN q>80 THEN -5 ELSE 0 END AS sc FROM h)"""
query("m02_enhanced_score", sql(f"WITH {ES} SELECT code, trade_date, c AS change_pct, rs AS range_rsi, CAST(sc AS DOUBLE) AS enhanced_score, CASE WHEN sc>=100 THEN 'S' WHEN sc>=85 THEN 'A' WHEN sc>=65 THEN 'B' ELSE 'C' END AS grade FROM s", "bars"))(
    lambda s, d: M.enhanced_score(I.bars(s, d)).select("code", "trade_date", "change_pct", "range_rsi", "enhanced_score", "grade"))
MF = f"""x AS (SELECT *, close/{lagx('close', 20)}-1 AS m20, close/{lagx('close', 60)}-1 AS m60, close/{lagx('close')}-1 AS r, volume/({roll('avg', 'volume', 20)}) AS vr, {roll('avg', 'close', 20)} AS a, {roll('avg', 'close', 60)} AS b, close/max(close) OVER ({P} ROWS UNBOUNDED PRECEDING)-1 AS dd FROM bars),
y AS (SELECT *, m20-{lagx('m20', 5)} AS acc, ({roll('stddev_samp', 'r', 20)})*sqrt(252) AS vol, {roll('min', 'dd', 20)} AS mdd, close>a AND a>b AS up FROM x), l AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)=1)"""
query("m11_momentum_select", sql(f"WITH {MF}, s AS (SELECT code, m20, (m20*0.6+m60*0.4)*0.5+least(vr/3,1)*0.3+CASE WHEN acc>0 THEN least(acc*10,1) ELSE 0 END*0.2 AS sc FROM l WHERE m20 BETWEEN -0.1 AND 0.5 AND m60>=-0.2 AND vr>=0.3 AND vol<=3) SELECT code, round(m20,6) AS momentum_20d, round(sc,6) AS total_score FROM s ORDER BY round(sc,9) DESC, code LIMIT 15", "bars"))(
    lambda s, d: rounded(M.momentum_select(I.bars(s, d), -0.1, 0.5, -0.2, 0.3, 3.0, False, 15).select("code", "momentum_20d", "total_score"), 6))
query("m12_low_volatility", sql(f"WITH {MF} SELECT code, round(vol,6) AS volatility_20d, round(mdd,6) AS max_drawdown_20d FROM l WHERE vol<1.3 AND mdd>-0.4 ORDER BY vol, code LIMIT 15", "bars"))(
    lambda s, d: rounded(M.low_volatility_select(I.bars(s, d), 1.3, -0.4, 15).select("code", "volatility_20d", "max_drawdown_20d"), 6))
query("m13_blend", sql(f"WITH {MF}, z AS (SELECT *, (m20-avg(m20) OVER ())/stddev_samp(m20) OVER ()*0.3+(m60-avg(m60) OVER ())/stddev_samp(m60) OVER ()*0.2-(vol-avg(vol) OVER ())/stddev_samp(vol) OVER ()*0.3+CASE WHEN up THEN 0.2 ELSE 0 END AS sc FROM l) SELECT code, round(sc,6) AS total_score FROM z WHERE m20>0 AND vol<3 AND vr>0.3 ORDER BY round(sc,9) DESC, code LIMIT 15", "bars"))(
    lambda s, d: rounded(M.blend_select(I.bars(s, d), 0.3, 3.0, 15).select("code", "total_score"), 6))
query("m15_best_sector", sql("WITH m AS (SELECT industry, code, CAST(date_trunc('month',trade_date) AS DATE) AS month, arg_max(close,trade_date)/arg_min(close,trade_date)-1 AS r FROM bars JOIN stocks USING (code) GROUP BY ALL), s AS (SELECT month, industry, avg(r) AS sr FROM m GROUP BY ALL) SELECT month, round(sr,6) AS best_return, industry AS best_sector FROM s QUALIFY row_number() OVER (PARTITION BY month ORDER BY round(sr,12) DESC, industry)=1", "bars", "stocks"))(
    lambda s, d: rounded(M.best_sector_per_month(I.bars(s, d).join(I.stocks(s, d).select("code", "industry"), "code")), 6))
query("m34_industry_cap", sql("SELECT code, industry, acctbal FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY acctbal DESC, code) AS k FROM stocks) WHERE k<=2 ORDER BY acctbal DESC, code LIMIT 20", "stocks"))(
    lambda s, d: M.industry_cap(I.stocks(s, d), 2, 20, score="acctbal").select("code", "industry", "acctbal"))


def month_picks(s, d):
    m = I.bars(s, d).groupBy("code", F.trunc("trade_date", "month").alias("pick_date")).agg(F.sum("volume").alias("v"))
    return m.where("v >= 250").join(I.stocks(s, d).select("code", "industry"), "code")


query("m35_pick_stability", sql("""WITH p AS (SELECT code, CAST(date_trunc('month',trade_date) AS DATE) AS pick_date FROM bars GROUP BY ALL HAVING sum(volume)>=250), q AS (SELECT * FROM p JOIN stocks USING (code)), dt AS (SELECT pick_date, lag(pick_date) OVER (ORDER BY pick_date) AS pv FROM (SELECT DISTINCT pick_date FROM q)),
x AS (SELECT q.pick_date, dt.pv, q.code, o.code AS old FROM q JOIN dt USING (pick_date) LEFT JOIN q o ON o.pick_date=dt.pv AND o.code=q.code), i AS (SELECT pick_date, max(n) AS m FROM (SELECT pick_date, industry, count(*) AS n FROM q GROUP BY ALL) GROUP BY 1)
SELECT pick_date, count(*) AS n, round(CASE WHEN max(pv) IS NULL THEN 0 ELSE 1-count(old)/count(*)::DOUBLE END,6) AS turnover_rate, round(any_value(m)/count(*)::DOUBLE,6) AS industry_concentration FROM x JOIN i USING (pick_date) GROUP BY 1""", "bars", "stocks"))(
    lambda s, d: rounded(M.pick_stability(month_picks(s, d)).select("pick_date", "n", "turnover_rate", "industry_concentration"), 6))


def per_code(s, d):
    r = with_change(I.bars(s, d))
    return r.groupBy("code").agg(F.avg(F.when(F.col("pct_chg") > 0, 1.0).when(F.col("pct_chg").isNotNull(), 0.0)).alias("win_rate"),
                                 (F.avg(F.when(F.col("pct_chg") > 0, F.col("pct_chg"))) / -F.avg(F.when(F.col("pct_chg") < 0, F.col("pct_chg")))).alias("profit_loss_ratio"))


query("m36_kelly", sql("WITH p AS (SELECT code, avg(CASE WHEN pct_chg>0 THEN 1.0::DOUBLE WHEN pct_chg IS NOT NULL THEN 0 END) AS w, avg(CASE WHEN pct_chg>0 THEN pct_chg END)/-avg(CASE WHEN pct_chg<0 THEN pct_chg END) AS b FROM chg GROUP BY 1) SELECT code, round(CAST(greatest(0.05, least(0.25, (w*b-(1-w))/b*0.5)) AS DOUBLE),6) AS kelly FROM p", "chg"))(
    lambda s, d: rounded(M.kelly(per_code(s, d), total=200).select("code", "kelly"), 6))


def held(s, d):
    x = I.bars(s, d).withColumn("ema_20", rmean("close", 20)).withColumn("entry_price", lag("close", 10))
    return latest_rows(x, "close", "entry_price", "ema_20", "trade_date").withColumnRenamed("close", "current_price")


query("m37_position_action", sql(f"WITH x AS (SELECT code, trade_date, close AS c, {lagx('close', 10)} AS e, {roll('avg', 'close', 20)} AS m FROM bars), l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)=1) SELECT code, round((c-e)/e,6) AS gain, CASE WHEN (c-e)/e>=0.2 THEN 'take_profit_2' WHEN (c-e)/e>=0.1 THEN 'take_profit_1' WHEN m>0 AND c<=m*0.97 THEN 'stop_loss' ELSE 'hold' END AS action FROM l", "bars"))(
    lambda s, d: rounded(M.position_action(held(s, d)).select("code", "gain", "action"), 6))
query("m38_circuit_state", sql("WITH ix AS (SELECT trade_date, avg(close) AS c FROM bars GROUP BY 1), x AS (SELECT trade_date, (c/lag(c) OVER (ORDER BY trade_date)-1)*100 AS ch FROM ix) SELECT trade_date, CASE WHEN ch<=-5 THEN 'close_all' WHEN ch<=-2 THEN 'pause_buy' WHEN ch>3 THEN 'pause_buy' ELSE 'normal' END AS circuit FROM x", "bars"))(
    lambda s, d: _circuit(s, d))


def _circuit(s, d):
    from tidemark.plans.q_filters import index_change
    x = index_change(s, d).withColumnRenamed("change", "change_pct")
    return M.circuit_state(x.withColumn("macd_signal", F.when(F.col("change_pct") > 3, "death_cross").otherwise("none"))).select("trade_date", "circuit")


def quotes(s, d):
    """Newest bars as quotes with seal and sector columns derived from volume and balance."""
    x = I.snapshot(s, d)
    return x.select("code", F.col("pct_chg").alias("change_pct"), (F.col("volume") / 20.0).alias("volume_ratio"), F.col("turnover").alias("turnover_rate"),
                    (F.col("acctbal") * 20).alias("seal_amount"), (F.col("acctbal") / 1500).alias("seal_ratio"), (F.col("grade_no") - 3).alias("sector_change"),
                    F.col("grade_no").cast("int").alias("sector_limit_count"), F.pmod("volume", F.lit(6)).cast("int").alias("limit_up_count"), (F.abs("acctbal") * 400 + 1).alias("market_cap"),
                    F.pmod("volume", F.lit(3)).cast("int").alias("open_count"), (F.pmod("volume", F.lit(2)) + 1).cast("int").alias("consecutive_limit"),
                    F.when(F.pmod("volume", F.lit(5)) < 3, "09:45:00").otherwise("11:00:00").alias("limit_time"))


QT = "qt AS (SELECT code, pct_chg AS ch, volume/20 AS vr, turnover AS tr, acctbal*20 AS sa, acctbal/1500 AS srt, grade_no-3 AS sch, grade_no AS slc, volume%6 AS lc, abs(acctbal)*400+1 AS mc, volume%3 AS oc, volume%2+1 AS cl, CASE WHEN volume%5<3 THEN '09:45:00' ELSE '11:00:00' END AS lt FROM snap)"
query("m28_pre_limit", sql(f"WITH {QT}, f AS (SELECT *, CASE WHEN ch>=9.9 THEN 100 WHEN ch>=7 THEN 80+(ch-7)*10 WHEN ch>=5 THEN 50+(ch-5)*15 ELSE ch*10 END AS a, (least(vr*30,80)+CASE WHEN tr BETWEEN 3 AND 10 THEN 100 WHEN tr>10 THEN greatest(0,100-(tr-10)*5) ELSE 0 END)/2 AS b, CASE WHEN sa>0 THEN CASE WHEN srt>=5 THEN 100 WHEN srt>=2 THEN 80 WHEN srt>=1 THEN 60 ELSE 40 END ELSE 50 END AS c, least(least(50+sch*10,100)+least(slc*5,30),100) AS e FROM qt), g AS (SELECT *, a*0.35+b*0.25+c*0.20+e*0.20 AS p FROM f) SELECT code, round(p,4) AS probability, CASE WHEN p>=80 THEN 'very_high' WHEN p>=60 THEN 'high' WHEN p>=40 THEN 'medium' ELSE 'low' END AS prediction FROM g", "snap"))(
    lambda s, d: rounded(M.pre_limit_probability(quotes(s, d)).select("code", "probability", "prediction")))
query("m29_opening_probability", sql(f"WITH {QT} SELECT code, round(CAST(greatest(0.1,least(0.9,0.5+CASE WHEN sa/mc>0.1 THEN -0.2 WHEN sa/mc<0.01 THEN 0.2 ELSE 0 END+CASE WHEN tr>0.1 THEN 0.15 ELSE 0 END+CASE WHEN lc>3 THEN (lc-3)*0.1 ELSE 0 END)) AS DOUBLE),6) AS opening_probability FROM qt", "snap"))(
    lambda s, d: rounded(M.opening_probability(quotes(s, d)).select("code", "opening_probability"), 6))
query("m40_limit_up_grade", sql(f"WITH {QT}, s AS (SELECT *, CASE WHEN srt>=5 AND lt<'10:00:00' AND oc=0 THEN 'strong' WHEN srt>=2 AND oc<=2 THEN 'medium' ELSE 'weak' END AS st FROM qt) SELECT code, st AS seal_strength, concat_ws(',', CASE WHEN cl=1 THEN 'first_board' ELSE cl::VARCHAR||'_boards' END, CASE WHEN sa>100000 THEN 'big_seal' END) AS reasons, CASE WHEN cl=1 AND st='strong' AND oc=0 THEN 'S' WHEN cl=1 AND st IN ('strong','medium') THEN 'A' WHEN st='medium' THEN 'B' ELSE 'C' END AS level, CASE WHEN st='strong' AND cl=1 THEN 'gap_or_one_word' WHEN st='strong' THEN 'gap_and_rise' WHEN st='medium' THEN 'gap_and_swing' ELSE 'flat_or_low' END AS next_day FROM s", "snap"))(
    lambda s, d: M.limit_up_grade(quotes(s, d)).select("code", "seal_strength", "reasons", "level", "next_day"))
query("m41_simple_score", sql("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM bars), g AS (SELECT code, max(CASE WHEN rn=1 THEN close END) AS c, max(CASE WHEN rn=2 THEN close END) AS p, max(CASE WHEN rn=1 THEN volume END) AS v, avg(volume) AS av, avg(CASE WHEN rn<=5 THEN close END) AS a, avg(CASE WHEN rn<=10 THEN close END) AS b, avg(close) AS d FROM r WHERE rn<=20 GROUP BY 1)
SELECT code, round(CAST(greatest(0,least(100, CASE WHEN c>a THEN 20 ELSE 0 END+CASE WHEN c>b THEN 15 ELSE 0 END+CASE WHEN c>d THEN 15 ELSE 0 END+CASE WHEN c>p THEN least(30,(c-p)/p*300) ELSE greatest(0,15+(c-p)/p*100) END+least(20,v/av*10))) AS DOUBLE),4) AS score FROM g""", "bars"))(
    lambda s, d: rounded(M.simple_score(I.bars(s, d)).select("code", "score")))
query("m03_snapshot_score", sql("SELECT code, trade_date, CASE WHEN pct_chg>3 THEN 'S' WHEN pct_chg>1 THEN 'A' WHEN pct_chg>0 THEN 'B' ELSE 'C' END AS grade, round(CASE WHEN pct_chg>0 THEN 60+pct_chg*2 ELSE 50+pct_chg END,4) AS enhanced_score, CASE WHEN pct_chg>0 THEN 'up' ELSE 'down' END AS trend FROM lastbar WHERE pct_chg IS NOT NULL", "snap"))(
    lambda s, d: rounded(M.snapshot_score(with_change(I.bars(s, d))).select("code", "trade_date", "grade", "enhanced_score", "trend")))
query("m17_end_of_day_select", sql("WITH q AS (SELECT code, pct_chg AS p, volume/10 AS v, abs(acctbal)/40 AS c FROM snap) SELECT code, round((100-abs(v-2.5)*20)*0.4+(100-abs(p-3.5)*20)*0.4+(100-abs(c-100)*0.5)*0.2,4) AS total_score FROM q WHERE p BETWEEN -3 AND 8 AND v BETWEEN 1 AND 5 AND c BETWEEN 10 AND 230", "snap"))(
    lambda s, d: rounded(M.end_of_day_select(I.snapshot(s, d).select("code", F.col("pct_chg").alias("price_change"), (F.col("volume") / 10).alias("volume_ratio"), (F.abs("acctbal") / 40).alias("market_cap")),
                                             (-3.0, 8.0), (1.0, 5.0), (10.0, 230.0)).select("code", "total_score")))
query("m07_component_total", sql("SELECT code, round(coalesce(roe,0)*0.4+coalesce(pb,0)*0.3+coalesce(pe_ttm,0)*0.2+grade_no*0.1,6) AS total_score FROM stocks", "stocks"))(
    lambda s, d: rounded(M.component_total(I.stocks(s, d), {"roe": 0.4, "pb": 0.3, "pe_ttm": 0.2, "grade_no": 0.1}).select("code", "total_score"), 6))
