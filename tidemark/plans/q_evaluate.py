"""Factor evaluation and model-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import div, lag, rmean
from tidemark.operators import evaluate as E
from tidemark.operators import ml as ML
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import A, RSI_C, ema_cte, lagx, roll

FACTORS = ["bias5", "mom10", "vol5"]


def panel(s, d):
    b = E.forward_returns(I.bars(s, d), (5,))
    return b.withColumns({"bias5": div(F.col("close") - rmean("close", 5), rmean("close", 5)), "mom10": div(F.col("close"), lag("close", 10)) - 1,
                          "vol5": div(F.col("volume"), rmean("volume", 5))})


def lng(s, d):
    return E.to_long(panel(s, d), FACTORS, "forward_return_5d")


LNG = f"""pn AS (SELECT code, trade_date, close, lead(close,5) OVER (PARTITION BY code ORDER BY trade_date)/close-1 AS ret, (close-({roll('avg', 'close', 5)}))/({roll('avg', 'close', 5)}) AS bias5, close/{lagx('close', 10)}-1 AS mom10, volume/({roll('avg', 'volume', 5)}) AS vol5 FROM bars),
lg AS (SELECT * FROM (SELECT code, trade_date, ret, 'bias5' AS factor, bias5 AS value FROM pn UNION ALL SELECT code, trade_date, ret, 'mom10', mom10 FROM pn UNION ALL SELECT code, trade_date, ret, 'vol5', vol5 FROM pn) WHERE value IS NOT NULL AND ret IS NOT NULL)"""
IC = f"""{LNG}, rk AS (SELECT *, rank() OVER (PARTITION BY factor, trade_date ORDER BY value) + (count(*) OVER (PARTITION BY factor, trade_date, value)-1)/2.0 AS ra, rank() OVER (PARTITION BY factor, trade_date ORDER BY ret) + (count(*) OVER (PARTITION BY factor, trade_date, ret)-1)/2.0 AS rb FROM lg),
ic AS (SELECT factor, trade_date, count(*) AS n, CASE WHEN count(*)>=10 AND min(ra)<max(ra) AND min(rb)<max(rb) THEN corr(ra,rb) END AS ic FROM rk GROUP BY ALL)"""
query("e01_forward_returns", sql("SELECT code, trade_date, " + ", ".join(f"round(lead(close,{n}) OVER (PARTITION BY code ORDER BY trade_date)/close-1,6) AS forward_return_{n}d" for n in (1, 5, 10, 20)) + " FROM bars", "bars"))(
    lambda s, d: rounded(E.forward_returns(I.bars(s, d)).select("code", "trade_date", *[f"forward_return_{n}d" for n in (1, 5, 10, 20)]), 6))
query("e02_tradable_returns", sql("""SELECT code, trade_date, round(CASE WHEN NOT (lead(volume,5) OVER w=0 OR (lead(high,5) OVER w=lead(low,5) OVER w AND (lead(high,5) OVER w > lead(open,5) OVER w*1.095 OR lead(low,5) OVER w < lead(open,5) OVER w*0.905))) THEN lead(close,5) OVER w/close-1 END,6) AS forward_return_5d
 FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)""", "bars"))(
    lambda s, d: rounded(E.tradable_forward_returns(I.bars(s, d)).select("code", "trade_date", "forward_return_5d"), 6))
query("e03_daily_ic", sql(f"WITH {IC} SELECT factor, trade_date, n, round(ic,6) AS ic FROM ic", "bars"))(lambda s, d: rounded(E.daily_ic(lng(s, d)), 6))
query("e03_daily_ic_pearson", sql(f"WITH {LNG} SELECT factor, trade_date, count(*) AS n, round(CASE WHEN count(*)>=10 AND min(value)<max(value) AND min(ret)<max(ret) THEN corr(value,ret) END,6) AS ic FROM lg GROUP BY ALL", "bars"))(
    lambda s, d: rounded(E.daily_ic(lng(s, d), "pearson"), 6))
query("e04_e09_ic_summary", sql(f"""WITH {IC} SELECT factor, count(*) AS n_dates, round(avg(ic),6) AS ic_mean, round(stddev_pop(ic),6) AS ic_std, round(avg(CASE WHEN ic>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS ic_positive_ratio, round(avg(ic)/stddev_pop(ic),6) AS ic_ir,
 round(avg(ic)/(stddev_samp(ic)/sqrt(count(*))),6) AS t_statistic FROM ic WHERE ic IS NOT NULL GROUP BY 1""", "bars"))(lambda s, d: rounded(E.ic_summary(E.daily_ic(lng(s, d))), 6))
QB = "cnt AS (SELECT *, row_number() OVER (PARTITION BY factor, trade_date ORDER BY value)-1 AS rn, count(*) OVER (PARTITION BY factor, trade_date) AS n FROM lg), q AS (SELECT factor, trade_date, any_value(n) AS n, " + ", ".join(
    f"max(CASE WHEN rn=((n-1)*{i})//5 THEN value END) + (max(CASE WHEN rn=((n-1)*{i}+4)//5 THEN value END) - max(CASE WHEN rn=((n-1)*{i})//5 THEN value END)) * (max(((n-1)*{i})%5)/5.0::DOUBLE) AS q{i}" for i in range(1, 5)) + " FROM cnt GROUP BY ALL)"
query("e05_quantile_returns", sql(f"WITH {LNG}, {QB} SELECT factor, trade_date, 1 + " + " + ".join(f"CASE WHEN round(value-q{i},10)>0 THEN 1 ELSE 0 END" for i in range(1, 5)) + " AS quantile, round(avg(ret),6) AS avg_return, count(*) AS count FROM lg JOIN q USING (factor, trade_date) WHERE n>=25 AND factor<>'vol5' GROUP BY ALL", "bars"))(
    lambda s, d: rounded(E.quantile_returns(E.to_long(panel(s, d), FACTORS[:2], "forward_return_5d"), 5, 25), 6))
LS = f"""{LNG}, o AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY factor, trade_date ORDER BY value DESC, code) AS kt, row_number() OVER (PARTITION BY factor, trade_date ORDER BY value, code) AS kb FROM lg WINDOW g AS (PARTITION BY factor, trade_date)),
ls AS (SELECT factor, trade_date, avg(CASE WHEN kt<=floor(n*0.2) THEN ret END) AS top, avg(CASE WHEN kb<=floor(n*0.2) THEN ret END) AS bottom FROM o WHERE n>=20 GROUP BY ALL), l2 AS (SELECT *, top-bottom AS long_short FROM ls)"""
query("e06_long_short_daily", sql(f"WITH {LS} SELECT factor, trade_date, round(top,6) AS top, round(bottom,6) AS bottom, round(long_short,6) AS long_short FROM l2", "bars"))(lambda s, d: rounded(E.long_short(lng(s, d)), 6))
query("e06_long_short_summary", sql(f"WITH {LS} SELECT factor, round(avg(long_short)*252,4) AS long_short_return, round(avg(top)*252,4) AS top_quantile_return, round(avg(bottom)*252,4) AS bottom_quantile_return, round(avg(long_short)*252/(stddev_pop(long_short)*sqrt(252)),4) AS long_short_sharpe FROM l2 GROUP BY 1", "bars"))(
    lambda s, d: rounded(E.long_short_summary(E.long_short(lng(s, d)))))
DD = "c AS (SELECT factor, trade_date, sum(ln(1+long_short)) OVER (PARTITION BY factor ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS l FROM l2), m AS (SELECT *, max(l) OVER (PARTITION BY factor ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS m FROM c), dd AS (SELECT factor, min(exp(l-m)-1) AS max_drawdown FROM m GROUP BY 1)"
query("e07_max_drawdown", sql(f"WITH {LS}, {DD} SELECT factor, round(max_drawdown,6) AS max_drawdown FROM dd", "bars"))(lambda s, d: rounded(E.max_drawdown(E.long_short(lng(s, d)), "long_short"), 6))
TO = """dy AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS dn FROM (SELECT DISTINCT trade_date FROM lg)), tp AS (SELECT factor, code, dn FROM (SELECT *, count(*) OVER (PARTITION BY factor, trade_date) AS n2, row_number() OVER (PARTITION BY factor, trade_date ORDER BY value DESC, code) AS k2 FROM lg) JOIN dy USING (trade_date) WHERE k2<=floor(n2*0.2)),
tt AS (SELECT a.factor, a.dn, 1-count(b.code)/count(*)::DOUBLE AS t FROM tp a LEFT JOIN tp b ON a.factor=b.factor AND a.code=b.code AND b.dn=a.dn+1 WHERE a.dn<(SELECT max(dn) FROM dy) GROUP BY ALL), tv AS (SELECT factor, avg(t) AS turnover FROM tt GROUP BY 1)"""
query("e08_top_turnover", sql(f"WITH {LNG}, {TO} SELECT factor, round(turnover,6) AS turnover FROM tv", "bars"))(lambda s, d: rounded(E.top_turnover(lng(s, d)), 6))
query("e10_all_factor_metrics", sql(f"WITH {IC}, {LS.split(LNG + ', ')[1]}, {DD}, {TO}, i AS (SELECT factor, avg(ic) AS m, stddev_pop(ic) AS sd FROM ic WHERE ic IS NOT NULL GROUP BY 1) SELECT i.factor, round(m,6) AS ic_mean, round(m/sd,6) AS ic_ir, round(max_drawdown,6) AS max_drawdown, round(turnover,6) AS turnover FROM i JOIN dd USING (factor) JOIN tv USING (factor)", "bars"))(
    lambda s, d: rounded(E.evaluate(panel(s, d), FACTORS, "forward_return_5d").select("factor", "ic_mean", "ic_ir", "max_drawdown", "turnover"), 6))
query("e10_effective_factors")(lambda s, d: rounded(E.effective(E.evaluate(panel(s, d), FACTORS, "forward_return_5d"), 0.0, 0.0, 0.5).select("factor", "ic_mean", "p_value"), 6))
query("e11_w19_rolling_ic", sql(f"""WITH {LNG}, dy AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS dn FROM (SELECT DISTINCT trade_date FROM lg)), x AS (SELECT l.factor, w.dn AS wn, w.trade_date, l.value, l.ret FROM dy w JOIN dy b ON b.dn>=w.dn-60 AND b.dn<w.dn JOIN lg l ON l.trade_date=b.trade_date WHERE w.dn>60),
rk AS (SELECT *, rank() OVER (PARTITION BY factor, wn ORDER BY value) + (count(*) OVER (PARTITION BY factor, wn, value)-1)/2.0 AS ra, rank() OVER (PARTITION BY factor, wn ORDER BY ret) + (count(*) OVER (PARTITION BY factor, wn, ret)-1)/2.0 AS rb FROM x)
SELECT factor, trade_date, round(CASE WHEN count(*)>=100 THEN coalesce(corr(ra,rb),0) ELSE 0 END,6) AS rolling_ic FROM rk GROUP BY ALL""", "bars"))(
    lambda s, d: rounded(E.rolling_ic(lng(s, d)), 6))
query("e11_dynamic_weights")(lambda s, d: rounded(E.dynamic_weights(E.daily_ic(lng(s, d)).select("factor", F.coalesce("ic", F.lit(0.0)).alias("rolling_ic"))), 6))
COMBOS = {"c1": {"bias5": 0.3, "mom10": 0.7}, "c2": {"bias5": -0.5, "vol5": 0.5}, "c3": {"bias5": 0.2, "mom10": 0.4, "vol5": -0.4}}
query("m32_composite", sql(f"WITH {LNG}, z AS (SELECT code, trade_date, coalesce((bias5-avg(bias5) OVER ())/stddev_samp(bias5) OVER (),0) AS a, coalesce((mom10-avg(mom10) OVER ())/stddev_samp(mom10) OVER (),0) AS b FROM pn) SELECT code, trade_date, round(a*0.3+b*0.7,6) AS composite_score FROM z", "bars"))(
    lambda s, d: rounded(E.composite(panel(s, d), {"bias5": 0.3, "mom10": 0.7}).select("code", "trade_date", "composite_score"), 6))
_SW = " UNION ALL ".join(f"SELECT code, trade_date, ret, '{c}' AS factor, {' + '.join(f'z_{f}*{w / sum(abs(x) for x in ws.values())!r}' for f, w in ws.items())} AS value FROM zz" for c, ws in COMBOS.items())
_ZZ = "zz AS (SELECT code, trade_date, ret, " + ", ".join(f"coalesce(({f}-avg({f}) OVER ())/stddev_samp({f}) OVER (),0) AS z_{f}" for f in FACTORS) + " FROM pn)"
SWL = LNG.split(",\nlg AS")[0] + f", {_ZZ}, lg AS (SELECT code, trade_date, ret, factor, round(CAST(value AS DOUBLE),9) AS value FROM ({_SW}) WHERE ret IS NOT NULL)"
query("e12_sweep", None)(lambda s, d: rounded(E.sweep(panel(s, d), COMBOS, "forward_return_5d").select("combo", "ic_mean", "ic_ir", "long_short_return", "long_short_sharpe", "max_drawdown", "turnover", "total_score"), 4))
query("e13_lagged_proxies", sql(f"""WITH a AS (SELECT *, {lagx('close')} AS c, {lagx('volume')} AS v, {lagx('high')} AS h, {lagx('low')} AS l FROM bars), b AS (SELECT *, c/{lagx('c')}-1 AS r FROM a),
x AS (SELECT *, {roll('avg', 'c', 20)} AS m, {roll('stddev_samp', 'c', 20)} AS s, {roll('avg', 'v', 20)} AS vm, {roll('max', 'h', 20)} AS hi, {roll('min', 'l', 20)} AS lo, {roll('avg', 'r', 60)} AS r60, {roll('stddev_samp', 'r', 60)} AS s60, {roll('avg', 'r', 20)} AS r20, {roll('avg', 'r', 120)} AS r120 FROM b)
SELECT code, trade_date, round(1/(c/(m*vm/1e6+0.001)+0.1),6) AS factor_ep, round(1/(c/m+0.1),6) AS factor_bp, round(r60/(s60+0.001)*10,6) AS factor_roe, round(r20/(abs(r120)+0.001)*10,4) AS factor_revenue_growth, round((c-lo)/(hi-lo+0.001),6) AS factor_price_position, round((c-m)/m,6) AS factor_momentum_health FROM x""", "bars"))(
    lambda s, d: ML.lagged_proxies(I.bars(s, d)).select("code", "trade_date", *[F.round(c, 6).alias(c) for c in ("factor_ep", "factor_bp", "factor_roe")], F.round("factor_revenue_growth", 4).alias("factor_revenue_growth"),
                                                        *[F.round(c, 6).alias(c) for c in ("factor_price_position", "factor_momentum_health")]))
SEQ = f"""{RSI_C}, {ema_cte('e1', 'bars', {'ef': ('close', A[12], True), 'es': ('close', A[26], True)})}, d1 AS (SELECT *, ef-es AS dif FROM e1), {ema_cte('e2', 'd1', {'dea': ('dif', A[9], True)})},
f AS (SELECT code, trade_date, close, close/{lagx('close')}-1 AS returns, {roll('avg', 'close', 20)} AS ma20, (close-({roll('min', 'low', 20)}))/(({roll('max', 'high', 20)})-({roll('min', 'low', 20)})) AS price_position FROM bars),
f2 AS (SELECT f.*, {roll('stddev_samp', 'returns', 20)} AS volatility FROM f),
ft AS (SELECT f2.*, rs.rsi, e2.dif AS macd, e2.dea AS macd_signal FROM f2 JOIN rs USING (code, trade_date) JOIN e2 USING (code, trade_date) WHERE f2.returns IS NOT NULL AND ma20 IS NOT NULL AND volatility IS NOT NULL AND rs.rsi IS NOT NULL)"""
query("e14_sequence_features", sql(f"WITH {SEQ} SELECT code, trade_date, round(returns,6) AS returns, round(price_position,6) AS price_position, round(volatility,6) AS volatility, round(rsi,4) AS rsi, round(macd,4) AS macd, round(macd_signal,4) AS macd_signal FROM ft", "bars"))(
    lambda s, d: ML.sequence_features(I.bars(s, d)).select("code", "trade_date", *[F.round(c, 6).alias(c) for c in ("returns", "price_position", "volatility")], *[F.round(c, 4).alias(c) for c in ("rsi", "macd", "macd_signal")]))
query("e15_sequences", sql("WITH x AS (SELECT code, trade_date, close, row_number() OVER w AS n, sum(close) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sm, lag(volume,20) OVER w AS v FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)) SELECT code, trade_date, round(close,4) AS target, 20 AS steps, round(sm,4) AS sum_close, CAST(v AS DOUBLE) AS first_volume FROM x WHERE n>20", "bars"))(
    lambda s, d: ML.sequences(I.bars(s, d), ["close", "volume"]).select("code", "trade_date", F.round("target", 4).alias("target"), F.size("sequence").alias("steps"),
                                                                        F.round(F.aggregate("sequence", F.lit(0.0), lambda a, r: a + r[0]), 4).alias("sum_close"), F.col("sequence")[0][1].alias("first_volume")))
query("e16_vif")(lambda s, d: _vif(s, d))


def _vif(s, d):
    v = ML.vif(panel(s, d), FACTORS)
    return s.createDataFrame([(k, round(x, 4)) for k, x in v.items()], "factor string, vif double")


def _ranked(s, d):
    p = E.materialize(panel(s, d).select("code", "trade_date", "forward_return_5d", *FACTORS))
    model, scores = ML.train_ranker(p, FACTORS, "forward_return_5d", folds=2, depth=3, rounds=5)
    out = ML.score(model, p, FACTORS)
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("prediction"), 6).alias("mean_score"))


query("e17_e18_ranker")(_ranked)
query("e19_forecast_errors", sql(f"WITH p AS (SELECT code, trade_date, close, {lagx('close')} AS pred FROM bars), q AS (SELECT * FROM p WHERE pred IS NOT NULL), r AS (SELECT *, pred-{lagx('pred')} AS dp, close-{lagx('close')} AS da FROM q) SELECT round(avg((pred-close)*(pred-close)),6) AS mse, round(avg(abs(pred-close)),6) AS mae, round(sqrt(avg((pred-close)*(pred-close))),6) AS rmse, round(avg(abs((pred-close)/close)),6) AS mape, round(avg(CASE WHEN dp IS NULL THEN NULL WHEN (dp>0)=(da>0) THEN 1.0::DOUBLE ELSE 0 END),6) AS direction_accuracy FROM r", "bars"))(
    lambda s, d: rounded(ML.forecast_errors(I.bars(s, d).withColumn("pred", lag("close")).where("pred is not null"), "pred", "close"), 6))
