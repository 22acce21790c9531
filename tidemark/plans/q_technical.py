"""Indicator queries and their oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.windows import latest_rows
from tidemark.operators import technical as T
from tidemark.operators import volume as VP
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql

P = "PARTITION BY code ORDER BY trade_date"


def roll(fn: str, x: str, n: int) -> str:
    fr = f"OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {fr} >= {n} THEN {fn}({x}) {fr} END"


def lagx(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({P})"


def bands(x: str, cuts, other, null=50, above=False) -> str:
    op = ">" if above else "<"
    whens = " ".join(f"WHEN {x} {op} {c} THEN {s}" for c, s in cuts)
    head = f"WHEN {x} IS NULL THEN {null} " if null is not None else ""
    return f"CAST(CASE {head}{whens} ELSE {other} END AS DOUBLE)"


def ema_cte(name: str, src: str, specs: dict[str, tuple[str, float, bool]], date: str = "trade_date") -> str:
    """Averages as explicit weighted sums over each row's past (self range join)."""
    cols = []
    sources = sorted({c for c, _, _ in specs.values()})
    assert len(sources) == 1
    x = sources[0]
    for out, (_, alpha, adjust) in specs.items():
        w = 1 - alpha
        if adjust:
            cols.append(f"sum(power({w!r}::DOUBLE, a._n - b._n) * b.{x}) / sum(power({w!r}::DOUBLE, a._n - b._n)) AS {out}")
        else:
            cols.append(f"sum(power({w!r}::DOUBLE, a._n - b._n) * b.{x} * CASE WHEN b._n = 1 THEN 1 ELSE {alpha!r}::DOUBLE END) AS {out}")
    reach = max(math.ceil(41 / -math.log(1 - a)) for _, a, _ in specs.values())
    return (f"_{name} AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {date}) AS _n FROM {src} WHERE {x} IS NOT NULL),\n"
            f"{name}_v AS (SELECT a.code, a.{date}, {', '.join(cols)} FROM _{name} a JOIN _{name} b ON a.code = b.code "
            f"AND b._n <= a._n AND b._n > a._n - {reach} GROUP BY a.code, a.{date}),\n"
            f"{name} AS (SELECT s.*, {', '.join('v.' + o for o in specs)} FROM {src} s LEFT JOIN {name}_v v "
            f"ON s.code = v.code AND s.{date} = v.{date})")


def out(cols: str, src: str, digits: int = 4, scores: str = "") -> str:
    c = ", ".join(f"round({x}, {digits}) AS {x}" for x in cols.split())
    s = "".join(f", {x}" for x in scores.split())
    return f"SELECT code, trade_date, {c}{s} FROM {src}"


def series(fn, cols: str, digits: int = 4, **params):
    names = cols.split()

    def run(spark, sf):
        return rounded(fn(I.panel(spark, sf), **params).select("code", "trade_date", *names), digits)
    return run


A = {n: 2 / (n + 1) for n in (3, 5, 9, 10, 12, 14, 20, 26, 60)}

query("t01_ma_trend", sql(f"""WITH m AS (SELECT *, {roll('avg', 'close', 5)} AS ma_short, {roll('avg', 'close', 10)} AS ma_medium,
  {roll('avg', 'close', 20)} AS ma_long FROM bars)
SELECT code, trade_date, round(ma_short,4) AS ma_short, round(ma_medium,4) AS ma_medium, round(ma_long,4) AS ma_long,
 CAST(CASE WHEN ma_long IS NULL THEN 50 WHEN close>ma_short AND ma_short>ma_medium AND ma_medium>ma_long THEN 100
  WHEN close>ma_short AND ma_short>ma_medium THEN 80 WHEN close>ma_short THEN 60 WHEN close>ma_long THEN 40
  WHEN close<ma_short AND ma_short<ma_medium AND ma_medium<ma_long THEN 0 ELSE 30 END AS DOUBLE) AS ma_trend_score FROM m""", "bars"))(
    series(T.ma_trend, "ma_short ma_medium ma_long ma_trend_score"))


def macd_ctes(adjust: bool) -> str:
    return (ema_cte("e1", "bars", {"ef": ("close", A[12], adjust), "es": ("close", A[26], adjust)})
            + ",\nd1 AS (SELECT *, ef - es AS dif FROM e1),\n" + ema_cte("e2", "d1", {"dea": ("dif", A[9], adjust)}))


MACD_SCORED = macd_ctes(True) + f""",
mm AS (SELECT *, dif - dea AS macd FROM e2), mp AS (SELECT *, {lagx('macd')} AS pm FROM mm),
ms AS (SELECT *, CAST(CASE WHEN pm IS NULL THEN 50 WHEN macd>0 AND pm<=0 THEN 100 WHEN macd>0 AND dif>0 THEN 80 WHEN macd>0 THEN 60
  WHEN macd<0 AND pm>=0 THEN 20 WHEN macd<0 THEN 40 ELSE 50 END AS DOUBLE) AS macd_score FROM mp)"""
query("t02_macd", sql("WITH " + MACD_SCORED + "\n" + out("dif dea macd", "ms", 4, "macd_score"), "bars"))(
    series(T.macd, "dif dea macd macd_score"))

RSI_C = f"""g AS (SELECT *, CASE WHEN close > {lagx('close')} THEN close - {lagx('close')} ELSE 0 END AS gain,
  CASE WHEN close < {lagx('close')} THEN {lagx('close')} - close ELSE 0 END AS loss FROM bars),
g2 AS (SELECT *, {roll('avg', 'gain', 14)} AS ag, {roll('avg', 'loss', 14)} AS al FROM g),
rs AS (SELECT *, CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi FROM g2)"""
RSI_B = bands("rsi", [(30, 80), (50, 60), (70, 50), (80, 30)], 20)
query("t03_rsi", sql(f"WITH {RSI_C} SELECT code, trade_date, round(rsi,4) AS rsi, {RSI_B} AS rsi_score FROM rs", "bars"))(
    series(T.rsi, "rsi rsi_score"))


def kdj_ctes(a1, a2, adjust):
    return (f"""r0 AS (SELECT *, {roll('min', 'low', 9)} AS lo, {roll('max', 'high', 9)} AS hi FROM bars),
r1 AS (SELECT *, CASE WHEN hi = lo THEN 50 ELSE (close - lo) / (hi - lo) * 100 END AS rsv FROM r0),
""" + ema_cte("k1", "r1", {"kdj_k": ("rsv", a1, adjust)}) + ",\n" + ema_cte("k2", "k1", {"kdj_d": ("kdj_k", a2, adjust)})
            + ",\nkj AS (SELECT *, 3 * kdj_k - 2 * kdj_d AS kdj_j FROM k2)")


query("t04_kdj", sql("WITH " + kdj_ctes(0.5, 0.5, True) + f"""
SELECT code, trade_date, round(rsv,4) AS rsv, round(kdj_k,4) AS kdj_k, round(kdj_d,4) AS kdj_d, round(kdj_j,4) AS kdj_j,
{bands('kdj_j', [(0, 90), (20, 80), (50, 60), (80, 40), (100, 20)], 10)} AS kdj_score FROM kj""", "bars"))(
    series(T.kdj, "rsv kdj_k kdj_d kdj_j kdj_score"))

BOLL = f"""b0 AS (SELECT *, {roll('avg', 'close', 20)} AS bb_middle, {roll('stddev_samp', 'close', 20)} AS sd FROM bars),
b1 AS (SELECT *, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower FROM b0),
b2 AS (SELECT *, (bb_upper - bb_lower) / bb_middle * 100 AS bb_bandwidth,
   CASE WHEN bb_upper = bb_lower THEN 0.5 ELSE (close - bb_lower) / (bb_upper - bb_lower) END AS bb_position FROM b1)"""
query("t05_bollinger", sql(f"""WITH {BOLL} SELECT code, trade_date, round(bb_middle,4) AS bb_middle, round(bb_upper,4) AS bb_upper,
 round(bb_lower,4) AS bb_lower, round(bb_bandwidth,4) AS bb_bandwidth, round(bb_position,4) AS bb_position,
 {bands('bb_position', [(0, 90), (.2, 80), (.4, 60), (.6, 50), (.8, 40), (1, 30)], 20)} AS bollinger_score FROM b2""", "bars"))(
    series(T.bollinger, "bb_middle bb_upper bb_lower bb_bandwidth bb_position bollinger_score"))


def tr(prev="close"):
    return f"greatest(high - low, abs(high - {lagx(prev)}), abs(low - {lagx(prev)}))"


for legacy in (False, True):
    query("t06_atr" + ("_legacy" if legacy else ""), sql(f"""WITH a0 AS (SELECT *, {tr('high' if legacy else 'close')} AS true_range FROM bars),
a1 AS (SELECT *, {roll('avg', 'true_range', 14)} AS atr FROM a0), a2 AS (SELECT *, atr / close * 100 AS atr_ratio FROM a1)
SELECT code, trade_date, round(true_range,4) AS true_range, round(atr,4) AS atr, round(atr_ratio,4) AS atr_ratio,
{bands('atr_ratio', [(5, 20), (4, 30), (3, 40), (2, 60), (1, 80)], 70, above=True)} AS atr_score FROM a2""", "bars"))(
        series(T.atr, "true_range atr atr_ratio atr_score", legacy=legacy))


def cci_ctes(n):
    return f"""c0 AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), c1 AS (SELECT *, {roll('avg', 'tp', n)} AS m FROM c0),
c2 AS (SELECT *, abs(tp - m) AS d FROM c1), c3 AS (SELECT *, {roll('avg', 'd', n)} AS md FROM c2),
c4 AS (SELECT *, CASE WHEN md = 0 THEN 0 ELSE (tp - m) / (0.015 * md) END AS cci FROM c3)"""


query("t07_cci", sql(f"""WITH {cci_ctes(14)} SELECT code, trade_date, round(cci,4) AS cci,
 {bands('cci', [(-200, 90), (-100, 80), (0, 60), (100, 50), (200, 30)], 20)} AS cci_score FROM c4""", "bars"))(
    series(T.cci, "cci cci_score"))

WR = f"""w0 AS (SELECT *, {roll('max', 'high', 14)} AS hh, {roll('min', 'low', 14)} AS ll FROM bars),
w1 AS (SELECT *, CASE WHEN hh = ll THEN -50 ELSE (hh - close) / (hh - ll) * -100 END AS wr FROM w0)"""
query("t08_wr", sql(f"""WITH {WR} SELECT code, trade_date, round(wr,4) AS wr,
 {bands('wr', [(-80, 90), (-50, 70), (-20, 50), (0, 30)], 20)} AS wr_score FROM w1""", "bars"))(series(T.wr, "wr wr_score"))

query("t09_dmi", sql(f"""WITH d0 AS (SELECT *, high - {lagx('high')} AS up, {lagx('low')} - low AS dn, {tr()} AS tr FROM bars),
d1 AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM d0),
d2 AS (SELECT *, {roll('sum', 'tr', 14)} AS st, {roll('sum', 'pdm', 14)} AS sp, {roll('sum', 'mdm', 14)} AS sm FROM d1),
d3 AS (SELECT *, CASE WHEN st = 0 THEN 0 ELSE sp / st * 100 END AS pdi, CASE WHEN st = 0 THEN 0 ELSE sm / st * 100 END AS mdi FROM d2),
d4 AS (SELECT *, CASE WHEN pdi + mdi = 0 THEN 0 ELSE abs(pdi - mdi) / (pdi + mdi) * 100 END AS adx FROM d3)
SELECT code, trade_date, round(pdi,4) AS pdi, round(mdi,4) AS mdi, round(adx,4) AS adx,
 {bands('adx', [(60, 90), (40, 70), (25, 60), (20, 50)], 40, above=True)} AS dmi_score FROM d4""", "bars"))(
    series(T.dmi, "pdi mdi adx dmi_score"))

query("t10_roc", sql(f"""WITH r AS (SELECT *, (close - {lagx('close', 12)}) / {lagx('close', 12)} * 100 AS roc FROM bars)
SELECT code, trade_date, round(roc,4) AS roc, {bands('roc', [(-15, 90), (-5, 70), (5, 50), (15, 40)], 30)} AS roc_score FROM r""", "bars"))(
    series(T.roc, "roc roc_score"))
query("t11_mtm", sql(f"""WITH r AS (SELECT *, close - {lagx('close', 12)} AS mtm FROM bars), q AS (SELECT *, mtm / close * 100 AS p FROM r)
SELECT code, trade_date, round(mtm,4) AS mtm, {bands('p', [(-10, 90), (-5, 70), (0, 55), (5, 50), (10, 40)], 30)} AS mtm_score FROM q""", "bars"))(
    series(T.mtm, "mtm mtm_score"))
query("t12_psy", sql(f"""WITH u AS (SELECT *, CASE WHEN close > {lagx('close')} THEN 1.0::DOUBLE ELSE 0 END AS u FROM bars),
p AS (SELECT *, {roll('sum', 'u', 12)} / 12 * 100 AS psy FROM u)
SELECT code, trade_date, round(psy,4) AS psy, {bands('psy', [(25, 90), (40, 70), (60, 50), (75, 40)], 30)} AS psy_score FROM p""", "bars"))(
    series(T.psy, "psy psy_score"))
query("t13_asi", sql(f"""WITH s0 AS (SELECT *, {lagx('close')} AS pc, {lagx('open')} AS po FROM bars),
s1 AS (SELECT *, abs(high - pc) AS a, abs(low - pc) AS b, abs(pc - po) AS d FROM s0),
s2 AS (SELECT *, CASE WHEN a >= b THEN a + b / 2 + d / 4 ELSE b + a / 2 + d / 4 END AS r FROM s1),
s3 AS (SELECT *, CASE WHEN r = 0 THEN 0 ELSE (close - pc + (close - open) / 2 + pc - po) / r * 50 END AS si FROM s2),
s4 AS (SELECT *, {roll('sum', 'si', 5)} AS asi FROM s3)
SELECT code, trade_date, round(asi,4) AS asi, {bands('asi', [(50, 75), (0, 60), (-50, 50)], 40, above=True)} AS asi_score FROM s4""", "bars"))(
    series(T.asi, "asi asi_score"))
query("t14_emv", sql(f"""WITH v0 AS (SELECT *, (high + low) / 2 AS mid FROM bars),
v1 AS (SELECT *, CASE WHEN high = low OR volume = 0 THEN 0 ELSE (mid - {lagx('mid')}) / ((high - low) / volume * 1000000) END AS e FROM v0),
v2 AS (SELECT *, {roll('avg', 'e', 14)} AS emv FROM v1)
SELECT code, trade_date, round(emv * 1000,4) AS emv, {bands('emv', [(0, 70)], 40, above=True)} AS emv_score FROM v2""", "bars"))(
    lambda s, d: rounded(T.emv(I.panel(s, d)).select("code", "trade_date", (F.col("emv") * 1000).alias("emv"), "emv_score")))
query("t15_ma5_bias_and_gap", sql(f"""WITH b AS (SELECT *, {roll('avg', 'close', 5)} AS m5, {roll('avg', 'close', 20)} AS m20 FROM bars)
SELECT code, trade_date, round((close - m5) / m5, 6) AS ma5_bias, round((m5 - m20) / m20 * 100, 6) AS ma_gap FROM b""", "bars"))(
    series(lambda d: T.ma_gap(T.ma5_bias(d)), "ma5_bias ma_gap", 6))

query("t16_panel_series", sql(f"""WITH {RSI_C}, {BOLL},
x AS (SELECT bars.*, {roll('avg', 'close', 5)} AS ma5, {roll('avg', 'close', 10)} AS ma10, {roll('avg', 'close', 20)} AS ma20,
  {roll('avg', 'close', 60)} AS ma60, volume / ({roll('avg', 'volume', 5)}) AS vol_ratio, {tr()} AS tr FROM bars),
y AS (SELECT x.*, {roll('avg', 'tr', 14)} AS atr, (close - ma20) / ma20 AS bias20, ma20 / {lagx('ma20', 5)} - 1 AS slope20 FROM x)
SELECT y.code, y.trade_date, round(rsi,4) AS rsi, round(ma5,4) AS ma5, round(ma60,4) AS ma60, round(vol_ratio,4) AS vol_ratio,
 round(atr,4) AS atr, round(bb_position,4) AS bb_position, round(bias20,4) AS bias20, round(slope20,4) AS slope20,
 (y.close > ma5 AND ma5 > ma10 AND ma10 > ma20) AS trend_up
FROM y JOIN rs USING (code, trade_date) JOIN b2 USING (code, trade_date)""", "bars"))(
    series(T.panel_series, "rsi ma5 ma60 vol_ratio atr bb_position bias20 slope20 trend_up"))

query("t17_library_macd", sql("WITH " + macd_ctes(False) + """
SELECT code, trade_date, round(dif,4) AS macd, round(dea,4) AS macd_signal, round(dif - dea,4) AS macd_histogram FROM e2""", "bars"))(
    series(T.library_macd, "macd macd_signal macd_histogram"))
LRSI = RSI_C.split("\ng2 AS")[0] + "\n" + ema_cte("lg", "g", {"eg": ("gain", A[14], False)}) + ",\n" + ema_cte("ll", "lg", {"el": ("loss", A[14], False)})
query("t17_library_rsi", sql(f"""WITH {LRSI} SELECT code, trade_date,
 round(CASE WHEN el = 0 THEN CASE WHEN eg = 0 THEN NULL ELSE 100 END ELSE 100 - 100 / (1 + eg / el) END, 4) AS rsi_14 FROM ll""", "bars"))(
    series(T.library_rsi, "rsi_14"))
query("t17_library_volume", sql(f"""WITH v AS (SELECT *, {lagx('close')} AS pc, (high + low + close) / 3 AS tp FROM bars),
w AS (SELECT *, {roll('avg', 'volume', 5)} AS volume_ma5, {roll('avg', 'volume', 20)} AS volume_ma20,
 sum((close - pc) / pc * volume) OVER ({P} ROWS UNBOUNDED PRECEDING) AS pvt,
 CAST(sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER ({P} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv,
 sum(tp * volume) OVER ({P} ROWS UNBOUNDED PRECEDING) / sum(volume) OVER ({P} ROWS UNBOUNDED PRECEDING) AS vwap FROM v)
SELECT code, trade_date, round(volume_ma5,4) AS volume_ma5, round(volume_ma20,4) AS volume_ma20, round(volume / volume_ma20,4) AS volume_ratio,
 round(pvt,4) AS pvt, obv, round(vwap,4) AS vwap FROM w""", "bars"))(
    series(T.library_volume, "volume_ma5 volume_ma20 volume_ratio pvt obv vwap"))
query("t17_library_ema_list", sql("WITH " + ema_cte("e", "bars", {f"ema{n}": ("close", A[n], False) for n in (5, 10, 20, 60)})
                                  + "\n" + out("ema5 ema10 ema20 ema60", "e"), "bars"))(series(T.ema_list, "ema5 ema10 ema20 ema60"))
query("t17_library_cci_wr_momentum", sql(f"""WITH {cci_ctes(20)}, {WR}
SELECT c4.code, c4.trade_date, round(cci,4) AS cci_20, round(wr,4) AS wr, round(c4.close - {lagx('c4.close', 10).replace('code', 'c4.code').replace('trade_date', 'c4.trade_date')},4) AS momentum_10,
 round((c4.close / {lagx('c4.close', 10).replace('code', 'c4.code').replace('trade_date', 'c4.trade_date')} - 1) * 100,4) AS momentum_pct_10
FROM c4 JOIN w1 USING (code, trade_date)""", "bars"))(
    series(lambda d: T.momentum(T.wr(T.library_cci(d))), "cci_20 wr momentum_10 momentum_pct_10"))
query("t17_library_atr", sql(f"""WITH a0 AS (SELECT *, greatest(high - low, coalesce(abs(high - {lagx('close')}), 0), coalesce(abs(low - {lagx('close')}), 0)) AS tr FROM bars),
{ema_cte('e', 'a0', {'atr_14': ('tr', A[14], False)})} {out('atr_14', 'e')}""", "bars"))(series(T.library_atr, "atr_14"))

query("t18_basic_features", sql(f"""WITH r AS (SELECT *, (close / {lagx('close')} - 1) * 100 AS returns FROM bars)
SELECT code, trade_date, round(returns,4) AS returns, round({roll('avg', 'close', 5)},4) AS ma5, round({roll('avg', 'close', 10)},4) AS ma10,
 round({roll('avg', 'close', 20)},4) AS ma20, round({roll('avg', 'close', 60)},4) AS ma60, round({roll('stddev_samp', 'returns', 20)},4) AS volatility_20,
 round({roll('avg', 'volume', 5)},4) AS volume_ma5, round({roll('avg', 'volume', 20)},4) AS volume_ma20 FROM r""", "bars"))(
    series(T.basic_features, "returns ma5 ma10 ma20 ma60 volatility_20 volume_ma5 volume_ma20"))
query("t19_panel_features", sql(f"""SELECT code, trade_date, round(close / {lagx('close', 20)} - 1,6) AS momentum_20d,
 round(({roll('stddev_samp', 'close', 20)}) / ({roll('avg', 'close', 20)}),6) AS volatility_20d, round(volume / ({roll('avg', 'volume', 10)}),4) AS v_ratio10
 FROM bars""", "bars"))(lambda s, d: T.panel_features(I.panel(s, d)).select(
    "code", "trade_date", F.round("momentum_20d", 6).alias("momentum_20d"), F.round("volatility_20d", 6).alias("volatility_20d"),
    F.round("v_ratio10", 4).alias("v_ratio10")))
query("t20_macd_cross", sql("WITH " + macd_ctes(True) + f""", x AS (SELECT *, dif - dea AS d FROM e2), y AS (SELECT *, {lagx('d')} AS p FROM x)
SELECT code, trade_date, CASE WHEN d > 0 AND p <= 0 THEN 'golden' WHEN d < 0 AND p >= 0 THEN 'death' END AS "cross" FROM y
WHERE (d > 0 AND p <= 0) OR (d < 0 AND p >= 0)""", "bars"))(
    lambda s, d: T.cross_signals(T.macd(I.panel(s, d))).where("cross is not null").select("code", "trade_date", "cross"))
query("t21_monthly_macd", sql("""WITH mo AS (SELECT code, CAST(date_trunc('month', trade_date) AS DATE) AS month, arg_max(close, trade_date) AS close FROM bars GROUP BY ALL),
""" + ema_cte("e1", "mo", {"ef": ("close", A[12], False), "es": ("close", A[26], False)}, "month") + ",\nd1 AS (SELECT *, ef - es AS dif FROM e1),\n"
    + ema_cte("e2", "d1", {"dea": ("dif", A[9], False)}, "month") + """,
z AS (SELECT *, dif - dea AS d, row_number() OVER (PARTITION BY code ORDER BY month) AS n FROM e2), y AS (SELECT *, lag(d) OVER (PARTITION BY code ORDER BY month) AS p FROM z)
SELECT code, month, round(close,4) AS close, round(CASE WHEN n>=30 THEN dif END,4) AS dif, round(CASE WHEN n>=30 THEN dea END,4) AS dea,
 CASE WHEN n>=30 THEN d > 0 AND p <= 0 END AS golden_cross, CASE WHEN n>=30 THEN dif > 0 AND dea > 0 END AS above_zero FROM y""", "bars"))(
    lambda s, d: rounded(T.monthly_macd(I.bars(s, d))))
query("t22_kama", sql(f"""WITH RECURSIVE a AS (SELECT code, trade_date, close, row_number() OVER ({P}) AS n, abs(close - {lagx('close')}) AS d, abs(close - {lagx('close', 10)}) AS chg FROM bars),
b AS (SELECT *, {roll('sum', 'd', 10)} AS vol FROM a),
c AS (SELECT code, trade_date, close, n, power(CASE WHEN vol > 0 THEN chg / vol WHEN vol = 0 THEN 0 END * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) AS sc FROM b),
k AS (SELECT code, n, close AS kama FROM c WHERE n = 11 UNION ALL SELECT c.code, c.n, k.kama + c.sc * (c.close - k.kama) FROM k JOIN c ON c.code = k.code AND c.n = k.n + 1)
SELECT c.code, c.trade_date, round(k.kama,4) AS kama FROM c LEFT JOIN k ON c.code = k.code AND c.n = k.n""", "bars").replace("WITH\n", "WITH ").replace(
    "WITH \nlegs", "WITH RECURSIVE \nlegs").replace("RECURSIVE a AS", "a AS"))(series(T.kama, "kama"))
query("t23_bias_and_wr_positive", sql(f"""WITH {WR} SELECT code, trade_date, round((close - ({roll('avg', 'close', 5)})) / ({roll('avg', 'close', 5)}) * 100,4) AS bias5,
 round((close - ({roll('avg', 'close', 10)})) / ({roll('avg', 'close', 10)}) * 100,4) AS bias10,
 round((close - ({roll('avg', 'close', 20)})) / ({roll('avg', 'close', 20)}) * 100,4) AS bias20, round(-wr,4) AS wr FROM w1""", "bars"))(
    series(lambda d: T.bias(T.wr(d, positive=True)), "bias5 bias10 bias20 wr"))
query("t24_textbook_set", sql("WITH " + kdj_ctes(1 / 3, 1 / 3, False) + ",\n" + LRSI + ",\n" + macd_ctes(False).replace("e1", "f1").replace("e2", "f2") + ",\n" + f"""
 a0 AS (SELECT *, greatest(high - low, coalesce(abs(high - {lagx('close')}), 0), coalesce(abs(low - {lagx('close')}), 0)) AS tr FROM bars),
{ema_cte('ea', 'a0', {'atr_14': ('tr', A[14], False)})}
SELECT kj.code, kj.trade_date, round(f2.ef,4) AS ema12, round(f2.es,4) AS ema26, round(dif,4) AS macd, round(dif - dea,4) AS macd_histogram,
 round(kj.kdj_k,4) AS kdj_k, round(kj.kdj_d,4) AS kdj_d, round(kj.kdj_j,4) AS kdj_j, round(atr_14,4) AS atr_14,
 round(CASE WHEN el = 0 THEN CASE WHEN eg = 0 THEN NULL ELSE 100 END ELSE 100 - 100 / (1 + eg / el) END, 4) AS rsi_14
FROM kj JOIN f2 USING (code, trade_date) JOIN ll USING (code, trade_date) JOIN ea USING (code, trade_date)""", "bars"))(
    series(T.textbook_set, "ema12 ema26 macd macd_histogram kdj_k kdj_d kdj_j atr_14 rsi_14"))


# ---- volume-price



query("v01_volume_ratio", sql(f"""WITH x AS (SELECT *, volume / ({roll('avg', 'volume', 5)}) AS volume_ratio FROM bars)
SELECT code, trade_date, round(volume_ratio,4) AS volume_ratio, {bands('volume_ratio', [(3, 100), (2, 80), (1.5, 60), (.8, 50)], 30, above=True)} AS volume_ratio_score FROM x""", "bars"))(
    series(VP.volume_ratio, "volume_ratio volume_ratio_score"))
query("v02_turnover", sql(f"""SELECT code, trade_date, round(turnover,4) AS turnover_value, {bands('turnover', [(20, 90), (10, 80), (5, 70), (3, 60), (1, 50)], 40, above=True)} AS turnover_score FROM bars""", "bars"))(
    lambda s, d: rounded(VP.turnover(I.bars(s, d)).select("code", "trade_date", "turnover_value", "turnover_score")))
query("v03_vma", sql(f"""WITH x AS (SELECT *, ({roll('avg', 'volume', 5)}) / ({roll('avg', 'volume', 20)}) AS vma_ratio FROM bars)
SELECT code, trade_date, round(vma_ratio,4) AS vma_ratio, {bands('vma_ratio', [(2, 90), (1.5, 75), (1, 60), (.8, 50)], 40, above=True)} AS vma_score FROM x""", "bars"))(
    series(VP.vma, "vma_ratio vma_score"))
query("v04_vosc", sql(f"""WITH a AS (SELECT *, {roll('avg', 'volume', 12)} AS s, {roll('avg', 'volume', 26)} AS l FROM bars), x AS (SELECT *, (s - l) / l * 100 AS vosc FROM a)
SELECT code, trade_date, round(vosc,4) AS vosc, {bands('vosc', [(-20, 90), (-10, 70), (0, 55), (10, 50), (20, 40)], 30)} AS vosc_score FROM x""", "bars"))(
    series(VP.vosc, "vosc vosc_score"))
OBV = f"""o0 AS (SELECT *, CASE WHEN close > {lagx('close')} THEN volume WHEN close < {lagx('close')} THEN -volume ELSE 0 END AS sv FROM bars),
o1 AS (SELECT *, CAST(sum(sv) OVER ({P} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv FROM o0), o2 AS (SELECT *, {roll('avg', 'obv', 20)} AS m FROM o1),
o3 AS (SELECT *, CASE WHEN m = 0 THEN 1 ELSE obv / m END AS obv_ratio FROM o2)"""
query("v05_obv", sql(f"""WITH {OBV} SELECT code, trade_date, obv, round(obv_ratio,4) AS obv_ratio,
 {bands('obv_ratio', [(1.5, 90), (1.2, 80), (1, 70), (.8, 50), (.5, 40)], 30, above=True)} AS obv_score FROM o3""", "bars"))(series(VP.obv, "obv obv_ratio obv_score"))
query("v06_mfi", sql(f"""WITH m0 AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), m1 AS (SELECT *, {lagx('tp')} AS pt FROM m0),
m2 AS (SELECT *, CASE WHEN tp > pt THEN tp * volume ELSE 0 END AS p, CASE WHEN tp < pt THEN tp * volume ELSE 0 END AS n FROM m1),
m3 AS (SELECT *, {roll('sum', 'p', 14)} AS ps, {roll('sum', 'n', 14)} AS ns FROM m2), m4 AS (SELECT *, CASE WHEN ns = 0 THEN 100 ELSE 100 - 100 / (1 + ps / ns) END AS mfi FROM m3)
SELECT code, trade_date, round(mfi,4) AS mfi, {bands('mfi', [(20, 90), (40, 70), (60, 50), (80, 40)], 30)} AS mfi_score FROM m4""", "bars"))(series(VP.mfi, "mfi mfi_score"))
query("v07_vr", sql(f"""WITH a AS (SELECT *, CASE WHEN close > {lagx('close')} THEN volume ELSE 0 END AS u, CASE WHEN close < {lagx('close')} THEN volume ELSE 0 END AS d,
 CASE WHEN close = {lagx('close')} THEN volume ELSE 0 END AS e FROM bars), b AS (SELECT *, {roll('sum', 'u', 26)} AS su, {roll('sum', 'd', 26)} AS sd, {roll('sum', 'e', 26)} AS se FROM a),
x AS (SELECT *, CASE WHEN sd + se / 2 = 0 THEN 100 ELSE (su + se / 2) / (sd + se / 2) * 100 END AS vr FROM b)
SELECT code, trade_date, round(vr,4) AS vr, {bands('vr', [(40, 90), (70, 70), (150, 50), (250, 40)], 30)} AS vr_score FROM x""", "bars"))(series(VP.vr, "vr vr_score"))
query("v08_wvad", sql(f"""WITH a AS (SELECT *, CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) * volume END AS w FROM bars), x AS (SELECT *, {roll('sum', 'w', 24)} AS wvad FROM a)
SELECT code, trade_date, round(wvad,4) AS wvad, {bands('wvad', [(0, 70)], 40, above=True)} AS wvad_score FROM x""", "bars"))(series(VP.wvad, "wvad wvad_score"))
query("v09_v11_daily_volume", sql(f"""WITH t AS (SELECT trade_date, sum(volume * close) / 1e8 AS v_total FROM bars GROUP BY 1)
SELECT code, trade_date, round(coalesce(CAST(volume AS DOUBLE) / {lagx('volume')}, 1),4) AS v_ratio10, round(v_total * 1e6,4) AS v_total, round(volume * open / 1e8 * 0.15 * 1e6,4) AS open_auction_volume
FROM bars JOIN t USING (trade_date)""", "bars"))(
    lambda s, d: rounded(VP.v_total(VP.open_auction_volume(VP.v_ratio10(I.panel(s, d)))).select(
        "code", "trade_date", "v_ratio10", (F.col("v_total") * 1e6).alias("v_total"), (F.col("open_auction_volume") * 1e6).alias("open_auction_volume"))))


def resonance_oracle() -> str:
    n = "ba AS (SELECT code, trade_date, close AS c, low AS l, high AS h, volume AS v, " \
        f"{lagx('close')} AS pc, {lagx('volume')} AS pv, {lagx('high')} AS ph, row_number() OVER ({P}) - 1 AS i FROM bars)"
    return sql(f"""WITH {n},
bb AS (SELECT *, avg(v) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS av, coalesce(c > pc AND l >= pc, false) AS rise FROM ba),
s1 AS (SELECT a.code, a.i, arg_min(j.v / j.pv, j.i) AS vr FROM ba a JOIN ba j ON j.code = a.code AND j.i BETWEEN greatest(a.i - 20, 1) AND a.i - 1
   AND j.c >= j.pc * 1.095 AND j.v / j.pv >= 1.5
   WHERE a.i >= 10 AND NOT EXISTS (SELECT 1 FROM ba k WHERE k.code = a.code AND k.i > j.i AND k.i <= least(j.i + 10, a.i) AND (k.l < j.c * 0.97 OR k.c < k.pc * 0.9)) GROUP BY 1, 2),
s2 AS (SELECT a.code, a.i, arg_min(least(25, least(15, (j.l - j.ph) / j.ph * 200) + 10 - (a.i - j.i) * 0.3), j.i) AS g
   FROM ba a JOIN ba j ON j.code = a.code AND j.i BETWEEN greatest(a.i - 3, 1) AND a.i - 1 AND j.l > j.ph WHERE a.i >= 10 GROUP BY 1, 2),
s4 AS (SELECT a.code, a.i, arg_min(least(25, least(15, (j.v / a.av - 2) * 5) + (a.i - j.i)), j.i) AS g
   FROM bb a JOIN ba j ON j.code = a.code AND j.i BETWEEN a.i - 5 AND a.i - 1 AND j.v >= a.av * 2
   WHERE a.i >= 10 AND NOT EXISTS (SELECT 1 FROM ba k WHERE k.code = a.code AND k.i > j.i AND k.i <= a.i AND k.c < j.c) GROUP BY 1, 2),
f AS (SELECT *, lag(rise,5) OVER ({P}) f5, lag(rise,4) OVER ({P}) f4, lag(rise,3) OVER ({P}) f3, lag(rise,2) OVER ({P}) f2, lag(rise,1) OVER ({P}) f1 FROM bb),
r AS (SELECT *, CASE WHEN f5 AND f4 AND f3 THEN CASE WHEN NOT f2 THEN 3 WHEN NOT f1 THEN 4 WHEN NOT rise THEN 5 ELSE 6 END
   WHEN f4 AND f3 AND f2 THEN CASE WHEN NOT f1 THEN 3 WHEN NOT rise THEN 4 ELSE 5 END
   WHEN f3 AND f2 AND f1 THEN CASE WHEN NOT rise THEN 3 ELSE 4 END WHEN f2 AND f1 AND rise THEN 3 ELSE 0 END AS run FROM f)
SELECT r.code, r.trade_date, round(CAST(CASE WHEN s1.vr IS NULL THEN 0 ELSE least(25, 12.5 + least(12.5, (s1.vr - 1.5) * 5)) END AS DOUBLE),4) AS mf_s1_limit_up,
 round(CAST(coalesce(s2.g, 0) AS DOUBLE),4) AS mf_s2_gap, round(CAST(CASE WHEN r.i >= 10 AND run >= 3 THEN least(25, 10 + run * 3) ELSE 0 END AS DOUBLE),4) AS mf_s3_consecutive,
 round(CAST(coalesce(s4.g, 0) AS DOUBLE),4) AS mf_s4_volume
FROM r LEFT JOIN s1 USING (code, i) LEFT JOIN s2 USING (code, i) LEFT JOIN s4 USING (code, i)""", "bars")


query("v12_mainforce_resonance", resonance_oracle())(
    series(VP.mainforce_resonance, "mf_s1_limit_up mf_s2_gap mf_s3_consecutive mf_s4_volume"))
query("v14_volume_price_pattern", sql(f"""WITH a AS (SELECT *, close / {lagx('close')} - 1 AS p, CAST(volume AS DOUBLE) / {lagx('volume')} - 1 AS v FROM bars),
b AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN (v > 0) = (p > 0) THEN 1 ELSE 0 END AS sm, CASE WHEN p IS NULL THEN NULL WHEN v > 0.2 AND p > 0 THEN 1 ELSE 0 END AS uu,
 CASE WHEN p IS NULL THEN NULL WHEN v < -0.1 AND p < 0 THEN 1 ELSE 0 END AS dd FROM a),
c AS (SELECT *, {roll('sum', 'sm', 5)} AS s5, {roll('sum', 'uu', 5)} AS u5, {roll('sum', 'dd', 5)} AS d5 FROM b)
SELECT code, trade_date, CASE WHEN s5 IS NULL THEN 'unknown' WHEN s5 >= 4 THEN 'rise_together' WHEN u5 >= 2 THEN 'rise_expand' WHEN d5 >= 2 THEN 'shrink_pullback' WHEN s5 <= 1 THEN 'diverge' ELSE 'normal' END AS vp_pattern,
 CAST(CASE WHEN s5 IS NULL THEN 50 WHEN s5 >= 4 THEN 90 WHEN u5 >= 2 THEN 80 WHEN d5 >= 2 THEN 70 WHEN s5 <= 1 THEN 30 ELSE 60 END AS DOUBLE) AS vp_score FROM c""", "bars"))(
    series(VP.volume_price_pattern, "vp_pattern vp_score"))


# ---- flagship

def flagship(bars, top: int = 20):
    """Weighted score of four indicators at each code's newest bar; price 3-100, score >= 50."""
    from tidemark.operators.scoring import weighted_score
    df = VP.volume_ratio(T.rsi(T.macd(T.ma_trend(bars))))
    last = latest_rows(df, "trade_date", "close", "ma_trend_score", "macd_score", "rsi_score", "volume_ratio_score")
    return weighted_score(
        last, {"ma_trend_score": (0.30, 50), "macd_score": (0.25, 40), "rsi_score": (0.20, 30), "volume_ratio_score": (0.25, 40)},
        min_score=50, price=(3, 100), top=top)


FLAG = f"""{MACD_SCORED}, {RSI_C},
tt AS (SELECT *, {roll('avg', 'close', 5)} AS s, {roll('avg', 'close', 10)} AS m, {roll('avg', 'close', 20)} AS l, volume / ({roll('avg', 'volume', 5)}) AS vr FROM bars),
al AS (SELECT tt.code, tt.trade_date, tt.close, CASE WHEN l IS NULL THEN 50 WHEN tt.close>s AND s>m AND m>l THEN 100 WHEN tt.close>s AND s>m THEN 80 WHEN tt.close>s THEN 60
 WHEN tt.close>l THEN 40 WHEN tt.close<s AND s<m AND m<l THEN 0 ELSE 30 END AS f1, macd_score AS f2, {RSI_B} AS f3,
 {bands('vr', [(3, 100), (2, 80), (1.5, 60), (.8, 50)], 30, above=True)} AS f4
 FROM tt JOIN ms USING (code, trade_date) JOIN rs USING (code, trade_date) QUALIFY row_number() OVER (PARTITION BY tt.code ORDER BY tt.trade_date DESC) = 1),
sc AS (SELECT *, CASE WHEN f1>=50 THEN f1*0.30 ELSE 0 END + CASE WHEN f2>=40 THEN f2*0.25 ELSE 0 END + CASE WHEN f3>=30 THEN f3*0.20 ELSE 0 END + CASE WHEN f4>=40 THEN f4*0.25 ELSE 0 END AS score FROM al)
SELECT code, trade_date, round(close,4) AS close, round(CAST(score AS DOUBLE),4) AS score FROM sc WHERE close BETWEEN 3 AND 100 AND score >= 50 ORDER BY score DESC, code LIMIT 20"""
query("flagship_weighted_top20", sql("WITH " + FLAG, "bars"))(
    lambda s, d: rounded(flagship(I.panel(s, d)).select("code", "trade_date", "close", "score")))
