"""Queries of the resonance signals and the three selection flows."""

from __future__ import annotations

from tidemark.functions.windows import CODE, DATE
from tidemark.operators import resonance as R, technical as T, volume as V
from tidemark.plans import inputs as I
from tidemark.plans import q_technical  # noqa: F401  registers the oracles that the balanced flow adds up
from tidemark.plans.catalog import ORACLES, query, rounded
from tidemark.plans.ctes import sql

AS_OF, MAX_AGE, MIN_VOLUME = "1998-12-01", 60, 20
P = "(PARTITION BY code ORDER BY trade_date"
FIRST = "min({{'at': trade_date, {0}}}) FILTER ({1})"


def first(test: str, **fields: str) -> str:
    return FIRST.format(", ".join(f"'{k}': {v}" for k, v in fields.items()), test)


SIGNALS = f"""
x AS (SELECT code, trade_date, high, low, close, volume, lag(close) OVER {P}) AS pc, lag(volume) OVER {P}) AS pv, lag(high) OVER {P}) AS ph, row_number() OVER {P}) AS k,
  count(*) OVER (PARTITION BY code) AS n, (sum(volume) OVER (PARTITION BY code)-last_value(volume) OVER {P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))::DOUBLE/nullif(count(*) OVER (PARTITION BY code)-1, 0) AS av,
  min(low) OVER {P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lf, min(close) OVER {P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cf,
  min(low) OVER {P} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS l10 FROM bars),
y AS (SELECT *, coalesce(max(CASE WHEN close<pc*0.9::DOUBLE THEN 1 ELSE 0 END) OVER {P} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0) AS fell, coalesce(close>pc AND low>=pc, false) AS up FROM x),
z AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER {P}) AS isle FROM y),
r AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY code, isle) AS run, min(trade_date) OVER (PARTITION BY code, isle) AS start_date, row_number() OVER (PARTITION BY code, isle ORDER BY trade_date DESC) AS back FROM z),
g AS (SELECT code, max(trade_date) AS trade_date,
  {first("n>=11 AND close>=pc*1.095::DOUBLE AND volume>=pv*1.5::DOUBLE AND coalesce(l10>=close*0.97::DOUBLE, true) AND fell=0", a="coalesce(volume/nullif(pv, 0), 0)", b="least(n-k, 10)")} AS f1,
  {first("n>=5 AND k>=3 AND low>ph AND coalesce(lf>ph, true)", a="low-ph", b="n-k+1")} AS f2,
  {first("n>=5 AND run>=2 AND up AND back=1", a="run+1", b="start_date")} AS f3,
  {first("n>=5 AND k>=4 AND volume>=av*2 AND coalesce(cf>=close, true)", a="volume/nullif(av, 0)", b="close")} AS f4 FROM r GROUP BY code),
sig AS (SELECT *, (f1 IS NOT NULL)::INT+(f2 IS NOT NULL)::INT+(f3 IS NOT NULL)::INT+(f4 IS NOT NULL)::INT AS signal_count FROM g),
sg AS (SELECT *, CASE signal_count WHEN 4 THEN 'S+' WHEN 3 THEN 'A' WHEN 2 THEN 'B' WHEN 1 THEN 'C' ELSE 'N' END AS grade FROM sig),
scan AS (SELECT * FROM sg WHERE signal_count>=2 AND trade_date>=DATE '{AS_OF}'-{MAX_AGE})"""
FLAGS = ", ".join(f"f{i} IS NOT NULL AS s{i}" for i in range(1, 5))


def signals(s, d):
    return R.resonance_signals(I.panel(s, d))


def scanned(s, d):
    return R.resonance_scan(signals(s, d), AS_OF, MAX_AGE)


query("v13_resonance_signals", sql(f"""WITH {SIGNALS}
SELECT code, trade_date, {FLAGS}, signal_count, grade, f1.at AS limit_up_date, round(f1.a, 4) AS limit_up_volume_ratio, f1.b AS consolidation_days, f2.at AS gap_date, round(f2.a, 4) AS gap_size,
 f2.b AS days_since_gap, f3.a AS consecutive_days, f3.b AS start_date, f4.at AS breakout_date, round(f4.a, 4) AS breakout_volume_ratio, round(f4.b, 4) AS breakout_price FROM sg""", "bars"))(
    lambda s, d: rounded(signals(s, d)))

query("v13_resonance_scan", sql(f"WITH {SIGNALS} SELECT code, trade_date, {FLAGS}, signal_count, grade FROM scan", "bars"))(
    lambda s, d: scanned(s, d).select(CODE, DATE, "s1", "s2", "s3", "s4", "signal_count", "grade"))

query("m25_conservative_flow", sql(f"""WITH {SIGNALS},
b AS (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM bars),
l AS (SELECT * FROM b WHERE n>=20 AND volume>0 AND volume>={MIN_VOLUME} AND (close-open)/open<0.099::DOUBLE AND (close-open)/open>-0.099::DOUBLE AND left(code, 3) NOT IN ('688', '300', '430', '870')
 QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)=1),
m AS (SELECT l.code, l.trade_date, l.close, l.volume, coalesce(grade, 'N') AS grade, coalesce(signal_count, 0) AS signal_count FROM l LEFT JOIN scan ON l.code=scan.code)
SELECT code, trade_date, round(close, 4) AS close, volume, grade, signal_count,
 round(CASE grade WHEN 'S+' THEN 100 WHEN 'A' THEN 80 WHEN 'B' THEN 60 WHEN 'C' THEN 40 ELSE 20 END*0.6::DOUBLE+signal_count*4::DOUBLE, 4) AS conservative_score FROM m ORDER BY conservative_score DESC, code LIMIT 30""", "bars"))(
    lambda s, d: rounded(R.conservative_flow(I.panel(s, d), scanned(s, d), min_volume=MIN_VOLUME)))

query("m25_aggressive_flow", sql(f"""WITH {SIGNALS},
t AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY signal_count DESC, code) AS rn, count(*) OVER (PARTITION BY grade) AS n FROM scan)
SELECT code, trade_date, {FLAGS}, signal_count, grade, signal_count*25::DOUBLE AS score FROM t WHERE rn<=CASE grade WHEN 'S+' THEN n WHEN 'A' THEN greatest(1, n//2) ELSE greatest(1, n//5) END""", "bars"))(
    lambda s, d: R.aggressive_flow(scanned(s, d)).select(CODE, DATE, "s1", "s2", "s3", "s4", "signal_count", "grade", "score"))

PARTS = dict(zip(R.FLOW_SCORES, ("t01_ma_trend", "t02_macd", "t03_rsi", "t04_kdj", "t05_bollinger", "t07_cci", "t08_wr", "t06_atr", "v01_volume_ratio", "v02_turnover", "v06_mfi", "v05_obv", "v07_vr", "v04_vosc")))


def scored(bars):
    for add in (T.ma_trend, T.macd, T.rsi, T.kdj, T.bollinger, T.cci, T.wr, T.atr, V.volume_ratio, V.turnover, V.mfi, V.obv, V.vr, V.vosc):
        bars = add(bars)
    return bars


def balanced_sql() -> str:
    each = ", ".join(f"q{i} AS ({ORACLES[name]})" for i, name in enumerate(PARTS.values()))
    last = "(SELECT code, max(trade_date) AS trade_date FROM q0 GROUP BY code)"
    total = "+".join(f"q{i}.{column}::DOUBLE" for i, column in enumerate(PARTS))
    joins = " ".join(f"JOIN q{i} USING (code, trade_date)" for i in range(len(PARTS)))
    return f"WITH {each} SELECT code, trade_date, round({total}, 4) AS factor_score FROM {last} {joins} ORDER BY factor_score DESC, code LIMIT 30"


query("m25_balanced_flow", balanced_sql())(lambda s, d: rounded(R.balanced_flow(scored(I.panel(s, d))).select(CODE, DATE, "factor_score")))
