"""Query of the swing signals."""

from __future__ import annotations

from tidemark.operators import swing as S
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql

FA, SA = "(2/13::DOUBLE)", "(2/27::DOUBLE)"
ROUNDED = ("close pct_chg ema5 ema10 ema20 ema60 ema120 price_vs_ema60 macd_dif macd_dea macd_hist pullback_pct volume_shrink_ratio trend_score pullback_score volume_score total_score "
           "confidence entry_price stop_loss target_price position_size").split()


def _line(n: int, a: str) -> str:
    return f"sum(CASE WHEN b.k<={n} THEN b.x/{n}*power(1-{a}, a.k-{n}) ELSE {a}*power(1-{a}, a.k-b.k)*b.x END)"


def macd_ctes(name: str, src: str) -> str:
    """``{name}(code, dif, dea)`` of ``src(code, k, n, x)``, ``k`` from the oldest on; codes of fewer than 35 values are left out."""
    return f"""{name}_d AS (SELECT a.code, a.k, a.n, {_line(12, FA)}-{_line(26, SA)} AS dif FROM {src} a JOIN {src} b ON a.code=b.code AND b.k<=a.k WHERE a.k>=26 AND a.n>=35 GROUP BY a.code, a.k, a.n),
{name} AS (SELECT code, max(CASE WHEN k=n THEN dif END) AS dif, sum(dif*power(0.8::DOUBLE, n-k)*CASE WHEN k=26 THEN 1 ELSE 0.2::DOUBLE END) AS dea FROM {name}_d GROUP BY code)"""


def _ema(n: int) -> str:
    return f"sum(close*power(1-2/{n + 1}::DOUBLE, n-k)*CASE WHEN k=1 THEN 1 ELSE 2/{n + 1}::DOUBLE END) AS ema{n}"


query("m24_swing_signals", sql(f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn, lag(volume) OVER (PARTITION BY code ORDER BY trade_date) AS pv, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS pc FROM bars),
w AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS k, count(*) OVER (PARTITION BY code) AS n, close AS x FROM s WHERE rn<=250),
w2 AS (SELECT * FROM w WHERE n>=120),
mc AS (SELECT code, date_trunc('month', trade_date) AS m, max_by(close, trade_date) AS x FROM w2 GROUP BY ALL),
mo AS (SELECT code, x, row_number() OVER (PARTITION BY code ORDER BY m) AS k, count(*) OVER (PARTITION BY code) AS n FROM mc), mp AS (SELECT code, x, k, n-1 AS n FROM mo WHERE k<n),
{macd_ctes('dm', 'w2')}, {macd_ctes('mm', 'mo')}, {macd_ctes('mq', 'mp')},
bu AS (SELECT code, min(rn)-1 AS back FROM w2 WHERE rn<=4 AND pv>0 AND volume/pv>2 GROUP BY code),
g AS (SELECT w2.code, max(trade_date) AS trade_date, max(CASE WHEN rn=1 THEN close END) AS close, max(CASE WHEN rn=1 THEN (close-pc)/pc*100 END) AS pct_chg, {', '.join(_ema(n) for n in (5, 10, 20, 60, 120))},
 max(bu.back) AS back, max(high) FILTER (rn<=bu.back+1) AS top, max(CASE WHEN rn=1 THEN high END) AS h, avg(volume) FILTER (rn<=5) AS v5, avg(volume) FILTER (rn<=bu.back) AS va, min(close) FILTER (rn<=5) AS low5, max(high) FILTER (rn=bu.back+1) AS burst_high
 FROM w2 LEFT JOIN bu USING (code) GROUP BY w2.code),
i AS (SELECT g.*, coalesce(dm.dif, 0) AS macd_dif, coalesce(dm.dea, 0) AS macd_dea, coalesce(mq.dif, 0)<=coalesce(mq.dea, 0) AND coalesce(mm.dif, 0)>coalesce(mm.dea, 0) AS macd_golden_cross, coalesce(mm.dif, 0)>0 AS macd_above_zero,
 back IS NOT NULL AS burst, CASE WHEN back>0 THEN (top-h)/top*100 ELSE 0 END AS pullback_pct, CASE WHEN back>0 THEN coalesce(v5/nullif(va, 0), 0) ELSE 0 END AS volume_shrink_ratio, low5 BETWEEN ema20*0.98::DOUBLE AND ema20*1.02::DOUBLE AS ema20_support,
 close>ema60 AND ema5>ema10 AND ema10>ema20 AS step1_passed FROM g LEFT JOIN dm USING (code) LEFT JOIN mm USING (code) LEFT JOIN mq USING (code)),
j AS (SELECT *, (close-ema60)/ema60*100 AS price_vs_ema60, (macd_dif-macd_dea)*2 AS macd_hist, CASE WHEN burst THEN pullback_pct BETWEEN 8 AND 15 AND volume_shrink_ratio<=0.5::DOUBLE ELSE ema20_support END AS step2_passed FROM i),
t AS (SELECT *, step1_passed AND step2_passed AS step3_passed, CASE WHEN step1_passed THEN 40+CASE WHEN ema20>ema60 THEN 10 ELSE 0 END+CASE WHEN macd_golden_cross THEN 20 WHEN macd_above_zero THEN 5 ELSE 0 END ELSE 0 END::DOUBLE AS trend_score,
 CASE WHEN step2_passed AND burst THEN 30+CASE WHEN pullback_pct BETWEEN 10 AND 12 THEN 5 ELSE 0 END+CASE WHEN volume_shrink_ratio<=0.3::DOUBLE THEN 5 ELSE 0 END WHEN step2_passed THEN 15 ELSE 0 END::DOUBLE AS pullback_score FROM j),
u AS (SELECT *, CASE WHEN step3_passed THEN 20 ELSE 0 END::DOUBLE AS volume_score FROM t),
v AS (SELECT *, trend_score+pullback_score+volume_score AS total_score, least(trend_score+pullback_score+volume_score, 100) AS confidence, CASE WHEN step3_passed THEN close ELSE 0 END AS entry_price, CASE WHEN step3_passed THEN close*0.97::DOUBLE ELSE 0 END AS stop_loss,
 CASE WHEN NOT step3_passed THEN 0 WHEN burst THEN burst_high ELSE close*1.08::DOUBLE END AS target_price, CASE WHEN step3_passed THEN 50 ELSE 0 END::DOUBLE AS position_size FROM u)
SELECT code, trade_date, {', '.join(f'round({c}, 4) AS {c}' for c in ROUNDED)}, macd_golden_cross, macd_above_zero, burst, ema20_support, step1_passed, step2_passed, step3_passed FROM v""", "bars"))(
    lambda s, d: rounded(S.swing_signals(I.bars(s, d))))
