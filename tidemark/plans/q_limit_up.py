"""Query of the limit-up score and probability."""

from __future__ import annotations

from tidemark.operators import limit_up as L
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql

P = "(PARTITION BY code ORDER BY trade_date"
FA, SL, SG = "(2/(least(12, a.n//3)+1)::DOUBLE)", "(2/(least(26, a.n//2)+1)::DOUBLE)", "(2/(least(9, n//4)+1)::DOUBLE)"
LAST = "max(CASE WHEN rn={0} THEN close END)"
POINTS = ", ".join(f"({a}, {b}::DOUBLE)" for a, b in L.PROBABILITY)

query("m23_limit_up_probability", sql(f"""
WITH s AS (SELECT *, close-lag(close) OVER {P}) AS d, ln(close)-ln(lag(close) OVER {P}) ) AS lr, max(high) OVER {P} ROWS 8 PRECEDING) AS h9, min(low) OVER {P} ROWS 8 PRECEDING) AS l9, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM bars),
w AS (SELECT *, row_number() OVER {P}) AS k, count(*) OVER (PARTITION BY code) AS n, CASE WHEN h9=l9 THEN 50 ELSE (close-l9)/(h9-l9)*100 END AS rsv FROM s WHERE rn<=120),
e AS (SELECT a.code, a.k, a.n, sum(b.close*power(1-{FA}, a.k-b.k)*CASE WHEN b.k=1 THEN 1 ELSE {FA} END)-sum(b.close*power(1-{SL}, a.k-b.k)*CASE WHEN b.k=1 THEN 1 ELSE {SL} END) AS dif,
 sum(CASE WHEN b.k>=9 THEN b.rsv*power(2/3::DOUBLE, a.k-b.k)/3 ELSE 0 END)+50*power(2/3::DOUBLE, a.k-8) AS kk FROM w a JOIN w b ON a.code=b.code AND b.k<=a.k WHERE a.n>=30 GROUP BY a.code, a.k, a.n),
m AS (SELECT code, max(CASE WHEN k=n THEN dif END) AS line, sum(CASE WHEN k>1 THEN dif*power(1-{SG}, n-k)*{SG} ELSE 0 END) AS sig, max(CASE WHEN k=n THEN kk END) AS kd,
 sum(CASE WHEN k>=11 THEN kk*power(2/3::DOUBLE, n-k)/3 ELSE 0 END)+50*power(2/3::DOUBLE, max(n)-10) AS dd FROM e GROUP BY 1),
g AS (SELECT code, max(trade_date) AS trade_date, {LAST.format(1)} AS p, avg(close) FILTER (rn<=5) AS m5, avg(close) FILTER (rn<=10) AS m10, avg(close) FILTER (rn<=20) AS m20, avg(close) FILTER (rn<=60) AS m60,
 avg(greatest(d,0)) FILTER (rn<=6) AS gn, avg(greatest(-d,0)) FILTER (rn<=6) AS ls, avg(close) FILTER (rn<=least(20,n//2)) AS bm, stddev_pop(close) FILTER (rn<=least(20,n//2)) AS bs,
 (max(CASE WHEN rn=1 THEN volume END)/avg(volume) FILTER (rn<=5)-1)*100 AS ratio, count(*) FILTER (rn<=4 AND d*volume<0) AS dn, count(*) FILTER (rn<=4 AND d*volume>0) AS un,
 ({LAST.format(1)}/{LAST.format(6)}-1)*100 AS f, ({LAST.format(1)}/{LAST.format(11)}-1)*100 AS t, stddev_pop(lr) FILTER (rn<=20)*sqrt(252)*100 AS vol FROM w WHERE n>=30 GROUP BY code),
i AS (SELECT *, CASE WHEN ls=0 THEN 100 ELSE 100-100/(1+gn/ls) END AS r, line-sig AS hist, 3*kd-2*dd AS j, CASE WHEN bs>0 THEN (p-bm+2*bs)/(4*bs) ELSE 0.5 END AS pos FROM g JOIN m USING (code)),
o AS (SELECT *, CASE WHEN m5>m10 AND m10>m20 AND m20>m60 AND p>m5*1.02::DOUBLE THEN 15 WHEN m5>m10 AND m10>m20 AND m20>m60 AND p>m5 THEN 13 WHEN m5>m10 AND m10>m20 AND p>m5 THEN 10 WHEN m5>m10 AND p>m5*1.01::DOUBLE THEN 7 WHEN m5>m10 THEN 5 WHEN p>m20 THEN 3 ELSE 1 END AS s1,
 CASE WHEN r=0 THEN 0 WHEN r BETWEEN 58 AND 65 THEN 15 WHEN r>65 AND r<=72 THEN 12 WHEN r>=50 AND r<58 THEN 9 WHEN r>72 AND r<=80 THEN 8 WHEN r>=40 AND r<50 THEN 5 WHEN r<30 THEN 3 ELSE 2 END AS s2,
 CASE WHEN hist>0 AND line>0 AND hist>sig*0.1::DOUBLE THEN 15 WHEN hist>0 AND line>0 THEN 12 WHEN hist>0 THEN 9 WHEN abs(hist)<0.001 THEN 2 ELSE 0 END AS s3,
 CASE WHEN kd=0 THEN 0 WHEN kd BETWEEN 55 AND 68 AND kd>dd AND j>kd THEN 10 WHEN kd BETWEEN 55 AND 70 AND kd>dd THEN 8 WHEN kd BETWEEN 50 AND 65 THEN 6 WHEN kd>dd AND kd>45 THEN 5 WHEN kd BETWEEN 30 AND 50 THEN 3 WHEN kd<20 THEN 2 ELSE 1 END AS s4,
 CASE WHEN pos>=0.9 THEN 10 WHEN pos>=0.8 THEN 8 WHEN pos>=0.65 THEN 6 WHEN pos>=0.5 THEN 4 WHEN pos>=0.35 THEN 2 ELSE 0 END AS s5,
 greatest(least(CASE WHEN ratio>200 THEN 18 WHEN ratio>150 THEN 15 WHEN ratio>100 THEN 12 WHEN ratio>50 THEN 8 WHEN ratio>20 THEN 5 WHEN ratio>0 THEN 3 ELSE 0 END+CASE WHEN dn=0 THEN 2 WHEN un=0 THEN -3 ELSE 0 END,20),0) AS s6,
 greatest(least(CASE WHEN f>15 THEN 12 WHEN f>10 THEN 10 WHEN f>5 THEN 7 WHEN f>2 THEN 4 WHEN f>0 THEN 2 ELSE 0 END+CASE WHEN t>10 THEN 3 WHEN t>5 THEN 2 WHEN t>2 THEN 1 ELSE 0 END-CASE WHEN vol>70 THEN 3 WHEN vol>50 THEN 1 WHEN vol<10 THEN 2 ELSE 0 END,15),0) AS s7 FROM i),
z AS (SELECT *, CAST(s1+s2+s3+s4+s5+s6+s7 AS DOUBLE) AS total FROM o),
pt(x, y) AS (VALUES {POINTS}), sg AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM pt)
SELECT code, trade_date, round(line,4) AS macd, round(sig,4) AS macd_signal, round(kd,4) AS kdj_k, round(dd,4) AS kdj_d, round(r,4) AS rsi6, round(pos,4) AS bb_position, round(vol,4) AS volatility, s1::DOUBLE AS ma_score, s2::DOUBLE AS rsi_score, s3::DOUBLE AS macd_score, s4::DOUBLE AS kdj_score,
 s5::DOUBLE AS boll_score, s6::DOUBLE AS volume_score, s7::DOUBLE AS momentum_score, total AS total_score, round(CASE WHEN x1 IS NULL THEN y ELSE y+(total-x)/(x1-x)*(y1-y) END,2) AS probability FROM z JOIN sg ON total>=x AND (total<x1 OR x1 IS NULL)""", "bars"))(
    lambda s, d: rounded(L.limit_up_score(L.limit_up_indicators(I.bars(s, d))).select(
        "code", "trade_date", "macd", "macd_signal", "kdj_k", "kdj_d", "rsi6", "bb_position", "volatility", *L.PARTS, "total_score", "probability"), 4))
