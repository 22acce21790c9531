"""Queries of the six limit-up scans and the hot-stock classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, latest_rows, rmean
from tidemark.operators import hot_stocks as H, limit_up_scans as L
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql

RISE, INFLOW, AS_OF, MAX_AGE = 3.0, 3e5, "1998-12-01", 200
P = "(PARTITION BY code ORDER BY trade_date"


def scans(s, d):
    b = I.bars(s, d)
    funds = latest_rows(I.flows(s, d), DATE, "main_net", "main_ratio").select(CODE, (F.col("main_net") * INFLOW).alias("main_net_inflow"), (F.col("main_ratio") / 100).alias("super_large_ratio"))
    day = latest_rows(b.withColumn("late_volume_ratio", F.col("volume") / rmean("volume", 5, min_rows=1)), DATE, "close", "low", "late_volume_ratio")
    intraday = day.select(CODE, ((F.col("close") - F.col("low")) / F.col("low") * 400).alias("late_change"), (F.col("late_volume_ratio") * 2).alias("late_volume_ratio"))
    sectors = L.sector_strength(I.snapshot(s, d)).withColumn("sector_change", F.col("sector_change") * 2)
    return L.limit_up_scans(b, sectors, funds, intraday, rise=RISE)


CHG = "(close-lag(close) OVER w)/lag(close) OVER w*100"
query("m20_limit_up_scans", sql(f"""
WITH st AS (SELECT industry, avg(CASE WHEN pct_chg>0 THEN 1.0::DOUBLE ELSE 0 END) AS heat, avg(pct_chg)*2 AS sector FROM snap WHERE pct_chg IS NOT NULL GROUP BY 1),
se AS (SELECT code, heat, sector FROM snap JOIN st USING (industry) WHERE pct_chg IS NOT NULL),
fu AS (SELECT code, main_net*{INFLOW}::DOUBLE AS inflow, main_ratio/100 AS large FROM flows QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)=1),
tr AS (SELECT code, (close-low)/low*400 AS late, volume/avg(volume) OVER {P} ROWS 4 PRECEDING)*2 AS busy FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)=1),
a AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)-1 AS back FROM bars),
b AS (SELECT *, {CHG} AS chg, count(*) OVER (PARTITION BY code) AS n FROM a WHERE back<30 WINDOW w AS {P})),
f AS (SELECT code, any_value(n) AS n, max(trade_date) AS trade_date, max(CASE WHEN back=0 THEN close END) AS c, max(CASE WHEN back=0 THEN chg END) AS chg, avg(close) FILTER (back<5) AS ma5, avg(volume) FILTER (back<3) AS v3, avg(volume) FILTER (back IN (3, 4)) AS pv,
 min(back) FILTER (back<10 AND chg>={RISE}) AS hit, coalesce(min(back) FILTER (back<10 AND coalesce(chg<{RISE}, true)), 10) AS boards, coalesce(max(CASE WHEN back=5 THEN close END), max_by(close, back)) AS old FROM b GROUP BY code),
g AS (SELECT f.*, (c-h.close)/h.close*100 AS pull, h.volume AS lv, (SELECT avg(volume) FROM b WHERE b.code=f.code AND back<least(5, f.n-boards)) AS rv, (SELECT avg(volume) FROM b WHERE b.code=f.code AND back>=least(5, f.n-boards) AND back<least(5, f.n-boards)+boards) AS pk,
 heat, sector, inflow, large, late, busy, (c-old)/old*100 AS five FROM f LEFT JOIN b h ON h.code=f.code AND h.back=f.hit LEFT JOIN se ON se.code=f.code LEFT JOIN fu ON fu.code=f.code LEFT JOIN tr ON tr.code=f.code),
r AS (
 SELECT code, trade_date, 'limitup_pullback' AS strategy, 60+CASE WHEN abs(pull)<5 THEN 15 ELSE 0 END+CASE WHEN lv>0 AND v3<lv*0.7::DOUBLE THEN 15 ELSE 0 END+CASE WHEN c>=ma5*0.98::DOUBLE THEN 10 ELSE 0 END AS raw FROM g WHERE n>=10 AND pull BETWEEN -8 AND 0 UNION ALL
 SELECT code, trade_date, 'dragon_head', 65+CASE WHEN boards>=3 THEN 15 ELSE 0 END+CASE WHEN pk>0 AND rv<pk*0.6::DOUBLE THEN 15 ELSE 0 END+CASE WHEN c>=ma5*0.97::DOUBLE THEN 5 ELSE 0 END FROM g WHERE n>=15 AND boards>=2 UNION ALL
 SELECT code, trade_date, 'relay_mode', 55+CASE WHEN heat>0.8::DOUBLE THEN 15 ELSE 0 END+CASE WHEN coalesce(v3/nullif(pv, 0), 1)>1.5::DOUBLE THEN 10 ELSE 0 END+CASE WHEN chg>5 THEN 10 ELSE 0 END FROM g WHERE n>=5 AND heat>=0.7::DOUBLE AND chg>=3 UNION ALL
 SELECT code, trade_date, 'theme_linkage', 50+CASE WHEN least(five/sector, 1)>0.7::DOUBLE THEN 20 ELSE 0 END+CASE WHEN sector>5 THEN 15 ELSE 0 END FROM g WHERE n>=5 AND sector>=3 UNION ALL
 SELECT code, trade_date, 'fund_resonance', 70+CASE WHEN inflow>100000000 THEN 15 ELSE 0 END+CASE WHEN large>0.5::DOUBLE THEN 10 ELSE 0 END+CASE WHEN n>=5 AND chg>3 THEN 5 ELSE 0 END FROM g WHERE inflow>=50000000 AND large>=0.3::DOUBLE UNION ALL
 SELECT code, trade_date, 'late_surge', 65+CASE WHEN late>7 THEN 15 ELSE 0 END+CASE WHEN busy>5 THEN 10 ELSE 0 END FROM g WHERE late>=5 AND busy>=3)
SELECT code, trade_date, strategy, least(raw, 100)::DOUBLE AS score, round(raw/100.0::DOUBLE, 4) AS confidence FROM r""", "snap", "flows"))(lambda s, d: rounded(scans(s, d)))

OUT = "close pct_change pct_5d pct_10d pct_20d vol_ratio amplitude limit_pct turnover_rate hot_score".split()
HOT = f"""
a AS (SELECT *, {', '.join(f'(close-lag(close, {k}) OVER w)/lag(close, {k}) OVER w*100 AS {n}' for n, k in H.CHANGES.items())}, CASE WHEN row_number() OVER w>=20 THEN volume/avg(volume) OVER {P} ROWS 19 PRECEDING) END AS vol_ratio, (high-low)/lag(close) OVER w*100 AS amplitude,
 avg(close) OVER {P} ROWS 4 PRECEDING) AS m5, avg(close) OVER {P} ROWS 9 PRECEDING) AS m10, avg(close) OVER {P} ROWS 19 PRECEDING) AS m20, turnover AS turnover_rate,
 CASE WHEN regexp_matches(code, '^(688|689|300|301)') THEN 20 WHEN regexp_matches(code, '^(4|8|92)') THEN 30 ELSE 10 END::DOUBLE AS limit_pct FROM bars WHERE trade_date<=DATE '{AS_OF}' WINDOW w AS {P})),
i AS (SELECT *, sum(CASE WHEN pct_change>=limit_pct*0.98::DOUBLE THEN 0 ELSE 1 END) OVER {P}) AS isle FROM a),
r AS (SELECT *, sum(CASE WHEN pct_change>=limit_pct*0.98::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY code, isle ORDER BY trade_date) AS run, close>m5 AND m5>m10 AND m10>m20 AS ma_bullish FROM i),
l AS (SELECT * FROM r WHERE pct_20d IS NOT NULL AND close>1.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC)=1),
h AS (SELECT l.*, name, CAST(run AS BIGINT) AS consecutive_limit_days, pct_change>=limit_pct*0.98::DOUBLE AND pct_change>0 AS is_limit_up, pct_5d>10 AND vol_ratio>1.5::DOUBLE AS is_hot, pct_20d>30 AS is_leading, vol_ratio>3 AND pct_change>5 AS is_breakout,
 greatest(pct_change, 0)*2+greatest(pct_5d, 0)*1.5::DOUBLE+greatest(pct_10d, 0)+greatest(pct_20d, 0)*0.5::DOUBLE+greatest(vol_ratio-1, 0)*5+CASE WHEN ma_bullish THEN 15 ELSE 0 END+CASE WHEN pct_change>=limit_pct*0.98::DOUBLE AND pct_change>0 THEN 30 ELSE 0 END
 +CASE WHEN pct_change>=limit_pct*0.99::DOUBLE THEN 50 ELSE 0 END+greatest(least(coalesce(turnover_rate, 0), 20), 0)*3+run*10 AS hot_score FROM l LEFT JOIN stocks USING (code)
 WHERE trade_date>=DATE '{AS_OF}'-{MAX_AGE} AND NOT regexp_matches(coalesce(name, ''), 'ST|退市') AND abs(pct_change)<=50)
SELECT code, trade_date, name, {', '.join(f'round({c}, 4) AS {c}' for c in OUT)}, ma_bullish, consecutive_limit_days, is_limit_up, is_hot, is_leading, is_breakout FROM h"""


def hot(s, d):
    return H.hot_stocks(I.bars(s, d), I.stocks(s, d), AS_OF, MAX_AGE)


query("m21_hot_stocks", sql("WITH " + HOT, "bars", "stocks"))(lambda s, d: rounded(hot(s, d)))
query("m21_top_hot", sql("WITH " + HOT + " ORDER BY h.hot_score DESC, code LIMIT 30", "bars", "stocks"))(lambda s, d: rounded(H.top_hot(hot(s, d))))
