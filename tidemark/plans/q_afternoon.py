"""Queries of the afternoon strategies: what each wants, the exclusive picks, the predicted ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, lag, with_runs
from tidemark.operators import afternoon as A
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql

RISE, BEST, MIN_DAYS, MIN_TURNOVER = 0.03, 2, 2, 0.02
P = "(PARTITION BY code ORDER BY trade_date"


def bars(s, d):
    return I.bars(s, d).withColumn("turnover_ratio", F.col("volume").cast("double") / 500.0)


def pool(s, d):
    """Bars that rose by ``RISE`` or more, with the length of the row of such bars."""
    b = bars(s, d).select(CODE, DATE, "close").withColumn("_p", lag("close"))
    b = with_runs(b.withColumn("_up", F.coalesce(F.col("close") >= F.col("_p") * (1 + RISE), F.lit(False))), "_up", "consecutive_days")
    return b.where("consecutive_days > 0").select(DATE, CODE, "consecutive_days")


def _avg(x: str, n: int) -> str:
    return f"avg({x}) OVER {P} ROWS {n - 1} PRECEDING)"


WANTED = f"""
a AS (SELECT code, trade_date, open, close, volume::DOUBLE/500 AS t, amount, lag(close) OVER {P}) AS pc, row_number() OVER {P}) AS k, volume/{_avg('volume', 20)} AS vr, {_avg('close', 5)} AS m5, {_avg('close', 10)} AS m10, {_avg('close', 20)} AS m20,
 (amount-{_avg('amount', 20)})/{_avg('amount', 20)} AS inflow, max(high) OVER {P} ROWS 39 PRECEDING) AS h40 FROM bars),
u AS (SELECT *, coalesce(close>=pc*1.03::DOUBLE, false) AS up, coalesce((close-pc)/pc*100, 0) AS chg, (h40-close)/h40 AS down FROM a),
i AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER {P}) AS isle FROM u),
d AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY code, isle ORDER BY trade_date) AS days FROM i),
e AS (SELECT *, (CASE WHEN chg>=9.9::DOUBLE THEN 100 WHEN chg>=7 THEN 80+(chg-7)*10 WHEN chg>=5 THEN 50+(chg-5)*15 ELSE chg*10 END)*0.35::DOUBLE
 +(least(vr*30, 80)+CASE WHEN t*100 BETWEEN 3 AND 10 THEN 100 WHEN t*100>10 THEN greatest(0, 100-(t*100-10)*5) ELSE 0 END)/2*0.25::DOUBLE+50*0.2::DOUBLE+50*0.2::DOUBLE AS probability FROM d WHERE up),
c AS (
 SELECT code, trade_date, probability, 0 AS priority, 'limitup_callback' AS strategy, 0.8::DOUBLE AS confidence, 0.8::DOUBLE AS ranked_by, close AS entry_price, m20*0.97::DOUBLE AS stoploss_price, close*1.1::DOUBLE AS take_profit_1, close*1.2::DOUBLE AS take_profit_2
 FROM e WHERE k>=20 AND days<=3 AND t<=0.15::DOUBLE AND close BETWEEN m20*0.98::DOUBLE AND m20*1.02::DOUBLE AND close>open AND vr>1.5::DOUBLE UNION ALL
 SELECT code, trade_date, probability, 1, 'dragon_head', 0.75::DOUBLE+(down-0.05::DOUBLE)*2, 0.75::DOUBLE+(down-0.05::DOUBLE)*2, close, close*0.93::DOUBLE, close*1.1::DOUBLE, close*1.2::DOUBLE
 FROM e WHERE k>=30 AND days>={MIN_DAYS} AND down BETWEEN 0.05::DOUBLE AND 0.15::DOUBLE AND m5>m10 AND close>m5 UNION ALL
 SELECT code, trade_date, probability, 2, 'tail_rush', 0.65::DOUBLE, vr, close*1.02::DOUBLE, close*0.95::DOUBLE, close*1.05::DOUBLE, close*1.1::DOUBLE FROM e WHERE k>=20 AND t>={MIN_TURNOVER}::DOUBLE AND vr>=1.5::DOUBLE UNION ALL
 SELECT code, trade_date, probability, 3, 'fund_resonance', 0.7::DOUBLE, inflow, close*1.02::DOUBLE, m20*0.98::DOUBLE, close*1.08::DOUBLE, close*1.15::DOUBLE FROM e WHERE k>=20 AND t>={MIN_TURNOVER}::DOUBLE AND close>m20 AND inflow>=0.1::DOUBLE)"""
COLUMNS = "code, trade_date, priority, strategy, " + ", ".join(f"round({c}, 4) AS {c}" for c in "probability confidence ranked_by entry_price stoploss_price take_profit_1 take_profit_2".split())


def picked(i: int) -> str:
    taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM p{j} WHERE p{j}.code=c.code AND p{j}.trade_date=c.trade_date)" for j in range(i))
    return f"p{i} AS (SELECT * FROM c WHERE priority={i}{taken} QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY ranked_by DESC, code)<={BEST})"


LIMITS = {"min_days": MIN_DAYS, "min_turnover": MIN_TURNOVER}
query("m39_afternoon_wanted", sql(f"WITH {WANTED} SELECT {COLUMNS} FROM c", "bars"))(
    lambda s, d: rounded(A.wanted(pool(s, d), bars(s, d), **LIMITS)))
query("m39_afternoon_picks", sql(f"WITH {WANTED}, {', '.join(picked(i) for i in range(4))} SELECT {COLUMNS} FROM ({' UNION ALL '.join(f'SELECT * FROM p{i}' for i in range(4))})", "bars"))(
    lambda s, d: rounded(A.afternoon_picks(pool(s, d), bars(s, d), best=BEST, **LIMITS).drop("rank")))
query("m39_predicted_picks", sql(f"""WITH {WANTED} SELECT code, trade_date, round(probability, 4) AS probability, round(close, 4) AS entry_price, round(close*0.95::DOUBLE, 4) AS stoploss_price, round(close*1.1::DOUBLE, 4) AS take_profit_1, round(close*1.2::DOUBLE, 4) AS take_profit_2
FROM e WHERE k>=10 AND probability>=60""", "bars"))(lambda s, d: rounded(A.predicted_picks(pool(s, d), bars(s, d))))
