"""Tracking, performance and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import lag, lead
from tidemark.operators import market as M
from tidemark.operators import risk as Q
from tidemark.operators import tracking as R
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import lagx
from tidemark.sources.bars import with_change


def picks(s, d):
    """Newest announcements' codes on their next bar: picks that have a bar on the pick date."""
    return I.bars(s, d).where("volume >= 40").select("code", F.col("trade_date").alias("pick_date"))


PK = "pk AS (SELECT code, trade_date AS pick_date FROM bars WHERE volume>=40), dy AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS dn FROM (SELECT DISTINCT trade_date FROM bars)), bd AS (SELECT b.*, dn FROM bars b JOIN dy USING (trade_date))"
query("r01_multi_period", sql(f"WITH {PK}, s AS (SELECT pk.code, pick_date, dn, close AS c0 FROM pk JOIN bd ON bd.code=pk.code AND bd.trade_date=pick_date), j AS (SELECT s.code, s.pick_date, s.c0, b.dn-s.dn AS k, b.close, b.high, b.low FROM s LEFT JOIN bd b ON b.code=s.code AND b.dn>s.dn AND b.dn<=s.dn+21) SELECT code, pick_date, " + ", ".join(
    f"round((arg_max(close,k) FILTER (WHERE k<={n})-any_value(c0))/any_value(c0)*100,4) AS day{n}_return, round((max(high) FILTER (WHERE k<={n})-any_value(c0))/any_value(c0)*100,4) AS day{n}_max_gain, round((min(low) FILTER (WHERE k<={n})-any_value(c0))/any_value(c0)*100,4) AS day{n}_max_drawdown" for n in R.PERIODS) + " FROM j GROUP BY code, pick_date", "bars"))(
    lambda s, d: rounded(R.multi_period(picks(s, d), I.bars(s, d))))


def tracked_picks(s, d):
    b = I.bars(s, d).where("volume >= 40")
    return b.select(F.concat("code", F.lit("-"), F.col("trade_date").cast("string")).alias("pick_id"), "code", F.col("trade_date").alias("pick_date"),
                    F.col("close").alias("price"), F.lit(10.0).alias("take_profit"), F.lit(-7.0).alias("stop_loss"))


#: Within the panel, so that some picks are still open.
AS_OF = "2000-06-15"
TR = f"""tp AS (SELECT code || '-' || CAST(trade_date AS VARCHAR) AS pick_id, code, trade_date AS pick_date, close AS price FROM bars WHERE volume>=40 AND trade_date<=DATE '{AS_OF}'),
tj AS (SELECT p.*, b.trade_date-p.pick_date AS dd, (b.close-price)/price*100 AS pr FROM tp p LEFT JOIN bars b ON b.code=p.code AND b.trade_date>p.pick_date AND b.trade_date<=p.pick_date+30 AND b.trade_date<=DATE '{AS_OF}'),
ts AS (SELECT pick_id, min(CASE WHEN pr>=10 OR pr<=-7 THEN dd END) AS sd FROM tj GROUP BY 1), tk AS (SELECT tj.*, sd FROM tj JOIN ts USING (pick_id) WHERE sd IS NULL OR dd<=sd),
t0 AS (SELECT pick_id, code, pick_date, max(sd) AS stop_day, arg_max(pr,dd) AS lastp, max(pr) AS hi, min(pr) AS lo, first(dd ORDER BY pr DESC, dd) AS hd, first(dd ORDER BY pr, dd) AS ld FROM tk GROUP BY ALL),
t1 AS (SELECT *, CASE WHEN stop_day IS NOT NULL THEN 'stopped' WHEN DATE '{AS_OF}'-pick_date>=30 THEN 'completed' ELSE 'tracking' END AS status FROM t0),
tr AS (SELECT pick_id, code, pick_date, status, CASE WHEN status='completed' THEN 'expired' WHEN status='stopped' AND lastp>=10 THEN 'profit_triggered' WHEN status='stopped' THEN 'loss_triggered' END AS stop_reason, stop_day,
 CASE WHEN status<>'tracking' THEN lastp END AS final_profit, greatest(coalesce(hi,0),0) AS max_profit, CASE WHEN hi>0 THEN hd END AS best_day, least(coalesce(lo,0),0) AS max_loss, CASE WHEN lo<0 THEN ld END AS worst_day FROM t1)"""
query("r02_tracking", sql(f"WITH {TR} SELECT pick_id, code, pick_date, status, stop_reason, stop_day, round(final_profit,4) AS final_profit, round(max_profit,4) AS max_profit, best_day, round(max_loss,4) AS max_loss, worst_day FROM tr", "bars"))(
    lambda s, d: rounded(R.track(tracked_picks(s, d), I.bars(s, d), AS_OF)))
query("r03_outcome_statistics", sql(f"""WITH {TR} SELECT pick_date, count(*) AS n, count(CASE WHEN final_profit>0 THEN 1 END) AS wins, round(count(CASE WHEN final_profit>0 THEN 1 END)/nullif(count(final_profit),0)::DOUBLE,4) AS win_rate,
 round(avg(final_profit),4) AS avg_profit, round(max(final_profit),4) AS best, round(min(final_profit),4) AS worst, count(CASE WHEN stop_reason='profit_triggered' THEN 1 END) AS n_take_profit, count(CASE WHEN stop_reason='loss_triggered' THEN 1 END) AS n_stop_loss FROM tr GROUP BY 1""", "bars"))(
    lambda s, d: rounded(R.outcome_statistics(R.track(tracked_picks(s, d), I.bars(s, d), AS_OF), "pick_date")))
query("r05_next_day", sql("WITH n AS (SELECT code, trade_date, volume, lead(close) OVER (PARTITION BY code ORDER BY trade_date)/close-1 AS r FROM bars) SELECT trade_date AS pick_date, count(*) AS n, round(avg(r),6) AS avg_return, round(avg(CASE WHEN r>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS win_rate, round(max(r),6) AS best, round(min(r),6) AS worst FROM n WHERE volume>=40 AND r IS NOT NULL GROUP BY 1", "bars"))(
    lambda s, d: rounded(R.next_day_performance(picks(s, d), I.bars(s, d)), 6))
query("r07_rebalance_dates", sql("SELECT min(trade_date) AS trade_date FROM bars GROUP BY date_trunc('month', trade_date)", "bars"))(lambda s, d: R.rebalance_dates(I.bars(s, d)))


def scored(s, d):
    return I.bars(s, d).withColumn("score", F.col("close") / lag("close", 10) - 1)


query("r06_cohort_backtest", sql(f"""WITH x AS (SELECT *, close/{lagx('close', 10)}-1 AS score, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS n FROM bars), rb AS (SELECT min(trade_date) AS trade_date FROM bars GROUP BY date_trunc('month', trade_date)),
e AS (SELECT a.code, a.trade_date, a.close, a.score, a.n, count(b.n) AS nb, min(CASE WHEN b.close/a.close-1<=-0.05 OR b.close/a.close-1>=0.10 THEN b.n END) AS hn, arg_max(b.close,b.n) AS lastc FROM x a JOIN rb USING (trade_date) JOIN x b ON b.code=a.code AND b.n>a.n AND b.n<=a.n+5 WHERE a.volume>0 AND NOT (a.high=a.low AND a.high>a.open*1.095) AND a.score IS NOT NULL GROUP BY ALL HAVING count(b.n)=5),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code)<=10), z AS (SELECT k.*, CASE WHEN hn IS NULL THEN lastc WHEN h.close/k.close-1<=-0.05 THEN h.low ELSE h.high END AS ep FROM k LEFT JOIN x h ON h.code=k.code AND h.n=k.hn),
g AS (SELECT trade_date, count(*) AS n, avg(ep/close-1-0.001*(1+ep/close)) AS pr FROM z GROUP BY 1) SELECT trade_date, n, round(pr,6) AS period_return, round(exp(sum(ln(1+pr)) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),4) AS equity FROM g""", "bars"))(
    lambda s, d: R.cohort_backtest(scored(s, d), R.rebalance_dates(I.bars(s, d))).select("trade_date", "n", F.round("period_return", 6).alias("period_return"), F.round("equity", 4).alias("equity")))


def rets(s, d):
    return I.bars(s, d).withColumn("ret", F.col("close") / lag("close") - 1)


RT = f"rt AS (SELECT *, close/{lagx('close')}-1 AS r FROM bars)"
query("r08_r09_return_statistics", sql(f"""WITH {RT}, a AS (SELECT *, sum(ln(1+r)) OVER (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS l FROM rt WHERE r IS NOT NULL), b AS (SELECT *, greatest(max(l) OVER (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING),0) AS m FROM a)
SELECT code, count(*) AS n, round(exp(sum(ln(1+r)))-1,6) AS total_return, round(avg(r)*sqrt(252)/stddev_pop(r),4) AS sharpe, round(avg(r)*sqrt(252)/stddev_pop(CASE WHEN r<0 THEN r END),4) AS sortino, round(min(exp(l-m)-1),6) AS max_drawdown, round(avg(CASE WHEN r>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS win_rate,
 round(avg(CASE WHEN r>0 THEN r END)/abs(avg(CASE WHEN r<0 THEN r END)),6) AS profit_loss_ratio FROM b GROUP BY 1""", "bars"))(
    lambda s, d: R.return_statistics(rets(s, d)).select("code", "n", *[F.round(c, k).alias(c) for c, k in (("total_return", 6), ("sharpe", 4), ("sortino", 4), ("max_drawdown", 6), ("win_rate", 6), ("profit_loss_ratio", 6))]))
query("r10_stock_vs_index", sql(f"""WITH {RT}, ix AS (SELECT trade_date, avg(close) AS c FROM bars GROUP BY 1), ir AS (SELECT trade_date, c/lag(c) OVER (ORDER BY trade_date)-1 AS ri FROM ix), x AS (SELECT code, sum(r) AS a, sum(ri) AS b, corr(r,ri) AS c FROM rt JOIN ir USING (trade_date) WHERE r IS NOT NULL AND ri IS NOT NULL GROUP BY 1)
SELECT code, round(c,6) AS corr, round(a,6) AS stock_return, round(a-b,6) AS excess, CASE WHEN a-b>0 THEN 'outperform' ELSE 'underperform' END AS label FROM x""", "bars"))(
    lambda s, d: rounded(R.stock_vs_index(I.bars(s, d)).select("code", "corr", "stock_return", "excess", "label"), 6))
query("r11_q03_correlation_pairs", sql(f"""WITH {RT}, r0 AS (SELECT code, trade_date, r FROM rt WHERE r IS NOT NULL), nd AS (SELECT count(DISTINCT trade_date) AS n FROM r0), cv AS (SELECT code, sum(r) AS s, sum(r*r) AS q FROM r0 GROUP BY 1 HAVING count(*)>=0.21*(SELECT n FROM nd)),
pr AS (SELECT a.code AS code_a, b.code AS code_b, a.s AS sa, a.q AS qa, b.s AS sb, b.q AS qb FROM cv a JOIN cv b ON a.code<b.code), xy AS (SELECT x.code AS code_a, y.code AS code_b, sum(x.r*y.r) AS p FROM r0 x JOIN r0 y ON x.trade_date=y.trade_date AND x.code<y.code GROUP BY ALL)
SELECT code_a, code_b, round((coalesce(p,0)-sa*sb/n)/sqrt((qa-sa*sa/n)*(qb-sb*sb/n)),6) AS corr FROM pr LEFT JOIN xy USING (code_a, code_b), nd""", "bars"))(
    lambda s, d: rounded(R.correlation_pairs(I.bars(s, d), 0.21, 30), 6))
query("r15_seat_pattern", sql("WITH g AS (SELECT code, trade_date, sum(CASE WHEN is_institution THEN net_buy_amount ELSE 0 END) AS a, sum(CASE WHEN NOT is_institution THEN net_buy_amount ELSE 0 END) AS b, count(CASE WHEN is_institution THEN 1 END) AS institution_seats, count(DISTINCT broker_name) AS seats FROM seats GROUP BY ALL) SELECT code, trade_date, round(a,4) AS institution_net, round(b,4) AS retail_net, institution_seats, seats, CASE WHEN a>0 AND b>0 THEN 'joint_buy' WHEN a>0 THEN 'institution_buy' WHEN b>0 THEN 'hot_money_buy' ELSE 'sell' END AS pattern FROM g", "seats"))(
    lambda s, d: rounded(R.seat_pattern(I.seats(s, d))))
query("r16_flow_summary", sql("""WITH d AS (SELECT trade_date, sum(main_net) AS t, count(CASE WHEN main_net>0 THEN 1 END) AS n_in, count(CASE WHEN main_net<0 THEN 1 END) AS n_out FROM flows GROUP BY 1), a AS (SELECT trade_date, string_agg(code, ',' ORDER BY k) AS top_in FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY main_net DESC, code) AS k FROM flows) WHERE k<=5 GROUP BY 1),
b AS (SELECT trade_date, string_agg(code, ',' ORDER BY k) AS top_out FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY main_net, code) AS k FROM flows) WHERE k<=5 GROUP BY 1) SELECT trade_date, round(t,4) AS total_net, n_in, n_out, top_in, top_out FROM d JOIN a USING (trade_date) JOIN b USING (trade_date)""", "flows"))(
    lambda s, d: rounded(R.flow_summary(I.flows(s, d))))
query("r20_market_summary", sql("SELECT trade_date, count(*) AS n, count(CASE WHEN pct_chg>0.5 THEN 1 END) AS rising, count(CASE WHEN pct_chg<-0.5 THEN 1 END) AS falling, count(CASE WHEN abs(pct_chg)<=0.5 THEN 1 END) AS flat, count(CASE WHEN pct_chg>=9.9 THEN 1 END) AS limit_up, count(CASE WHEN pct_chg<=-9.9 THEN 1 END) AS limit_down, round(sum(amount),2) AS amount, round(count(pct_chg)/count(*)::DOUBLE,4) AS completeness FROM chg GROUP BY 1", "chg"))(
    lambda s, d: R.market_summary(with_change(I.bars(s, d))).withColumns({"amount": F.round("amount", 2), "completeness": F.round("completeness", 4)}))
query("r17_period_rollup", None)(lambda s, d: rounded(R.period_rollup(M.market_state(M.cost_peak(with_change(I.bars(s, d))), ("000003",)))))
query("q01_var_cvar", sql(f"WITH {RT}, v AS (SELECT code, quantile_cont(r,0.05) AS var FROM rt WHERE r IS NOT NULL GROUP BY 1) SELECT v.code, round(var,6) AS var, round(avg(CASE WHEN r<=var THEN r END),6) AS cvar FROM v JOIN rt USING (code) GROUP BY v.code, var", "bars"))(
    lambda s, d: rounded(Q.value_at_risk(rets(s, d)), 6))
query("q02_drawdown_position", sql("WITH x AS (SELECT *, close/max(close) OVER (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING)-1 AS d FROM bars) SELECT code, round(min(d),6) AS max_drawdown, arg_min(trade_date, d) AS trough_date FROM x GROUP BY 1", "bars"))(
    lambda s, d: rounded(Q.drawdown_position(I.bars(s, d), "close"), 6))
AS = ["000001", "000002", "000003", "000004"]
query("q04_risk_contribution", None)(lambda s, d: rounded(Q.risk_contribution(Q.covariance(rets(s, d), AS), I.stocks(s, d).where(F.col("code").isin(*AS)).select("code", F.lit(0.25).alias("weight"))), 6))
query("q05_position_limits", sql("WITH t AS (SELECT code, abs(acctbal) AS value, abs(acctbal)/sum(abs(acctbal)) OVER () AS w FROM stocks) SELECT code, value, round(w,6) AS weight, w>0.015 AS over_limit, CASE WHEN w<0.005 THEN 'low' WHEN w<0.012 THEN 'medium' ELSE 'high' END AS risk_level FROM t", "stocks"))(
    lambda s, d: rounded(Q.position_limits(I.stocks(s, d).select("code", F.abs("acctbal").alias("value")), 0.015, (0.005, 0.012)), 6))
query("q06_stress", sql("WITH p AS (SELECT abs(acctbal) AS v, grade_no/5 AS b FROM stocks), s AS (SELECT * FROM (VALUES ('crash',-0.2::DOUBLE),('dip',-0.05::DOUBLE),('rally',0.1::DOUBLE)) t(scenario, shock)) SELECT scenario, shock, round(sum(v),2) AS value, round(sum(v*(1+shock*b)),3) AS stressed_value FROM p, s GROUP BY ALL", "stocks"))(
    lambda s, d: Q.stress(I.stocks(s, d).select(F.abs("acctbal").alias("value"), (F.col("grade_no") / 5).alias("beta")), {"crash": -0.2, "dip": -0.05, "rally": 0.1}).select("scenario", "shock", F.round("value", 2).alias("value"), F.round("stressed_value", 3).alias("stressed_value")))


def flow_picks(s, d):
    e = I.events_table(s, d)
    return e.select(F.col("kind").alias("flow"), "code", F.col("publish_date").alias("pick_date")).distinct()


query("r04_flow_performance", sql("""WITH p AS (SELECT DISTINCT kind AS flow, code, publish_date AS pick_date FROM ev), e AS (SELECT p.flow, p.code, p.pick_date, min(b.trade_date) AS ed FROM p LEFT JOIN bars b ON b.code=p.code AND b.trade_date>=p.pick_date GROUP BY ALL),
x AS (SELECT p.flow, p.code, p.pick_date, min(b.trade_date) AS xd FROM p LEFT JOIN bars b ON b.code=p.code AND b.trade_date>=p.pick_date+10 GROUP BY ALL), l AS (SELECT code, max(trade_date) AS ld FROM bars GROUP BY 1),
r AS (SELECT e.flow, xd IS NULL AS o, (b2.close-b1.close)/b1.close*100 AS r FROM e JOIN x USING (flow, code, pick_date) LEFT JOIN l ON l.code=e.code LEFT JOIN bars b1 ON b1.code=e.code AND b1.trade_date=ed LEFT JOIN bars b2 ON b2.code=e.code AND b2.trade_date=coalesce(xd,ld))
SELECT flow, count(*) AS positions, count(CASE WHEN o THEN 1 END) AS open, round(avg(r),6) AS avg_return, round(count(CASE WHEN r>0 THEN 1 END)/count(r)::DOUBLE,6) AS win_rate, round(max(r),6) AS best, round(min(r),6) AS worst FROM r GROUP BY 1""", "ev", "bars"))(
    lambda s, d: rounded(R.flow_performance(flow_picks(s, d), I.bars(s, d)), 6))


def trades(s, d):
    b = I.bars(s, d)
    x = b.select("code", F.col("trade_date").alias("entry_date"), lead("trade_date", 5).alias("exit_date"), ((lead("close", 5) / F.col("close") - 1) * 100).alias("pnl_pct"),
                 F.pmod("volume", F.lit(100)).cast("double").alias("selection_score"))
    return x.where("exit_date is not null")


query("r14_attribution", sql("""WITH ix AS (SELECT trade_date, avg(close) AS c FROM bars GROUP BY 1), t AS (SELECT code, trade_date AS entry_date, lead(trade_date,5) OVER w AS exit_date, (lead(close,5) OVER w/close-1)*100 AS pnl, volume%100 AS sc FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
m AS (SELECT t.*, (b.c/a.c-1)*100 AS mp FROM t JOIN ix a ON a.trade_date=entry_date JOIN ix b ON b.trade_date=exit_date WHERE exit_date IS NOT NULL), p AS (SELECT *, (pnl-mp)*sc/100 AS sp, pnl-mp-(pnl-mp)*sc/100 AS tp FROM m)
SELECT code, entry_date, round(mp,6) AS market_part, round(sp,6) AS selection_part, round(tp,6) AS timing_part FROM p""", "bars"))(
    lambda s, d: rounded(R.attribution(trades(s, d), I.bars(s, d).groupBy("trade_date").agg(F.avg("close").alias("index_close"))).select(
        "code", "entry_date", "market_part", "selection_part", "timing_part"), 6))
query("r19_performance_grade", sql("WITH a AS (SELECT code, avg(pct_chg) AS m FROM chg GROUP BY 1) SELECT code, CASE WHEN m>5 THEN 'excellent' WHEN m>2 THEN 'good' WHEN m>0 THEN 'fair' ELSE 'poor' END AS grade FROM a", "chg"))(
    lambda s, d: R.performance_grade(with_change(I.bars(s, d)).groupBy("code").agg(F.avg("pct_chg").alias("m")), "m").select("code", "grade"))
