"""Quality, audit and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as D
from tidemark.operators import text as X
from tidemark.operators.evaluate import materialize
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import lagx
from tidemark.sources.bars import with_change

query("d01_d02_bar_suite", sql("""WITH r AS (SELECT count(*) AS n, count(close) AS nc, count(CASE WHEN close BETWEEN 22 AND 30 THEN 1 END) AS nb, count(CASE WHEN high>=greatest(open,close) AND low<=least(open,close) THEN 1 END) AS no FROM bars)
SELECT 'between(close)' AS expectation, n AS tested, nb AS passed FROM r UNION ALL SELECT 'not_null(close)', n, nc FROM r UNION ALL SELECT 'ohlc', n, no FROM r UNION ALL SELECT 'unique(code,trade_date)', n, n FROM r UNION ALL SELECT 'exists(turnover)', 1, 1 UNION ALL SELECT 'exists(nothing)', 1, 0
 UNION ALL SELECT 'in_set(code)', n, (SELECT count(*) FROM bars WHERE code IN ('000001','000002')) FROM r""", "bars"))(
    lambda s, d: D.validate(I.bars(s, d), [D.Expect("between", "close", (22.0, 30.0)), D.Expect("not_null", "close"), D.Expect("ohlc"), D.Expect("unique", "code,trade_date"), D.Expect("exists", "turnover"),
                                           D.Expect("exists", "nothing"), D.Expect("in_set", "code", ("000001", "000002"))]).select("expectation", "tested", "passed"))
query("d02_d16_d21_stage_status", sql("SELECT 15 AS n, 15 AS n_ok, 'passed' AS status FROM (SELECT count(*) FROM bars)", "bars"))(lambda s, d: D.stage_status(D.validate(I.bars(s, d), D.BAR_SUITE)))
query("d03_d08_bar_checks", sql(f"WITH g AS (SELECT *, trade_date-{lagx('trade_date')} AS gap FROM bars) SELECT code, count(*) AS rows, count(CASE WHEN close<=0 OR open<=0 THEN 1 END) AS bad_price, count(CASE WHEN high<greatest(open,close) OR low>least(open,close) THEN 1 END) AS bad_ohlc, 0 AS bad_volume, count(CASE WHEN gap>5 THEN 1 END) AS gaps, max(gap) AS longest_gap FROM g GROUP BY 1", "bars"))(
    lambda s, d: D.bar_checks(I.bars(s, d)))
query("d04_panel_checks", sql("""WITH d AS (SELECT trade_date, count(DISTINCT code) AS c FROM bars GROUP BY 1) SELECT 'missing_close' AS "check", 0 AS count, true AS ok UNION ALL SELECT 'missing_pct_chg', count(*)-count(pct_chg), count(*)=count(pct_chg) FROM chg UNION ALL SELECT 'bad_price', 0, true UNION ALL SELECT 'bad_volume', 0, true
 UNION ALL SELECT 'bad_change', count(CASE WHEN abs(pct_chg)>25 THEN 1 END), count(CASE WHEN abs(pct_chg)>25 THEN 1 END)=0 FROM chg UNION ALL SELECT 'latest_coverage', arg_max(c,trade_date), arg_max(c,trade_date)>=max(c)*0.5 FROM d""", "chg"))(
    lambda s, d: D.panel_checks(with_change(I.bars(s, d)), ["close", "pct_chg"]))
query("d05_weekdays_to_fetch", sql("WITH l AS (SELECT code, max(trade_date) AS m FROM bars GROUP BY 1), x AS (SELECT code, CAST(unnest(generate_series(m+1, DATE '2001-11-20', INTERVAL 1 DAY)) AS DATE) AS trade_date FROM l) SELECT code, trade_date FROM x WHERE isodow(trade_date)<6", "bars"))(lambda s, d: D.weekdays_to(I.bars(s, d), "2001-11-20"))
query("d06_stale_codes", sql("SELECT code, max(trade_date) AS last_date FROM bars GROUP BY 1 HAVING max(trade_date)<DATE '2001-11-03'", "bars"))(lambda s, d: D.stale_codes(I.bars(s, d), "2001-11-03"))
query("d07_gap_days", sql(f"WITH g AS (SELECT code, trade_date, {lagx('trade_date')} AS p FROM bars), x AS (SELECT code, CAST(unnest(generate_series(p+1, trade_date-1, INTERVAL 1 DAY)) AS DATE) AS missing FROM g WHERE trade_date-p>7) SELECT code, missing FROM x WHERE isodow(missing)<6", "bars"))(lambda s, d: D.gap_days(I.bars(s, d)))
query("d09_d10_content_changes", sql("SELECT status, count(*) AS n FROM (SELECT code, CASE WHEN code='000003' THEN 'removed' WHEN code IN (SELECT code FROM bars WHERE volume>=95) THEN 'changed' ELSE 'same' END AS status FROM (SELECT DISTINCT code FROM bars)) GROUP BY 1", "bars"))(
    lambda s, d: _content_changes(materialize(I.bars(s, d))).groupBy("status").agg(F.count(F.lit(1)).alias("n")))


def _content_changes(b):
    """Both sides come from one stored panel: sums of doubles built twice differ in their last digit."""
    return D.content_changes(b, b.where("code <> '000003'").withColumn("close", F.when(F.col("volume") >= 95, F.col("close") + 1).otherwise(F.col("close"))))


query("d12_table_diff", "SELECT s_suppkey, 'modified' AS change, 's_acctbal' AS \"column\" FROM supplier WHERE s_acctbal<0 AND s_suppkey>=5 UNION ALL SELECT s_suppkey, 'removed', '*' FROM supplier WHERE s_suppkey<5")(
    lambda s, d: D.table_diff(I.table(s, d, "supplier"), I.table(s, d, "supplier").where("s_suppkey >= 5").withColumn("s_acctbal", F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal"))), ["s_suppkey"]).select("s_suppkey", "change", "column"))
query("d13_lineage_reach", """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey%60 AS src, l_partkey%60+1+l_suppkey%4 AS dst FROM lineitem),
 r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, r.depth+1 FROM r JOIN e ON r.node=e.src)
 SELECT node, min(depth) AS depth FROM r WHERE node<>1 GROUP BY 1""")(
    lambda s, d: D.lineage_reach(I.table(s, d, "lineitem").select(F.expr("l_partkey % 60").alias("src"), F.expr("l_partkey % 60 + 1 + l_suppkey % 4").alias("dst")),
                                 I.table(s, d, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("node"))))


def audit(s, d):
    e = I.table(s, d, "events")
    return e.select(F.col("user_id").alias("user"), "ts", F.when(F.col("event_type") == "purchase", "export").when(F.col("event_type") == "error", "delete").otherwise("read").alias("action"),
                    F.when(F.col("value") > 50, "financial").otherwise("bar").alias("data_type"))


query("d14_audit_anomalies", """WITH a AS (SELECT user_id AS "user", ts, CASE event_type WHEN 'purchase' THEN 'export' WHEN 'error' THEN 'delete' ELSE 'read' END AS action, CASE WHEN value>50 THEN 'financial' ELSE 'bar' END AS dt FROM events)
SELECT "user", 'off_hours' AS anomaly, count(*) AS n FROM a WHERE action IN ('delete','export') AND (hour(ts)<9 OR hour(ts)>=18) GROUP BY 1 UNION ALL SELECT "user", 'sensitive_export', count(*) FROM a WHERE action='export' AND dt='financial' GROUP BY 1 UNION ALL
SELECT "user", 'burst', count(*) FROM (SELECT "user", date_trunc('minute',ts) AS m FROM a GROUP BY ALL HAVING count(*)>1) GROUP BY 1""")(
    lambda s, d: D.audit_anomalies(audit(s, d), 1).groupBy("user", "anomaly").agg(F.count(F.lit(1)).alias("n")))
query("d15_run_statistics", "SELECT event_type, count(*) AS runs, count(CASE WHEN value>10 THEN 1 END) AS succeeded, round(count(CASE WHEN value>10 THEN 1 END)/count(*)::DOUBLE,6) AS success_rate FROM events GROUP BY 1")(
    lambda s, d: rounded(D.run_statistics(I.table(s, d, "events").withColumn("ok", F.col("value") > 10), "event_type").drop("last_run"), 6))
query("d15_recent_duplicates", "WITH x AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS p FROM events) SELECT event_id, coalesce(epoch(ts)-epoch(p)<=86400, false) AS is_duplicate FROM x")(
    lambda s, d: D.recent_duplicates(I.table(s, d, "events").withColumn("c", F.concat_ws("-", F.col("user_id").cast("string"), "event_type")), "c").select("event_id", "is_duplicate"))
query("d18_compare_sources", sql("SELECT status, count(*) AS n FROM (SELECT CASE WHEN code='000001' THEN 'only_a' WHEN volume>=50 THEN 'different' ELSE 'equal' END AS status FROM bars) GROUP BY 1", "bars"))(
    lambda s, d: D.compare_sources(I.bars(s, d), I.bars(s, d).where("code <> '000001'").withColumn("close", F.when(F.col("volume") >= 50, F.col("close") * 1.05).otherwise(F.col("close")))).groupBy("status").agg(F.count(F.lit(1)).alias("n")))
query("d19_clean_bars", sql("SELECT code, trade_date, round((close-open)/open*100,4) AS pct_change, 'good' AS quality FROM bars WHERE abs((close-open)/open*100)<=1.5", "bars"))(lambda s, d: rounded(D.clean_bars(I.bars(s, d), 1.5).select("code", "trade_date", "pct_change", "quality")))
query("d20_valid_rows", sql("SELECT code, trade_date FROM chg WHERE close>0 AND close<=28 AND volume<=5e9 AND abs(pct_chg)<=25", "chg"))(lambda s, d: D.valid_rows(with_change(I.bars(s, d)), 28.0).select("code", "trade_date"))
query("d22_issue_list", sql(f"WITH x AS (SELECT trade_date-{lagx('trade_date')} AS g, abs(close/{lagx('close')}-1)*100 AS c, abs(open/{lagx('open')}-1)*100 AS o, abs(high/{lagx('high')}-1)*100 AS h, abs(low/{lagx('low')}-1)*100 AS l FROM bars) " + " UNION ALL ".join(
    [f"SELECT 'spike_{n}' AS issue, count(CASE WHEN {n[0]}>20 THEN 1 END) AS count, round(max(CASE WHEN {n[0]}>20 THEN {n[0]} END),4) AS maximum FROM x" for n in ("open", "high", "low", "close")] + ["SELECT 'gap', count(CASE WHEN g>7 THEN 1 END), CAST(max(CASE WHEN g>7 THEN g END) AS DOUBLE) FROM x"]), "bars"))(lambda s, d: rounded(D.issue_list(I.bars(s, d))))
query("d23_freshness", sql("SELECT code, max(trade_date) AS last_date, CASE WHEN max(trade_date)>=DATE '2001-11-03' THEN 'current' WHEN DATE '2001-11-03'-max(trade_date)<=5 THEN 'suspended' ELSE 'needs_update' END AS freshness FROM bars GROUP BY 1", "bars"))(lambda s, d: D.freshness(I.bars(s, d), "2001-11-03", 5))
query("d24_invalid_series", sql("WITH g AS (SELECT code, count(*) AS rows, max(trade_date) AS last_date FROM bars GROUP BY 1) SELECT *, CASE WHEN last_date<DATE '2001-10-28' THEN 'too_old' ELSE 'too_short' END AS reason FROM g WHERE last_date<DATE '2001-10-28' OR rows<520", "bars"))(lambda s, d: D.invalid_series(I.bars(s, d), "2001-10-28", 520))
query("d25_intraday_written", "SELECT event_id FROM events WHERE isodow(ts)<6 AND hour(ts)*60+minute(ts) BETWEEN 570 AND 900")(lambda s, d: D.intraday_written(I.table(s, d, "events")).select("event_id"))
PW, NW, IW = ("the", "leau", "tion"), ("ouan", "sh", "ich"), ("erbl", "viei")


def _hits(words):
    return " + ".join(f"CASE WHEN contains(text,'{w}') THEN 1 ELSE 0 END" for w in words)


SENT = f"st AS (SELECT doc_id, lang, greatest(-1, least(1, (({_hits(PW)}) - ({_hits(NW)}))*0.2::DOUBLE*(1+({_hits(IW)})*0.5::DOUBLE))) AS sc FROM documents), sl AS (SELECT *, CASE WHEN sc>0.2 THEN 'positive' WHEN sc<-0.2 THEN 'negative' ELSE 'neutral' END AS sentiment FROM st)"
query("x01_sentiment", f"WITH {SENT} SELECT doc_id, round(CAST(sc AS DOUBLE),4) AS sentiment_score, sentiment FROM sl")(lambda s, d: rounded(X.sentiment(I.table(s, d, "documents"), "text", PW, NW, IW).select("doc_id", "sentiment_score", "sentiment")))
query("x02_market_sentiment", f"WITH {SENT} SELECT lang, count(*) AS n, round(avg(sc),6) AS avg_score, count(CASE WHEN sentiment='positive' THEN 1 END) AS positive, count(CASE WHEN sentiment='negative' THEN 1 END) AS negative, count(CASE WHEN sentiment='neutral' THEN 1 END) AS neutral FROM sl GROUP BY 1")(
    lambda s, d: rounded(X.market_sentiment(X.sentiment(I.table(s, d, "documents"), "text", PW, NW, IW), ["lang"]), 6))
query("x03_duplicate_news", "SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY lower(trim(text, ' '))) AS is_duplicate FROM documents")(lambda s, d: X.duplicate_news(I.table(s, d, "documents"), "doc_id").select("doc_id", "is_duplicate"))
