"""Sources, projections, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import order_stats as OS
from tidemark.functions import windows as W
from tidemark.operators import relational as R
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_technical import ema_cte, lagx, roll
from tidemark.sources import bars as B
from tidemark.sources import files as S
from tidemark.session import checkpoint_dir


def scratch(spark, name):
    """A fresh folder, under the shared checkpoint folder, for a query that writes and reads back."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


# ---- sources and sinks

query("s01_read_files_limit", "SELECT count(*) AS n, count(DISTINCT l_orderkey) > 0 AS ok FROM (SELECT l_orderkey FROM lineitem LIMIT 5000)")(
    lambda s, d: S.read_files(s, [f"{d}/lineitem.parquet"], ["l_orderkey", "l_suppkey"], rows_per_file=5000).agg(
        F.count(F.lit(1)).alias("n"), (F.countDistinct("l_orderkey") > 0).alias("ok")))
query("s02_read_glob", "SELECT n_name, n_regionkey FROM nation")(lambda s, d: S.read_glob(s, f"{d}/nat*.parquet", ["n_name", "n_regionkey"]))
query("s03_read_directory", "SELECT r_regionkey, r_name FROM region")(lambda s, d: S.read_directory(s, d, "region.parquet"))


def stored_bars(s, d):
    path = scratch(s, "bars")
    S.save_daily(I.bars(s, d).withColumn("trade_date", F.trunc("trade_date", "quarter")).groupBy("code", "trade_date").agg(
        F.max("high").alias("high"), F.sum("volume").alias("volume")), path)
    return path


QB = "qb AS (SELECT code, CAST(date_trunc('quarter', trade_date) AS DATE) AS trade_date, max(high) AS high, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL)"
query("s04_s05_read_bars_range", sql(f"WITH {QB} SELECT code, trade_date, round(high,4) AS high, volume FROM qb WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'", "bars"))(
    lambda s, d: rounded(S.read_bars(s, stored_bars(s, d), "1997-01-01", "1998-06-30", ["code", "trade_date", "high", "volume"])))
query("s06_query_sql", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")(
    lambda s, d: S.query_sql(s, "SELECT l_returnflag, count(*) AS n FROM {li} WHERE l_quantity > 25 GROUP BY 1", {"li": I.table(s, d, "lineitem")}))
query("s06_query_parquet", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")(
    lambda s, d: S.query_parquet(s, f"{d}/supplier.parquet", "s_acctbal > 0", [F.col("s_acctbal").desc(), "s_suppkey"], 10).select("s_suppkey", "s_acctbal"))


def roundtrip(s, d, fmt):
    path = scratch(s, fmt)
    df = I.table(s, d, "supplier")
    S.export(df, path, fmt)
    if fmt == "parquet":
        return s.read.parquet(path)
    if fmt == "csv":
        return S.read_csv(s, path, df.schema)
    return s.read.schema(df.schema).json(path)


for fmt in ("parquet", "csv", "json"):
    query(f"s07_s08_export_{fmt}" if fmt != "csv" else "s08_s16_export_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(
        lambda s, d, fmt=fmt: roundtrip(s, d, fmt).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
query("s09_read_latest", sql(f"WITH {QB} SELECT code, trade_date, round(high,4) AS high, volume FROM qb WHERE trade_date=(SELECT max(trade_date) FROM qb)", "bars"))(
    lambda s, d: rounded(S.read_latest(s, stored_bars(s, d)).select("code", "trade_date", "high", "volume")))


def appended(s, d):
    path = scratch(s, "append")
    S.write_parquet(I.table(s, d, "nation"), path)
    S.append(I.table(s, d, "nation").where("n_nationkey < 5"), path)
    return s.read.parquet(path)


query("s10_append", "SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey < 5")(appended)


def upserted(s, d):
    path = scratch(s, "upsert")
    base = I.bars(s, d).withColumn("trade_date", F.trunc("trade_date", "quarter")).groupBy("code", "trade_date").agg(F.max("high").alias("high"), F.sum("volume").alias("volume"))
    S.save_daily(base, path)
    new = base.where("trade_date >= '2001-01-01'").withColumns({"high": F.col("high") + 1, "seq": F.lit(1)})
    newer = new.withColumns({"high": F.col("high") + 1, "seq": F.lit(2)}).where("code < '000050'")
    both = new.unionByName(newer)
    S.upsert_daily(s, path, both, sequence="seq")
    return s.read.parquet(path)


query("s11_keyed_upsert", sql(f"WITH {QB} SELECT code, trade_date, round(CASE WHEN trade_date >= DATE '2001-01-01' THEN CASE WHEN code < '000050' THEN high+2 ELSE high+1 END ELSE high END,4) AS high, volume FROM qb", "bars"))(
    lambda s, d: rounded(upserted(s, d).select("code", "trade_date", "high", "volume")))
query("s12_statement_upsert", sql("SELECT code, report_date, round(CASE WHEN report_date >= DATE '2001-01-01' THEN total_revenue*1.1 ELSE total_revenue END,4) AS total_revenue FROM inc", "stm"))(
    lambda s, d: _statement_upsert(s, d))


def _statement_upsert(s, d):
    inc = I.income_statement(s, d)
    new = inc.where("report_date >= '2001-01-01'").withColumn("total_revenue", F.col("total_revenue") * 1.1)
    return B.upsert(inc, new, ["code", "report_date"]).select("code", "report_date", F.round("total_revenue", 4).alias("total_revenue"))


query("s14_kafka_payload", "SELECT CAST(n_nationkey AS VARCHAR) AS key, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")(
    lambda s, d: S.kafka_payload(I.table(s, d, "nation"), "n_nationkey"))

# ---- projection, typing, cleaning

query("p01_p04_normalize", sql("SELECT code, trade_date, round(open,4) AS open, round(close,4) AS close, round(preclose,4) AS preclose, round(pct_chg,4) AS pct_chg, round(turnover,4) AS turnover FROM chg", "chg"))(
    lambda s, d: rounded(B.standard_order(B.derive_change(B.ensure_code(B.normalize_names(
        B.with_change(I.bars(s, d)).drop("pct_chg").withColumnsRenamed({"trade_date": "date", "preclose": "pre_close", "turnover": "turnover_rate"})))))
        .select("code", "trade_date", "open", "close", "preclose", "pct_chg", "turnover")))
query("p03_preclose_from_change", sql("SELECT code, trade_date, round(close/(1+pct_chg/100),4) AS preclose FROM chg", "chg"))(
    lambda s, d: rounded(B.derive_change(B.with_change(I.bars(s, d)).drop("preclose")).select("code", "trade_date", "preclose")))
query("p05_clean_identity", "SELECT lpad(CAST(o_custkey AS VARCHAR),6,'0') AS code, CAST(o_orderdate AS DATE) AS trade_date, o_totalprice FROM orders")(
    lambda s, d: B.clean_identity(I.table(s, d, "orders").select(
        F.concat(F.element_at(F.array(F.lit("sh."), F.lit("sz."), F.lit("bj.")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int")), I.code_of("o_custkey")).alias("code"),
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.col("o_orderdate")).alias("trade_date"), F.col("o_orderdate").alias("date"), "o_totalprice")))
query("p06_numeric_or_null", "SELECT doc_id, TRY_CAST(substr(text,1,2) AS DOUBLE) AS head, TRY_CAST(text AS DOUBLE) AS text, CAST(n_chars AS DOUBLE) AS n_chars FROM documents")(
    lambda s, d: B.numeric_or_null(I.table(s, d, "documents").select("doc_id", F.substring("text", 1, 2).alias("head"), "text", F.col("n_chars").cast("string").alias("n_chars")), ["head", "text", "n_chars"]))
query("p07_narrow_types", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")(
    lambda s, d: B.narrow_types(I.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")))
query("p08_expressions", sql("SELECT code, trade_date, round((high-low)/close,6) AS amplitude, round(close*volume,4) AS value FROM bars", "bars"))(
    lambda s, d: B.with_expressions(I.bars(s, d), {"amplitude": "round((high - low) / close, 6)", "value": F.round(F.col("close") * F.col("volume"), 4)}).select("code", "trade_date", "amplitude", "value"))
query("p09_fill_factors", sql(f"SELECT code, trade_date, round(coalesce(close/{lagx('close', 20)}-1,0),6) AS factor_m FROM bars", "bars"))(
    lambda s, d: rounded(B.fill_factors(I.bars(s, d).withColumn("factor_m", F.col("close") / W.lag("close", 20) - 1)).select("code", "trade_date", "factor_m"), 6))
query("p10_boards", "SELECT c_custkey, CASE WHEN regexp_matches(k,'^(688|689)') THEN 'star' WHEN regexp_matches(k,'^(300|301)') THEN 'growth' WHEN regexp_matches(k,'^(4|8|92)') THEN 'beijing' ELSE 'main' END AS board, CAST(CASE WHEN regexp_matches(k,'^(688|689|300|301)') THEN 20 WHEN regexp_matches(k,'^(4|8|92)') THEN 30 ELSE 10 END AS DOUBLE) AS lim FROM (SELECT c_custkey, lpad(CAST((c_custkey*7919) % 1000 AS VARCHAR),3,'0') || '001' AS k FROM customer)")(
    lambda s, d: _boards(I.table(s, d, "customer").select("c_custkey", F.concat(F.lpad(F.pmod(F.col("c_custkey") * 7919, F.lit(1000)).cast("string"), 3, "0"), F.lit("001")).alias("code"))))


def _boards(x):
    return x.select("c_custkey", B.board().alias("board"), B.board_limit().alias("lim"))


query("p11_rebase", sql("SELECT code, trade_date, round(close/first_value(close) OVER (PARTITION BY code ORDER BY trade_date)*100,4) AS normalized FROM bars", "bars"))(
    lambda s, d: rounded(B.rebase(I.bars(s, d)).select("code", "trade_date", "normalized")))
query("p12_seat_alias", sql("SELECT code, trade_date, broker_name, CASE WHEN broker_name IN ('seat1','seat4') THEN 'north' WHEN broker_name='seat7' THEN 'fast' END AS alias, l_orderkey, l_linenumber FROM seats", "seats"))(
    lambda s, d: B.seat_alias(I.seats(s, d), _seat_names(s, d)).select("code", "trade_date", "broker_name", "alias", "l_orderkey", "l_linenumber"))


def _seat_names(s, d):
    n = I.table(s, d, "nation").where("n_nationkey in (1, 4, 7)")
    return n.select(F.concat(F.lit("seat"), "n_nationkey").alias("seat"), F.when(F.col("n_nationkey") == 7, "fast").otherwise("north").alias("alias"))


# ---- joins

query("j01_panel_daily", sql("WITH d AS (SELECT trade_date, sum(amount) AS total FROM bars GROUP BY 1) SELECT code, trade_date, round(amount/total,6) AS share FROM bars JOIN d USING (trade_date)", "bars"))(
    lambda s, d: R.with_daily(I.bars(s, d), {"total": F.sum("amount")}).select("code", "trade_date", F.round(F.col("amount") / F.col("total"), 6).alias("share")))
query("j03_industry_daily", sql("WITH x AS (SELECT * FROM bars JOIN stocks USING (code)), d AS (SELECT trade_date, industry, avg(close) AS m FROM x GROUP BY ALL) SELECT code, trade_date, round(close/m,6) AS rel FROM x JOIN d USING (trade_date, industry)", "bars", "stocks"))(
    lambda s, d: R.with_daily(I.bars(s, d).join(I.stocks(s, d).select("code", "industry"), "code"), {"m": F.avg("close")}, ["trade_date", "industry"]).select(
        "code", "trade_date", F.round(F.col("close") / F.col("m"), 6).alias("rel")))
query("j02_j12_panel_row_result", sql(f"WITH r AS (SELECT code, trade_date, {roll('avg', 'close', 5)} AS ma5 FROM bars) SELECT code, trade_date, round(close,4) AS close, round(ma5,4) AS ma5 FROM bars LEFT JOIN r USING (code, trade_date)", "bars"))(
    lambda s, d: rounded(R.attach(I.bars(s, d).select("code", "trade_date", "close"), I.bars(s, d).select("code", "trade_date", "close", W.rmean("close", 5).alias("ma5")), ["code", "trade_date"])))
query("j04_latest_row", sql("SELECT code, trade_date, round(close,4) AS close, volume FROM lastbar", "snap"))(
    lambda s, d: rounded(W.latest_rows(I.bars(s, d), "trade_date", "close", "volume")))
query("j05_latest_with_stats", sql("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM bars)
SELECT code, """ + ", ".join(f"round(avg(CASE WHEN rn<={n} THEN close END),4) AS close_avg_{n}, round(min(CASE WHEN rn<={n} THEN low END),4) AS low_min_{n}, round(max(CASE WHEN rn<={n} THEN high END),4) AS high_max_{n}" for n in (5, 10, 20, 60)) + " FROM r GROUP BY 1", "bars"))(
    lambda s, d: rounded(R.last_n_stats(I.bars(s, d), {"close_avg": (F.avg, "close"), "low_min": (F.min, "low"), "high_max": (F.max, "high")}, (5, 10, 20, 60))))
query("j06_today_vs_previous", sql(f"SELECT code, trade_date, round(close - {lagx('close')},4) AS change, volume - {lagx('volume')} AS dvolume FROM bars", "bars"))(
    lambda s, d: I.bars(s, d).select("code", "trade_date", F.round(F.col("close") - W.lag("close"), 4).alias("change"), (F.col("volume") - W.lag("volume")).alias("dvolume")))


def picks(s, d):
    e = I.events_table(s, d).where("kind = 'forecast'").select("code", F.col("publish_date").alias("pick_date")).distinct()
    return e


PK = "picks AS (SELECT DISTINCT code, publish_date AS pick_date FROM ev WHERE kind='forecast')"
query("j07_asof_forward_entry_exit", sql(f"""WITH {PK}, e AS (SELECT p.code, p.pick_date, min(b.trade_date) AS entry_date FROM picks p LEFT JOIN bars b ON b.code=p.code AND b.trade_date>=p.pick_date GROUP BY ALL),
x AS (SELECT p.code, p.pick_date, min(b.trade_date) AS exit_date FROM picks p LEFT JOIN bars b ON b.code=p.code AND b.trade_date>=p.pick_date+10 GROUP BY ALL),
l AS (SELECT code, max(trade_date) AS last_date FROM bars GROUP BY 1)
SELECT e.code, e.pick_date, entry_date, coalesce(exit_date, last_date) AS exit_date, exit_date IS NULL AS is_open, round(b1.close,4) AS entry_price, round(b2.close,4) AS exit_price
FROM e JOIN x USING (code, pick_date) LEFT JOIN l ON l.code=e.code LEFT JOIN bars b1 ON b1.code=e.code AND b1.trade_date=entry_date LEFT JOIN bars b2 ON b2.code=e.code AND b2.trade_date=coalesce(exit_date,last_date)""", "ev", "bars"))(
    lambda s, d: rounded(R.entry_exit(picks(s, d), I.bars(s, d), 10).select("code", "pick_date", "entry_date", "exit_date", "is_open", "entry_price", "exit_price")))
query("j08_range_join", sql(f"""WITH {PK} SELECT p.code, pick_date, count(b.close) AS bars, round(max(b.high),4) AS high, round(min(b.low),4) AS low
FROM picks p LEFT JOIN bars b ON b.code=p.code AND b.trade_date>p.pick_date AND b.trade_date<=p.pick_date+30 GROUP BY ALL""", "ev", "bars"))(
    lambda s, d: rounded(R.range_aggregate(picks(s, d), I.bars(s, d), 30, {"bars": F.count("close"), "high": F.max("high"), "low": F.min("low")})))
query("j09_asof_backward", sql(f"""WITH {PK}, a AS (SELECT p.code, p.pick_date, b.trade_date AS asof_date, b.close FROM picks p ASOF LEFT JOIN bars b ON p.code=b.code AND p.pick_date>=b.trade_date)
SELECT code, pick_date, asof_date, round(close,4) AS close FROM a""", "ev", "bars"))(
    lambda s, d: rounded(W.asof_backward(picks(s, d), I.bars(s, d), ["close"], left_date="pick_date")))
query("j10_asof_with_max_age", sql(f"""WITH {PK}, a AS (SELECT p.code, p.pick_date, b.trade_date AS asof_date, b.close FROM picks p ASOF LEFT JOIN bars b ON p.code=b.code AND p.pick_date>=b.trade_date)
SELECT code, pick_date, CASE WHEN pick_date-asof_date<=3 THEN asof_date END AS asof_date, round(CASE WHEN pick_date-asof_date<=3 THEN close END,4) AS close FROM a""", "ev", "bars"))(
    lambda s, d: rounded(W.asof_backward(picks(s, d), I.bars(s, d), ["close"], left_date="pick_date", max_age=3)))
query("j11_names", sql("SELECT code, name, industry, trade_date FROM bars LEFT JOIN stocks USING (code)", "bars", "stocks"))(
    lambda s, d: R.with_names(I.bars(s, d), I.stocks(s, d)).select("code", "name", "industry", "trade_date"))
query("j14_stock_index_returns", sql(f"""WITH ix AS (SELECT trade_date, avg(close) AS c FROM bars GROUP BY 1), ir AS (SELECT trade_date, c/lag(c) OVER (ORDER BY trade_date)-1 AS ri FROM ix), sr AS (SELECT code, trade_date, close/{lagx('close')}-1 AS rs FROM bars)
SELECT code, count(*) AS n, round(corr(rs,ri),6) AS corr, round(covar_samp(rs,ri)/var_samp(ri),6) AS beta FROM sr JOIN ir USING (trade_date) WHERE rs IS NOT NULL AND ri IS NOT NULL GROUP BY 1""", "bars"))(
    lambda s, d: rounded(R.stock_index_stats(I.bars(s, d)), 6))
query("j15_l08_semi_anti_sets", sql("""WITH a AS (SELECT code FROM stocks WHERE grade_no<4), b AS (SELECT code FROM stocks WHERE acctbal>5000)
SELECT 'both' AS side, code FROM (SELECT code FROM a INTERSECT SELECT code FROM b) UNION ALL SELECT 'only_a', code FROM (SELECT code FROM a EXCEPT SELECT code FROM b)""", "stocks"))(
    lambda s, d: _sets(I.stocks(s, d)))


def _sets(st):
    a, b = st.where("grade_no < 4").select("code"), st.where("acctbal > 5000").select("code")
    return a.join(b, "code", "left_semi").select(F.lit("both").alias("side"), "code").unionByName(
        a.join(b, "code", "left_anti").select(F.lit("only_a").alias("side"), "code"))


query("j16_parent_child_counts", "SELECT c_custkey, count(o_orderkey) AS n_orders, count(CASE WHEN o_orderstatus='F' THEN 1 END) AS n_done FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")(
    lambda s, d: R.child_counts(I.table(s, d, "customer"), I.table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey",
                                {"n_orders": F.lit(True), "n_done": F.col("o_orderstatus") == "F"}))
query("j17_round_trips", """WITH t AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS trade_date, o_orderkey AS id, CASE WHEN o_orderstatus='F' THEN 'sell' ELSE 'buy' END AS side, o_totalprice AS price FROM orders),
x AS (SELECT *, max(CASE WHEN side='buy' THEN (trade_date, id, price) END) OVER (PARTITION BY code ORDER BY trade_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t)
SELECT code, id, trade_date, round(price/b[3]-1,6) AS ret, price > b[3] AS win, trade_date - b[1] AS days FROM x WHERE side='sell' AND b IS NOT NULL"""
      .replace("b[3]", "struct_extract(b, 3)").replace("b[1]", "struct_extract(b, 1)"))(
    lambda s, d: rounded(R.round_trips(I.table(s, d, "orders").select(
        F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("trade_date"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), F.col("o_totalprice").alias("price"))), 6))

# ---- aggregates

query("a01_a03_group_stats", sql("SELECT code, count(*) AS n, round(sum(amount),2) AS total, round(avg(close),4) AS mean, round(min(low),4) AS lo, round(max(high),4) AS hi, round(stddev_samp(close),4) AS sd_sample, round(stddev_pop(close),4) AS sd_population FROM bars GROUP BY 1", "bars"))(
    lambda s, d: I.bars(s, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("total"), *[F.round(e, 4).alias(n) for n, e in {
        "mean": F.avg("close"), "lo": F.min("low"), "hi": F.max("high"), "sd_sample": F.stddev_samp("close"), "sd_population": F.stddev_pop("close")}.items()]))
query("a04_a05_quantiles", sql("SELECT trade_date, count(*) AS n, round(quantile_cont(close,0.1),6) AS p10, round(quantile_cont(close,0.5),6) AS p50, round(quantile_cont(close,0.9),6) AS p90 FROM bars GROUP BY 1", "bars"))(
    lambda s, d: rounded(OS.quantiles(I.bars(s, d), ["trade_date"], "close", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), 6))
query("a05_quantiles_many_pieces", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice,0.25),4) AS q25, round(quantile_cont(l_extendedprice,0.999),4) AS q999 FROM lineitem GROUP BY 1")(
    lambda s, d: rounded(OS.quantiles(I.table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q999": 0.999}, piece=500)))
query("a06_conditional_counts", "SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS BIGINT) AS done, round(avg(CASE WHEN o_orderstatus='F' THEN 100.0::DOUBLE ELSE 0 END),4) AS done_pct FROM orders GROUP BY 1")(
    lambda s, d: rounded(R.conditional_counts(I.table(s, d, "orders"), ["o_orderpriority"], {"done": F.col("o_orderstatus") == "F"})))
query("a07_coverage", sql("SELECT trade_date, count(DISTINCT code) AS codes FROM bars GROUP BY 1 HAVING count(DISTINCT code) > 20", "bars"))(lambda s, d: R.date_coverage(I.bars(s, d), 20))
query("a08_corr_cov", "SELECT l_returnflag, round(corr(l_quantity,l_extendedprice),6) AS corr, round(covar_samp(l_quantity,l_extendedprice),2) AS cov_s, round(covar_pop(l_quantity,l_extendedprice),2) AS cov_p, round(covar_samp(l_quantity,l_extendedprice)/var_samp(l_quantity),4) AS beta FROM lineitem GROUP BY 1")(
    lambda s, d: I.table(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("cov_s"),
        F.round(F.covar_pop("l_quantity", "l_extendedprice"), 2).alias("cov_p"), F.round(F.covar_samp("l_quantity", "l_extendedprice") / F.var_samp("l_quantity"), 4).alias("beta")))
query("a09_skew_kurtosis", sql("SELECT code, round(skewness(close),6) AS skew, round(kurtosis(close),6) AS kurt FROM bars GROUP BY 1", "bars"))(
    lambda s, d: I.bars(s, d).groupBy("code").agg(F.round(R.skew_sample("close"), 6).alias("skew"), F.round(R.kurt_sample("close"), 6).alias("kurt")))
query("a10_topk_strings", sql("""WITH g AS (SELECT code, broker_name, sum(net_buy_amount) AS net FROM seats GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY net DESC, broker_name) AS k FROM g)
SELECT code, string_agg(broker_name, ',' ORDER BY k) AS top_seats FROM r WHERE k<=3 GROUP BY 1""", "seats"))(
    lambda s, d: R.topk_strings(I.seats(s, d).groupBy("code", "broker_name").agg(F.sum("net_buy_amount").alias("net")), "code", "broker_name", "net", 3, "top_seats"))
query("a11_value_counts", "SELECT p_type, count(*) AS count FROM part GROUP BY 1")(lambda s, d: R.value_counts(I.table(s, d, "part"), "p_type"))
query("a12_open_close", sql("SELECT code, CAST(date_trunc('month', trade_date) AS DATE) AS month, round(arg_min(open, trade_date),4) AS open, round(arg_max(close, trade_date),4) AS close FROM bars GROUP BY ALL", "bars"))(
    lambda s, d: rounded(I.bars(s, d).groupBy("code", F.trunc("trade_date", "month").alias("month")).agg(F.min_by("open", "trade_date").alias("open"), F.max_by("close", "trade_date").alias("close"))))
query("a13_compound", sql(f"WITH r AS (SELECT *, close/{lagx('close')}-1 AS r FROM bars) SELECT code, round(product(1+r)-1,6) AS total FROM r GROUP BY 1", "bars"))(
    lambda s, d: rounded(R.compound(I.bars(s, d).withColumn("r", F.col("close") / W.lag("close") - 1), "code", "r"), 6))
query("a14_label_buckets", "SELECT CASE WHEN o_totalprice<100000 THEN 'small' WHEN o_totalprice<300000 THEN 'mid' ELSE 'large' END AS bucket, count(*) AS n, round(avg(o_totalprice),2) AS mean FROM orders GROUP BY 1")(
    lambda s, d: R.bucket_stats(I.table(s, d, "orders"), "o_totalprice", [(100000, "small"), (300000, "mid")], "large").select("bucket", "n", F.round("mean", 2).alias("mean")))
query("a15_score_statistics", sql("SELECT count(*) AS n, count(CASE WHEN acctbal>=8000 THEN 1 END) AS n_s, count(CASE WHEN acctbal>=5000 AND acctbal<8000 THEN 1 END) AS n_a, round(avg(acctbal),4) AS avg_score, max(acctbal) AS max_score FROM stocks", "stocks"))(
    lambda s, d: rounded(R.score_statistics(I.stocks(s, d), "acctbal", {"n_s": (8000, None), "n_a": (5000, 8000)})))

# ---- windows

query("w01_rolling", sql("SELECT code, trade_date, " + ", ".join(f"round({roll(f, 'close', 20)},4) AS {n}" for n, f in (("m", "avg"), ("sd", "stddev_samp"), ("lo", "min"), ("hi", "max"), ("sm", "sum"))) + " FROM bars", "bars"))(
    lambda s, d: rounded(I.bars(s, d).select("code", "trade_date", W.rmean("close", 20).alias("m"), W.rstd("close", 20).alias("sd"), W.rmin("close", 20).alias("lo"), W.rmax("close", 20).alias("hi"), W.rsum("close", 20).alias("sm"))))
query("w02_last_n_rows", sql("SELECT code, trade_date, rn FROM (SELECT code, trade_date, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn<=10", "bars"))(
    lambda s, d: W.newest_rank(I.bars(s, d)).where("rn <= 10").select("code", "trade_date", "rn"))
for unit in ("week", "month"):
    query(f"w03_resample_{unit}", sql(f"""SELECT code, CAST(date_trunc('{unit}', trade_date) AS DATE) AS period, round(arg_min(open,trade_date),4) AS open, round(max(high),4) AS high, round(min(low),4) AS low, round(arg_max(close,trade_date),4) AS close,
 CAST(sum(volume) AS BIGINT) AS volume, max(trade_date) AS last_date, count(*) AS days FROM bars GROUP BY ALL""", "bars"))(
        lambda s, d, unit=unit: rounded(B.resample(I.bars(s, d), unit).drop("amount")))
query("w04_cumulative", sql("SELECT code, trade_date, CAST(sum(volume) OVER w AS BIGINT) AS cum_volume, round(max(high) OVER w,4) AS cum_high FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING)", "bars"))(
    lambda s, d: rounded(I.bars(s, d).select("code", "trade_date", F.sum("volume").over(W.wc().rowsBetween(W.UNB, 0)).alias("cum_volume"), F.max("high").over(W.wc().rowsBetween(W.UNB, 0)).alias("cum_high"))))
query("w05_running_sum_frame", sql("SELECT code, trade_date, CAST(sum(volume) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM bars", "bars"))(
    lambda s, d: I.bars(s, d).select("code", "trade_date", F.sum("volume").over(W.wc().rowsBetween(-60, 0)).alias("s")))
query("w06_w07_lag_lead", sql("SELECT code, trade_date, round(close-lag(close,5) OVER w,4) AS d5, round(close/lag(close,10) OVER w-1,6) AS r10, round(lead(close,5) OVER w/close-1,6) AS f5 FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)", "bars"))(
    lambda s, d: I.bars(s, d).select("code", "trade_date", F.round(F.col("close") - W.lag("close", 5), 4).alias("d5"), F.round(F.col("close") / W.lag("close", 10) - 1, 6).alias("r10"), F.round(W.lead("close", 5) / F.col("close") - 1, 6).alias("f5")))
query("w08_w09_ema_both", sql("WITH " + ema_cte("e", "bars", {"a3": ("close", 0.5, True), "b3": ("close", 0.5, False), "a60": ("close", 2 / 61, True), "b60": ("close", 2 / 61, False)}) + " SELECT code, trade_date, round(a3,6) AS a3, round(b3,6) AS b3, round(a60,6) AS a60, round(b60,6) AS b60 FROM e", "bars"))(
    lambda s, d: rounded(W.with_ema(I.bars(s, d), {"a3": W.Ema("close", 3, adjust=True), "b3": W.Ema("close", 3), "a60": W.Ema("close", 60, adjust=True), "b60": W.Ema("close", 60)}).select("code", "trade_date", "a3", "b3", "a60", "b60"), 6))
query("w10_runs", sql(f"""WITH f AS (SELECT *, close > {lagx('close')} AS up, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS rn FROM bars),
g AS (SELECT *, max(CASE WHEN coalesce(up,false) THEN 0 ELSE rn END) OVER (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS lb FROM f) SELECT code, trade_date, rn-lb AS run FROM g""", "bars"))(
    lambda s, d: W.with_runs(I.bars(s, d).withColumn("up", F.coalesce(F.col("close") > W.lag("close"), F.lit(False))), "up").select("code", "trade_date", "run"))
query("w11_longest_runs", sql(f"""WITH f AS (SELECT *, sign(close - {lagx('close')}) AS sg, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS rn FROM bars),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY code, sg ORDER BY trade_date) AS isl FROM f), r AS (SELECT code, sg, isl, count(*) AS n FROM g GROUP BY ALL)
SELECT code, max(CASE WHEN sg>0 THEN n ELSE 0 END) AS longest_win, max(CASE WHEN sg<0 THEN n ELSE 0 END) AS longest_loss FROM r GROUP BY 1""", "bars"))(
    lambda s, d: R.longest_runs(I.bars(s, d).withColumn("r", F.col("close") - W.lag("close")), "r"))
query("w12_forward_fill", sql("SELECT code, trade_date, round(last_value(CASE WHEN volume>30 THEN close END IGNORE NULLS) OVER (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING),4) AS filled FROM bars", "bars"))(
    lambda s, d: rounded(I.bars(s, d).withColumn("x", F.when(F.col("volume") > 30, F.col("close"))).select("code", "trade_date", W.forward_fill("x").alias("filled"))))
query("w13_zscore", sql("SELECT code, trade_date, round(CASE WHEN stddev_samp(close) OVER (PARTITION BY trade_date)>0 THEN (close-avg(close) OVER (PARTITION BY trade_date))/stddev_samp(close) OVER (PARTITION BY trade_date) END,6) AS z, round((close-avg(close) OVER ())/stddev_samp(close) OVER (),6) AS z_all FROM bars", "bars"))(
    lambda s, d: rounded(R.zscore(R.zscore(I.bars(s, d), "close", "z"), "close", "z_all", scope="all").select("code", "trade_date", "z", "z_all"), 6))
query("w14_rank_label", sql("SELECT code, trade_date, round((rank() OVER (PARTITION BY trade_date ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, close)-1)/2.0 - 1)/count(*) OVER (PARTITION BY trade_date),6) AS label FROM bars", "bars"))(
    lambda s, d: rounded(R.rank_label(I.bars(s, d), "close").select("code", "trade_date", "label"), 6))
CUTS = ", ".join(
    f"max(CASE WHEN rn=((n-1)*{i})//5 THEN close END) + (max(CASE WHEN rn=((n-1)*{i}+4)//5 THEN close END) - max(CASE WHEN rn=((n-1)*{i})//5 THEN close END)) * (max(((n-1)*{i})%5)/5.0::DOUBLE) AS q{i}"
    for i in range(1, 5))
query("w15_quantile_bucket", sql(f"""
WITH o AS (SELECT trade_date, close, row_number() OVER (PARTITION BY trade_date ORDER BY close)-1 AS rn, count(*) OVER (PARTITION BY trade_date) AS n FROM bars), q AS (SELECT trade_date, {CUTS} FROM o GROUP BY 1)
SELECT code, trade_date, 1 + {" + ".join(f"CASE WHEN close>=q{i} THEN 1 ELSE 0 END" for i in range(1, 5))} AS bucket FROM bars JOIN q USING (trade_date)""", "bars"))(
    lambda s, d: OS.quantile_bucket(I.bars(s, d).select("code", "trade_date", "close"), ["trade_date"], "close", 5).select("code", "trade_date", "bucket"))


query("w16_topk_per_industry", sql("SELECT code, industry, acctbal, k FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY acctbal DESC, code) AS k FROM stocks) WHERE k<=2", "stocks"))(
    lambda s, d: R.top_per_group(I.stocks(s, d), ["industry"], "acctbal", 2).select("code", "industry", "acctbal", "k"))
query("w17_local_extrema", sql("SELECT code, trade_date, round(low,4) AS low, low <= min(low) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS is_low, high >= max(high) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS is_high FROM bars", "bars"))(
    lambda s, d: rounded(R.local_extrema(I.bars(s, d)).select("code", "trade_date", "low", "is_low", "is_high")))

# ---- sort, top-k, sets

query("l01_l02_top_bottom", sql("SELECT * FROM (SELECT 'top' AS side, code, acctbal FROM stocks ORDER BY acctbal DESC, code LIMIT 7) UNION ALL SELECT * FROM (SELECT 'bottom' AS side, code, acctbal FROM stocks ORDER BY acctbal, code LIMIT 7)", "stocks"))(
    lambda s, d: R.top_bottom(I.stocks(s, d), "acctbal", 7).select("side", "code", "acctbal"))
query("l03_l05_retention", sql("WITH r AS (SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, code) AS k, floor(count(*) OVER (PARTITION BY trade_date)*0.2) AS lim FROM bars) SELECT code, trade_date FROM r WHERE k<=lim", "bars"))(
    lambda s, d: OS.top_share(I.bars(s, d), ["trade_date"], "close", 0.2).where("in_top").select("code", "trade_date"))
query("l05_top_share_with_ties", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey*1000000000+l_linenumber*100000000+CAST(round(l_extendedprice*100) AS BIGINT)) AS k, floor(count(*) OVER (PARTITION BY l_returnflag)*0.33) AS lim FROM lineitem) SELECT l_returnflag, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM r WHERE k<=lim GROUP BY 1")(
    lambda s, d: OS.top_share(I.table(s, d, "lineitem").withColumn("k", F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")),
                              ["l_returnflag"], "l_quantity", 0.33, key="k", piece=300).where("in_top").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("s")))
query("l06_union_by_name", "SELECT n_nationkey AS key, n_name AS name, NULL::VARCHAR AS r FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")(
    lambda s, d: I.table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).unionByName(
        I.table(s, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("r")), allowMissingColumns=True))
query("l07_dedupe_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")(
    lambda s, d: B.dedupe_last(I.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("seq", F.col("o_orderkey")), ["o_custkey"], "seq").drop("seq"))
query("l09_missing_dates", sql("""WITH sp AS (SELECT code, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY 1), w AS (SELECT code, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS trade_date FROM sp)
SELECT code, trade_date FROM w WHERE isodow(trade_date) < 6 EXCEPT SELECT code, trade_date FROM bars""", "bars"))(
    lambda s, d: B.missing_dates(I.bars(s, d), B.calendar(I.bars(s, d))))
query("d17_calendar", sql("""WITH sp AS (SELECT min(trade_date) AS a, max(trade_date) AS b FROM bars), w AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS trade_date FROM sp)
SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day_no FROM w WHERE isodow(trade_date) < 6 AND NOT (month(trade_date)=10 AND day(trade_date)<=7)""", "bars"))(
    lambda s, d: B.day_index(B.calendar(I.bars(s, d), _holidays(s, d))))


def _holidays(s, d):
    """First week of October of the years in the data."""
    y = I.bars(s, d).select(F.year("trade_date").alias("y")).distinct()
    return y.select(F.explode(F.sequence(F.make_date("y", F.lit(10), F.lit(1)), F.make_date("y", F.lit(10), F.lit(7)))).alias("holiday"))
