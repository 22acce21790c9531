"""Market tables derived from the star-schema test tables.

Each function has its DuckDB twin in ``plans/ctes.py`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import spread
from tidemark.sources.bars import bars_from_trades


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code_of(c: str):
    return F.lpad(F.col(c).cast("string"), 6, "0")


def legs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as priced trades."""
    li = table(spark, sf, "lineitem")
    px = F.lit(20.0) + F.sqrt(F.sqrt(F.col("l_extendedprice") / F.col("l_quantity")))
    out = li.select(
        code_of("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"),
        px.alias("open"), (px * (1 + F.col("l_tax") * 0.5)).alias("high"),
        (px * (1 - F.col("l_discount") * 0.4)).alias("low"),
        (F.pmod("l_partkey", F.lit(11)).cast("double") / 10.0).alias("at"),
        F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("amount"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    return out.withColumn("close", F.col("low") + (F.col("high") - F.col("low")) * F.col("at"))


LEG_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def leg_key():
    """The four order columns packed into one exact decimal, so bar building stays a hash aggregate."""
    def dec(c, digits):
        return c.cast(f"decimal({digits},0)")
    low = F.col("l_linenumber").cast("long") * F.lit(10 ** 11) + F.col("l_partkey")
    return (dec(F.col("l_orderkey"), 13) * dec(F.lit("1" + "0" * 22), 23) + dec(low, 13) * dec(F.lit(10 ** 10), 11)
            + dec(F.round(F.col("l_extendedprice") * 100), 12))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return (bars_from_trades(legs(spark, sf).withColumn("_order", leg_key()), ["_order"])
            .withColumn("turnover", F.col("volume").cast("double") / 10.0))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """``bars`` for chains of code windows: tasks grow in number with the trades (counted from file footers)."""
    return spread(bars(spark, sf), table(spark, sf, "lineitem").count())


def stocks(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as the stock list; some names carry risk marks."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey")
    mark = (F.when(F.pmod(k, F.lit(17)) == 3, "*ST ").when(F.pmod(k, F.lit(23)) == 5, "退市 ").otherwise(""))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        code_of("s_suppkey").alias("code"), F.concat(mark, F.col("s_name")).alias("name"),
        F.col("n_name").alias("industry"),
        F.date_add(F.lit("1999-01-01").cast("date"), F.pmod(k * 37, F.lit(1100)).cast("int")).alias("list_date"),
        F.col("s_acctbal").alias("acctbal"),
        (F.abs("s_acctbal") * 5e6).alias("market_cap"), (F.abs("s_acctbal") * 3e6).alias("float_market_cap"),
        (F.col("s_acctbal") / 80.0).alias("pe_ttm"), (F.col("s_acctbal") / 700.0).alias("pb"),
        (F.col("s_acctbal") / 200.0 - 5.0).alias("roe"), F.pmod(k, F.lit(7)).cast("double").alias("grade_no"))


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Newest bar of each code joined to its stock row (unlisted codes drop out)."""
    from tidemark.functions.windows import latest_rows
    from tidemark.sources.bars import with_change
    last = latest_rows(with_change(bars(spark, sf)))
    return last.join(stocks(spark, sf), "code")


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly sums per supplier as statement items (one row per code and quarter)."""
    q = F.date_trunc("quarter", F.col("trade_date")).cast("date")
    g = legs(spark, sf).groupBy("code", q.alias("report_date")).agg(
        F.sum("l_extendedprice").alias("rev"), F.sum("volume").alias("qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)).alias("ret"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(0.0)).alias("opn"),
        F.count(F.lit(1)).alias("n"))
    return g


def balance_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).select(
        "code", "report_date", (F.col("rev") * 3.0).alias("total_assets"),
        (F.col("opn") * 2.5).alias("total_liabilities"), (F.col("rev") * 3.0 - F.col("opn") * 2.5).alias("total_equity"),
        (F.col("rev") * 1.2).alias("total_current_assets"), (F.col("opn") * 1.1).alias("total_current_liabilities"),
        (F.col("ret") * 0.5).alias("inventory"), (F.col("rev") * 0.3).alias("cash_and_deposits"),
        (F.col("opn") * 0.4).alias("accounts_receivable"), (F.col("qty") * 10.0).alias("share_capital"))


def income_statement(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).select(
        "code", "report_date", F.col("rev").alias("total_revenue"), (F.col("rev") * 0.95).alias("operating_revenue"),
        (F.col("ret") * 0.9 + F.col("rev") * 0.4).alias("total_cost"), (F.col("ret") * 0.8 + F.col("rev") * 0.3).alias("operating_cost"),
        (F.col("rev") * 0.6 - F.col("ret") * 0.9).alias("operating_profit"),
        (F.col("rev") * 0.5 - F.col("ret") * 0.8).alias("net_profit"),
        (F.col("rev") * 0.45 - F.col("ret") * 0.75).alias("net_profit_parent"),
        ((F.col("rev") * 0.45 - F.col("ret") * 0.75) / (F.col("qty") * 10.0)).alias("basic_eps"))


def cash_flow(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).select(
        "code", "report_date", (F.col("rev") * 0.4 - F.col("opn") * 0.3).alias("operating_cash_flow"),
        (F.col("opn") * 0.1).alias("cash_for_fixed_assets"))


def events_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as announcements of the codes."""
    o = table(spark, sf, "orders")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("forecast", "major", "equity", "halt", "resume")]),
                        (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    return o.select(
        code_of_mod("o_custkey").alias("code"), F.to_date("o_orderdate").alias("publish_date"), kind.alias("kind"),
        F.substring("o_orderpriority", 3, 20).alias("subtype"),
        (F.col("o_totalprice") / 100000.0).alias("ratio"), F.substring("o_orderpriority", 1, 1).cast("int").alias("importance"))


def code_of_mod(c: str):
    return F.lpad(F.pmod(F.col(c), F.lit(100)).cast("string"), 6, "0")


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Signed trade amounts per code and day as fund flow; holdings by price level."""
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    return legs(spark, sf).groupBy("code", "trade_date").agg(
        F.sum(sign * F.col("amount") / 100.0).alias("main_net"),
        F.sum(sign * F.col("volume")).alias("_v"), F.sum("volume").alias("_t"),
        F.avg("l_linenumber").alias("hold_ratio")).select(
        "code", "trade_date", "main_net", (F.col("_v") / F.col("_t") * 100.0).alias("main_ratio"), "hold_ratio")


def seats(spark: SparkSession, sf: str) -> DataFrame:
    """Trades as broker-seat records."""
    return legs(spark, sf).select(
        "code", "trade_date", F.concat(F.lit("seat"), F.pmod("l_partkey", F.lit(20)).cast("string")).alias("broker_name"),
        (F.col("l_returnflag") == "A").alias("is_institution"),
        ((F.col("volume") - 20.0) * F.col("open")).alias("net_buy_amount"), *LEG_ORDER[:2])


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id", code_of("user_id").alias("code"), F.col("ts"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), "B").otherwise("S").alias("side"))
