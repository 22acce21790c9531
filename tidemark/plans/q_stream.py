"""Streams replayed to their end over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import inputs as I
from tidemark.plans.catalog import query
from tidemark.plans.ctes import sql
from tidemark.plans.q_relational import scratch
from tidemark.streaming import stream as ST


def ticks(s, d):
    e = s.readStream.schema(I.table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select("event_id", I.code_of("user_id").alias("code"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
                    F.get_json_object("props", "$.k").cast("long").alias("volume"),
                    F.when(F.col("event_type").isin("click", "purchase", "signup"), "B").otherwise("S").alias("side"))


def to_files(s, df, mode="append"):
    path = scratch(s, "stream")
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-ckpt").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(df.schema).parquet(path)


def to_batches(s, df, mode):
    """Update and complete outputs by ``foreachBatch``: one folder per batch, so a retry overwrites its own."""
    path = scratch(s, "stream")

    def write(batch, i):
        batch.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/b={i}")
    df.writeStream.foreachBatch(write).option("checkpointLocation", path + "-ckpt").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(path).drop("b")


def messages(t):
    data = F.to_json(F.struct("code", "ts", "price", "volume", "side"))
    kind = F.when(F.col("side") == "B", "tick").otherwise("quote")
    return t.select(F.when(F.pmod("event_id", F.lit(10)) == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(kind.alias("type"), data.alias("data")))).alias("value"))


query("st01_parse_and_route", sql("SELECT CASE WHEN event_id%10=0 THEN 'bad' WHEN side='B' THEN 'tick' ELSE 'quote' END AS kind, count(*) AS n, round(sum(CASE WHEN event_id%10<>0 THEN price END),2) AS price FROM ticks GROUP BY 1", "ticks"))(
    lambda s, d: to_files(s, ST.parse_messages(messages(ticks(s, d)))).select(
        F.when(F.col("bad").isNotNull(), "bad").otherwise(F.col("type")).alias("kind"), F.coalesce("tick.price", "quote.price").alias("p")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 2).alias("price")))
query("st02_latest_quote", sql("SELECT code, arg_max(price, ts) AS price, arg_max(volume, ts) AS volume FROM ticks GROUP BY 1", "ticks"))(
    lambda s, d: to_batches(s, ST.latest_quote(ticks(s, d).select("code", "ts", "price", "volume")), "complete").transform(
        lambda x: x.groupBy("code").agg(F.max_by("price", "_batch").alias("price"), F.max_by("volume", "_batch").alias("volume"))))
query("st03_recent_ticks", sql("SELECT code, count(*) AS n, round(sum(price),4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS k FROM ticks) WHERE k<=20 GROUP BY 1", "ticks"))(
    lambda s, d: to_batches(s, ST.recent_ticks(ticks(s, d), 20), "update").groupBy("code").agg(F.max_by("price", "_batch").alias("p")).select(
        "code", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 4).alias("total")))
for width, secs in (("1 minute", 60), ("5 minutes", 300)):
    query(f"st04_tick_bars_{secs // 60}m", sql(f"""WITH w AS (SELECT *, to_timestamp(CAST(floor(epoch(ts)/{secs})*{secs} AS BIGINT)) AS st FROM ticks), b AS (SELECT code, st, arg_min(price,ts) AS open, max(price) AS high, arg_max(price,ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(CASE WHEN side='B' THEN volume ELSE 0 END) AS BIGINT) AS buy_volume FROM w GROUP BY ALL)
SELECT code, CAST(epoch(st) AS BIGINT) AS start, open, high, close, volume, buy_volume FROM b WHERE epoch(st)+{secs} <= (SELECT max(epoch(ts)) FROM ticks)-120""", "ticks"))(
        lambda s, d, width=width: to_files(s, ST.tick_bars(ticks(s, d), width)).select("code", F.col("start").cast("long").alias("start"), "open", "high", "close", "volume", "buy_volume"))
query("st05_window_alerts")(lambda s, d: to_files(s, ST.window_alerts(ticks(s, d), "6 hours", "2 hours", "2 minutes")).select("code", "start", "change", "volume", F.array_join("alerts", ",").alias("alerts")))
query("st07_board_events", sql("""WITH p AS (SELECT code, ts, price>60 AS f, coalesce(lag(price>60) OVER (PARTITION BY code ORDER BY ts), false) AS pf FROM ticks), b AS (SELECT *, coalesce(bool_or(pf AND NOT f) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS broke FROM p)
SELECT code, event, count(*) AS n FROM (SELECT code, CASE WHEN pf AND NOT f THEN 'broken' WHEN f AND NOT pf AND broke THEN 'reseal' END AS event FROM b) WHERE event IS NOT NULL GROUP BY ALL""", "ticks"))(
    lambda s, d: to_files(s, ST.board_events(ticks(s, d).select("code", "ts", (F.col("price") > 60).alias("in_pool")))).groupBy("code", "event").agg(F.count(F.lit(1)).alias("n")))
query("st09_suppress_duplicates", sql("SELECT count(DISTINCT (code, side)) AS n FROM ticks", "ticks"))(
    lambda s, d: to_files(s, ST.suppress_duplicates(ticks(s, d).select("code", "side", "ts"), ["code", "side"], 24 * 60)).agg(F.count(F.lit(1)).alias("n")))


def flushed(s, d):
    path = scratch(s, "ticks")
    ST.flush_ticks(ticks(s, d), path, path + "-ckpt").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


query("st10_flush_ticks", sql("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(price),2) AS price FROM ticks GROUP BY 1", "ticks"))(flushed)


def upserted(s, d):
    """Daily tick bars merged twice through the sink: the replay changes nothing."""
    path = scratch(s, "upsert")
    day = I.ticks(s, d).groupBy("code", F.to_date("ts").alias("trade_date")).agg(F.max("price").alias("high"))
    from tidemark.sources.files import save_daily
    save_daily(day.withColumn("high", F.lit(0.0)), path)
    sink = ST.upsert_sink(s, path)
    sink(day, 1)
    sink(day, 1)
    return s.read.parquet(path).select("code", "trade_date", "high")


query("st08_upsert_sink", sql("SELECT code, CAST(ts AS DATE) AS trade_date, max(price) AS high FROM ticks GROUP BY ALL", "ticks"))(upserted)
