"""Structured Streaming forms of the live operators.

Late data is dropped past the watermark.  Arbitrary state is one bounded record
per code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.windows import CODE, div
from tidemark.operators.quote_scans import quote_scans
from tidemark.sources.files import upsert_daily

TICK = "code string, ts timestamp, price double, volume long, side string"
LEVEL = "array<struct<price: double, volume: long>>"
QUOTE = f"code string, ts timestamp, price double, asks {LEVEL}, bids {LEVEL}"
BAR = "code string, ts timestamp, open double, high double, low double, close double, volume long, amount double"


def parse_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON envelopes ``{type, data}`` to ``type, tick, quote, kline, bad``; ``bad`` keeps what does not parse."""
    env = F.from_json(F.col(value).cast("string"), "type string, data string")
    x = raw.select(F.col(value).cast("string").alias("_raw"), env.alias("_e"))
    kind = F.col("_e.type")

    def body(name: str, schema: str) -> Column:
        return F.when(kind == name, F.from_json(F.col("_e.data"), schema)).alias(name)

    x = x.select("_raw", kind.alias("type"), body("tick", TICK), body("quote", QUOTE), body("kline", BAR))
    known = F.coalesce("tick.code", "quote.code", "kline.code").isNotNull()
    return x.withColumn("bad", F.when(known, F.lit(None)).otherwise(F.col("_raw"))).drop("_raw")


def route(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.where(F.col(f"{kind}.code").isNotNull()).select(f"{kind}.*")


def latest_quote(quotes: DataFrame) -> DataFrame:
    """Newest record per code (update or complete mode)."""
    rest = [c for c in quotes.columns if c not in (CODE, "ts")]
    return quotes.groupBy(CODE).agg(F.max("ts").alias("ts"), F.max_by(F.struct(*rest), "ts").alias("_q")).select(CODE, "ts", "_q.*")


def tick_bars(ticks: DataFrame, width: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """OHLC, volume, amount and buy / sell volume per code and window (append mode)."""
    w = ticks.withWatermark("ts", delay).groupBy(CODE, F.window("ts", width).alias("w"))
    buy = F.col("side") == "B"
    return w.agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("amount"),
        F.sum(F.when(buy, F.col("volume")).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(~buy, F.col("volume")).otherwise(0)).alias("sell_volume")).select(
        CODE, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "amount", "buy_volume", "sell_volume")


def recent_ticks(ticks: DataFrame, n: int = 100) -> DataFrame:
    """After each micro-batch, the newest ``n`` ticks of every code that moved (update mode).

    The state is a list of at most ``n`` records per code.
    """
    out = T.StructType([T.StructField("code", T.StringType()), T.StructField("ts", T.ArrayType(T.TimestampType())),
                        T.StructField("price", T.ArrayType(T.DoubleType()))])
    state = T.StructType([T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("price", T.ArrayType(T.DoubleType()))])

    def keep(key: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        ts, price = (list(st.get[0]), list(st.get[1])) if st.exists else ([], [])
        for pdf in batches:
            ts += pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
            price += pdf["price"].tolist()
            order = sorted(range(len(ts)), key=lambda i: ts[i])[-n:]
            ts, price = [ts[i] for i in order], [price[i] for i in order]
        st.update((ts, price))
        yield pd.DataFrame({"code": [key[0]], "ts": [[pd.Timestamp(t, unit="us") for t in ts]], "price": [price]})

    return ticks.select(CODE, "ts", "price").groupBy(CODE).applyInPandasWithState(keep, out, state, "update", GroupStateTimeout.NoTimeout)


def window_alerts(ticks: DataFrame, width: str = "5 minutes", slide: str = "1 minute", delay: str = "2 minutes", move: float = 0.05,
                  surge: float = 3.0) -> DataFrame:
    """Sliding-window alerts: price move of at least ``move``; second-half volume ``surge`` times the first half."""
    x = ticks.withWatermark("ts", delay).withColumn("w", F.window("ts", width, slide))
    mid = (F.col("w.start").cast("double") + F.col("w.end").cast("double")) / 2
    late = F.sum(F.when(F.col("ts").cast("double") >= mid, F.col("volume")).otherwise(0))
    x = x.groupBy(CODE, "w").agg(F.min_by("price", "ts").alias("open"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), late.alias("_late"))
    change = div(F.col("close") - F.col("open"), "open")
    alerts = F.array_compact(F.array(
        F.when(F.abs(change) >= move, "price_move"), F.when((F.col("volume") > F.col("_late")) & (F.col("_late") >= (F.col("volume") - F.col("_late")) * surge), "volume_surge")))
    return x.withColumn("alerts", alerts).where(F.size("alerts") > 0).select(CODE, F.col("w.start").alias("start"), F.col("w.end").alias("end"), change.alias("change"), "volume", "alerts")


def board_events(snapshots: DataFrame) -> DataFrame:
    """``broken`` when a code leaves the limit pool, ``reseal`` when it comes back (append mode).

    ``snapshots``: ``code, ts, in_pool``.  The state per code: last flag and
    whether it broke before.
    """
    out, state = "code string, ts timestamp, event string", "flag boolean, broke boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        flag, broke = st.get if st.exists else (False, False)
        rows = pd.concat(list(batches)).sort_values("ts")
        ts, ev = [], []
        for t, now in zip(rows["ts"], rows["in_pool"]):
            if flag and not now:
                ts.append(t)
                ev.append("broken")
                broke = True
            elif now and not flag and broke:
                ts.append(t)
                ev.append("reseal")
            flag = bool(now)
        st.update((flag, broke))
        yield pd.DataFrame({"code": [key[0]] * len(ts), "ts": pd.to_datetime(ts), "event": ev})

    return snapshots.groupBy(CODE).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def suppress_duplicates(items: DataFrame, keys: list[str], hours: int = 24) -> DataFrame:
    """First of each key within the watermark."""
    return items.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(keys)


def upsert_sink(spark: SparkSession, path: str, sequence: str | None = None):
    """``foreachBatch`` writer merging bars by key: replaying a batch gives the same table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_daily(batch.sparkSession, path, batch, sequence=sequence)
    return write


def flush_ticks(ticks: DataFrame, path: str, checkpoint: str):
    """Ticks to files partitioned by date; returns the started writer definition."""
    day = ticks.withColumn("day", F.to_date("ts"))
    return day.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def scan_stream(quotes: DataFrame, features: DataFrame) -> DataFrame:
    """The nine quote scans on a stream of quotes and a static table of history features (append mode)."""
    return quote_scans(quotes, features)
