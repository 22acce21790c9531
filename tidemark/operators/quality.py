"""Data-quality expectations, gap checks, diffs and run statistics, all as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, close, div, lag


@dataclass(frozen=True)
class Expect:
    """One expectation; ``kind`` is a key of the rules below."""

    kind: str
    column: str = ""
    args: tuple[Any, ...] = ()
    mostly: float = 1.0

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column})" if self.column else self.kind


def ohlc_ok() -> Column:
    return (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.col("low"))


# Ready suites.
BAR_SUITE = [Expect("exists", c) for c in ("code", "trade_date", "open", "high", "low", "close", "volume")] + [
    Expect("not_null", "code"), Expect("not_null", "trade_date"), Expect("not_null", "close", mostly=0.99),
    Expect("between", "close", (0.01, 10000.0)), Expect("between", "volume", (0, None)), Expect("ohlc"),
    Expect("unique", "code,trade_date"), Expect("row_count", "", (1, None))]
STOCK_SUITE = [Expect("exists", "code"), Expect("exists", "name"), Expect("not_null", "code"), Expect("unique", "code"), Expect("row_count", "", (1, None))]


def validate(df: DataFrame, suite: Sequence[Expect]) -> DataFrame:
    """One row per expectation: tested rows, passed rows, share and success.

    Row rules share one aggregate pass; each uniqueness rule adds one grouped
    count.  ``between`` and ``in_set`` leave nulls out of the tested rows.
    """
    n = F.count(F.lit(1))
    parts: list[tuple[Expect, Column, Column]] = []
    extra: list[DataFrame] = []
    types = dict(df.dtypes)
    for e in suite:
        c = F.col(e.column) if e.column in df.columns else None
        if e.kind == "exists":
            parts.append((e, F.lit(1).cast("long"), F.lit(int(e.column in df.columns)).cast("long")))
        elif e.kind == "type":
            parts.append((e, F.lit(1).cast("long"), F.lit(int(types.get(e.column) == e.args[0])).cast("long")))
        elif e.kind == "row_count":
            lo, hi = e.args
            ok = (n >= (lo or 0)) & (n <= hi if hi is not None else F.lit(True))
            parts.append((e, F.lit(1).cast("long"), ok.cast("long")))
        elif e.kind == "ohlc":
            parts.append((e, n, F.count_if(ohlc_ok())))
        elif e.kind == "unique":
            keys = [F.col(k) for k in e.column.split(",")]
            g = df.groupBy(*keys).agg(n.alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("tested"), F.count_if(F.col("_n") == 1).alias("passed"))
            extra.append(g.select(F.lit(e.name).alias("expectation"), "tested", "passed", F.lit(e.mostly).alias("mostly")))
        elif c is None:
            parts.append((e, F.lit(1).cast("long"), F.lit(0).cast("long")))
        elif e.kind == "not_null":
            parts.append((e, n, F.count(c)))
        elif e.kind == "between":
            lo, hi = e.args
            ok = reduce(lambda a, b: a & b, [x for x in (c >= lo if lo is not None else None, c <= hi if hi is not None else None) if x is not None])
            parts.append((e, F.count(c), F.count_if(ok)))
        elif e.kind == "in_set":
            parts.append((e, F.count(c), F.count_if(c.isin(*e.args))))
        elif e.kind == "equal":
            parts.append((e, n, F.count_if(c.eqNullSafe(F.col(e.args[0])))))
        else:
            raise ValueError(f"unknown expectation {e.kind!r}")
    one = df.agg(*[x.alias(f"t{i}") for i, (_, x, _) in enumerate(parts)], *[x.alias(f"p{i}") for i, (_, _, x) in enumerate(parts)])
    rows = F.array(*[F.struct(F.lit(e.name).alias("expectation"), F.col(f"t{i}").alias("tested"), F.col(f"p{i}").alias("passed"), F.lit(e.mostly).alias("mostly"))
                     for i, (e, _, _) in enumerate(parts)])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    for x in extra:
        out = out.unionByName(x)
    share = F.when(F.col("tested") == 0, 1.0).otherwise(F.col("passed") / F.col("tested"))
    return out.withColumns({"share": share, "success": share >= F.col("mostly")}).drop("mostly")


def stage_status(results: DataFrame, warn: float = 0.8) -> DataFrame:
    """Status of a stage from its expectation results: passed, warning or failed."""
    r = F.avg(F.col("success").cast("double"))
    return results.agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_ok"),
                       F.when(r == 1, "passed").when(r >= warn, "warning").otherwise("failed").alias("status"))


def bar_checks(bars: DataFrame, max_gap: int = 5) -> DataFrame:
    """Price, OHLC, volume and continuity problems per code."""
    gap = F.datediff(DATE, lag(DATE))
    x = bars.withColumn("_gap", gap)
    bad = (F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)
    return x.groupBy(CODE).agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_price"), F.count_if(~ohlc_ok()).alias("bad_ohlc"),
                               F.count_if(F.col("volume") < 0).alias("bad_volume"), F.count_if(F.col("_gap") > max_gap).alias("gaps"),
                               F.max("_gap").alias("longest_gap"))


def panel_checks(bars: DataFrame, cols: Sequence[str], max_change: float = 25.0, coverage: float = 0.5) -> DataFrame:
    """Missing fields, price, volume and change validity, and newest-date coverage, as one row per check."""
    per = bars.groupBy(DATE).agg(F.countDistinct(CODE).alias("_c"))
    cov = per.agg(F.max_by("_c", DATE).alias("_last"), F.max("_c").alias("_most")).withColumn("_k", F.lit(1))
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols],
            F.count_if(close() <= 0).alias("bad_price"), F.count_if(F.col("volume") < 0).alias("bad_volume"),
            F.count_if(F.abs("pct_chg") > max_change).alias("bad_change")]
    one = bars.agg(*aggs).withColumn("_k", F.lit(1)).join(cov, "_k")
    names = [*[f"missing_{c}" for c in cols], "bad_price", "bad_volume", "bad_change"]
    rows = [F.struct(F.lit(x).alias("check"), F.col(x).alias("count"), (F.col(x) == 0).alias("ok")) for x in names]
    rows.append(F.struct(F.lit("latest_coverage").alias("check"), F.col("_last").alias("count"), (F.col("_last") >= F.col("_most") * coverage).alias("ok")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def weekdays_to(bars: DataFrame, target: str, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays after each code's newest bar up to ``target``: the days to fetch."""
    t = F.lit(target).cast("date")
    last = bars.groupBy(CODE).agg(F.max(DATE).alias("last")).where(F.col("last") < t)
    x = last.select(CODE, F.explode(F.sequence(F.date_add("last", 1), t)).alias(DATE)).where(F.weekday(DATE) < 5)
    return x.join(holidays.select(F.col("holiday").alias(DATE)), DATE, "left_anti").select(CODE, DATE) if holidays is not None else x


def stale_codes(bars: DataFrame, target: str) -> DataFrame:
    return bars.groupBy(CODE).agg(F.max(DATE).alias("last_date")).where(F.col("last_date") < F.lit(target).cast("date"))


def gap_days(bars: DataFrame, min_gap: int = 7) -> DataFrame:
    """Weekdays inside gaps of more than ``min_gap`` days between two bars of a code."""
    x = bars.select(CODE, DATE, lag(DATE).alias("_p")).where(F.datediff(DATE, "_p") > min_gap)
    days = F.sequence(F.date_add("_p", 1), F.date_sub(DATE, 1))
    return x.select(CODE, F.explode(days).alias("missing")).where(F.weekday("missing") < 5)


def content_hash(df: DataFrame, key: str = CODE) -> DataFrame:
    """Order-free content hash per key: row hashes summed, so partial sums combine map-side."""
    h = F.xxhash64(*[c for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("hash"))


def content_changes(old: DataFrame, new: DataFrame, key: str = CODE) -> DataFrame:
    a = content_hash(old, key).withColumnsRenamed({"rows": "old_rows", "hash": "_ho"})
    b = content_hash(new, key).withColumnsRenamed({"rows": "new_rows", "hash": "_hn"})
    x = a.join(b, key, "full")
    status = (F.when(F.col("_ho").isNull(), "added").when(F.col("_hn").isNull(), "removed")
              .when(F.col("_ho") == F.col("_hn"), "same").otherwise("changed"))
    return x.select(key, "old_rows", "new_rows", status.alias("status"))


def overall_score(parts: Mapping[str, float]) -> tuple[float, str]:
    """Weighted collection / completeness / freshness / consistency score and level; a driver-side summary of four numbers."""
    # Weights of the parts.
    weights = {"collection": 0.3, "completeness": 0.3, "freshness": 0.2, "consistency": 0.2}
    s = sum(parts[k] * w for k, w in weights.items())
    return s, "excellent" if s >= 95 else "good" if s >= 85 else "fair" if s >= 70 else "poor"


def table_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added and removed rows and changed cells by key, in long form."""
    cols = [c for c in old.columns if c in new.columns and c not in keys]
    a = old.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in cols]).alias("_a"))
    b = new.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in cols]).alias("_b"))
    x = a.join(b, list(keys), "full")
    cells = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.struct(
        F.lit(c).alias("column"), F.col(f"_a.{c}").alias("old"), F.col(f"_b.{c}").alias("new"))) for c in cols]))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(F.lit("*").alias("column"), none.alias("old"), none.alias("new")))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("modified")
    return x.select(*keys, kind.alias("change"), F.explode(F.when(F.col("_a").isNull() | F.col("_b").isNull(), whole).otherwise(cells)).alias("c")).select(
        *keys, "change", "c.*")


def lineage_reach(edges: DataFrame, start: DataFrame, direction: str = "downstream", max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from ``start(node)`` over ``edges(src, dst)`` with their depth, until no new node is met; ``max_depth`` ends the walk earlier.

    Each round is checkpointed, so the plan stays short and lost executors do not
    replay the walk.
    """
    from tidemark.session import checkpoint_dir
    if direction == "upstream":
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    checkpoint_dir(edges.sparkSession)
    edges = edges.select("src", "dst").distinct()
    seen = start.select("node", F.lit(0).alias("depth"))
    front = seen
    d = 0
    while max_depth is None or d < max_depth:
        d += 1
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def audit_anomalies(events: DataFrame, per_minute: int = 100, open_hour: int = 9, close_hour: int = 18,
                    sensitive: Sequence[str] = ("financial", "user")) -> DataFrame:
    """Bursts per user and minute, deletes or exports off hours, exports of sensitive types.

    ``events``: ``user, ts, action, data_type``.
    """
    burst = (events.groupBy("user", F.date_trunc("minute", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
                   .where(F.col("n") > per_minute).select("user", "ts", F.lit("burst").alias("anomaly"), "n"))
    off = events.where(F.col("action").isin("delete", "export") & ((F.hour("ts") < open_hour) | (F.hour("ts") >= close_hour)))
    sens = events.where((F.col("action") == "export") & F.col("data_type").isin(*sensitive))
    one = F.lit(1).cast("long").alias("n")
    return burst.unionByName(off.select("user", "ts", F.lit("off_hours").alias("anomaly"), one)).unionByName(
        sens.select("user", "ts", F.lit("sensitive_export").alias("anomaly"), one))


def run_statistics(runs: DataFrame, by: str) -> DataFrame:
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("ok")).alias("succeeded"),
                                (F.count_if(F.col("ok")) / F.count(F.lit(1))).alias("success_rate"), F.max("ts").alias("last_run"))


def recent_duplicates(items: DataFrame, content: str, ts: str = "ts", hours: int = 24, slot: int = 600) -> DataFrame:
    """Items whose content already occurred within the last hours (previous occurrence by hash).

    A content repeated very often is one hot group, so its copies are cut into
    time slots; the copy before a slot's first one comes from a table of slots,
    which time bounds.
    """
    secs = F.col(ts).cast("timestamp").cast("double")
    x = items.withColumns({"_h": F.xxhash64(content), "_t": secs}).withColumn("_slot", F.floor(F.col("_t") / slot))
    slots = x.groupBy("_h", "_slot").agg(F.max("_t").alias("_last"))
    slots = slots.select("_h", "_slot", F.lag("_last").over(Window.partitionBy("_h").orderBy("_slot")).alias("_before"))
    x = x.withColumn("_p", F.lag("_t").over(Window.partitionBy("_h", "_slot").orderBy("_t"))).join(slots, ["_h", "_slot"])
    age = F.col("_t") - F.coalesce("_p", "_before")
    return x.withColumn("is_duplicate", F.coalesce(age <= hours * 3600, F.lit(False))).drop("_h", "_t", "_slot", "_p", "_before")


def compare_sources(a: DataFrame, b: DataFrame, cols: Sequence[str] = ("open", "high", "low", "close", "volume"), tol: float = 0.01) -> DataFrame:
    """Two bar sources joined by key: which side is missing, and relative differences over ``tol``."""
    x = a.select(CODE, DATE, F.lit(1).alias("_in_a"), *[F.col(c).alias(f"_a_{c}") for c in cols]).join(
        b.select(CODE, DATE, F.lit(1).alias("_in_b"), *[F.col(c).alias(f"_b_{c}") for c in cols]), [CODE, DATE], "full")
    diffs = F.array_compact(F.array(*[F.when(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) > F.abs(F.col(f"_b_{c}")) * tol, c) for c in cols]))
    status = F.when(F.col("_in_a").isNull(), "only_b").when(F.col("_in_b").isNull(), "only_a").when(F.size(diffs) > 0, "different").otherwise("equal")
    return x.select(CODE, DATE, status.alias("status"), F.array_join(diffs, ",").alias("columns"))


def clean_bars(bars: DataFrame, max_change: float = 20.0) -> DataFrame:
    """Positive prices, volume at least 0, open-to-close change within bounds, one row per key, quality tags."""
    ok = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (close() > 0) & (F.col("volume") >= 0)
    chg = div(close() - F.col("open"), "open") * 100
    x = bars.where(ok).withColumn("pct_change", chg).where(F.abs("pct_change") <= max_change)
    # of rows for one key the largest volume stays, then the largest of the other columns
    rest = ["volume", *[c for c in x.columns if c not in (CODE, DATE, "volume")]]
    x = x.groupBy(CODE, DATE).agg(F.max(F.struct(*rest)).alias("_r")).select(CODE, DATE, "_r.*").select(*x.columns)
    return x.withColumn("quality", F.when(F.col("volume") == 0, "suspended").when(~ohlc_ok(), "suspect").otherwise("good"))


def valid_rows(df: DataFrame, max_close: float = 500.0, max_volume: float = 5e9, max_change: float = 25.0) -> DataFrame:
    return df.where((close() > 0) & (close() <= max_close) & (F.col("volume") <= max_volume) & (F.abs("pct_chg") <= max_change))


def issue_list(bars: DataFrame, spike: float = 20.0, max_gap: int = 7) -> DataFrame:
    """Gap, spike and OHLC issues with counts and maxima."""
    x = bars.withColumn("_g", F.datediff(DATE, lag(DATE)))
    for c in ("open", "high", "low", "close"):
        x = x.withColumn(f"_{c}", F.abs(div(F.col(c), lag(c)) - 1) * 100)
    aggs = {"gap": (F.col("_g") > max_gap, F.col("_g").cast("double")), "ohlc": (~ohlc_ok(), F.lit(1.0)),
            **{f"spike_{c}": (F.col(f"_{c}") > spike, F.col(f"_{c}")) for c in ("open", "high", "low", "close")}}
    one = x.agg(*[F.count_if(p).alias(f"n_{k}") for k, (p, _) in aggs.items()], *[F.max(F.when(p, v)).alias(f"m_{k}") for k, (p, v) in aggs.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("issue"), F.col(f"n_{k}").alias("count"), F.col(f"m_{k}").alias("maximum")) for k in aggs])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("count > 0")


def freshness(bars: DataFrame, target: str, cutoff_days: int = 30, delisted: DataFrame | None = None) -> DataFrame:
    """Class per code: current, suspended (stale within the cutoff), needs_update, delisted."""
    last = bars.groupBy(CODE).agg(F.max(DATE).alias("last_date"))
    t = F.lit(target).cast("date")
    x = last.join(delisted.select(CODE, F.lit(1).alias("_d")), CODE, "left") if delisted is not None else last.withColumn("_d", F.lit(None))
    cls = (F.when(F.col("_d").isNotNull(), "delisted").when(F.col("last_date") >= t, "current")
           .when(F.datediff(t, "last_date") <= cutoff_days, "suspended").otherwise("needs_update"))
    return x.select(CODE, "last_date", cls.alias("freshness"))


def invalid_series(bars: DataFrame, oldest: str, min_rows: int = 10) -> DataFrame:
    g = bars.groupBy(CODE).agg(F.count(F.lit(1)).alias("rows"), F.max(DATE).alias("last_date"))
    reason = F.when(F.col("last_date") < F.lit(oldest).cast("date"), "too_old").when(F.col("rows") < min_rows, "too_short")
    return g.withColumn("reason", reason).where("reason is not null")


def intraday_written(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows fetched on a weekday between 9:30 and 15:00."""
    m = F.hour(ts) * 60 + F.minute(ts)
    return df.where((F.weekday(ts) < 5) & (m >= 570) & (m <= 900))
