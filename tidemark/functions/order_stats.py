"""Exact ranks, quantiles and top shares per group, safe for hot groups.

A window over ``partitionBy(date)`` puts every code of a date into one task,
and the exact ``percentile`` aggregate keeps a date's distinct values in one
buffer.  Here equal values are first counted map-side, large groups are cut at
values picked by hash, each piece is summed on its own, and only the totals of
the pieces (a few per group) are accumulated.  The cuts depend on the data
alone, so recomputed tasks see the same pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 500_000
_MOD = 1 << 30


def _cuts_up_to(value: str) -> Column:
    """How many of the sorted ``_cuts`` are at most ``value``, by halving."""
    size = F.size("_cuts")

    def half(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        open_ = s["lo"] < s["hi"]
        below = F.get("_cuts", mid) <= F.col(value)
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), half)["lo"]
    return F.when(F.col("_cuts").isNotNull(), found)


def order_stats(df: DataFrame, by: Sequence[str], value: str, piece: int = PIECE) -> DataFrame:
    """``by.., value, cnt, below, total``: multiplicity, rows below, group size."""
    if not by:
        return order_stats(df.withColumn("_all", F.lit(1)), ["_all"], value, piece).drop("_all")
    by = list(by)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
                .agg(F.count(F.lit(1)).alias("cnt")))
    share = max(1, int(_MOD * 4 / piece))
    cuts = (counts.where(F.pmod(F.xxhash64(value), F.lit(_MOD)) < share)
                  .groupBy(*[F.col(b).alias(f"_{b}") for b in by])
                  .agg(F.array_sort(F.collect_list(value)).alias("_cuts")))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    joined = counts.join(F.broadcast(cuts), on, "left")  # four cuts in PIECE distinct values
    pieces = joined.select(*by, value, "cnt", F.coalesce(_cuts_up_to(value), F.lit(0)).alias("_piece"))
    w = Window.partitionBy(*by, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = pieces.withColumn("_in", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    totals = pieces.groupBy(*by, "_piece").agg(F.sum("cnt").alias("_size"))
    wp = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*by)
    offsets = totals.select(
        *[F.col(b).alias(f"_{b}") for b in by], F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_size").over(wp), F.lit(0)).alias("_off"),
        F.sum("_size").over(wall).alias("total"))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col("_piece") == F.col("_p")]
    return inside.join(offsets, on).select(
        *by, value, "cnt", (F.col("_in") + F.col("_off")).alias("below"), "total")


def with_rank(df: DataFrame, by: Sequence[str], value: str, name: str, piece: int = PIECE) -> DataFrame:
    """Average rank (ties share the mean rank) of non-null values per group."""
    st = order_stats(df, by, value, piece).select(
        *[F.col(b).alias(f"_{b}") for b in by], F.col(value).alias("_v"),
        (F.col("below") + (F.col("cnt") + 1) / 2.0).alias(name))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col(value) == F.col("_v")]
    return df.join(st, on, "left").drop("_v", *[f"_{b}" for b in by])


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
              piece: int = PIECE) -> DataFrame:
    """Linear-interpolated quantiles per group, one row per group."""
    st = order_stats(df, by, value, piece)
    first, last = F.col("below"), F.col("below") + F.col("cnt") - 1
    x = F.col(value)
    aggs = []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        h = F.when(F.abs(h - F.round(h)) < 1e-9, F.round(h)).otherwise(h)  # 35 * 0.2 is not quite 7
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [
            F.max(F.when((first <= lo) & (lo <= last), x)).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi <= last), x)).alias(f"_hi_{name}"),
            F.max(h - lo).alias(f"_f_{name}"),
        ]
    out = st.groupBy(*by).agg(F.max("total").alias("n"), *aggs)
    cols = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs]
    return out.select(*by, "n", *cols)


def share_ends(df: DataFrame, by: Sequence[str], value: str, top: float, bottom: float, key: str = "code",
               piece: int = PIECE) -> DataFrame:
    """Flags ``in_top`` / ``in_bottom``: the best and worst ``floor(n * share)`` rows per group.

    ``n`` counts rows with a value; ``key`` (unique inside a group) breaks ties
    in ascending order.  One pass ranks values; only rows whose value straddles
    a border are ranked again, by key.
    """
    by = list(by)
    st = order_stats(df, by, value, piece)
    place = st.select(
        *[F.col(b).alias(f"_{b}") for b in by], F.col(value).alias("_v"), "cnt",
        F.floor(F.col("total") * F.lit(float(top))).alias("_kt"), F.floor(F.col("total") * F.lit(float(bottom))).alias("_kb"),
        (F.col("total") - F.col("below") - F.col("cnt")).alias("_at"), F.col("below").alias("_ab"))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col(value) == F.col("_v")]
    rows = df.join(place, on, "left").drop("_v", *[f"_{b}" for b in by])

    def whole(s: str) -> Column:
        return (F.col(f"_a{s}") + F.col("cnt")) <= F.col(f"_k{s}")

    def edge(s: str) -> Column:
        return (F.col(f"_a{s}") < F.col(f"_k{s}")) & ~whole(s)

    split = rows.where(edge("t") | edge("b"))
    ties = order_stats(split, [*by, value], key, piece).select(
        *[F.col(b).alias(f"_{b}") for b in by], F.col(key).alias("_key"), F.col("below").alias("_tie"))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col(key) == F.col("_key")]
    out = rows.join(ties, on, "left").drop("_key", *[f"_{b}" for b in by])

    def flag(s: str) -> Column:
        return F.coalesce(whole(s) | (edge(s) & ((F.col(f"_a{s}") + F.col("_tie")) < F.col(f"_k{s}"))), F.lit(False))

    return out.withColumns({"in_top": flag("t"), "in_bottom": flag("b")}).drop("cnt", "_kt", "_kb", "_at", "_ab", "_tie")


def top_share(df: DataFrame, by: Sequence[str], value: str, share: float, key: str = "code", piece: int = PIECE) -> DataFrame:
    """Flag ``in_top`` for the best ``floor(n * share)`` rows per group."""
    return share_ends(df, by, value, share, 0.0, key, piece).drop("in_bottom")


def quantile_bucket(df: DataFrame, by: Sequence[str], value: str, n: int, name: str = "bucket",
                    piece: int = PIECE, closed: str = "left") -> DataFrame:
    """Half-open buckets 1..n between interpolated cut values per group.

    ``closed`` names the side of a bucket its own cut belongs to.
    """
    if not by:
        whole = quantile_bucket(df.withColumn("_all", F.lit(1)), ["_all"], value, n, name, piece, closed)
        return whole.drop("_all")
    probs = {f"_q{i}": i / n for i in range(1, n)}
    q = quantiles(df, by, value, probs, piece).drop("n")
    q = q.select(*[F.col(b).alias(f"_{b}") for b in by], *probs)
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    out = df.join(q, on, "left")
    bucket: Column = F.lit(1)
    for p in probs:
        above = F.col(value) >= F.col(p) if closed == "left" else F.col(value) > F.col(p)
        bucket = bucket + F.when(above, 1).otherwise(0)
    out = out.withColumn(name, F.when(F.col(value).isNotNull(), bucket))
    return out.drop(*probs, *[f"_{b}" for b in by])
