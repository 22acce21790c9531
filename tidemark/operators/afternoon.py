"""Afternoon strategies over a pool of limit-up codes: each keeps its best, and a code goes to one strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, asof_backward, div, lag, rmax, rmean, wc
from tidemark.operators.strategies import pre_limit_probability

FIELDS = ["open", "close", "turnover_ratio", "change_pct", "volume_ratio", "inflow", "ma5", "ma10", "ma20", "pullback", "n_bars"]
STRATEGIES = ("limitup_callback", "dragon_head", "tail_rush", "fund_resonance")


def pool_indicators(bars: DataFrame) -> DataFrame:
    """What the strategies look at, per bar: averages of 5, 10 and 20 bars, volume and value against theirs, fall from the 40-bar high.

    ``bars`` has ``amount`` and ``turnover_ratio`` (a share). Before 20 bars ``volume_ratio`` is against those there are.
    """
    high = rmax("high", 40, min_rows=1)
    return bars.select(CODE, DATE, "open", "close", "turnover_ratio", div(F.col("close") - lag("close"), lag("close")).alias("_chg"), F.row_number().over(wc()).alias("n_bars"),
                       div("volume", rmean("volume", 20, min_rows=1)).alias("volume_ratio"), div(F.col("amount") - rmean("amount", 20), rmean("amount", 20)).alias("inflow"),
                       *[rmean("close", n).alias(f"ma{n}") for n in (5, 10, 20)], div(high - F.col("close"), high).alias("pullback")
                       ).withColumn("change_pct", F.coalesce(F.col("_chg") * 100, F.lit(0.0))).drop("_chg")


def continuation(rows: DataFrame) -> DataFrame:
    """``probability`` (0 to 100) that a code goes on rising next day, from its change, volume and turnover; no seal or sector known."""
    x = rows.withColumns({"turnover_rate": F.col("turnover_ratio") * 100, **{c: F.lit(0.0) for c in ("seal_amount", "seal_ratio", "sector_change", "sector_limit_count")}})
    return pre_limit_probability(x).select(*rows.columns, "probability")


def wanted(pool: DataFrame, bars: DataFrame, max_turnover: float = 0.15, min_turnover: float = 0.05, max_days: int = 3, min_days: int = 3, fall: tuple[float, float] = (0.05, 0.15),
           surge: float = 1.5, min_inflow: float = 0.10, near: float = 0.02) -> DataFrame:
    """One row per pool row and strategy that wants it, with prices, confidence and what it is ranked by.

    ``pool`` is ``trade_date, code, consecutive_days``; its rows are met with the code's newest bar on or before the date.
    """
    x = continuation(asof_backward(pool, pool_indicators(bars), FIELDS))
    c, turn, ratio, m20, down, days, n = (F.col(k) for k in ("close", "turnover_ratio", "volume_ratio", "ma20", "pullback", "consecutive_days", "n_bars"))
    conf = 0.75 + (down - fall[0]) * 2
    rules = [
        ((n >= 20) & (days <= max_days) & (turn <= max_turnover) & c.between(m20 * (1 - near), m20 * (1 + near)) & (c > F.col("open")) & (ratio > surge),
         F.lit(0.8), F.lit(0.8), c, m20 * 0.97, c * 1.10, c * 1.20),
        ((n >= 30) & (days >= min_days) & down.between(*fall) & (F.col("ma5") > F.col("ma10")) & (c > F.col("ma5")), conf, conf, c, c * 0.93, c * 1.10, c * 1.20),
        ((n >= 20) & (turn >= min_turnover) & (ratio >= surge), F.lit(0.65), ratio, c * 1.02, c * 0.95, c * 1.05, c * 1.10),
        ((n >= 20) & (turn >= min_turnover) & (c > m20) & (F.col("inflow") >= min_inflow), F.lit(0.70), F.col("inflow"), c * 1.02, m20 * 0.98, c * 1.08, c * 1.15)]
    each = [F.when(test, F.struct(F.lit(i).alias("priority"), F.lit(name).alias("strategy"), conf.cast("double").alias("confidence"), by.cast("double").alias("ranked_by"),
                                  entry.alias("entry_price"), stop.alias("stoploss_price"), one.alias("take_profit_1"), two.alias("take_profit_2")))
            for i, (name, (test, conf, by, entry, stop, one, two)) in enumerate(zip(STRATEGIES, rules))]
    found = x.select(DATE, CODE, "probability", F.explode(F.array_compact(F.array(*each))).alias("s"))
    return found.select(DATE, CODE, "probability", "s.*")


def allocate(candidates: DataFrame, best: int = 1, exclusive: bool = True) -> DataFrame:
    """The ``best`` rows of each strategy per date. A code that an earlier strategy took leaves the later ones' lists.

    Earlier strategies can take no more than their ``best`` each, so that many further rows of a strategy are enough; the fold over
    this bounded list is exact. With ``exclusive=False`` strategies choose apart.
    """
    order = Window.partitionBy(DATE, "priority").orderBy(F.col("ranked_by").desc(), CODE)
    some = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best * len(STRATEGIES))
    rest = [c for c in candidates.columns if c not in (DATE, "priority", CODE)]
    lists = some.groupBy(DATE).agg(F.array_sort(F.collect_list(F.struct("priority", "rank", CODE, *rest))).alias("list"))

    def step(taken, x):
        full = F.size(F.filter(taken, lambda t: t["priority"] == x["priority"])) >= best
        gone = F.exists(taken, lambda t: t[CODE] == x[CODE]) if exclusive else F.lit(False)
        return F.when(full | gone, taken).otherwise(F.concat(taken, F.array(x)))

    picks = F.aggregate("list", F.filter("list", lambda x: F.lit(False)), step)
    return lists.select(DATE, F.explode(picks).alias("p")).select(DATE, "p.*")


def afternoon_picks(pool: DataFrame, bars: DataFrame, existing: DataFrame | None = None, best: int = 1, exclusive: bool = True, **limits) -> DataFrame:
    """Picks of all strategies per date; ``existing`` picks (``trade_date, code``) leave the pool first."""
    if existing is not None:
        pool = pool.join(existing.select(DATE, CODE).distinct(), [DATE, CODE], "left_anti")
    return allocate(wanted(pool, bars, **limits), best, exclusive)


def predicted_picks(pool: DataFrame, bars: DataFrame, least: float = 60.0) -> DataFrame:
    """Pool rows with ten bars or more whose continuation probability is ``least`` or more, with entry, stop and targets."""
    x = continuation(asof_backward(pool, pool_indicators(bars), FIELDS)).where((F.col("n_bars") >= 10) & (F.col("probability") >= least))
    c = F.col("close")
    return x.select(DATE, CODE, "probability", c.alias("entry_price"), (c * 0.95).alias("stoploss_price"), (c * 1.10).alias("take_profit_1"), (c * 1.20).alias("take_profit_2"))
