"""Five-layer funnel over each code's newest bars, its accounting, and the picks drawn from it.

One scan of the bars gives a row per code. The layers then work on that row; what a layer lets through is cut to the first
``retention`` share by code. ``reached`` counts the layers a code stayed in, ``passed`` those whose test it met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import tails as T
from tidemark.functions.order_stats import order_stats
from tidemark.functions.windows import CODE, DATE
from tidemark.session import checkpoint_dir
from tidemark.sources.bars import with_change

# fixed values
RETENTION = 0.85
WEIGHTS = {"layer1": 0.1, "layer2": 0.15, "layer3": 0.25, "layer4": 0.2, "layer5": 0.3}
LAYER_SCORE = 80.0


def code_metrics(bars: DataFrame, as_of=None) -> DataFrame:
    """One row per code from its last 60 bars up to ``as_of``; means over fewer bars where there are fewer."""
    b = bars if "pct_chg" in bars.columns else with_change(bars)
    rows = T.newest_bars(b, 60, ["close", "high", "low", "volume", "pct_chg", "turnover"], as_of)
    means = {f"ma{n}": T.mean(T.tail("close", n)) for n in (5, 10, 20)} | {f"vol{n}": T.mean(T.tail("volume", n)) for n in (5, 10, 20)}
    m = T.macd("close", F.lit(12), F.lit(26), F.lit(9))
    rows = rows.withColumns({
        "n_bars": T.size(), "data_date": T.at(DATE), "close": T.at("close"), "low": T.at("low"), "volume": T.at("volume"),
        "pct_chg": T.at("pct_chg"), "turnover": T.at("turnover"), "high_20": F.array_max(T.tail("high", 20)),
        "limit_ups_20": F.size(F.filter(T.tail("pct_chg", 20), lambda x: x >= 9.9)),
        "limit_ups": F.size(F.filter(T.series("pct_chg"), lambda x: x >= 9.9)),
        "_std": T.deviation(T.tail("close", 20)), "_macd": m, **means})
    return rows.withColumns({
        "volume_ratio": F.when(F.col("vol20") > 0, F.col("volume") / F.col("vol20")).otherwise(1.0),
        "volatility": F.when(F.col("ma20") > 0, F.col("_std") / F.col("ma20")).otherwise(0.0),
        "macd": F.when(F.col("n_bars") >= 35, F.col("_macd.line") - F.col("_macd.signal")).otherwise(0.0),
    }).drop(T.BARS, "_std", "_macd")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _through(rows: DataFrame, layer: int, test: Column, retention: float) -> DataFrame:
    """Rows in the layer before that meet ``test``, cut to their first share by code, step on to ``layer``."""
    rows = rows.withColumn("passed", F.when((F.col("reached") == layer - 1) & _sure(test), layer).otherwise(F.col("passed"))).checkpoint()
    place = order_stats(rows.where(F.col("passed") == layer).select(CODE), [], CODE)
    place = place.select(CODE, (F.col("below") < F.greatest(F.floor(F.col("total") * F.lit(retention)), F.lit(1))).alias("_kept"))
    kept = rows.join(place, CODE, "left")
    return kept.withColumn("reached", F.when(F.col("_kept"), layer).otherwise(F.col("reached"))).drop("_kept").checkpoint()


def funnel(bars: DataFrame, names: DataFrame, as_of=None, retention: float = RETENTION, max_age: int = 30,
           min_turnover_rows: int = 10, free_places: int = 50) -> DataFrame:
    """Every code with its metrics, ``passed`` and ``reached`` (0 to 5).

    1 no risk mark, traded, change within 9.9 %, newest bar within ``max_age`` days of the newest of those; 2 a turnover,
    if more than ``min_turnover_rows`` have one; 3 twenty bars and volume over its mean or rising averages; 4 volume of five
    days over 0.8 of ten; 5 a limit-up in twenty bars, a close near the high, a touch of the mean, or one of the first
    ``free_places`` by code. A code without a name has no mark; without a change it fails the first layer.
    """
    checkpoint_dir(bars.sparkSession)
    name = names.groupBy(CODE).agg(F.min("name").alias("name"))
    rows = code_metrics(bars, as_of).join(name, CODE, "left").withColumns({"passed": F.lit(0), "reached": F.lit(0)}).checkpoint()
    c = F.col
    sound = _sure(~F.upper(F.coalesce(c("name"), F.lit(""))).rlike("ST|退市") & (c("volume") > 0) & (c("pct_chg") > -9.9) & (c("pct_chg") < 9.9))
    newest = rows.where(sound).agg(F.max("data_date").alias("_newest"))
    rows = _through(rows.crossJoin(F.broadcast(newest)), 1, sound & (c("data_date") >= F.date_sub(c("_newest"), max_age)), retention).drop("_newest")

    with_turnover = rows.where("reached = 1").agg(F.count_if(c("turnover") > 0).alias("_n"))
    rows = _through(rows.crossJoin(F.broadcast(with_turnover)), 2, (c("_n") <= min_turnover_rows) | (c("turnover") > 0), retention).drop("_n")

    rising = (c("ma5") > c("ma10")) & (c("ma10") > c("ma20"))
    rows = _through(rows, 3, (c("n_bars") >= 20) & ((c("volume_ratio") > 1.0) | rising), retention)
    rows = _through(rows, 4, (c("n_bars") >= 5) & (c("vol5") > c("vol10") * 0.8), retention)

    place = order_stats(rows.where("reached = 4 and n_bars >= 20").select(CODE), [], CODE).select(CODE, c("below").alias("_place"))
    rows = rows.withColumns({
        "has_limit_gene": c("limit_ups_20") > 0, "is_breakout": c("close") >= c("high_20") * 0.98,
        "is_callback": (c("low") <= c("ma5") * 1.02) & (c("close") >= c("ma5") * 0.98)})
    pattern = _sure(c("has_limit_gene")) | _sure(c("is_breakout")) | _sure(c("is_callback"))
    return _through(rows.join(place, CODE, "left"), 5, (c("n_bars") >= 20) & (pattern | _sure(c("_place") < free_places)), retention).drop("_place")


def accounting(rows: DataFrame) -> DataFrame:
    """Per layer: rows that came in, met the test, were kept, and the kept share. One aggregate over the layers a row saw."""
    seen = rows.select("passed", "reached", F.explode(F.sequence(F.lit(1), F.least(F.col("reached") + 1, F.lit(5)))).alias("layer"))
    out = seen.groupBy("layer").agg(F.count(F.lit(1)).alias("n_in"), F.count_if(F.col("passed") >= F.col("layer")).alias("n_passed"),
                                    F.count_if(F.col("reached") >= F.col("layer")).alias("n_kept"))
    return out.withColumn("kept_share", F.col("n_kept") / F.col("n_in"))


def funnel_score(rows: DataFrame) -> DataFrame:
    """Weighted layer scores; a layer without a column scores 80."""
    total = sum((F.coalesce(F.col(k).cast("double"), F.lit(LAYER_SCORE)) if k in rows.columns else F.lit(LAYER_SCORE)) * w for k, w in WEIGHTS.items())
    return rows.withColumn("funnel_score", total)


def funnel_picks(rows: DataFrame, turnover_scale: float = 100.0) -> DataFrame:
    """Codes that reached the end and have thirty bars: rule score, entry, stop, targets, support and resistance."""
    c = F.col
    rate = F.coalesce(c("turnover"), F.lit(0.0)) * turnover_scale
    change = F.coalesce(c("pct_chg"), F.lit(0.0))
    score = (c("funnel_score") * 0.3
             + F.when(change >= 5, 20).when(change >= 3, 15).when(change >= 0, 10).otherwise(0)
             + F.when(c("volume_ratio") >= 2, 15).when(c("volume_ratio") >= 1.5, 10).otherwise(0)
             + F.when(rate >= 5, 10).when(rate >= 3, 5).otherwise(0)
             + F.when((c("ma5") > c("ma10")) & (c("ma10") > c("ma20")), 15).otherwise(0)
             + F.when(c("macd") > 0, 10).otherwise(0)
             + F.least(c("limit_ups") * 3, F.lit(15))
             + F.when(c("volatility") < 0.05, 5).otherwise(0))
    picks = funnel_score(rows.where("reached = 5 and n_bars >= 30"))
    return picks.withColumns({
        "rule_score": F.least(score, F.lit(100.0)), "entry_price": c("close"), "stoploss_price": c("close") * 0.95,
        "take_profit_1": c("close") * 1.10, "take_profit_2": c("close") * 1.20, "support_price": c("ma20") * 0.98,
        "resistance_price": c("high_20") * 1.02, "turnover_rate": rate, "trend": F.when(c("ma5") > c("ma20"), "up").otherwise("sideways")})
