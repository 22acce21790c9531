"""Model features, screens, training and scoring with Spark ML."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, QuantileDiscretizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, close, corr, div, lag, rmax, rmean, rmin, rstd, vol, wc
from tidemark.operators.evaluate import by_dates, daily_ic, is_stored, materialize, to_long
from tidemark.operators.relational import rank_label
from tidemark.operators.technical import macd, rsi
from tidemark.session import stored
from tidemark.sources.bars import day_index


def lagged_proxies(bars: DataFrame) -> DataFrame:
    """Point-in-time fundamental proxies: every input is one bar old.

    Real columns (``pe_ttm, pb, roe, revenue_growth``) are used inside their
    valid ranges, the price proxies elsewhere.
    """
    keep = bars.columns
    x = bars.withColumns({"_c": lag("close"), "_v": lag("volume"), "_h": lag("high"), "_l": lag("low")})
    x = x.withColumn("_r", div(F.col("_c"), lag("_c")) - 1)
    x = x.withColumns({"_m": rmean("_c", 20), "_s": rstd("_c", 20), "_vm": rmean("_v", 20), "_hi": rmax("_h", 20), "_lo": rmin("_l", 20),
                       "_r60": rmean("_r", 60), "_s60": rstd("_r", 60), "_r20": rmean("_r", 20), "_r120": rmean("_r", 120)})
    c = F.col

    def real(name: str, ok, proxy):
        return F.when(ok, c(name)).otherwise(proxy) if name in keep else proxy

    pe_proxy = c("_m") / (c("_s") + 0.001) if "pe_ttm" in keep else c("_c") / (c("_m") * c("_vm") / 1e6 + 0.001)
    pe = real("pe_ttm", (c("pe_ttm") > 0) & (c("pe_ttm") < 200), pe_proxy)
    pb_proxy = div("_c", "_m")
    pb = real("pb", (c("pb") > 0) & (c("pb") < 20), pb_proxy)
    roe_proxy = c("_r60") / (c("_s60") + 0.001) * 10
    roe = real("roe", F.abs("roe") < 100, roe_proxy)
    rg_proxy = c("_r20") / (F.abs("_r120") + 0.001) * 10
    rg = real("revenue_growth", F.abs("revenue_growth") < 200, rg_proxy)
    x = x.withColumns({"factor_pe": pe, "factor_pb": pb, "factor_roe": roe, "factor_revenue_growth": rg})
    x = x.withColumns({
        "factor_ep": 1.0 / (c("factor_pe") + 0.1), "factor_bp": 1.0 / (c("factor_pb") + 0.1), "factor_ps": c("_c") / (c("_vm") / 1e6 + 0.001),
        "factor_profitability": c("_r60") / (c("_c") + 0.001), "factor_sharpe": c("_r20") / (c("_s60") + 0.001),
        "factor_vol_health": 1.0 / (div("_s", "_m") + 0.001), "factor_liquidity_health": c("_vm") / 1e6,
        "factor_price_position": (c("_c") - c("_lo")) / (c("_hi") - c("_lo") + 0.001), "factor_momentum_health": div(c("_c") - c("_m"), "_m")})
    x = x.withColumns({"factor_value_score": c("factor_ep") + c("factor_bp") + c("factor_roe") / 100,
                       "factor_quality_score": c("factor_profitability") + c("factor_vol_health") + c("factor_liquidity_health")})
    return x.select(*keep, *[n for n in x.columns if n.startswith("factor_")])


def sequence_features(bars: DataFrame) -> DataFrame:
    """Feature rows for sequence models: returns, averages, position, volatility, RSI, MACD; incomplete rows drop out."""
    x = bars.withColumns({"returns": div(close(), lag("close")) - 1, "log_returns": F.ln(div(close(), lag("close")))})
    x = x.withColumns({
        "ma5": rmean(close(), 5), "ma10": rmean(close(), 10), "ma20": rmean(close(), 20),
        "price_position": div(close() - rmin("low", 20), rmax("high", 20) - rmin("low", 20)), "volatility": rstd("returns", 20),
        "volume_ma5": rmean(vol(), 5), "volume_ratio": div(vol(), rmean(vol(), 5))})
    x = macd(rsi(x).drop("rsi_score")).drop("macd_score", "macd").withColumnsRenamed({"dif": "macd", "dea": "macd_signal"})
    return x.dropna(subset=["returns", "ma20", "price_position", "volatility", "volume_ratio", "rsi", "macd_signal"])


def sequences(features: DataFrame, cols: Sequence[str], length: int = 20, target: str = "close") -> DataFrame:
    """Per row: the ``length`` feature rows before it (oldest first) and the target; bounded arrays."""
    frame = wc().rowsBetween(-length, -1)
    x = features.withColumns({"sequence": F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(frame),
                              "target": F.col(target)})
    return x.where(F.size("sequence") == length).select(CODE, DATE, "sequence", "target")


def vif(panel: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Variance inflation per column: diagonal of the inverse correlation matrix (columns x columns, driver-sized)."""
    full = panel.dropna(subset=list(cols))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = full.agg(*[corr(cols[i], cols[j]).alias(f"c_{i}_{j}") for i, j in pairs]).first() if pairs else {}
    m = np.eye(len(cols))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"c_{i}_{j}"]
    return dict(zip(cols, np.diag(np.linalg.pinv(m)).tolist()))


def drop_collinear(panel: DataFrame, cols: Sequence[str], limit: float = 10.0) -> list[str]:
    """Columns kept after dropping the worst one until all factors are under ``limit``."""
    keep = list(cols)
    while len(keep) > 1:
        v = vif(panel, keep)
        worst = max(keep, key=lambda c: v[c])
        if v[worst] < limit:
            break
        keep.remove(worst)
    return keep


def time_folds(panel: DataFrame, n: int = 3) -> DataFrame:
    """``fold`` 0..n by date order: fold k validates a model trained on folds before it."""
    days = day_index(panel)
    total = days.agg(F.max("day_no")).first()[0]
    fold = F.least(F.lit(n), F.floor((F.col("day_no") - 1) * (n + 1) / F.lit(total))).cast("int")
    return panel.join(F.broadcast(days.withColumn("fold", fold).select(DATE, "fold")), DATE)  # one row per day


#: Most values of a column that a tree tells apart, and the share of the rows each tree sees, as drawn by hash.
BINS, DRAWN = 32, 0.8
#: Weight of every tree after the first.
STEP = 0.1


def _bin(c: str) -> str:
    return f"_bin_{c}"


def _ranked_within_dates(rows: DataFrame, ret: str) -> DataFrame:
    """``rank_label`` by windows over dates that are sent once; dates too large for one task take the order statistics."""
    w = Window.partitionBy(DATE)

    def calm(x: DataFrame) -> DataFrame:
        same = F.count(F.lit(1)).over(w.orderBy(ret).rangeBetween(Window.currentRow, Window.currentRow))
        return x.withColumn("label", (F.rank().over(w.orderBy(ret)) - 1 + (same - 1) / 2.0) / F.count(F.lit(1)).over(w))
    return by_dates(rows, calm, lambda x: rank_label(x, ret))


def _cells(rows: DataFrame, cols: Sequence[str], rounds: int, seed: int) -> tuple[Bucketizer, DataFrame]:
    """Rows counted by their bins: ``_n<m>`` rows that tree ``m`` sees and the sum ``_s<m>`` of their labels."""
    cut = QuantileDiscretizer(numBuckets=BINS, inputCols=list(cols), outputCols=[_bin(c) for c in cols], handleInvalid="keep").fit(rows)
    aggs = []
    for m in range(rounds):
        seen = F.pmod(F.xxhash64(F.lit(seed + m), DATE, "label", *cols), F.lit(1 << 30)) < int(DRAWN * (1 << 30))
        aggs += [F.count_if(seen).cast("double").alias(f"_n{m}"), F.sum(F.when(seen, F.col("label"))).alias(f"_s{m}")]
    return cut, materialize(cut.transform(rows).groupBy(*[_bin(c) for c in cols]).agg(*aggs))


def _boosted(rows: DataFrame, cols: Sequence[str], depth: int, rounds: int, seed: int) -> PipelineModel:
    """Gradient boosting on squared error, grown on cells.

    A tree of binned columns knows a row by its bins and a node by sums over
    its rows, so cells with their count and mean label give the tree that their
    rows would. No row is kept in memory or spilled between rounds.
    """
    cut, cells = _cells(rows, cols, rounds, seed)
    assemble = VectorAssembler(inputCols=[_bin(c) for c in cols], outputCol="_features")
    cells, fitted, trees = assemble.transform(cells), F.lit(0.0), []
    for m in range(rounds):
        mean = F.try_divide(F.col(f"_s{m}"), F.col(f"_n{m}"))
        target = mean if m == 0 else 2 * (mean - fitted)  # the loss falls fastest along twice the residual
        grower = DecisionTreeRegressor(featuresCol="_features", labelCol="_y", weightCol="_w", predictionCol=f"_p{m}", maxDepth=depth, maxBins=BINS, seed=seed + m)
        tree = grower.fit(cells.where(F.col(f"_n{m}") > 0).select("_features", target.alias("_y"), F.col(f"_n{m}").alias("_w")))
        cells = tree.transform(cells)
        fitted = fitted + F.col(f"_p{m}") * (1.0 if m == 0 else STEP)
        trees.append(tree)
    return PipelineModel([cut, assemble, _together(rows.sparkSession, trees, len(cols))])


def _together(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel], width: int) -> GBTRegressionModel:
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    ml = jvm.org.apache.spark.ml.regression
    parts, weights = new(ml.DecisionTreeRegressionModel, len(trees)), new(jvm.double, len(trees))
    for i, t in enumerate(trees):
        parts[i], weights[i] = t._java_obj, 1.0 if i == 0 else STEP
    model = ml.GBTRegressionModel(f"GBTRegressor_{uuid.uuid4().hex[:12]}", parts, weights, width)
    return GBTRegressionModel(model.setFeaturesCol("_features").setPredictionCol("prediction"))


def train_ranker(panel: DataFrame, cols: Sequence[str], ret: str, folds: int = 3, depth: int = 4, rounds: int = 20,
                 seed: int = 7) -> tuple[PipelineModel, list[float | None]]:
    """Boosted trees on the per-date rank target; time-ordered folds score by mean daily rank IC.

    The panel is stored once and sent to its dates once; a fit then reads the
    labelled rows twice, for the bins and for the counts by bin.
    """
    cols = list(cols)
    kept = panel if is_stored(panel) else materialize(panel.select(CODE, DATE, ret, *cols))
    rows = time_folds(kept.where(F.col(ret).isNotNull()).fillna(0.0, cols).select(CODE, DATE, ret, *cols), folds)
    data = stored(_ranked_within_dates(rows.drop(CODE), ret).select(DATE, "fold", "label", *cols))
    scores = []
    for k in range(1, folds + 1):
        model = _boosted(data.where(F.col("fold") < k), cols, depth, rounds, seed)
        out = model.transform(rows.where(F.col("fold") == k))
        ic = daily_ic(to_long(out, ["prediction"], ret))
        scores.append(ic.agg(F.avg("ic")).first()[0])
    return _boosted(data, cols, depth, rounds, seed), scores


def score(model: PipelineModel, panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Batch scores; missing features count as 0."""
    return model.transform(panel.fillna(0.0, list(cols))).drop("_features", *[_bin(c) for c in cols])


def forecast_errors(df: DataFrame, predicted: str, actual: str, by: str = CODE, date: str = DATE) -> DataFrame:
    """mse, mae, rmse, mape and direction accuracy over all consecutive pairs."""
    e = F.col(predicted) - F.col(actual)
    dp, da = F.col(predicted) - lag(predicted), F.col(actual) - lag(actual)
    x = df.withColumns({"_e": e, "_d": F.when(dp.isNotNull(), ((dp > 0) == (da > 0)).cast("double"))})
    return x.agg(F.avg(F.col("_e") * F.col("_e")).alias("mse"), F.avg(F.abs("_e")).alias("mae"),
                 F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs(div("_e", actual))).alias("mape"),
                 F.avg("_d").alias("direction_accuracy"))
