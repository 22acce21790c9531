"""Findings of the fourth review: disk that grew with passes, blocks and copies of rows."""

import datetime as dt
import random
import time

import pytest

from tidemark.operators import evaluate as E
from tidemark.operators import ml as ML

DAY = dt.date(2024, 1, 1)


def features(spark, codes=40, days=30, seed=3):
    r = random.Random(seed)
    rows = []
    for c in range(codes):
        for t in range(days):
            a, b = r.gauss(0, 1), r.choice([0.0, 1.0, 2.0, None])
            ret = None if r.random() < 0.05 else r.choice([0.0, round(0.4 * a + r.gauss(0, 1), 1)])
            rows.append((f"{c:03d}", None if r.random() < 0.01 else DAY + dt.timedelta(days=t), a, b, ret))
    return spark.createDataFrame(rows, "code string, trade_date date, a double, b double, ret double")


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_f1_f2_f3_a_stored_frame_leaves_no_shuffle_files(spark):
    from tidemark.session import FREE_SHUFFLES, stored
    before, setting = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES)
    df = stored(spark.range(20_000).groupBy("id").count())
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert df.count() == 20_000 and spark.conf.get(FREE_SHUFFLES) == setting


def test_f1_a_ranker_reads_its_panel_once_and_caches_no_rows(spark):
    p = features(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r
    model, scores = ML.train_ranker(spark.createDataFrame(p.rdd.mapPartitions(count), p.schema), ["a", "b"], "ret", folds=2, depth=2, rounds=3)
    assert seen.value == p.count()
    assert len(scores) == 2 and all(s > 0.05 for s in scores), scores
    out = ML.score(model, p, ["a", "b"])
    assert out.columns == [*p.columns, "prediction"] and out.count() == p.count()
    assert model.stages[-1].getNumTrees == 3 and model.stages[-1].treeWeights == [1.0, 0.1, 0.1]


def test_f1_trees_of_cells_are_the_trees_of_their_rows(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor
    monkeypatch.setattr(ML, "DRAWN", 1.0)
    rows = features(spark, 60, 40).where("ret is not null").fillna(0.0, ["a", "b"]).withColumn("label", E.F.col("ret") * 2).cache()
    model = ML._boosted(rows, ["a", "b"], 3, 6, 7)
    whole = Pipeline(stages=[*model.stages[:2], GBTRegressor(featuresCol="_features", labelCol="label", maxDepth=3, maxIter=6, stepSize=0.1, maxBins=32, seed=7)]).fit(rows)
    got, want = ([x.prediction for x in m.transform(rows).orderBy("code", "trade_date", "a").collect()] for m in (model, whole))
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9 and len(set(got)) > 20


def test_f1_every_tree_draws_rows_of_its_own(spark):
    rows = features(spark, 100, 50).where("ret is not null").fillna(0.0, ["a", "b"]).withColumn("label", E.F.col("ret"))
    _, cells = ML._cells(rows, ["a", "b"], 3, 7)
    n, total = cells.agg(*[E.F.sum(f"_n{m}").alias(f"n{m}") for m in range(3)]).first(), rows.count()
    assert all(0.77 < x / total < 0.83 for x in n) and len(set(n)) > 1


@pytest.mark.parametrize("piece", [500_000, 5])
def test_f1_labels_are_those_of_rank_label(spark, monkeypatch, piece):
    from tidemark.operators.relational import rank_label
    monkeypatch.setattr(E, "PIECE", piece)
    rows = features(spark).where("ret is not null and trade_date is not null")
    got, want = (sorted((x.code, x.trade_date, round(x.label, 12)) for x in f(rows, "ret").collect()) for f in (ML._ranked_within_dates, rank_label))
    assert got == want


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_f2_codes_are_sent_to_their_own_block_only(spark, threshold):
    from tidemark.operators import _pairs as P
    r = random.Random(6)
    px = {(c, t): 10 + r.random() for c in range(36) for t in range(25) if r.random() < 0.8}
    bars = spark.createDataFrame([(f"{c:06d}", DAY + dt.timedelta(days=t), v) for (c, t), v in px.items()], "code string, trade_date date, r double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = P.block_correlations(bars, 0.0, 3)  # 12 blocks, 78 pairs of them
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {(x.code_a, x.code_b): x.corr for x in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan and "FlatMapGroups" not in plan
    assert ("CartesianProduct" in plan) == (threshold == "-1")
    assert len(got) == 36 * 35 // 2 and all(a < b for a, b in got)
    n = len({t for _, t in px})
    for (a, b), v in got.items():
        x, y = ([px.get((int(k), t), 0.0) for t in range(25)] for k in (a, b))
        mx, my = sum(x) / n, sum(y) / n
        cov, sx, sy = (sum((p - q) * (u - w) for p, u in zip(e, f)) for e, f, q, w in ((x, y, mx, my), (x, x, mx, mx), (y, y, my, my)))
        assert abs(v - cov / (sx * sy) ** 0.5) < 1e-9


@pytest.mark.parametrize("pack", [1, 2, 3])
def test_f3_a_row_goes_to_its_blocks_with_several_factors(spark, monkeypatch, pack):
    r = random.Random(2)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0]
    rows = [(f"{c:03d}", None if r.random() < 0.02 else DAY + dt.timedelta(days=t), *[r.choice(odd) if r.random() < 0.2 else float(r.randrange(9)) for _ in range(3)],
             None, r.choice([None, -0.0, 0.01, r.random()])) for t in range(30) for c in range(25)]
    p = spark.createDataFrame(rows, "code string, trade_date date, fc double, fa double, fb double, none double, fwd double")
    monkeypatch.setattr(E, "PACK", pack)
    factors = ["fc", "fa", "fb", "none"]
    long = E.to_long(p, factors, "fwd")
    loose = spark.createDataFrame(long.collect(), long.schema)
    want = sorted(map(repr, E.rolling_ic(loose, 5, 60).collect()))
    monkeypatch.setattr(E, "WINDOWS", 7)
    df = E.rolling_ic(long, 5, 60)
    assert sorted(map(repr, df.collect())) == want and {x.factor for x in df.collect()} == {"fa", "fb", "fc"}
    packed, names, size = E._packed(long)
    assert names == factors and size == pack
    assert packed.count() <= -(-4 // pack) * p.where("fwd is not null").count()  # a row holds the values of up to so many factors
    if pack == 3:
        assert packed.count() < 0.6 * long.count()
    monkeypatch.setattr(E, "BLOCK_ROWS", 100)  # too many for a task: ranked in Spark
    assert sorted((x.factor, x.trade_date, round(x.rolling_ic, 9)) for x in E.rolling_ic(long, 5, 60).collect()) == sorted(
        (x.factor, x.trade_date, round(x.rolling_ic, 9)) for x in df.collect())
