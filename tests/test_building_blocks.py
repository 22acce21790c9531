"""Unit and property tests on small frames, against pandas or by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import order_stats as OS
from tidemark.functions import windows as W
from tidemark.functions.stats import t_two_sided


def panel(spark, codes=3, n=80, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(codes):
        px = 20 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        for i, p in enumerate(px):
            o = p * (1 + rng.normal(0, 0.01))
            rows.append((f"{c:06d}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(o), float(max(o, p) * 1.01), float(min(o, p) * 0.99),
                         float(p), int(rng.integers(1, 100)), float(p * 10)))
    return spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, volume long, amount double")


@pytest.mark.parametrize("span,adjust", [(3, True), (3, False), (26, True), (60, False), (1.2, False)])
def test_ema_equals_pandas(spark, span, adjust):
    df = panel(spark, 2, 1300)
    got = W.with_ema(df, {"e": W.Ema("close", span, adjust=adjust)}).toPandas().sort_values(["code", "trade_date"])
    for _, g in got.groupby("code"):
        want = g["close"].ewm(span=span, adjust=adjust).mean()
        assert np.allclose(g["e"], want, rtol=1e-11)


def test_ema_skips_leading_nulls(spark):
    df = panel(spark, 1, 30).withColumn("x", F.when(F.col("trade_date") > "2024-01-05", F.col("close")))
    got = W.with_ema(df, {"e": W.Ema("x", 5)}).orderBy("trade_date").toPandas()
    assert got["e"][:5].isna().all()
    assert np.allclose(got["e"][5:], got["x"][5:].ewm(span=5, adjust=False).mean())


@pytest.mark.parametrize("piece", [5, 40, 100000])
def test_order_stats_exact_with_ties_and_hot_group(spark, piece):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["hot"] * 900 + ["cold"] * 40, "v": rng.integers(0, 60, 940).astype(float), "code": [f"{i:05d}" for i in range(940)]})
    pdf.loc[pdf.index % 3 == 0, "v"] = 30.0  # a third of the rows shares one value
    df = spark.createDataFrame(pdf)
    ranks = OS.with_rank(df, ["g"], "v", "r", piece).toPandas().set_index("code")["r"]
    want = pdf.assign(r=pdf.groupby("g")["v"].rank()).set_index("code")["r"]
    assert (ranks.sort_index() == want.sort_index()).all()
    q = OS.quantiles(df, ["g"], "v", {"a": 0.2, "b": 0.9}, piece).toPandas().set_index("g")
    for g, x in pdf.groupby("g"):
        assert np.allclose([q.loc[g, "a"], q.loc[g, "b"]], np.percentile(x["v"], [20, 90]))
    top = OS.share_ends(df, ["g"], "v", 0.5, 0.5, piece=piece).toPandas()
    for g, x in pdf.groupby("g"):
        k = int(len(x) * 0.5)
        assert set(top[(top.g == g) & top.in_top].code) == set(x.sort_values(["v", "code"], ascending=[False, True]).code[:k])
        assert set(top[(top.g == g) & top.in_bottom].code) == set(x.sort_values(["v", "code"]).code[:k])


def test_quantile_bucket_sides(spark):
    df = spark.createDataFrame([("d", float(i)) for i in range(11)], "d string, v double")
    left = OS.quantile_bucket(df, ["d"], "v", 5).orderBy("v").toPandas()["bucket"].tolist()
    right = OS.quantile_bucket(df, ["d"], "v", 5, closed="right").orderBy("v").toPandas()["bucket"].tolist()
    assert left == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]
    assert right == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_runs_and_fill(spark):
    flags = [True, True, False, True, True, True, False]
    df = spark.createDataFrame([("a", dt.date(2024, 1, i + 1), f) for i, f in enumerate(flags)], "code string, trade_date date, up boolean")
    assert [r.run for r in W.with_runs(df, "up").orderBy("trade_date").collect()] == [1, 2, 0, 1, 2, 3, 0]


def test_asof_both_directions(spark):
    left = spark.createDataFrame([("a", dt.date(2024, 1, 3)), ("a", dt.date(2024, 1, 9)), ("b", dt.date(2024, 1, 3))], "code string, trade_date date")
    right = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 5), 2.0)], "code string, trade_date date, x double")
    back = {(r.code, r.trade_date.day): r.x for r in W.asof_backward(left, right, ["x"]).collect()}
    assert back == {("a", 3): 1.0, ("a", 9): 2.0, ("b", 3): None}
    fwd = {(r.code, r.trade_date.day): r.x for r in W.asof_forward(left, right, ["x"]).collect()}
    assert fwd == {("a", 3): 2.0, ("a", 9): None, ("b", 3): None}
    aged = {(r.code, r.trade_date.day): r.x for r in W.asof_backward(left, right, ["x"], max_age=1).collect()}
    assert aged[("a", 9)] is None


def test_t_distribution():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)


@pytest.mark.parametrize("name", ["ma_trend", "macd", "rsi", "kdj", "bollinger", "atr", "cci", "wr", "dmi", "roc", "mtm", "psy", "asi", "emv", "ma5_bias",
                                  "volume_ratio", "vma", "vosc", "obv", "mfi", "vr", "wvad", "mainforce_resonance", "cost_peak", "market_health"])
def test_factor_has_no_lookahead_and_codes_are_independent(spark, name):
    import tidemark.operators.market  # noqa: F401
    import tidemark.operators.technical  # noqa: F401
    import tidemark.operators.volume  # noqa: F401
    from tidemark.registry import add_factor
    df = panel(spark, 2, 70)
    full = add_factor(df, name).where("code = '000001' and trade_date <= '2024-02-20'").orderBy("trade_date").toPandas()[f"factor_{name}"]
    cut = add_factor(df.where("code = '000001' and trade_date <= '2024-02-20'").orderBy(F.rand(3)), name).orderBy("trade_date").toPandas()[f"factor_{name}"]
    assert np.allclose(full, cut, equal_nan=True)


def test_registry_rejects_unknown(spark):
    from tidemark.operators import filters as X
    from tidemark.registry import add_factor
    df = panel(spark, 1, 5)
    with pytest.raises(KeyError):
        add_factor(df, "nothing")
    assert add_factor(df, "nothing", on_unknown="neutral").first()["factor_nothing"] == 50.0
    with pytest.raises(TypeError):
        add_factor(df, "rsi", {"window": 3})
    with pytest.raises(TypeError):
        X.apply(df, "price_filter", lowest=3)
    assert X.apply(df, "st_filter").count() == df.count()  # column missing: unchanged


def test_division_by_zero_gives_null(spark):
    df = panel(spark, 1, 40).withColumn("volume", F.lit(0).cast("long"))
    from tidemark.operators import technical as T
    from tidemark.operators import volume as V
    V.mainforce_resonance(V.volume_price_pattern(V.v_ratio10(V.volume_ratio(T.library_volume(df).drop("volume_ratio"))))).collect()


def test_three_white_soldiers_by_hand(spark):
    rows = [(10.0, 11.1, 9.9, 11.0), (11.0, 12.1, 10.9, 12.0), (12.0, 13.1, 11.9, 13.0)]
    df = spark.createDataFrame([("a", dt.date(2024, 1, i + 1), *r) for i, r in enumerate(rows)], "code string, trade_date date, open double, high double, low double, close double")
    from tidemark.operators import patterns as C
    found = C.detect(df, ["three_white_soldiers"]).collect()
    assert [(r.trade_date.day, r.signal, r.strength) for r in found] == [(3, "bullish", 4)]
    assert len(C.pattern_names()) == 35


def test_stop_exits_at_low_and_profit_at_high(spark):
    from tidemark.operators import tracking as R
    def bars(path):
        return spark.createDataFrame([("a", dt.date(2024, 1, i + 1), c, c * 1.02, c * 0.98, c, 10, 1.0) for i, c in enumerate(path)],
                                     "code string, trade_date date, open double, high double, low double, close double, volume long, score double")
    day = spark.createDataFrame([(dt.date(2024, 1, 1),)], "trade_date date")
    down = R.cohort_backtest(bars([100.0, 94.0, 120.0]), day, hold=2, cost=0.0).first()
    up = R.cohort_backtest(bars([100.0, 111.0, 50.0]), day, hold=2, cost=0.0).first()
    assert down.period_return == pytest.approx(94 * 0.98 / 100 - 1)
    assert up.period_return == pytest.approx(111 * 1.02 / 100 - 1)


def test_upsert_keeps_last_and_other_rows(spark, tmp_path):
    from tidemark.sources import bars as B
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "code string, k int, v double")
    new = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 1, 6.0, 2), ("c", 1, 7.0, 1)], "code string, k int, v double, seq int")
    got = {(r.code, r.v) for r in B.upsert(old, new, ["code", "k"], "seq").collect()}
    assert got == {("a", 6.0), ("b", 2.0), ("c", 7.0)}
