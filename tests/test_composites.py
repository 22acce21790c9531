import datetime as dt

import pytest

from tidemark.operators import composites as C

DAY = dt.date(2024, 1, 1)


def test_multi_factor_filters_nulls_and_scores_what_is_there(spark):
    df = spark.createDataFrame([("a", 100.0, 9.0, 0.2, 0.1), ("b", None, 9.0, 0.2, 0.1), ("c", 100.0, 60.0, 0.2, 0.1), ("d", 100.0, 9.0, 0.2, None)], "code string, market_cap double, pe double, roe double, momentum_20d double")
    got = {r.code: r.composite_score for r in C.multi_factor(df).collect()}
    assert got == {"a": pytest.approx(0.1 * 0.15 + 0.2 * 0.15 + 0.1 * 0.05), "d": None}
    assert [r.code for r in C.multi_factor(df, top=1).collect()] == ["a"]


def test_rotation_takes_the_regime_of_the_day(spark):
    df = spark.createDataFrame([(c, DAY + dt.timedelta(i), 0.2, 1.0) for i, c in enumerate("abcd")], "code string, trade_date date, roe double, momentum_20d double")
    market = spark.createDataFrame([(DAY, 0.06, 0.1), (DAY + dt.timedelta(1), -0.06, 0.1), (DAY + dt.timedelta(2), 0.06, 0.3)], "trade_date date, index_trend double, volatility double")
    got = {r.code: (r.regime, round(r.composite_score, 9)) for r in C.factor_rotation(df, market).collect()}
    assert got == {"a": ("bull", 0.18), "b": ("bear", 0.04), "c": ("neutral", 0.08), "d": ("neutral", 0.08)}


def test_dimensions_without_data_stay_at_fifty(spark):
    rows = C.dimension_scores(spark.createDataFrame([("a", None), ("b", 0.0), ("c", 16.0), ("d", 4.0)], "code string, roe double")).collect()
    assert {r.code: (r.fundamental, r.total_score, r.label) for r in rows} == {"a": (50.0, 50.0, "caution"), "b": (50.0, 50.0, "caution"), "c": (70.0, 54.0, "caution"), "d": (35.0, 47.0, "avoid")}


def test_sectors_need_history_and_weights_are_cut_one_by_one(spark):
    days = [DAY + dt.timedelta(i) for i in range(61)]
    path = lambda name, step, n=61: [(name, d, 100.0 * (1 + step) ** i * (1 + 0.001 * (i % 2))) for i, d in enumerate(days[:n])]
    sectors = spark.createDataFrame(path("technology", 0.02) + path("medicine", 0.004) + path("falling", -0.01) + path("short", 0.05, 59), "sector string, trade_date date, close double")
    index = spark.createDataFrame(path("all", 0.01), "index_code string, trade_date date, close double")
    got = {r.sector: r for r in C.sector_rotation(sectors, index).collect()}
    assert set(got) == {"technology", "medicine"} and {r.regime for r in got.values()} == {"bull"}
    assert got["technology"].preference == 1.5 and got["technology"].weight == 0.40 and got["medicine"].weight == pytest.approx(max(0.1, min(0.4, got["medicine"].score / sum(r.score for r in got.values()))))
    assert C.sector_rotation(sectors.where("false"), index).count() == 0


def test_periods_of_one_day_drop_out_and_idle_days_do_not_count(spark):
    daily = spark.createDataFrame([(dt.date(2024, 1, d), p, r, s) for d, p, r, s in ((1, 1.0, 0.1, "up"), (2, 1.0, -0.2, "down"), (3, 0.0, 9.0, "up"), (8, 1.0, 0.1, "up"))], "trade_date date, position double, ret double, state string")
    row, = C.period_performance(daily, "week").collect()
    assert (row.days, row.dominant_state) == (3, "up")
    assert (row.total_return, row.max_drawdown, row.win_rate, row.profit_loss_ratio) == pytest.approx((-0.12, 0.2, 0.5, 0.5))


def test_quintiles_keep_border_rows(spark):
    panel = spark.createDataFrame([(str(i), DAY, float(i), float(i)) for i in range(10)], "code string, trade_date date, f double, future_return double")
    got = {r.bucket: (r.n, r.mean_return) for r in C.quintile_returns(panel, "f").collect()}
    assert sum(n for n, _ in got.values()) == 10 and got[1] == (2, 0.5) and got[5] == (2, 8.5)
