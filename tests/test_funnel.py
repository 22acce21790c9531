import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.interpolation import interpolate
from tidemark.operators import drawdown as D
from tidemark.operators import funnel as N

DAY = dt.date(2024, 1, 1)
BAR = "code string, trade_date date, open double, high double, low double, close double, volume long, turnover double"


def panel(paths, volumes=None):
    return [(c, DAY + dt.timedelta(i), p, p * 1.01, p * 0.99, p, (volumes or {}).get(c, 100) + i, 1.0) for c, path in paths.items() for i, p in enumerate(path)]


def test_interpolate_at_borders_and_beyond_both_ends(spark):
    points = [(0, 0), (10, 1), (20, 5), (50, 8)]
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 5.0, 10.0, 15.0, 20.0, 35.0, 50.0, 51.0, float("nan"), None)], "x double")
    got = [r.y for r in rows.select(interpolate(F.col("x"), points).alias("y")).collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 3.0, 5.0, 6.5, 8.0, 8.0, None, None]
    assert rows.select(interpolate(F.col("x"), [(1, 7)]).alias("y")).first().y == 7.0
    with pytest.raises(ValueError):
        interpolate(F.col("x"), [(1, 7), (1, 8)])


def test_funnel_counts_every_layer_and_keeps_the_first_by_code(spark):
    rising = [10 + i * 0.1 for i in range(40)]
    bars = spark.createDataFrame(panel({f"{i:02d}": rising for i in range(10)} | {"st": rising, "short": [10.0, 10.1], "jump": [10.0] * 30 + [11.5]}), BAR)
    names = spark.createDataFrame([("st", "*st x"), ("00", "plain")], "code string, name string")
    rows = N.funnel(bars, names)
    got = {r.code: (r.passed, r.reached) for r in rows.collect()}
    assert len(got) == 13
    assert got["st"] == (0, 0) and got["jump"] == (0, 0)   # risk mark; change over 9.9 %
    assert got["short"][1] == 0                            # newest bar too old
    steps = [(r.layer, r.n_in, r.n_passed, r.n_kept) for r in N.accounting(rows).orderBy("layer").collect()]
    assert steps == [(1, 13, 10, 8), (2, 8, 8, 6), (3, 6, 6, 5), (4, 5, 5, 4), (5, 4, 4, 3)]
    assert sorted(c for c, v in got.items() if v[1] == 5) == ["00", "01", "02"]
    picks = N.funnel_picks(rows).collect()
    assert [p.trend for p in picks] == ["up"] * 3 and picks[0].stoploss_price == pytest.approx(13.9 * 0.95)


def test_funnel_of_an_empty_table(spark):
    rows = N.funnel(spark.createDataFrame([], BAR), spark.createDataFrame([], "code string, name string"))
    assert rows.count() == 0 and N.accounting(rows).count() == 0


def test_drawdown_splits_market_and_own_part(spark):
    up = [10.0, 11.0, 10.0, 12.0]
    bars = spark.createDataFrame(panel({"a": up, "b": up, "one": [5.0]}), BAR)
    picks = spark.createDataFrame([("a", DAY + dt.timedelta(1), 90.0, 10.0), ("one", DAY, 90.0, 90.0), ("a", DAY + dt.timedelta(9), 1.0, 1.0)],
                                  "code string, pick_date date, momentum double, volume double")
    got = D.pick_drawdowns(picks, bars).collect()
    assert len(got) == 1                                   # a code of one bar, a date without a bar
    r = got[0]
    assert r.beta == pytest.approx(1.0) and r.drawdown == pytest.approx(100 / 11)
    assert r.market_part == pytest.approx((10 / 11 - 1 + 0.2) * 100) and r.own_part == pytest.approx(r.drawdown - r.market_part)
    assert r.reasons == "illiquid"
    flat = spark.createDataFrame(panel({"a": [10.0] * 4}), BAR)
    assert [(x.beta, x.drawdown, x.own_part) for x in D.pick_drawdowns(picks, flat).collect()] == [(0.0, 0.0, 0.0)]


def test_shared_falls_and_failed_factors(spark):
    d = spark.createDataFrame([(DAY, f"{i}", x, m) for i, (x, m) in enumerate([(-6.0, 80.0), (-6.0, 90.0), (-6.0, None), (1.0, 70.0)])],
                              "pick_date date, code string, drawdown double, momentum double")
    s = D.shared_falls(d).first()
    assert (s.n, s.large_drawdown_count, s.large_drawdown_ratio, s.systematic_ratio, s.conclusion) == (4, 3, 0.75, 0.7, "systematic")
    assert [(r.factor, r.high_score_count, r.average_drawdown, r.failure_detected) for r in D.failed_factors(d).collect()] == [("momentum", 2, -6.0, True)]
