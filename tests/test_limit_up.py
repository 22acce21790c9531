import datetime as dt

import pytest

from tidemark.operators import limit_up as L

DAY = dt.date(2024, 1, 1)


def indicators(spark, **given):
    row = dict(code="a", close=11.0, ma5=10.5, ma10=10.0, ma20=9.0, ma60=8.0, rsi6=58.0, macd=1.0, macd_signal=0.5, macd_hist=0.5, kdj_k=60.0, kdj_d=55.0, kdj_j=70.0,
               bb_position=0.9, volume_ratio=201.0, obv_trend="rising", momentum_5=15.1, momentum_10=10.1, volatility=30.0) | given
    return L.limit_up_score(spark.createDataFrame([row])).first()


def test_full_and_empty_scores(spark):
    best = indicators(spark)
    assert [best[p] for p in L.PARTS] == [15, 15, 15, 10, 10, 20, 15] and (best.total_score, best.probability) == (100, 18)
    least = indicators(spark, close=8.0, ma5=9.0, rsi6=35.0, macd=-1.0, macd_signal=1.0, macd_hist=-2.0, kdj_k=25.0, kdj_d=30.0, kdj_j=15.0, bb_position=0.1, volume_ratio=0.0,
                       obv_trend="falling", momentum_5=-1.0, momentum_10=0.0, volatility=9.0)
    assert [least[p] for p in L.PARTS] == [1, 2, 0, 1, 0, 0, 0] and least.total_score == 4 and least.probability == 0.0


def test_flat_prices_short_codes_and_empty_tables(spark):
    schema = "code string, trade_date date, high double, low double, close double, volume long"
    flat = [("flat", DAY + dt.timedelta(i), 5.0, 5.0, 5.0, 10) for i in range(30)]
    short = [("short", DAY + dt.timedelta(i), 5.0, 5.0, 5.0, 10) for i in range(29)]
    rows = L.limit_up_score(L.limit_up_indicators(spark.createDataFrame(flat + short, schema))).collect()
    assert [r.code for r in rows] == ["flat"]
    r = rows[0]
    assert (r.rsi6, r.bb_position, r.volume_ratio, r.volatility, r.obv_trend) == (100.0, 0.5, 0.0, 0.0, "rising")
    assert (r.kdj_k, r.kdj_d) == (pytest.approx(50.0), pytest.approx(50.0))
    assert L.limit_up_score(L.limit_up_indicators(spark.createDataFrame([], schema))).count() == 0
