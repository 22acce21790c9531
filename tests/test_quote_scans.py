import datetime as dt

from tidemark.operators import quote_scans as Q

DAY = dt.date(2024, 1, 1)
QUOTE = ("code string, price double, change_pct double, turnover_rate double, volume double, volume_ratio double, amplitude double, limit_pct double, in_pool boolean, consecutive_limit int")


def bars(spark, n):
    return spark.createDataFrame([("a", DAY + dt.timedelta(i), 10.0 + i / 10, 10.0 + i / 10, 100) for i in range(n)], "code string, trade_date date, high double, close double, volume long")


def test_history_uses_the_bars_there_are(spark):
    short, = Q.history_features(bars(spark, 5)).collect()
    assert (short.n_bars, short.ma5, short.ma10, short.ma20, short.avg_vol_5) == (5, 10.2, None, None, None) and short.high_60d == 10.4
    long_, = Q.history_features(bars(spark, 70)).collect()
    assert (long_.n_bars, long_.avg_vol_5, long_.high_60d) == (60, 100.0, 16.9)


def test_scans_by_quote(spark):
    rows = [("a", 16.8, 9.9, 12.0, 300.0, 3.0, 7.0, 10.0, True, 2), ("a", 16.8, 6.0, 12.0, 300.0, 3.0, 7.0, 10.0, False, None), ("x", 16.8, 6.0, 12.0, 300.0, 3.0, 7.0, 10.0, None, None),
            ("a", None, None, None, None, None, None, None, None, None)]
    got = {}
    for r in Q.quote_scans(spark.createDataFrame(rows, QUOTE), Q.history_features(bars(spark, 70))).collect():
        got.setdefault((r.code, r.in_pool), {})[r.signal] = round(r.signal_score, 6)
    assert got[("a", True)] == {"limit_up": 100.0, "volume_price": 240.0, "breakout_high": 129.5, "high_turnover": 60.0, "strong_signal": 94.0}
    assert got[("a", False)] == {"fast_rise": 60.0, "volume_price": 240.0, "breakout_high": 110.0, "near_limit": 48 + 20 + 15 + 10 + 15 + 18.0, "high_turnover": 60.0, "strong_signal": 94.0,
                                 "quality_non_limit": 25 + 15 + 10 + 20 + 12.0}
    assert set(got[("x", None)]) == {"fast_rise", "volume_price", "high_turnover"}
    assert set(got) == {("a", True), ("a", False), ("x", None)}
