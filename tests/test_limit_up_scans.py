"""Six scans, sector state and hot-stock classes on hand-made bars."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import hot_stocks as H, limit_up_scans as L

D0 = dt.date(2020, 1, 1)


def frame(spark, series):
    rows = [(code, D0 + dt.timedelta(days=i), float(c), float(c) * 1.01, float(c) * 0.99, float(c), float(v)) for code, bars in series.items() for i, (c, v) in enumerate(bars)]
    return spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, volume double")


FLAT = [(10, 100)] * 12
SERIES = {
    "back": FLAT + [(11, 500), (10.8, 100), (10.7, 100), (10.6, 100)],
    "deep": FLAT + [(11, 500), (9.9, 100)],
    "boards": FLAT + [(11, 300), (12.1, 300), (13.31, 300)],
    "rise": FLAT + [(10, 300), (10, 300), (10.6, 300)],
    "flat": FLAT + FLAT,
    "new": [(10, 100)] * 4}


def scans(spark, **tables):
    return {(x.code, x.strategy): (x.score, x.confidence) for x in L.limit_up_scans(frame(spark, SERIES), **tables).collect()}


def test_pullback_and_boards_need_no_other_table(spark):
    got = scans(spark)
    assert got == {("back", "limitup_pullback"): (100.0, 1.0), ("boards", "limitup_pullback"): (85.0, 0.85), ("boards", "dragon_head"): (85.0, 0.85)}
    assert L.limit_up_scans(frame(spark, SERIES).limit(0)).count() == 0


def test_sector_fund_and_intraday_scans(spark):
    sectors = spark.createDataFrame([("rise", 0.9, 6.0), ("flat", 0.9, 3.0), ("new", 0.9, 6.0), ("back", 0.6, 2.9)], "code string, sector_heat double, sector_change double")
    funds = spark.createDataFrame([("rise", 2e8, 0.6), ("flat", 5e7, 0.3), ("back", 4e7, 0.9)], "code string, main_net_inflow double, super_large_ratio double")
    intraday = spark.createDataFrame([("flat", 7.5, 6.0), ("rise", 5.0, 3.0), ("back", 9.0, 2.0), ("new", None, None)], "code string, late_change double, late_volume_ratio double")
    got = {k: v[0] for k, v in scans(spark, sectors=sectors, funds=funds, intraday=intraday).items() if k[1] not in ("limitup_pullback", "dragon_head")}
    assert got == {("rise", "relay_mode"): 90.0, ("rise", "theme_linkage"): 85.0, ("flat", "theme_linkage"): 50.0, ("rise", "fund_resonance"): 100.0, ("flat", "fund_resonance"): 70.0,
                   ("flat", "late_surge"): 90.0, ("rise", "late_surge"): 65.0}


def test_sector_strength_of_a_hot_sector(spark):
    rows = [(f"{k:06d}", "big", 1.0 if k % 4 else -1.0) for k in range(2000)] + [("a", "small", None), ("b", "small", 2.0), ("c", None, 2.0)]
    got = {x.code: (x.sector_heat, x.sector_change) for x in L.sector_strength(spark.createDataFrame(rows, "code string, industry string, pct_chg double")).collect()}
    assert len(got) == 2001 and got["000000"] == got["001999"] == (0.75, 0.5) and got["b"] == (1.0, 2.0)


def test_hot_classes_and_score(spark):
    steady = [(10, 100)] * 21
    series = {"600001": steady + [(11, 500)], "600002": steady, "600003": steady + [(11, 500)], "600004": [(10, 100)] * 20, "600005": [(1.2, 100)] * 30, "300001": steady + [(11, 500)], "600006": steady + [(16, 500)]}
    bars = frame(spark, series).withColumn("turnover", F.lit(30.0))
    names = spark.createDataFrame([("600001", "one"), ("600003", "*ST three"), ("300001", "growth")], "code string, name string")
    got = {x.code: x for x in H.hot_stocks(bars, names, D0 + dt.timedelta(days=40)).collect()}
    assert set(got) == {"600001", "600002", "300001"}
    one, two, wide = got["600001"], got["600002"], got["300001"]
    assert (one.is_limit_up, one.is_hot, one.is_leading, one.is_breakout, one.consecutive_limit_days) == (True, False, False, True, 1) and not wide.is_limit_up and wide.is_breakout
    ratio = 500 / ((1900 + 500) / 20)
    base = 10 * (2 + 1.5 + 1 + 0.5) + (ratio - 1) * 5 + 15 + 60
    assert abs(wide.hot_score - base) < 1e-9 and abs(one.hot_score - (base + 30 + 50 + 10)) < 1e-9 and two.hot_score == 60.0
    assert H.hot_stocks(bars, names, D0 + dt.timedelta(days=100)).count() == 0
    assert [x.code for x in H.top_hot(H.hot_stocks(bars, names, D0 + dt.timedelta(days=40)), 2).collect()] == ["600001", "300001"]
