import datetime as dt

import pytest

from tidemark.operators import selections as S
from tidemark.operators import tracking as R

DAY = dt.date(2024, 1, 1)


def test_range_score_skips_missing_metrics(spark):
    cols = "code string, pe double, pb double, roe double, revenue_growth double, profit_growth double, debt_ratio double"
    df = spark.createDataFrame([("a", 25.0, 5.0, 100.0, 200.0, 200.0, 0.0), ("b", None, None, None, None, None, None), ("c", 60.0, 5.0, 55.0, None, None, 30.0)], cols)
    got = {r.code: r for r in S.fundamental_range_score(df).collect()}
    assert (got["a"].score, got["a"].passed, got["a"].label, got["a"].reasons) == (100.0, True, "excellent", "")
    assert (got["b"].score, got["b"].passed, got["b"].reasons) == (0.0, False, "pe_out_of_range,low_roe,high_debt,slow_growth")
    assert got["c"].score == pytest.approx((0 * 0.15 + 100 * 0.10 + 50 * 0.20 + 50 * 0.20) / 0.65, abs=0.01)


def test_dragon_head_needs_a_shallow_and_ended_fall(spark):
    head = spark.createDataFrame([(c, 3, "leader", 50.0) for c in "abcd"] + [("e", 2, "leader", 50.0)], "code string, consecutive_limitup int, market_position string, market_cap double")
    paths = {"a": [10.0, 9.5, 9.0, 8.8, 8.8], "b": [10.0, 9.0, 8.0, 8.0, 8.0], "c": [10.0, 9.9, 9.8, 9.7, 9.5], "d": [10.0, 10.0, 10.0, 10.0], "e": [10.0] * 5}
    bars = spark.createDataFrame([(c, DAY + dt.timedelta(i), p) for c, path in paths.items() for i, p in enumerate(path)], "code string, trade_date date, close double")
    assert [(r.code, r.in_buy_zone) for r in S.dragon_head(head, bars).collect()] == [("a", True)]


def test_order_checks_count_losses_and_sectors_only_where_they_are(spark):
    orders = spark.createDataFrame([(1, "a", 10, 5.0), (1, "b", 10, 30.0), (2, "a", 1, 1.0), (3, "a", 1, 1.0)], "account_id int, code string, quantity int, price double")
    held = spark.createDataFrame([(1, "a", 40.0), (1, "a", 20.0)], "account_id int, code string, value double")
    accounts = spark.createDataFrame([(1, 1000.0, 90.0, 1000.0), (2, 1000.0, -90.0, 1500.0)], "account_id int, total_capital double, daily_pnl double, peak_capital double")
    stocks = spark.createDataFrame([("a", "x", 2e7, 1.0), ("b", "x", 1e6, 9.0)], "code string, industry string, amount double, atr_pct double")
    got = {(r.account_id, r.code): (r.blocks, r.warnings, r.can_execute) for r in S.check_orders(orders, held, accounts, stocks).collect()}
    assert got == {(1, "a"): ("single_stock_limit", "", False), (1, "b"): ("single_stock_limit,sector_concentration", "liquidity_check,volatility_check", False),
                   (2, "a"): ("daily_drawdown,total_drawdown", "", False), (3, "a"): ("unknown_account", "", False)}


def test_pullback_tests_only_columns_that_are_there(spark):
    df = spark.createDataFrame([("a", 9.9, 10.0, 200, 100.0, 10.0, 5), ("b", 9.9, 10.0, 200, 100.0, 10.0, 3), ("c", 9.9, 10.0, 200, 100.0, 0.0, 1)],
                               "code string, open double, close double, volume long, volume_20_avg double, ema_20 double, limitup_days int")
    assert [r.code for r in S.limit_up_pullback(df).collect()] == ["b"]
    assert sorted(r.code for r in S.limit_up_pullback(df.drop("limitup_days")).collect()) == ["a", "b"]


def test_track_knows_nothing_after_its_date(spark):
    picks = spark.createDataFrame([("p", "a", DAY, 100.0, 10.0, -7.0), ("q", "b", DAY, 100.0, 10.0, -7.0), ("r", "a", DAY + dt.timedelta(9), 100.0, 10.0, -7.0)],
                                  "pick_id string, code string, pick_date date, price double, take_profit double, stop_loss double")
    bars = spark.createDataFrame([("a", DAY + dt.timedelta(i), c, c, c, c) for i, c in ((1, 99.0), (2, 98.0), (5, 120.0))] + [("b", DAY + dt.timedelta(2), 90.0, 90.0, 90.0, 90.0)],
                                 "code string, trade_date date, open double, high double, low double, close double")
    early = {r.pick_id: r for r in R.track(picks, bars, DAY + dt.timedelta(3)).collect()}
    assert sorted(early) == ["p", "q"]
    p = early["p"]
    assert (p.status, p.stop_reason, p.final_profit, p.max_profit, p.best_day, p.max_loss, p.worst_day) == ("tracking", None, None, 0.0, None, -2.0, 2)
    assert (early["q"].status, early["q"].stop_reason) == ("stopped", "loss_triggered")
    assert {r.pick_id: r.status for r in R.track(picks, bars, "2024-01-07").collect()}["p"] == "stopped"
    assert {r.pick_id: r.status for r in R.track(picks, bars.where("close < 100"), "2024-02-20").collect()} == {"p": "completed", "q": "stopped", "r": "completed"}
