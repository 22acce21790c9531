import datetime as dt

from tidemark.operators import fund_behavior as B

DAY = dt.date(2024, 1, 1)


def test_exit_steps_by_time(spark):
    rows = [("09:26", 1.0, 1.0, 1.0, None, None), ("09:26", 1.0, 1.0, 1.0, True, None), ("10:00", 1.0, 2.0, 2.0, None, True), ("10:01", 1.0, 2.0, 0.5, None, True), ("11:00", 1.0, None, 2.0, None, False),
            ("14:56", 1.0, 0.5, 2.0, None, True), ("14:56", 1.0, 2.0, None, None, True), ("15:00", 1.0, 2.0, 2.0, None, None)]
    df = spark.createDataFrame(rows, "time string, price double, vwap double, yesterday_close double, is_limit_up_open boolean, is_limit_up boolean")
    assert [(r.action, r.exit_ratio) for r in B.four_step_exit(df).collect()] == [
        ("sell_25", 0.25), ("hold", 0.0), ("hold", 0.0), ("sell_25_on_break", 0.25), ("hold", 0.0), ("clear_all", 1.0), ("hold", 0.0), ("hold", 0.0)]


def test_short_term_takes_fewer_on_a_falling_day(spark):
    rows = [(f"{i:06d}", DAY + dt.timedelta(up), bool(up), float(i % 12), 0, 1.0, 2.0) for i in range(40) for up in (0, 1)] + [("688001", DAY, True, 12.0, 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "code string, trade_date date, upward boolean, factor_limit_up_score double, factor_pioneer_status int, factor_ma5_bias double, factor_v_ratio10 double")
    got = {r.trade_date: r["count"] for r in B.short_term_selection(df, 12).groupBy("trade_date").count().collect()}
    assert got == {DAY: 10, DAY + dt.timedelta(1): 12}
    assert B.short_term_selection(df).count() == 2 * sum(1 for i in range(40) if i % 12)


def test_defense_names_every_reason(spark):
    df = spark.createDataFrame([(400.0, 1000.0, 3900.0, 50.0), (900.0, 1000.0, 4067.0, 90.0), (900.0, 0.0, 4120.0, 50.0), (None, None, None, None)], "v_total double, avg_v_total double, price double, sentiment_temperature double")
    assert [(r.action, r.reasons, r.near_support, r.near_resistance) for r in B.defense_signals(df).collect()] == [
        ("defense", "volume_shrink,open_auction_low,support_break", False, False), ("caution", "sentiment_overheat", True, False), ("buy", "", False, True), ("buy", "", False, False)]
