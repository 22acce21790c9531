"""One test per settled finding of the third review."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import order_stats as OS
from tidemark.functions.order_stats import with_rank
from tidemark.functions.windows import corr
from tidemark.operators import evaluate as E
from tidemark.operators import market as M
from tidemark.plans import inputs as I
from tidemark.plans import load

SF = "/root/testdata/sf0.001"


def test_f7_content_changes_when_sums_differ_in_the_last_digit(spark, monkeypatch):
    real = I.bars
    monkeypatch.setattr(I, "bars", lambda s, d: real(s, d).withColumn("amount", F.col("amount") * (1 + F.rand() * 1e-12)))
    got = {r.status: r.n for r in load()[0]["d09_d10_content_changes"](spark, SF).collect()}
    codes = real(spark, SF).groupBy("code").agg(F.max("volume").alias("v")).where("code <> '000003'")
    assert got.get("same", 0) == codes.where("v < 95").count() and got.get("changed", 0) == codes.where("v >= 95").count()


def test_f8_numbers_of_heads_and_of_whole_texts(spark, tmp_path):
    rows = [(1, "12 apples"), (2, "7"), (3, "x"), (4, None), (5, " 3.5 "), (6, "1d"), (7, "2F and more"), (8, "1e3"), (9, "")]
    spark.createDataFrame([(i, t, 4) for i, t in rows], "doc_id long, text string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    q, o = load()
    got = {r.doc_id: (r.head, r.text, r.n_chars) for r in q["p06_numeric_or_null"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(o["p06_numeric_or_null"]).fetchall()}
    assert got == want and got[1] == (12.0, None, 4.0) and got[5][1] == 3.5


def panel(spark, codes=40, days=25, seed=3):
    """Two factors with many ties, some of them null or not a number."""
    r = random.Random(seed)
    odd = [None, float("nan"), -0.0, 0.0]
    rows = [(f"{c:06d}", dt.date(2024, 1, 1) + dt.timedelta(days=t), r.choice(odd) if r.random() < 0.2 else float(r.randrange(7)),
             r.random(), r.choice([None, -0.0, 0.01, 0.02, r.random()])) for t in range(days) for c in range(codes) if r.random() < 0.9]
    return spark.createDataFrame(rows, "code string, trade_date date, fa double, fb double, fwd double")


def rows_of(df, digits=9):
    key = df.columns
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in (r[c] for c in key)) for r in df.collect()), key=repr)


METRICS = {"daily_ic": lambda x: E.daily_ic(x), "quantile_returns": lambda x: E.quantile_returns(x, 5, 20), "long_short": lambda x: E.long_short(x),
           "top_turnover": lambda x: E.top_turnover(x)}


@pytest.mark.parametrize("name", METRICS)
def test_large_dates_give_the_same_metrics(spark, monkeypatch, name):
    p = panel(spark)
    plain = rows_of(METRICS[name](E.to_long(p, ["fa", "fb"], "fwd")))
    monkeypatch.setattr(E, "PIECE", 29)
    long = E.to_long(p, ["fa", "fb"], "fwd")
    assert E._parts(long)[1] is not None
    assert plain and rows_of(METRICS[name](long)) == plain
    loose = spark.createDataFrame(long.collect(), long.schema)  # a frame that to_long did not make
    assert rows_of(METRICS[name](loose)) == plain


def test_f9_a_rank_correlation_of_zero_is_zero(spark):
    day = dt.date(2024, 1, 1)
    pairs = [(1, 5), (2, 13), (3, 12), (4, 7), (5, 8), (6, 9), (7, 10), (8, 3), (9, 14), (10, 4), (11, 1), (12, 6), (13, 11), (14, 15), (15, 2)]
    near = [(a, b) for a, b in pairs]
    r = random.Random(0)
    found = []
    while len(found) < 20:  # orders whose whole-number covariance is zero
        r.shuffle(near)
        b = [x for _, x in near]
        if sum((i - 7) * (v - 8) for i, v in enumerate(b)) == 0:
            found.append(list(b))
    rows = [(f"{i:06d}", day + dt.timedelta(days=k), "f", i / 7.0, v / 3.0) for k, b in enumerate(found) for i, v in enumerate(b)]
    long = spark.createDataFrame(rows, "code string, trade_date date, factor string, value double, ret double")
    assert [x.ic for x in E.daily_ic(long).collect()] == [0.0] * 20
    assert E.ic_summary(E.daily_ic(long)).first().ic_positive_ratio == 0.0


def test_f1_rolling_sends_a_row_to_few_blocks_and_agrees_by_any_width(spark, monkeypatch):
    long = E.to_long(panel(spark, 30, 40), ["fa", "fb"], "fwd")
    days = {r.trade_date: r.day_no for r in E.day_index(long).collect()}
    x = [(r.factor, days[r.trade_date], r.value, r.ret) for r in long.collect()]
    wide = spark.createDataFrame([(f, w, v, t) for f, d, v, t in x for w in range(max(d + 1, 6), min(d + 5, max(days.values())) + 1)], "f string, w long, value double, ret double")
    want = with_rank(with_rank(wide, ["f", "w"], "value", "a"), ["f", "w"], "ret", "b").groupBy("f", "w").agg(F.count("a").alias("n"), corr("a", "b").alias("c"))
    want = sorted((r.f, r.w, round(r.c if r.n >= 100 and r.c is not None else 0.0, 9)) for r in want.collect())
    for width, rows in ((120, 12_000_000), (7, 12_000_000), (1, 12_000_000), (7, 250), (120, 1)):
        monkeypatch.setattr(E, "WINDOWS", width)
        monkeypatch.setattr(E, "BLOCK_ROWS", rows)
        got = sorted((r.factor, days[r.trade_date], round(r.rolling_ic, 9)) for r in E.rolling_ic(long, 5, 100).collect())
        assert got == want


def test_f3_a_panel_is_built_once_for_all_metrics(spark):
    p = panel(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r
    counted = spark.createDataFrame(p.rdd.mapPartitions(count), p.schema)
    E.evaluate(counted, ["fa", "fb"], "fwd").collect()
    assert seen.value == p.count()


def test_f2_many_cuts_are_halved_and_broadcast(spark):
    r = random.Random(5)
    rows = [(g, r.choice([-0.0, float(r.randrange(4000)), r.random()])) for g in ("a", "b", None) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    st = OS.order_stats(df, ["g"], "v", piece=8)
    plan = st._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(_cuts" not in plan and "strategy=broadcast" in plan
    got = {(x.g, x.v + 0.0): (x.cnt, x.below, x.total) for x in st.collect()}
    for g in ("a", "b", None):
        v = sorted(x + 0.0 for k, x in rows if k == g)
        for x in set(v):
            assert got[g, x] == (v.count(x), v.index(x), len(v))


def test_f24_cost_peak_is_one_pass_over_the_window(spark):
    r = random.Random(8)
    rows = [("000001", dt.date(2024, 1, 1) + dt.timedelta(days=i), r.choice([10.0, 10.5, 11.0, 12.0, 10 + r.random()]), r.choice([0, 1, 5, 5, 9])) for i in range(90)]
    df = M.cost_peak(spark.createDataFrame(rows, "code string, trade_date date, close double, volume long"))
    assert "array_max(transform(" not in df._jdf.queryExecution().analyzed().toString()  # every bar against every bar
    for i, x in enumerate(df.orderBy("trade_date").collect()):
        w = rows[max(0, i - 19):i + 1]
        lo, hi = min(b[2] for b in w), max(b[2] for b in w)
        step = (hi - lo) / 50
        if len(w) < 5:
            want = w[-1][2]
        elif step == 0:
            want = hi
        else:
            bins = {}
            for b in w:
                k = min(int((b[2] - lo) / step // 1), 49)
                bins[k] = bins.get(k, 0) + b[3]
            want = lo + (min(bins, key=lambda k: (-bins[k], k)) + 0.5) * step
        assert abs(x.cost_peak - want) < 1e-9


def test_f6_a_code_is_sent_to_few_blocks_and_pairs_agree_by_any_block(spark, monkeypatch):
    from tidemark.operators import _pairs as P
    from tidemark.operators.tracking import correlation_pairs
    assert [P.block_count(n, 30) for n in (0, 10, 300, 600, 36_000, 216_000)] == [1, 1, 10, 14, 14, 36]
    r = random.Random(4)
    px = {(c, t): 10 + r.random() for c in range(40) for t in range(30) if r.random() < (0.9 if c % 5 else 0.4)}
    px |= {(40, t): 5.0 for t in range(30)}  # never moves: no correlation
    rows = [(f"{c:06d}", dt.date(2024, 1, 1) + dt.timedelta(days=t), v) for (c, t), v in px.items()]
    bars = spark.createDataFrame(rows, "code string, trade_date date, close double")
    m = {}
    for c in range(41):
        days = sorted(t for k, t in px if k == c)
        m[c] = {b: px[c, b] / px[c, a] - 1 for a, b in zip(days, days[1:])}
    n = len({t for v in m.values() for t in v})
    kept = [c for c in m if len(m[c]) >= 0.6 * n]
    assert 30 < len(kept) < 41
    want = {}
    for a in kept:
        for b in kept:
            if a < b:
                x, y = ([m[k].get(t, 0.0) for t in {t for v in m.values() for t in v}] for k in (a, b))
                mx, my = sum(x) / n, sum(y) / n
                cov, sx, sy = (sum((p - q) * (u - w) for p, u in zip(e, f)) for e, f, q, w in ((x, y, mx, my), (x, x, mx, mx), (y, y, my, my)))
                want[f"{a:06d}", f"{b:06d}"] = None if sx == 0 or sy == 0 else round(cov / (sx * sy) ** 0.5, 9)
    for widest, batch in ((6000, 250_000), (5, 7), (1, 1)):
        monkeypatch.setattr(P, "WIDEST", widest)
        monkeypatch.setattr(P, "BATCH", batch)
        got = {(x.code_a, x.code_b): None if x.corr is None else round(x.corr, 9) for x in correlation_pairs(bars, 0.6, 1).collect()}
        assert got == want


@pytest.mark.parametrize("name", ["t24_textbook_set", "m25_balanced_flow", "flagship_weighted_top20", "m25_aggressive_flow", "v13_resonance_scan"])
def test_f10_f16_f22_f28_f29_tasks_grow_in_number_with_the_trades(spark, monkeypatch, name):
    from tidemark.functions import windows as W
    q = load()[0][name]
    want = rows_of(q(spark, SF), 4)
    monkeypatch.setattr(W, "TASK_ROWS", 300)  # some 6,000 trades
    df = q(spark, SF)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(code" in x]
    assert any(f", {n}), REPARTITION_BY_NUM" in x for x in dealt)
    assert len(dealt) == 2  # bars, and their tasks: no window deals them out again
    assert rows_of(df, 4) == want


def test_f10_an_average_is_computed_once(spark):
    from tidemark.operators import technical as T
    p = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0, 12.0 + i % 3, 9.0 - i % 2, 10.0 + i % 5, 5) for i in range(60)],
                              "code string, trade_date date, open double, high double, low double, close double, volume long")
    x = T.textbook_set(p)
    plan = x._jdf.queryExecution().executedPlan().toString()
    m = T.library_macd(p)
    assert rows_of(x.select("code", "trade_date", "macd", "macd_signal", "macd_histogram")) == rows_of(m.select("code", "trade_date", "macd", "macd_signal", "macd_histogram"))
    assert plan.count("Sort [") < 16


def test_f11_first_rows_of_files_need_no_window(spark, tmp_path):
    from tidemark.sources import files as S
    for k in range(2):
        spark.range(1000 * k, 1000 * k + 700).coalesce(1).write.option("parquet.block.size", 512).parquet(str(tmp_path / f"p{k}"))
    df = S.read_files(spark, [str(tmp_path / "p0"), str(tmp_path / "p1")], ["id"], rows_per_file=5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert sorted(r.id for r in df.collect()) == [*range(5), *range(1000, 1005)]
    assert S.read_files(spark, [str(tmp_path / "p0")], rows_per_file=9000).count() == 700


def test_f17_forward_as_of_reads_each_row_once(spark):
    from tidemark.functions.windows import asof_forward
    r = random.Random(9)
    day = dt.date(2024, 1, 1)
    bars = [(c, day + dt.timedelta(days=t), r.random()) for c in ("a", "b", None) for t in range(60) if r.random() < 0.4]
    picks = [(i, r.choice(["a", "b", "c", None]), None if i == 7 else day + dt.timedelta(days=r.randrange(70))) for i in range(80)]
    p = spark.createDataFrame(picks, "i int, code string, trade_date date")
    df = asof_forward(p, spark.createDataFrame(bars, "code string, trade_date date, close double"), ["close"])
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "unboundedfollowing" not in plan.lower()  # such a frame reads the rest of the code again for each row
    got = {x.i: (x.asof_date, x.close) for x in df.collect()}
    for i, c, d in picks:
        if d is not None:
            assert got[i] == min(((t, v) for k, t, v in bars if k == c and t >= d), default=(None, None))


def test_f17_performance_of_codes_without_bars_and_open_ends(spark):
    from tidemark.operators.tracking import flow_performance
    day = dt.date(2024, 1, 1)
    bars = spark.createDataFrame([(c, day + dt.timedelta(days=t), 10.0 + t) for c in ("a", "z") for t in (0, 5, 20)], "code string, trade_date date, close double")
    picks = spark.createDataFrame([("f", "a", day), ("f", "a", day + dt.timedelta(days=12)), ("f", "b", day), ("f", "a", day + dt.timedelta(days=30))], "flow string, code string, pick_date date")
    x = flow_performance(picks, bars, 10)
    assert "LeftSemi" in x._jdf.queryExecution().optimizedPlan().toString()  # bars of other codes stay where they are
    x = x.first()
    assert (x.positions, x.open, x.avg_return, x.win_rate, x.best, x.worst) == (4, 3, 100.0, 0.5, 200.0, 0.0)


def order_tables(spark):
    r = random.Random(11)
    orders = [(r.choice([1, 2, 3, 9, None]), r.choice(["a", "b", "c", "x", None]), i, float(r.randrange(1, 9)), float(r.randrange(1, 50))) for i in range(120)]
    held = [(r.choice([1, 2, 3, None]), r.choice(["a", "b", "c", "x", "y", None]), float(r.randrange(100))) for _ in range(60)]
    accounts = [(1, 1000.0, -80.0, 1000.0), (2, 500.0, 9.0, 700.0), (3, 0.0, 0.0, 0.0), (4, 10.0, 0.0, 10.0)]
    stocks = [("a", "m", 2e7, 1.0), ("b", "m", 1e6, 9.0), ("c", "n", None, None), ("y", None, 1.0, 1.0)]
    return orders, held, accounts, stocks


def test_f26_order_checks_send_an_order_by_code_and_by_account_only(spark, monkeypatch):
    from tidemark.functions import windows as W
    from tidemark.operators import selections as S
    orders, held, accounts, stocks = order_tables(spark)
    frames = [spark.createDataFrame(x, t) for x, t in (
        (orders, "account_id int, code string, i int, quantity double, price double"), (held, "account_id int, code string, value double"),
        (accounts, "account_id int, total_capital double, daily_pnl double, peak_capital double"), (stocks, "code string, industry string, amount double, atr_pct double"))]
    monkeypatch.setattr(W, "TASK_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = S.check_orders(*frames, rows=120)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {x.i: (x.industry, x.stock_ratio, x.sector_ratio) for x in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 5 and "(account_id" in plan and ", 12), REPARTITION_BY_NUM" in plan  # by code and by account; holdings, stocks, accounts
    place = {c: s for c, s, _, _ in stocks}
    capital = {a: k for a, k, _, _ in accounts}
    assert len(got) == 120
    for a, c, i, q, p in orders:
        s, k = place.get(c), capital.get(a)
        mine = sum(v for x, y, v in held if x == a and y == c and a is not None and c is not None)
        sector = sum(v for x, y, v in held if x == a and a is not None and s is not None and place.get(y) == s)
        assert got[i] == (s, (mine + q * p) / k if k else None, (sector + q * p) / k if k else None)
