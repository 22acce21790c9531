"""Resonance signals, swing signals and afternoon picks against plain versions and hand-made bars."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import afternoon as A, resonance as R, swing as S

D0 = dt.date(2020, 1, 1)


def frame(spark, series):
    rows = [(code, D0 + dt.timedelta(days=i), *map(float, bar)) for code, bars in series.items() for i, bar in enumerate(bars)]
    return spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, volume double")


def plain_signals(b):
    """The four signals of one code's bars (open, high, low, close, volume), as ``signal: first bar`` or None."""
    n, low, close, vol, high = len(b), [x[2] for x in b], [x[3] for x in b], [x[4] for x in b], [x[1] for x in b]
    out = dict.fromkeys(("s1", "s2", "s3", "s4"))
    if n < 5:
        return out
    for i in range(1, n if n >= 11 else 0):
        held = all(low[j] >= close[i] * 0.97 and close[j] >= close[j - 1] * 0.9 for j in range(i + 1, min(i + 11, n)))
        if close[i] >= close[i - 1] * 1.095 and vol[i] >= vol[i - 1] * 1.5 and held:
            out["s1"] = i
            break
    out["s2"] = next((i for i in range(2, n) if low[i] > high[i - 1] and all(x > high[i - 1] for x in low[i + 1:])), None)
    ups = [i > 0 and close[i] > close[i - 1] and low[i] >= close[i - 1] for i in range(n)]
    out["s3"] = next((i for i in range(1, n) if ups[i] and ups[i - 1] and not (i + 1 < n and ups[i + 1])), None)
    mean = sum(vol[:-1]) / (n - 1)
    out["s4"] = next((i for i in range(3, n) if vol[i] >= mean * 2 and all(x >= close[i] for x in close[i + 1:])), None)
    return out


def test_resonance_equals_a_plain_version(spark):
    r = random.Random(7)
    series = {}
    for k in range(60):
        price, bars = 20.0, []
        for _ in range(r.choice((3, 4, 5, 8, 10, 11, 25, 40))):
            opened = price * r.choice((1.0, 1.0, 1.01, 1.06))
            price = opened * r.choice((0.97, 0.99, 1.0, 1.02, 1.1))
            bars.append((opened, max(opened, price) * 1.001, min(opened, price) * 0.999, price, r.choice((100, 120, 200, 500))))
        series[f"{k:06d}"] = bars
    got = {x.code: x for x in R.resonance_signals(frame(spark, series)).collect()}
    assert set(got) == set(series)
    kinds = set()
    for code, bars in series.items():
        want, x = plain_signals(bars), got[code]
        at = {"s1": x.limit_up_date, "s2": x.gap_date, "s4": x.breakout_date}
        assert {s: want[s] is not None for s in want} == {s: x[s] for s in want}, code
        assert all(at[s] == (None if want[s] is None else D0 + dt.timedelta(days=want[s])) for s in at), code
        if want["s3"] is not None:
            assert x.start_date == D0 + dt.timedelta(days=want["s3"] + 1 - x.consecutive_days)
        assert x.grade == {4: "S+", 3: "A", 2: "B", 1: "C", 0: "N"}[x.signal_count] and x.signal_count == sum(v is not None for v in want.values())
        kinds |= {s for s in want if want[s] is not None}
    assert kinds == {"s1", "s2", "s3", "s4"}
    assert R.resonance_signals(frame(spark, series).limit(0)).count() == 0


def test_scan_leaves_out_old_and_weak_codes_and_flows_take_their_shares(spark):
    rows = [(f"{k:06d}", D0 if k else D0 - dt.timedelta(days=99), g, n) for k, (g, n) in enumerate([("S+", 4)] * 2 + [("A", 3)] * 5 + [("B", 2)] * 11 + [("C", 1)])]
    signals = spark.createDataFrame(rows, "code string, trade_date date, grade string, signal_count int")
    scan = R.resonance_scan(signals, D0)
    assert [x.signal_count for x in scan.collect()] == [4] + [3] * 5 + [2] * 11
    got = R.aggressive_flow(scan).collect()
    assert sorted((x.grade, x.score) for x in got) == [("A", 75.0)] * 2 + [("B", 50.0)] * 2 + [("S+", 100.0)]
    bars = frame(spark, {c: [(10, 10, 10, 10, 100)] * n for c, n in (("000001", 20), ("000002", 19), ("688001", 20), ("000099", 20))})
    flow = {x.code: (x.grade, x.conservative_score) for x in R.conservative_flow(bars, scan, min_volume=100).collect()}
    assert flow == {"000001": ("S+", 76.0), "000099": ("N", 12.0)}


def candidates(spark, rows):
    return spark.createDataFrame([(D0, c, p, A.STRATEGIES[p], float(by)) for c, p, by in rows], "trade_date date, code string, priority int, strategy string, ranked_by double")


@pytest.mark.parametrize("best", [1, 2])
def test_a_code_wanted_by_three_strategies_goes_to_the_first(spark, best):
    rows = [("x", 0, 9), ("y", 0, 1), ("x", 1, 9), ("y", 1, 8), ("z", 1, 7), ("x", 2, 9), ("y", 2, 8), ("z", 2, 7), ("w", 2, 1), ("v", 3, 5)]
    taken, want = set(), []
    for p in range(4):
        mine = [c for c, q, _ in sorted(rows, key=lambda t: (t[1], -t[2], t[0])) if q == p and c not in taken][:best]
        taken |= set(mine)
        want += [(p, c) for c in mine]
    assert sorted((x.priority, x.code) for x in A.allocate(candidates(spark, rows), best).collect()) == sorted(want)
    apart = A.allocate(candidates(spark, rows), best, exclusive=False).collect()
    assert sum(x.code == "x" for x in apart) == 3 and A.allocate(candidates(spark, []), best).count() == 0


def test_allocation_equals_a_plain_version_on_long_lists(spark):
    r = random.Random(3)
    rows = list({(f"{r.randrange(40):03d}", p): (f"{r.randrange(40):03d}", p, r.randrange(5)) for p in range(4) for _ in range(60)}.values())
    rows = list({(c, p): (c, p, by) for c, p, by in rows}.values())
    taken, want = set(), []
    for p in range(4):
        mine = [c for c, q, _ in sorted(rows, key=lambda t: (-t[2], t[0])) if q == p and c not in taken][:3]
        taken |= set(mine)
        want += [(p, c) for c in mine]
    assert sorted((x.priority, x.code) for x in A.allocate(candidates(spark, rows), 3).collect()) == sorted(want)


def test_existing_picks_leave_the_pool(spark):
    bars = frame(spark, {c: [(10, 10.1, 9.9, 10, 100)] * 39 + [(10, 10.2, 10, 10.1, 300)] for c in ("a", "b")}).withColumns({"amount": F.col("volume") * 10, "turnover_ratio": F.lit(0.1)})
    last = D0 + dt.timedelta(days=39)
    pool = spark.createDataFrame([(last, "a", 1), (last, "b", 1)], "trade_date date, code string, consecutive_days int")
    got = A.afternoon_picks(pool, bars).collect()
    assert [(x.strategy, x.code) for x in sorted(got, key=lambda x: x.priority)] == [("limitup_callback", "a"), ("tail_rush", "b")]
    got = A.afternoon_picks(pool, bars, existing=pool.where("code = 'a'")).collect()
    assert [(x.strategy, x.code) for x in got] == [("limitup_callback", "b")]


def test_swing_entry_stop_and_target(spark):
    # a rise, a burst of volume three bars ago with the high, then a fall of a tenth in the highs on little volume
    close = [10 + 0.1 * i for i in range(130)]
    bars = [(c, c * 1.01, c * 0.99, c, 100) for c in close] + [(23, 27.0, 23, 23.2, 900), (23, 25, 23, 23.3, 90), (23, 25, 23, 23.4, 60), (23, 24.3, 23, 23.5, 20)]
    # short: same bars, the oldest left out; flat: no trend
    series = {"up": bars, "short": bars[-119:], "flat": [(10, 10, 10, 10, 100)] * 130}
    got = {x.code: x for x in S.swing_signals(frame(spark, series)).collect()}
    assert set(got) == {"up", "flat"}
    up = got["up"]
    assert up.burst and up.step1_passed and abs(up.pullback_pct - 10.0) < 1e-9
    mean5 = (100 + 900 + 90 + 60 + 20) / 5
    assert abs(up.volume_shrink_ratio - mean5 / (170 / 3)) < 1e-9 and not up.step2_passed and up.entry_price == 0
    flat = got["flat"]
    assert flat.ema20_support and flat.step2_passed and not flat.step1_passed and flat.total_score == 15.0
    calm = [(c, c * 1.01, c * 0.99, c, 100) for c in (10 + 0.002 * i for i in range(130))]
    calm = S.swing_signals(frame(spark, {"calm": calm})).first()
    assert calm.step3_passed and calm.entry_price == calm.close and abs(calm.target_price - calm.close * 1.08) < 1e-9 and abs(calm.stop_loss - calm.close * 0.97) < 1e-9
    assert calm.total_score == 50.0 + 15.0 + 20.0
    early = S.swing_signals(frame(spark, series), as_of=D0 + dt.timedelta(days=125)).where("code = 'up'").first()
    assert early.trade_date == D0 + dt.timedelta(days=125) and not early.burst
