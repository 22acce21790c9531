"""Candlestick patterns for every bar, in long form.

The last five bars of a code are read through ``lag``; each pattern is a
boolean, and the matching ones of a row are gathered in an array and exploded:
one window pass, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, div, wc

WEAK, MODERATE, STRONG, VERY_STRONG = 1, 2, 3, 4


def _bar(k: int) -> Column:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = h - lo
    body, up, dn = F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - lo

    def ratio(x: Column) -> Column:
        return F.when(rng > 0, x / rng).otherwise(0.0)

    bar = F.struct(o.alias("o"), h.alias("h"), lo.alias("l"), c.alias("c"), body.alias("body"), rng.alias("rng"), up.alias("up"),
                   dn.alias("dn"), (c > o).alias("bull"), (c < o).alias("bear"), ratio(body).alias("br"), ratio(up).alias("ur"), ratio(dn).alias("dr"))
    return bar if k == 0 else F.lag(bar, k).over(wc())


class _B:
    """Field access to the bar ``k`` rows back."""

    def __init__(self, k: int):
        self.k = k

    def __getattr__(self, name: str) -> Column:
        return F.col(f"_b{self.k}.{name}")


def with_bars(df: DataFrame, back: int = 4) -> DataFrame:
    w = wc()
    df = df.withColumns({f"_b{k}": _bar(k) for k in range(back + 1)})
    return df.withColumns({
        "_first1": F.first("close").over(w.rowsBetween(-5, -1)), "_first2": F.first("close").over(w.rowsBetween(-6, -2)),
        "_n": F.row_number().over(w), "_avg_body": F.avg(F.abs(F.col("close") - F.col("open"))).over(w.rowsBetween(-9, 0))})


def _falling(k: int) -> Column:
    """Close ``k`` bars back against the first of the five bars ending there; true when there is only one."""
    return F.when(F.col("_n") <= k + 1, True).otherwise(F.col(f"_b{k}.c") < F.col(f"_first{k}"))


def _rising(k: int) -> Column:
    return F.when(F.col("_n") <= k + 1, True).otherwise(F.col(f"_b{k}.c") > F.col(f"_first{k}"))


def _table() -> list[tuple[str, str, Column, Column | str, Column | int, Column | float]]:
    """(name, group, condition, signal, strength, confidence)."""
    a, b, c, d, e = (_B(k) for k in range(5))

    def when(cond: Column, x: float, y: float) -> Column:
        return F.when(cond, x).otherwise(y)

    out: list = []

    def add(name, group, cond, signal, strength, confidence):
        out.append((name, group, cond, signal, strength, confidence))

    # single bar
    low_tail = (a.body > 0) & (div(a.dn, a.body) >= 2.0) & (div(a.up, a.body) <= 0.3) & (a.br < 0.4) & (F.col("_n") >= 2)
    high_tail = (a.body > 0) & (div(a.up, a.body) >= 2.0) & (div(a.dn, a.body) <= 0.3) & (a.br < 0.4) & (F.col("_n") >= 2)
    fall, rise = _falling(1), _rising(1)
    add("doji", "single", a.br < 0.1, "neutral", when(a.rng > F.col("_avg_body") * 0.5, MODERATE, WEAK), 0.7)
    add("hammer", "single", low_tail, "bullish", when(fall, STRONG, MODERATE), when(fall, 0.75, 0.6))
    add("inverted_hammer", "single", high_tail, "bullish", when(fall, STRONG, MODERATE), when(fall, 0.7, 0.55))
    add("hanging_man", "single", low_tail, "bearish", when(rise, STRONG, MODERATE), when(rise, 0.75, 0.6))
    add("shooting_star", "single", high_tail, "bearish", when(rise, STRONG, MODERATE), when(rise, 0.75, 0.6))
    add("marubozu", "single", (a.rng > 0) & (a.ur <= 0.05) & (a.dr <= 0.05) & (a.br > 0.8),
        F.when(a.bull, "bullish").otherwise("bearish"), VERY_STRONG, 0.85)
    add("spinning_top", "single", (a.rng > 0) & (a.br < 0.3) & (a.ur >= 0.3) & (a.dr >= 0.3), "neutral", WEAK, 0.6)

    # reversal
    fall2, rise2 = _falling(2), _rising(2)
    add("bullish_engulfing", "reversal", b.bear & a.bull & (a.o <= b.c) & (a.c >= b.o) & (a.body >= b.body), "bullish",
        when(fall2, STRONG, MODERATE), when(fall2, 0.8, 0.65))
    add("bearish_engulfing", "reversal", b.bull & a.bear & (a.o >= b.c) & (a.c <= b.o) & (a.body >= b.body), "bearish",
        when(rise2, STRONG, MODERATE), when(rise2, 0.8, 0.65))
    add("bullish_harami", "reversal", b.bear & a.bull & (a.o >= b.c) & (a.c <= b.o) & (a.body <= b.body * 0.3), "bullish", MODERATE, 0.65)
    add("bearish_harami", "reversal", b.bull & a.bear & (a.o <= b.c) & (a.c >= b.o) & (a.body <= b.body * 0.3), "bearish", MODERATE, 0.65)
    add("morning_star", "reversal", c.bear & (c.br > 0.3) & (b.br < 0.3) & (b.l < c.c) & a.bull & (a.c > (c.o + c.c) / 2), "bullish", VERY_STRONG, 0.85)
    add("evening_star", "reversal", c.bull & (c.br > 0.3) & (b.br < 0.3) & (b.h > c.c) & a.bear & (a.c < (c.o + c.c) / 2), "bearish", VERY_STRONG, 0.85)
    add("three_white_soldiers", "reversal", a.bull & b.bull & c.bull & (a.br > 0.5) & (b.br > 0.5) & (c.br > 0.5) & (a.c > b.c) & (b.c > c.c),
        "bullish", VERY_STRONG, 0.85)
    add("three_black_crows", "reversal", a.bear & b.bear & c.bear & (a.br > 0.5) & (b.br > 0.5) & (c.br > 0.5) & (a.c < b.c) & (b.c < c.c),
        "bearish", VERY_STRONG, 0.85)
    add("tweezer_top", "reversal", (div(F.abs(b.h - a.h), b.h) <= 0.01) & a.bear, "bearish", STRONG, 0.75)
    add("tweezer_bottom", "reversal", (div(F.abs(b.l - a.l), b.l) <= 0.01) & a.bull, "bullish", STRONG, 0.75)

    # continuation
    def small(m: _B, bear: bool) -> Column:
        return (m.bear if bear else m.bull) & (m.br < 0.3) & ((m.c > e.c) if bear else (m.c < e.c))

    add("rising_window", "continuation", (a.l > b.h) & (div(a.l - b.h, b.h) >= 0.01), "bullish", STRONG, 0.8)
    add("falling_window", "continuation", (b.l > a.h) & (div(b.l - a.h, b.l) >= 0.01), "bearish", STRONG, 0.8)
    add("rising_three_methods", "continuation", e.bull & (e.br > 0.5) & small(b, True) & small(c, True) & small(d, True) & a.bull & (a.c > e.c),
        "bullish", STRONG, 0.8)
    add("falling_three_methods", "continuation", e.bear & (e.br > 0.5) & small(b, False) & small(c, False) & small(d, False) & a.bear & (a.c < e.c),
        "bearish", STRONG, 0.8)
    add("separating_lines_bullish", "continuation", b.bear & a.bull & (div(F.abs(b.o - a.o), b.o) <= 0.005), "bullish", MODERATE, 0.7)
    add("separating_lines_bearish", "continuation", b.bull & a.bear & (div(F.abs(b.o - a.o), b.o) <= 0.005), "bearish", MODERATE, 0.7)
    add("upside_gap_two_crows", "continuation", c.bull & (b.l > c.h) & (div(b.l - c.h, c.h) >= 0.01) & b.bear & a.bear & (a.o > b.o) & (a.c < b.c),
        "bearish", STRONG, 0.75)
    add("meeting_lines_bullish", "continuation", b.bear & a.bull & (div(F.abs(b.c - a.c), b.c) <= 0.005), "bullish", MODERATE, 0.65)
    add("meeting_lines_bearish", "continuation", b.bull & a.bear & (div(F.abs(b.c - a.c), b.c) <= 0.005), "bearish", MODERATE, 0.65)

    # limits and special dojis
    chg = div(a.c - b.c, b.c)
    one_word = (F.abs(a.o - a.c) < 0.01) & (F.abs(a.h - a.l) < 0.01)
    add("limit_up", "special", (chg >= 0.095) & (F.abs(a.c - a.h) < 0.01), "bullish",
        F.when(one_word, VERY_STRONG).when(a.o < a.c, STRONG).otherwise(MODERATE), 0.9)
    add("limit_down", "special", (chg <= -0.095) & (F.abs(a.c - a.l) < 0.01), "bearish",
        F.when(one_word, VERY_STRONG).when(a.o > a.c, STRONG).otherwise(MODERATE), 0.9)
    add("t_shape", "special", (div(F.abs(a.o - a.h), a.h) < 0.01) & (div(F.abs(a.c - a.h), a.h) < 0.01) & (a.dn > 0) & (a.dr >= 0.3), "bullish", STRONG, 0.85)
    add("inverted_t", "special", (div(F.abs(a.o - a.l), a.l) < 0.01) & (div(F.abs(a.c - a.l), a.l) < 0.01) & (a.up > 0) & (a.ur >= 0.3), "bearish", STRONG, 0.85)
    add("one_word_board", "special", F.when(a.c > 0, div(a.rng, a.c)).otherwise(0.0) < 0.005,
        F.when(chg > 0.05, "bullish").when(chg < -0.05, "bearish").otherwise("neutral"), VERY_STRONG, 0.95)
    add("long_legged_doji", "special", (a.rng > 0) & (a.br < 0.1) & (a.ur >= 0.3) & (a.dr >= 0.3), "neutral", MODERATE, 0.7)
    add("dragonfly_doji", "special", (div(F.abs(a.o - a.c), a.c) < 0.01) & (div(F.abs(a.c - a.h), a.h) < 0.01) & (a.up < 0.01) & (a.dr >= 0.5), "bullish", STRONG, 0.8)
    add("gravestone_doji", "special", (div(F.abs(a.o - a.c), a.c) < 0.01) & (div(F.abs(a.c - a.l), a.l) < 0.01) & (a.dn < 0.01) & (a.ur >= 0.5), "bearish", STRONG, 0.8)
    add("near_limit_up", "special", (chg >= 0.07) & (chg < 0.095) & (a.c < a.h), "bullish", MODERATE, 0.7)
    return out


def _simple_table() -> list:
    a, b, c = (_B(k) for k in range(3))
    star = (b.rng > 0) & (b.body < b.rng * 0.3)
    mid = (c.o + c.c) / 2
    return [
        ("morning_star", "simple", c.bear & star & a.bull & (a.c > mid), "bullish", MODERATE, 1.0),
        ("evening_star", "simple", c.bull & star & a.bear & (a.c < mid), "bearish", MODERATE, 1.0),
        ("hammer", "simple", (a.body > 0) & (a.dn >= a.body * 2) & (a.up <= a.body), "bullish", MODERATE, 1.0),
        ("shooting_star", "simple", (a.body > 0) & (a.up >= a.body * 2) & (a.dn <= a.body), "bearish", MODERATE, 1.0),
        ("bullish_engulfing", "simple", b.bear & a.bull & (a.o <= b.c) & (a.c >= b.o), "bullish", MODERATE, 1.0),
        ("bearish_engulfing", "simple", b.bull & a.bear & (a.o >= b.c) & (a.c <= b.o), "bearish", MODERATE, 1.0),
        ("three_white_soldiers", "simple", a.bull & b.bull & c.bull & (a.c > b.c) & (b.c > c.c) & (b.o > c.o) & (b.o < c.c)
         & (a.o > b.o) & (a.o < b.c), "bullish", MODERATE, 1.0)]


def pattern_names(variant: str = "full") -> list[str]:
    return [t[0] for t in (_table() if variant == "full" else _simple_table())]


def detect(bars: DataFrame, names: Sequence[str] | None = None, min_confidence: float = 0.5,
           variant: str = "full") -> DataFrame:
    """One row per code, date and matching pattern: group, signal, strength 1-4, confidence."""
    table = _table() if variant == "full" else _simple_table()
    if names is not None:
        unknown = set(names) - {t[0] for t in table}
        if unknown:
            raise KeyError(f"unknown patterns {sorted(unknown)}")
        table = [t for t in table if t[0] in names]

    def lit(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    hits = [F.when(cond, F.struct(F.lit(n).alias("pattern"), F.lit(g).alias("grp"), lit(s).alias("signal"),
                                  lit(k).cast("int").alias("strength"), lit(p).cast("double").alias("confidence")))
            for n, g, cond, s, k, p in table]
    x = with_bars(bars.select(CODE, DATE, "open", "high", "low", "close"))
    x = x.select(CODE, DATE, F.explode(F.array_compact(F.array(*hits))).alias("p")).select(CODE, DATE, "p.*")
    return x.where(F.col("confidence") >= min_confidence)


def strongest(found: DataFrame) -> DataFrame:
    """Best pattern per code and date by confidence x strength (x 1.5 when directional); ties by name."""
    weight = F.col("confidence") * F.col("strength") * F.when(F.col("signal") != "neutral", 1.5).otherwise(1.0)
    pick = F.min_by(F.struct("pattern", "signal", "strength", "confidence"), F.struct(-F.round(weight, 9), F.col("pattern")))
    return found.groupBy(CODE, DATE).agg(pick.alias("p")).select(CODE, DATE, "p.*")


def overall(found: DataFrame, factor: float = 1.5) -> DataFrame:
    """Bull against bear score per code and date, with the overall signal and strength."""
    w = F.col("confidence") * F.col("strength")
    x = found.groupBy(CODE, DATE).agg(
        F.round(F.sum(F.when(F.col("signal") == "bullish", w).otherwise(0.0)), 9).alias("bullish_score"),
        F.round(F.sum(F.when(F.col("signal") == "bearish", w).otherwise(0.0)), 9).alias("bearish_score"),
        F.count(F.lit(1)).alias("n_patterns"))
    bull, bear = F.col("bullish_score"), F.col("bearish_score")
    total = bull + bear

    def level(s: Column) -> Column:
        return F.least(F.lit(4), (div(s, total) * 4).cast("int") + 1)

    up, down = (total > 0) & (bull > bear * factor), (total > 0) & (bear > bull * factor)
    return x.withColumns({"overall_signal": F.when(up, "bullish").when(down, "bearish").otherwise("neutral"),
                          "overall_strength": F.when(up, level(bull)).when(down, level(bear)).otherwise(F.lit(1))})
