"""Four traces of large buyers per code, their grade, and the three selection flows built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, DATE, UNB, div, lag, latest_rows, lead, wc, wc_desc, with_runs

# fixed values: grade by number of signals, score by grade
GRADES = {4: "S+", 3: "A", 2: "B", 1: "C", 0: "N"}
GRADE_SCORES = {"S+": 100, "A": 80, "B": 60, "C": 40, "N": 20}
# fixed values: prefixes of boards whose price limits differ
OTHER_BOARDS = ("688", "300", "430", "870")
FLOW_SCORES = ("ma_trend_score", "macd_score", "rsi_score", "kdj_score", "bollinger_score", "cci_score", "wr_score", "atr_score",
               "volume_ratio_score", "turnover_score", "mfi_score", "obv_score", "vr_score", "vosc_score")


def _map(values: dict, key: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def resonance_signals(bars: DataFrame) -> DataFrame:
    """One row per code: signals ``s1`` to ``s4``, their details, ``signal_count`` and ``grade``; under five bars there is none.

    ``s1``: a rise of 9.5 % on 1.5 times the volume before, held for ten bars. ``s2``: a gap upwards that no later low fills.
    ``s3``: the first run of two or more bars that close higher and never trade below the close before. ``s4``: twice the mean
    volume (the newest bar's apart), with no later close below. Details are those of the first such bar.
    """
    whole, later, ten = Window.partitionBy(CODE), wc_desc().rowsBetween(UNB, -1), wc().rowsBetween(1, 10)
    c, low, vol, k, n = F.col("close"), F.col("low"), F.col("volume"), F.col("_k"), F.col("_n")
    pc, pv, ph = F.col("_pc"), F.col("_pv"), F.col("_ph")
    x = bars.select(CODE, DATE, "high", "low", "close", "volume").withColumns({
        "_k": F.row_number().over(wc()), "_n": F.count(F.lit(1)).over(whole), "_pc": lag("close"), "_pv": lag("volume"), "_ph": lag("high"),
        "_mean": div(F.sum("volume").over(whole) - F.max_by("volume", DATE).over(whole), F.count(F.lit(1)).over(whole) - 1),
        "_low": F.min("low").over(later), "_close": F.min("close").over(later)})
    x = x.withColumns({"_low10": F.min("low").over(ten), "_fell": F.coalesce(F.max((c < pc * 0.9).cast("int")).over(ten), F.lit(0)),
                       "_up": F.coalesce((c > pc) & (low >= pc), F.lit(False))})
    x = with_runs(x, "_up", "_run").withColumn("_from", F.max(F.when(~F.col("_up"), F.col(DATE))).over(wc().rowsBetween(UNB, 0)))
    x = x.withColumn("_ends", F.coalesce(lead("_run"), F.lit(0)) == 0)
    tests = {
        "s1": (n >= 11) & (c >= pc * 1.095) & (vol >= pv * 1.5) & F.coalesce(F.col("_low10") >= c * 0.97, F.lit(True)) & (F.col("_fell") == 0),
        "s2": (n >= 5) & (k >= 3) & (low > ph) & F.coalesce(F.col("_low") > ph, F.lit(True)),
        "s3": (n >= 5) & (F.col("_run") >= 2) & F.col("_ends"),
        "s4": (n >= 5) & (k >= 4) & (vol >= F.col("_mean") * 2) & F.coalesce(F.col("_close") >= c, F.lit(True))}
    details = {
        "s1": {"limit_up_date": F.col(DATE), "limit_up_volume_ratio": F.coalesce(div(vol, pv), F.lit(0.0)), "consolidation_days": F.least(n - k, F.lit(10))},
        "s2": {"gap_date": F.col(DATE), "gap_size": low - ph, "days_since_gap": n - k + 1},
        "s3": {"consecutive_days": F.col("_run") + 1, "start_date": F.col("_from")},
        "s4": {"breakout_date": F.col(DATE), "breakout_volume_ratio": div(vol, F.col("_mean")), "breakout_price": c}}
    first = [F.min(F.when(tests[s], F.struct(F.col(DATE).alias("_at"), *[v.alias(name) for name, v in details[s].items()]))).alias(f"_{s}") for s in tests]
    g = x.groupBy(CODE).agg(F.max(DATE).alias(DATE), *first)
    g = g.withColumns({s: F.col(f"_{s}").isNotNull() for s in tests})
    g = g.withColumn("signal_count", sum((F.col(s).cast("int") for s in tests), F.lit(0)))
    return g.select(CODE, DATE, *tests, "signal_count", _map(GRADES, F.col("signal_count")).alias("grade"),
                    *[F.col(f"_{s}.{name}").alias(name) for s in tests for name in details[s]])


def resonance_scan(signals: DataFrame, as_of, max_age: int = 30, least: int = 2) -> DataFrame:
    """Codes of at least ``least`` signals whose newest bar is at most ``max_age`` days before ``as_of``; most signals first."""
    fresh = F.col(DATE) >= F.date_sub(F.lit(as_of).cast("date"), max_age)
    return signals.where(fresh & (F.col("signal_count") >= least)).orderBy(F.col("signal_count").desc(), CODE)


def _top(df: DataFrame, score: str, top: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), CODE).limit(top)


def conservative_flow(bars: DataFrame, scan: DataFrame, min_volume: float = 1_000_000, boards: Sequence[str] = OTHER_BOARDS, least: int = 20, top: int = 30) -> DataFrame:
    """Filters first: newest traded bar that is neither thin nor near its limit, scored by grade and signals of ``scan``.

    Codes with fewer than ``least`` bars or on ``boards`` are left out; codes outside the scan have grade ``N``.
    """
    move = div(F.col("close") - F.col("open"), "open")
    x = bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(CODE))).where(F.col("_n") >= least)
    x = x.where((F.col("volume") > 0) & (F.col("volume") >= min_volume) & (move < 0.099) & (move > -0.099))
    for prefix in boards:
        x = x.where(~F.col(CODE).startswith(prefix))
    x = latest_rows(x, DATE, "close", "volume").join(scan.select(CODE, "grade", "signal_count"), CODE, "left")
    x = x.withColumns({"grade": F.coalesce("grade", F.lit("N")), "signal_count": F.coalesce("signal_count", F.lit(0))})
    return _top(x.withColumn("conservative_score", _map(GRADE_SCORES, F.col("grade")) * 0.6 + F.col("signal_count") * 4.0), "conservative_score", top)


def balanced_flow(scored: DataFrame, scores: Sequence[str] = FLOW_SCORES, top: int = 30) -> DataFrame:
    """Factors first: sum of the newest bar's indicator scores."""
    last = latest_rows(scored, DATE, "close", "volume", *scores)
    return _top(last.withColumn("factor_score", sum((F.col(s).cast("double") for s in scores[1:]), F.col(scores[0]).cast("double"))), "factor_score", top)


def aggressive_flow(scan: DataFrame) -> DataFrame:
    """Signals first: all of grade ``S+``, the first half of ``A`` and the first fifth of ``B``, one at least where there is any."""
    grade = Window.partitionBy("grade")
    n = F.count(F.lit(1)).over(grade)
    take = F.when(F.col("grade") == "S+", n).when(F.col("grade") == "A", F.greatest(F.lit(1), F.floor(n / 2))).when(F.col("grade") == "B", F.greatest(F.lit(1), F.floor(n / 5)))
    x = scan.withColumns({"_take": take, "_rn": F.row_number().over(grade.orderBy(F.col("signal_count").desc(), CODE))})
    return x.where(F.col("_rn") <= F.col("_take")).withColumn("score", F.col("signal_count") * 25.0).drop("_take", "_rn")
