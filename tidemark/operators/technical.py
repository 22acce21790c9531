"""Technical indicators as per-code series.

Every function takes a bar panel and adds its value columns and, where a 0-100
reading is defined, ``<name>_score``; rows without enough history are null and
score 50.  All windows share one partitioning by code.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import (
    CODE, DATE, UNB, Ema, band, close, div, high, lag, low, open_, rmax, rmean, rmin, rstd, rsum, safe_div, vol, wc,
    with_ema)
from tidemark.registry import FACTORS


def _num(x: float) -> Column:
    return F.lit(float(x))


def _first_match(pairs: Sequence[tuple[Column, float]], otherwise: float) -> Column:
    out = None
    for cond, score in pairs:
        out = F.when(cond, _num(score)) if out is None else out.when(cond, _num(score))
    return out.otherwise(_num(otherwise))


def true_range(prev: str = "close") -> Column:
    return F.greatest(high() - low(), F.abs(high() - lag(prev)), F.abs(low() - lag(prev)))


def sma(df: DataFrame, periods: Sequence[int] = (5, 10, 20, 60, 120, 250), col: str = "close") -> DataFrame:
    return df.withColumns({f"ma{n}": rmean(col, n) for n in periods})


def ema_list(df: DataFrame, periods: Sequence[int] = (5, 10, 20, 60), col: str = "close") -> DataFrame:
    return with_ema(df, {f"ema{n}": Ema(col, n) for n in periods})


@FACTORS.register("ma_trend", "technical", "ma_trend_score")
def ma_trend(df: DataFrame, short: int = 5, medium: int = 10, long: int = 20) -> DataFrame:
    df = df.withColumns({"ma_short": rmean(close(), short), "ma_medium": rmean(close(), medium), "ma_long": rmean(close(), long)})
    s, m, n = F.col("ma_short"), F.col("ma_medium"), F.col("ma_long")
    score = _first_match([
        (n.isNull(), 50), ((close() > s) & (s > m) & (m > n), 100), ((close() > s) & (s > m), 80), (close() > s, 60), (close() > n, 40),
        ((close() < s) & (s < m) & (m < n), 0)], 30)
    return df.withColumn("ma_trend_score", score)


@FACTORS.register("macd", "technical", "macd_score")
def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = True,
         col: str = "close") -> DataFrame:
    keep = df.columns
    df = with_ema(df, {"_f": Ema(col, fast, adjust=adjust), "_s": Ema(col, slow, adjust=adjust)})
    df = with_ema(df.withColumn("dif", F.col("_f") - F.col("_s")), {"dea": Ema("dif", signal, adjust=adjust)})
    df = df.withColumn("macd", F.col("dif") - F.col("dea")).withColumn("_p", lag("macd"))
    m, p = F.col("macd"), F.col("_p")
    score = _first_match([
        (p.isNull(), 50), ((m > 0) & (p <= 0), 100), ((m > 0) & (F.col("dif") > 0), 80), (m > 0, 60),
        ((m < 0) & (p >= 0), 20), (m < 0, 40)], 50)
    return df.select(*keep, "dif", "dea", "macd", score.alias("macd_score"))


def _gain_loss(col: str = "close") -> tuple[Column, Column]:
    d = F.col(col) - lag(col)
    return F.when(d > 0, d).otherwise(0.0), F.when(d < 0, -d).otherwise(0.0)


@FACTORS.register("rsi", "technical", "rsi_score")
def rsi(df: DataFrame, period: int = 14, col: str = "close") -> DataFrame:
    keep = df.columns
    g, s = _gain_loss(col)
    df = df.withColumns({"_g": g, "_l": s}).withColumns({"_ag": rmean("_g", period), "_al": rmean("_l", period)})
    value = F.when(F.col("_al") == 0, _num(100)).otherwise(100 - 100 / (1 + F.col("_ag") / F.col("_al")))
    df = df.withColumn("rsi", value)
    score = band(F.col("rsi"), [(30, 80), (50, 60), (70, 50), (80, 30)], 20, null=50)
    return df.select(*keep, "rsi", score.alias("rsi_score"))


@FACTORS.register("kdj", "technical", "kdj_score")
def kdj(df: DataFrame, n: int = 9, m1: int = 3, m2: int = 3, adjust: bool = True,
        smoothing: str = "span") -> DataFrame:
    keep = df.columns
    lo, hi = rmin(low(), n), rmax(high(), n)
    df = df.withColumns({"_lo": lo, "_hi": hi})
    rng = F.col("_hi") - F.col("_lo")
    df = df.withColumn("rsv", F.when(rng == 0, _num(50)).otherwise((close() - F.col("_lo")) / rng * 100))

    def spec(src: str, m: int) -> Ema:
        return Ema(src, m, adjust=adjust) if smoothing == "span" else Ema(src, alpha=1.0 / m, adjust=adjust)

    df = with_ema(with_ema(df, {"kdj_k": spec("rsv", m1)}), {"kdj_d": spec("kdj_k", m2)})
    df = df.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d"))
    score = band(F.col("kdj_j"), [(0, 90), (20, 80), (50, 60), (80, 40), (100, 20)], 10, null=50)
    return df.select(*keep, "rsv", "kdj_k", "kdj_d", "kdj_j", score.alias("kdj_score"))


@FACTORS.register("bollinger", "technical", "bollinger_score")
def bollinger(df: DataFrame, period: int = 20, std: float = 2.0) -> DataFrame:
    mid, sd = rmean(close(), period), rstd(close(), period)
    df = df.withColumns({"bb_middle": mid, "_sd": sd})
    df = df.withColumns({"bb_upper": F.col("bb_middle") + F.col("_sd") * std,
                         "bb_lower": F.col("bb_middle") - F.col("_sd") * std}).drop("_sd")
    width = F.col("bb_upper") - F.col("bb_lower")
    df = df.withColumns({
        "bb_bandwidth": safe_div(width, F.col("bb_middle")) * 100,
        "bb_position": F.when(width == 0, _num(0.5)).otherwise((close() - F.col("bb_lower")) / width)})
    score = band(F.col("bb_position"), [(0, 90), (.2, 80), (.4, 60), (.6, 50), (.8, 40), (1, 30)], 20, null=50)
    return df.withColumn("bollinger_score", score)


@FACTORS.register("atr", "technical", "atr_score")
def atr(df: DataFrame, period: int = 14, legacy: bool = False) -> DataFrame:
    """Mean true range; ``legacy`` measures against the previous high."""
    df = df.withColumn("true_range", true_range("high" if legacy else "close"))
    df = df.withColumn("atr", rmean("true_range", period)).withColumn("atr_ratio", div("atr", "close") * 100)
    score = band(F.col("atr_ratio"), [(5, 20), (4, 30), (3, 40), (2, 60), (1, 80)], 70, null=50, above=True)
    return df.withColumn("atr_score", score)


@FACTORS.register("cci", "technical", "cci_score")
def cci(df: DataFrame, period: int = 14) -> DataFrame:
    keep = df.columns
    df = df.withColumn("_tp", (high() + low() + close()) / 3).withColumn("_m", rmean("_tp", period))
    df = df.withColumn("_d", F.abs(F.col("_tp") - F.col("_m"))).withColumn("_md", rmean("_d", period))
    df = df.withColumn("cci", F.when(F.col("_md") == 0, _num(0)).otherwise(
        (F.col("_tp") - F.col("_m")) / (0.015 * F.col("_md"))))
    score = band(F.col("cci"), [(-200, 90), (-100, 80), (0, 60), (100, 50), (200, 30)], 20, null=50)
    return df.select(*keep, "cci", score.alias("cci_score"))


@FACTORS.register("wr", "technical", "wr_score")
def wr(df: DataFrame, period: int = 14, positive: bool = False) -> DataFrame:
    keep = df.columns
    df = df.withColumns({"_hh": rmax(high(), period), "_ll": rmin(low(), period)})
    rng = F.col("_hh") - F.col("_ll")
    sign = 100.0 if positive else -100.0
    df = df.withColumn("wr", F.when(rng == 0, _num(sign / 2)).otherwise((F.col("_hh") - close()) / rng * sign))
    x = -F.col("wr") if positive else F.col("wr")
    return df.select(*keep, "wr", band(x, [(-80, 90), (-50, 70), (-20, 50), (0, 30)], 20, null=50).alias("wr_score"))


@FACTORS.register("dmi", "technical", "dmi_score")
def dmi(df: DataFrame, period: int = 14) -> DataFrame:
    keep = df.columns
    df = df.withColumns({"_up": high() - lag("high"), "_dn": lag("low") - low(), "_tr": true_range()})
    up, dn = F.col("_up"), F.col("_dn")
    df = df.withColumns({"_pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0),
                         "_mdm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0)})
    df = df.withColumns({"_t": rsum("_tr", period), "_p": rsum("_pdm", period), "_m": rsum("_mdm", period)})
    df = df.withColumns({"pdi": safe_div(F.col("_p"), F.col("_t"), 0.0) * 100,
                         "mdi": safe_div(F.col("_m"), F.col("_t"), 0.0) * 100})
    both = F.col("pdi") + F.col("mdi")
    df = df.withColumn("adx", safe_div(F.abs(F.col("pdi") - F.col("mdi")), both, 0.0) * 100)
    score = band(F.col("adx"), [(60, 90), (40, 70), (25, 60), (20, 50)], 40, null=50, above=True)
    return df.select(*keep, "pdi", "mdi", "adx", score.alias("dmi_score"))


@FACTORS.register("roc", "technical", "roc_score")
def roc(df: DataFrame, period: int = 12) -> DataFrame:
    p = lag(close(), period)
    df = df.withColumn("roc", F.when(p == 0, _num(0)).otherwise((close() - p) / p * 100))
    return df.withColumn("roc_score", band(F.col("roc"), [(-15, 90), (-5, 70), (5, 50), (15, 40)], 30, null=50))


@FACTORS.register("mtm", "technical", "mtm_score")
def mtm(df: DataFrame, period: int = 12) -> DataFrame:
    df = df.withColumn("mtm", close() - lag(close(), period))
    pct = div("mtm", "close") * 100
    return df.withColumn("mtm_score", band(pct, [(-10, 90), (-5, 70), (0, 55), (5, 50), (10, 40)], 30, null=50))


@FACTORS.register("psy", "technical", "psy_score")
def psy(df: DataFrame, period: int = 12) -> DataFrame:
    keep = df.columns
    df = df.withColumn("_up", F.when(close() > lag("close"), 1.0).otherwise(0.0))
    df = df.withColumn("psy", rsum("_up", period) / period * 100)
    return df.select(*keep, "psy", band(F.col("psy"), [(25, 90), (40, 70), (60, 50), (75, 40)], 30, null=50).alias("psy_score"))


@FACTORS.register("asi", "technical", "asi_score")
def asi(df: DataFrame, period: int = 5) -> DataFrame:
    keep = df.columns
    pc, po = lag("close"), lag("open")
    df = df.withColumns({"_a": F.abs(high() - pc), "_b": F.abs(low() - pc), "_d": F.abs(pc - po),
                         "_x": close() - pc + (close() - open_()) / 2 + pc - po})
    a, b, d = F.col("_a"), F.col("_b"), F.col("_d")
    r = F.when(a >= b, a + b / 2 + d / 4).otherwise(b + a / 2 + d / 4)
    df = df.withColumn("_r", r)
    df = df.withColumn("_si", F.when(F.col("_r") == 0, _num(0)).otherwise(F.col("_x") / F.col("_r") * 50))
    df = df.withColumn("asi", rsum("_si", period))
    score = band(F.col("asi"), [(50, 75), (0, 60), (-50, 50)], 40, null=50, above=True)
    return df.select(*keep, "asi", score.alias("asi_score"))


@FACTORS.register("emv", "technical", "emv_score")
def emv(df: DataFrame, period: int = 14) -> DataFrame:
    keep = df.columns
    df = df.withColumn("_mid", (high() + low()) / 2)
    change, rng = F.col("_mid") - lag("_mid"), high() - low()
    df = df.withColumn("_e", F.when((rng == 0) | (vol() == 0), _num(0)).otherwise(change / (rng / vol() * 1000000)))
    df = df.withColumn("emv", rmean("_e", period))
    return df.select(*keep, "emv", band(F.col("emv"), [(0, 70)], 40, null=50, above=True).alias("emv_score"))


@FACTORS.register("ma5_bias", "technical", "ma5_bias")
def ma5_bias(df: DataFrame, period: int = 5) -> DataFrame:
    m = rmean(close(), period)
    return df.withColumn("ma5_bias", safe_div(close() - m, m))


def ma_gap(df: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    s, n = rmean(close(), short), rmean(close(), long)
    return df.withColumn("ma_gap", safe_div(s - n, n) * 100)


def bias(df: DataFrame, periods: Sequence[int] = (5, 10, 20)) -> DataFrame:
    return df.withColumns({f"bias{n}": div(close() - rmean(close(), n), rmean(close(), n)) * 100 for n in periods})


# --------------------------------------------------------------------------
# library set: recursive averages without warm-up weighting


def library_rsi(df: DataFrame, period: int = 14, col: str = "close", alpha: float | None = None) -> DataFrame:
    keep = df.columns
    g, s = _gain_loss(col)
    df = df.withColumns({"_g": g, "_l": s})
    spec = {"span": period} if alpha is None else {"alpha": alpha}
    df = with_ema(df, {"_ag": Ema("_g", **spec), "_al": Ema("_l", **spec)})
    value = F.when(F.col("_al") == 0, F.when(F.col("_ag") == 0, F.lit(None)).otherwise(_num(100))).otherwise(
        100 - 100 / (1 + F.col("_ag") / F.col("_al")))
    return df.select(*keep, value.alias(f"rsi_{period}"))


def library_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close") -> DataFrame:
    keep = df.columns
    out = macd(df, fast, slow, signal, adjust=False, col=col)
    return out.select(*keep, F.col("dif").alias("macd"), F.col("dea").alias("macd_signal"),
                      F.col("macd").alias("macd_histogram"))


def library_volume(df: DataFrame) -> DataFrame:
    keep = df.columns
    chg = close() - lag("close")
    tp = (high() + low() + close()) / 3
    df = df.withColumns({"_pv": div(chg, lag("close")) * vol(), "_sv": F.when(chg > 0, vol()).when(chg < 0, -vol()).otherwise(F.lit(0)),
                         "_tv": tp * vol(), "volume_ma5": rmean(vol(), 5), "volume_ma20": rmean(vol(), 20)})
    run = wc().rowsBetween(UNB, 0)
    return df.withColumns({
        "volume_ratio": div(vol(), F.col("volume_ma20")), "pvt": F.sum("_pv").over(run), "obv": F.sum("_sv").over(run),
        "vwap": div(F.sum("_tv").over(run), F.sum(vol()).over(run))}).select(
        *keep, "volume_ma5", "volume_ma20", "volume_ratio", "pvt", "obv", "vwap")


def library_cci(df: DataFrame, period: int = 20) -> DataFrame:
    return cci(df, period).withColumnRenamed("cci", f"cci_{period}").drop("cci_score")


def library_atr(df: DataFrame, period: int = 14) -> DataFrame:
    """Recursive true range; the first bar uses its own range."""
    tr = F.greatest(high() - low(), F.coalesce(F.abs(high() - lag("close")), high() - low()), F.coalesce(F.abs(low() - lag("close")), high() - low()))
    return with_ema(df.withColumn("true_range", tr), {f"atr_{period}": Ema("true_range", period)})


def momentum(df: DataFrame, period: int = 10) -> DataFrame:
    p = lag(close(), period)
    return df.withColumns({f"momentum_{period}": close() - p, f"momentum_pct_{period}": (div(close(), p) - 1) * 100})


def basic_features(df: DataFrame) -> DataFrame:
    """MA 5/10/20/60, daily return %, 20-day volatility of returns, volume MA 5/20."""
    df = df.withColumn("returns", (div(close(), lag("close")) - 1) * 100)
    return df.withColumns({**{f"ma{n}": rmean(close(), n) for n in (5, 10, 20, 60)},
                           "volatility_20": rstd("returns", 20), "volume_ma5": rmean(vol(), 5), "volume_ma20": rmean(vol(), 20)})


def panel_features(df: DataFrame) -> DataFrame:
    """momentum_20d, volatility_20d (std / mean), v_ratio10, ma_gap."""
    m20 = rmean(close(), 20)
    df = df.withColumns({"momentum_20d": div(close(), lag(close(), 20)) - 1, "volatility_20d": div(rstd(close(), 20), m20),
                         "v_ratio10": div(vol(), rmean(vol(), 10))})
    return ma_gap(df)


def cross_signals(df: DataFrame, fast: str = "dif", slow: str = "dea") -> DataFrame:
    """``cross``: 'golden', 'death' or null when the difference changes sign."""
    d = F.col(fast) - F.col(slow)
    df = df.withColumn("_d", d).withColumn("_p", lag("_d"))
    cross = F.when((F.col("_d") > 0) & (F.col("_p") <= 0), "golden").when((F.col("_d") < 0) & (F.col("_p") >= 0), "death")
    return df.withColumn("cross", cross).drop("_d", "_p")


def monthly_macd(df: DataFrame, min_months: int = 30) -> DataFrame:
    """MACD of month-end closes; null until ``min_months`` months exist."""
    m = df.groupBy(CODE, F.trunc(DATE, "month").alias("month")).agg(F.max_by("close", DATE).alias("close"))
    wm = Window.partitionBy(CODE).orderBy("month")
    m = with_ema(m, {"_f": Ema("close", 12), "_s": Ema("close", 26)}, date="month")
    m = with_ema(m.withColumn("dif", F.col("_f") - F.col("_s")), {"dea": Ema("dif", 9)}, date="month")
    m = m.withColumns({"_n": F.row_number().over(wm), "_d": F.col("dif") - F.col("dea")}).withColumn("_p", F.lag("_d").over(wm))
    ready = F.col("_n") >= min_months
    return m.select(
        CODE, "month", "close", *[F.when(ready, F.col(c)).alias(c) for c in ("dif", "dea")],
        F.when(ready, (F.col("_d") > 0) & (F.col("_p") <= 0)).alias("golden_cross"),
        F.when(ready, (F.col("dif") > 0) & (F.col("dea") > 0)).alias("above_zero"))


def kama(df: DataFrame, period: int = 10, fast: int = 2, slow: int = 30, col: str = "close") -> DataFrame:
    """Adaptive average: the smoothing constant changes per bar, so it is a true recursion.

    Rows arrive partitioned and sorted by code; the state is one number per code.
    """
    hi, lo = 2.0 / (fast + 1), 2.0 / (slow + 1)
    d = F.abs(F.col(col) - lag(col))
    df = df.withColumn("_d", d)
    df = df.withColumns({"_vol": rsum("_d", period), "_chg": F.abs(F.col(col) - lag(col, period))})
    er = F.when(F.col("_vol") > 0, F.col("_chg") / F.col("_vol")).when(F.col("_vol") == 0, 0.0)
    df = df.withColumn("_sc", F.pow(er * (hi - lo) + lo, F.lit(2.0)))
    keep = [c for c in df.columns if c not in ("_d", "_vol", "_chg", "_sc")]
    src = df.select(*keep, "_sc").repartition(CODE).sortWithinPartitions(CODE, DATE)
    schema = src.select(*keep, F.lit(None).cast("double").alias("kama")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, state = None, np.nan
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            codes, xs, scs = pdf[CODE].to_numpy(), pdf[col].to_numpy(float), pdf["_sc"].to_numpy(float)
            for i in range(len(pdf)):
                if codes[i] != code:
                    code, state = codes[i], np.nan
                if np.isnan(scs[i]):
                    continue
                state = xs[i] if np.isnan(state) else state + scs[i] * (xs[i] - state)
                out[i] = state
            res = pdf.drop(columns="_sc")
            res["kama"] = pd.array(out, dtype="Float64")
            res["kama"] = res["kama"].mask(np.isnan(out))
            yield res

    return src.mapInPandas(run, schema)


def textbook_set(df: DataFrame) -> DataFrame:
    """EMA 12/26, MACD, RSI 14, KDJ (alpha 1/m), bands and ATR with textbook parameters."""
    keep = df.columns
    df = with_ema(ema_list(df, (12, 26)).withColumn("macd", F.col("ema12") - F.col("ema26")), {"macd_signal": Ema("macd", 9)})
    df = df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    df = library_rsi(df, 14)
    df = kdj(df, adjust=False, smoothing="alpha")
    df = bollinger(df)
    df = library_atr(df, 14)
    return df.select(*keep, "ema12", "ema26", "macd", "macd_signal", "macd_histogram", "rsi_14",
                     "kdj_k", "kdj_d", "kdj_j", "bb_upper", "bb_middle", "bb_lower", "atr_14")


def panel_series(df: DataFrame) -> DataFrame:
    """The wide per-row feature set used by screens: bias, slope, trend, RSI, ratio, bands, ATR, limit flag."""
    df = rsi(df).drop("rsi_score")
    df = df.withColumns({"ma5": rmean(close(), 5), "ma10": rmean(close(), 10), "ma20": rmean(close(), 20), "ma60": rmean(close(), 60),
                         "vol_ratio": div(vol(), rmean(vol(), 5))})
    df = atr(bollinger(df)).drop("bollinger_score", "atr_score", "true_range", "atr_ratio", "bb_bandwidth")
    return df.withColumns({
        "bias20": div(close() - F.col("ma20"), "ma20"), "slope20": div("ma20", lag("ma20", 5)) - 1,
        "trend_up": ((close() > F.col("ma5")) & (F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")))})
