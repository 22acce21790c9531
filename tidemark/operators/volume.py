"""Volume-price factors as per-code series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import (
    CODE, DATE, UNB, band, close, div, high, lag, low, open_, rmean, rsum, safe_div, vol, wc)
from tidemark.registry import FACTORS



@FACTORS.register("volume_ratio", "volume_price", "volume_ratio_score")
def volume_ratio(df: DataFrame, period: int = 5) -> DataFrame:
    df = df.withColumn("volume_ratio", safe_div(vol(), rmean(vol(), period)))
    return df.withColumn("volume_ratio_score", band(
        F.col("volume_ratio"), [(3, 100), (2, 80), (1.5, 60), (.8, 50)], 30, null=50, above=True))


@FACTORS.register("turnover", "volume_price", "turnover_score")
def turnover(df: DataFrame, period: int = 5) -> DataFrame:
    """Turnover column, else volume per amount, else relative volume: chosen by schema."""
    if "turnover" in df.columns:
        x = F.col("turnover")
    elif "amount" in df.columns:
        x = safe_div(vol(), F.col("amount")) * 100
    else:
        x = safe_div(vol(), rmean(vol(), period)) * 5
    df = df.withColumn("turnover_value", x)
    return df.withColumn("turnover_score", band(
        F.col("turnover_value"), [(20, 90), (10, 80), (5, 70), (3, 60), (1, 50)], 40, null=50, above=True))


@FACTORS.register("vma", "volume_price", "vma_score")
def vma(df: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    df = df.withColumn("vma_ratio", safe_div(rmean(vol(), short), rmean(vol(), long)))
    return df.withColumn("vma_score", band(
        F.col("vma_ratio"), [(2, 90), (1.5, 75), (1, 60), (.8, 50)], 40, null=50, above=True))


@FACTORS.register("vosc", "volume_price", "vosc_score")
def vosc(df: DataFrame, short: int = 12, long: int = 26) -> DataFrame:
    s, n = rmean(vol(), short), rmean(vol(), long)
    df = df.withColumn("vosc", safe_div(s - n, n) * 100)
    return df.withColumn("vosc_score", band(
        F.col("vosc"), [(-20, 90), (-10, 70), (0, 55), (10, 50), (20, 40)], 30, null=50))


@FACTORS.register("obv", "volume_price", "obv_score")
def obv(df: DataFrame, period: int = 20) -> DataFrame:
    keep = df.columns
    p = lag("close")
    df = df.withColumn("_s", F.when(close() > p, vol()).when(close() < p, -vol()).otherwise(F.lit(0)))
    df = df.withColumn("obv", F.sum("_s").over(wc().rowsBetween(UNB, 0)))
    df = df.withColumn("_m", rmean("obv", period))
    df = df.withColumn("obv_ratio", safe_div(F.col("obv"), F.col("_m"), 1.0))
    score = band(F.col("obv_ratio"), [(1.5, 90), (1.2, 80), (1, 70), (.8, 50), (.5, 40)], 30, null=50, above=True)
    return df.select(*keep, "obv", "obv_ratio", score.alias("obv_score"))


@FACTORS.register("mfi", "volume_price", "mfi_score")
def mfi(df: DataFrame, period: int = 14) -> DataFrame:
    keep = df.columns
    df = df.withColumn("_tp", (high() + low() + close()) / 3).withColumn("_pt", lag("_tp"))
    flow = F.col("_tp") * vol()
    df = df.withColumns({"_p": F.when(F.col("_tp") > F.col("_pt"), flow).otherwise(0.0),
                         "_n": F.when(F.col("_tp") < F.col("_pt"), flow).otherwise(0.0)})
    df = df.withColumns({"_ps": rsum("_p", period), "_ns": rsum("_n", period)})
    df = df.withColumn("mfi", F.when(F.col("_ns") == 0, F.lit(100.0)).otherwise(
        100 - 100 / (1 + F.col("_ps") / F.col("_ns"))))
    return df.select(*keep, "mfi", band(F.col("mfi"), [(20, 90), (40, 70), (60, 50), (80, 40)], 30, null=50).alias("mfi_score"))


@FACTORS.register("vr", "volume_price", "vr_score")
def vr(df: DataFrame, period: int = 26) -> DataFrame:
    keep = df.columns
    p = lag("close")
    df = df.withColumns({"_u": F.when(close() > p, vol()).otherwise(F.lit(0)), "_d": F.when(close() < p, vol()).otherwise(F.lit(0)),
                         "_e": F.when(close() == p, vol()).otherwise(F.lit(0))})
    up, dn, eq = (rsum(c, period) for c in ("_u", "_d", "_e"))
    df = df.withColumn("vr", safe_div(up + eq / 2, dn + eq / 2, 100.0) * F.when(dn + eq / 2 == 0, 1.0).otherwise(100.0))
    return df.select(*keep, "vr", band(F.col("vr"), [(40, 90), (70, 70), (150, 50), (250, 40)], 30, null=50).alias("vr_score"))


@FACTORS.register("wvad", "volume_price", "wvad_score")
def wvad(df: DataFrame, period: int = 24) -> DataFrame:
    keep = df.columns
    df = df.withColumn("_w", F.when(high() == low(), F.lit(0.0)).otherwise((close() - open_()) / (high() - low()) * vol()))
    df = df.withColumn("wvad", rsum("_w", period))
    return df.select(*keep, "wvad", band(F.col("wvad"), [(0, 70)], 40, null=50, above=True).alias("wvad_score"))


@FACTORS.register("v_ratio10", "volume_price", "v_ratio10")
def v_ratio10(df: DataFrame) -> DataFrame:
    return df.withColumn("v_ratio10", F.coalesce(safe_div(vol(), lag("volume")), F.lit(1.0)))


@FACTORS.register("v_total", "volume_price", "v_total")
def v_total(df: DataFrame) -> DataFrame:
    """Traded value of the whole market per date, in units of 1e8, on every row."""
    day = df.groupBy(DATE).agg((F.sum(vol() * close()) / 1e8).alias("v_total"))
    return df.join(day, DATE, "left").select(*df.columns, "v_total")


@FACTORS.register("open_auction_volume", "volume_price", "open_auction_volume")
def open_auction_volume(df: DataFrame, share: float = 0.15) -> DataFrame:
    return df.withColumn("open_auction_volume", vol() * open_() / 1e8 * share)


def volume_price_pattern(df: DataFrame, days: int = 5) -> DataFrame:
    """Agreement of price and volume changes over the last days: a label and its score."""
    keep = df.columns
    dp, dv = div(close(), lag("close")) - 1, div(vol(), lag("volume")) - 1
    df = df.withColumns({"_p": dp, "_v": dv})
    p, v = F.col("_p"), F.col("_v")
    df = df.withColumns({"_same": ((v > 0) == (p > 0)).cast("int"), "_uu": ((v > 0.2) & (p > 0)).cast("int"),
                         "_dd": ((v < -0.1) & (p < 0)).cast("int")})
    df = df.withColumns({c: rsum(c, days) for c in ("_same", "_uu", "_dd")})
    same, uu, dd = F.col("_same"), F.col("_uu"), F.col("_dd")
    label = (F.when(same.isNull(), "unknown").when(same >= 4, "rise_together").when(uu >= 2, "rise_expand")
             .when(dd >= 2, "shrink_pullback").when(same <= 1, "diverge").otherwise("normal"))
    # Score per label.
    scores = {"unknown": 50.0, "rise_together": 90.0, "rise_expand": 80.0, "shrink_pullback": 70.0,
              "diverge": 30.0, "normal": 60.0}
    table = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    return df.select(*keep, label.alias("vp_pattern")).withColumn("vp_score", table[F.col("vp_pattern")])


@FACTORS.register("mainforce_resonance", "volume_price", "mainforce_resonance")
def mainforce_resonance(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Sum of four 0-25 parts over a bounded look-back of 20 bars.

    Limit-up on volume that then held for 10 bars, an upward gap within 3 bars,
    a rising run, and a volume breakout that stood.  The default sees no bar
    after the scored one; ``legacy`` lets the hold check look ahead and takes
    the mean volume of the whole series.
    """
    keep = df.columns
    ahead = 10 if legacy else 0
    pc, pv, ph = lag("close"), lag("volume"), lag("high")
    rise = (close() > pc) & (low() >= pc)
    df = df.withColumns({
        "_i": F.row_number().over(wc()) - 1,
        "_hit": F.coalesce((close() >= pc * 1.095) & (div(vol(), pv) >= 1.5), F.lit(False)), "_vr": safe_div(vol(), pv),
        "_crash": F.coalesce(close() < pc * 0.9, F.lit(False)), "_gap": F.when(low() > ph, div(low() - ph, ph)),
        "_rise": F.coalesce(rise, F.lit(False))})
    if not legacy:
        df = df.withColumn("_avg", F.avg(vol()).over(wc().rowsBetween(UNB, -1)))
    else:
        df = df.withColumn("_tail", F.lead("close").over(wc()).isNotNull())
        df = df.withColumn("_avg", F.avg(F.when(F.col("_tail"), vol())).over(Window.partitionBy(CODE)))
    bar = F.struct(close().alias("c"), low().alias("l"), F.col("_hit").alias("hit"), F.col("_vr").alias("vr"),
                   F.col("_crash").alias("crash"))
    df = df.withColumn("_bars", F.collect_list(bar).over(wc().rowsBetween(-20, ahead)))
    df = df.withColumn("_at", F.least(F.col("_i"), F.lit(20)))
    held = """
      filter(sequence(if(_i > 20, 0, 1), greatest(_at - 1, 1)), j -> _bars[j].hit and not exists(
        slice(_bars, j + 2, 10), b -> b.l < _bars[j].c * 0.97D or b.crash))"""
    first = F.when(F.col("_at") >= 2, F.expr(f"try_element_at(transform({held}, j -> _bars[j].vr), 1)"))
    s1 = F.when(first.isNotNull(), F.least(F.lit(25.0), 12.5 + F.least(F.lit(12.5), (first - 1.5) * 5)))
    ready = F.col("_i") >= 10
    df = df.withColumn("mf_s1_limit_up", F.when(ready, F.coalesce(s1, F.lit(0.0))).otherwise(0.0))
    gap = None
    for d in (3, 2, 1):
        g = lag("_gap", d)
        part = F.least(F.lit(25.0), F.least(F.lit(15.0), g * 200) + F.lit(10.0 - d * 0.3))
        gap = F.when(g.isNotNull(), part) if gap is None else gap.when(g.isNotNull(), part)
    df = df.withColumn("mf_s2_gap", F.when(ready, gap.otherwise(0.0)).otherwise(0.0))
    flags = [F.coalesce(lag("_rise", d), F.lit(False)) if d else F.col("_rise") for d in (5, 4, 3, 2, 1, 0)]
    df = df.withColumn("_flags", F.array(*flags))
    run = F.expr("""aggregate(_flags, named_struct('n', 0, 'done', false),
        (s, f) -> if(s.done, s, if(f, named_struct('n', s.n + 1, 'done', false),
                  if(s.n >= 3, named_struct('n', s.n, 'done', true), named_struct('n', 0, 'done', false))))).n""")
    df = df.withColumn("_run", run)
    df = df.withColumn("mf_s3_consecutive", F.when(ready & (F.col("_run") >= 3), F.least(
        F.lit(25.0), 10.0 + F.col("_run") * 3)).otherwise(0.0))
    burst = None
    for d in (5, 4, 3, 2, 1):
        stood = F.min(close()).over(wc().rowsBetween(-(d - 1), 0)) >= lag("close", d)
        ratio = div(lag("volume", d), "_avg")
        cond = (ratio >= 2) & stood
        part = F.least(F.lit(25.0), F.least(F.lit(15.0), (ratio - 2) * 5) + F.lit(float(d)))
        burst = F.when(cond, part) if burst is None else burst.when(cond, part)
    df = df.withColumn("mf_s4_volume", F.when(ready, burst.otherwise(0.0)).otherwise(0.0))
    total = sum((F.col(c) for c in ("mf_s1_limit_up", "mf_s2_gap", "mf_s3_consecutive", "mf_s4_volume")), F.lit(0.0))
    return df.withColumn("mainforce_resonance", total).select(
        *keep, "mainforce_resonance", "mf_s1_limit_up", "mf_s2_gap", "mf_s3_consecutive", "mf_s4_volume")
