"""Six scans around limit-up days at each code's newest bar, and the state of its sector that two of them need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import tails as T
from tidemark.functions.windows import CODE, DATE, div

# fixed values: what the scans are called, in the order they run
SCANS = ("limitup_pullback", "dragon_head", "relay_mode", "theme_linkage", "fund_resonance", "late_surge")
LOOK_BACK = 10


def sector_strength(newest: DataFrame, sector: str = "industry", change: str = "pct_chg") -> DataFrame:
    """``code, sector_heat, sector_change``: share of a sector's codes that rise, and their mean change.

    One aggregate per sector with map-side sums, joined back: members never meet each other. Codes without a sector or a change
    have no row.
    """
    known = newest.where(F.col(sector).isNotNull() & F.col(change).isNotNull())
    state = known.groupBy(sector).agg(F.avg((F.col(change) > 0).cast("double")).alias("sector_heat"), F.avg(change).alias("sector_change"))
    return known.select(CODE, sector).distinct().join(state, sector).select(CODE, "sector_heat", "sector_change")


def _bonus(*cases: tuple[Column, float]) -> Column:
    """Sum of the points whose test holds; an unknown test gives none."""
    return sum((F.when(test, F.lit(float(points))).otherwise(0.0) for test, points in cases[1:]), F.when(cases[0][0], F.lit(float(cases[0][1]))).otherwise(0.0))


def limit_up_scans(bars: DataFrame, sectors: DataFrame | None = None, funds: DataFrame | None = None, intraday: DataFrame | None = None, as_of=None, rise: float = 9.5) -> DataFrame:
    """One row per code and scan that fires: ``score`` (at most 100) and ``confidence``.

    ``sectors`` is ``code, sector_heat, sector_change``; ``funds`` is ``code, main_net_inflow, super_large_ratio``; ``intraday`` is
    ``code, late_change, late_volume_ratio``. A scan whose table is not given, or has no row of the code, does not fire. A day counts
    as limit-up at a change of ``rise`` percent.
    """
    x = T.newest_bars(bars, 30, ["close", "volume"], as_of)
    for table, columns in ((sectors, ("sector_heat", "sector_change")), (funds, ("main_net_inflow", "super_large_ratio")), (intraday, ("late_change", "late_volume_ratio"))):
        x = x.withColumns({c: F.lit(None).cast("double") for c in columns}) if table is None else x.join(table.select(CODE, *columns), CODE, "left")

    def change(back: int) -> Column:
        return div(T.at("close", back) - T.at("close", back + 1), T.at("close", back + 1)) * 100

    limit = [F.coalesce((T.at("close", k + 1) > 0) & (change(k) >= rise), F.lit(False)) for k in range(LOOK_BACK)]
    x = x.withColumns({DATE: T.at(DATE), "_n": T.size(), "_c": T.at("close"), "_ma5": T.mean(T.tail("close", 5)), "_v3": T.mean(T.tail("volume", 3)), "_chg": F.when(T.at("close", 1) > 0, change(0)),
                       "_at": F.coalesce(*[F.when(limit[k], F.lit(k)) for k in range(LOOK_BACK)]), "boards": F.coalesce(*[F.when(~limit[k], F.lit(k)) for k in range(LOOK_BACK)], F.lit(LOOK_BACK))})
    day = lambda field: F.try_element_at(T.series(field), -1 - F.col("_at"))
    recent = F.least(F.lit(5), F.col("_n") - F.col("boards"))
    start = F.greatest(F.col("_n") - F.col("boards") - recent + 1, F.lit(1))
    old = T.at("close", 5)
    x = x.withColumns({
        "pullback_pct": div(F.col("_c") - day("close"), day("close")) * 100, "_lv": day("volume"), "_recent": T.mean(T.tail("volume", recent)), "_peak": T.mean(F.slice(T.series("volume"), start, F.col("boards"))),
        "_ratio": F.coalesce(div(F.col("_v3"), T.mean(F.slice(T.series("volume"), F.greatest(F.col("_n") - 4, F.lit(1)), F.lit(2)))), F.lit(1.0)),
        "_five": div(F.col("_c") - F.coalesce(old, T.series("close")[0]), F.coalesce(old, T.series("close")[0])) * 100})
    n, c, chg, boards, pull, heat, sector, five = (F.col(k) for k in ("_n", "_c", "_chg", "boards", "pullback_pct", "sector_heat", "sector_change", "_five"))
    inflow, large, late, busy = (F.col(k) for k in ("main_net_inflow", "super_large_ratio", "late_change", "late_volume_ratio"))
    linkage = F.when(sector > 0, F.least(div(five, sector), F.lit(1.0))).otherwise(0.0)
    rules = [
        ((n >= 10) & pull.between(-8, 0), 60 + _bonus((F.abs(pull) < 5, 15), ((F.col("_lv") > 0) & (F.col("_v3") < F.col("_lv") * 0.7), 15), (c >= F.col("_ma5") * 0.98, 10))),
        ((n >= 15) & (boards >= 2), 65 + _bonus((boards >= 3, 15), ((F.col("_peak") > 0) & (F.col("_recent") < F.col("_peak") * 0.6), 15), (c >= F.col("_ma5") * 0.97, 5))),
        ((n >= 5) & (heat >= 0.7) & (chg >= 3), 55 + _bonus((heat > 0.8, 15), (F.col("_ratio") > 1.5, 10), (chg > 5, 10))),
        ((n >= 5) & (sector >= 3.0), 50 + _bonus((linkage > 0.7, 20), (sector > 5, 15))),
        ((inflow >= 50_000_000) & (large >= 0.3), 70 + _bonus((inflow > 100_000_000, 15), (large > 0.5, 10), ((n >= 5) & (chg > 3), 5))),
        ((late >= 5) & (busy >= 3), 65 + _bonus((late > 7, 15), (busy > 5, 10)))]
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("strategy"), score.alias("raw"))) for name, (test, score) in zip(SCANS, rules)]))
    return (x.select(CODE, DATE, F.explode(each).alias("s"))
            .select(CODE, DATE, "s.strategy", F.least(F.col("s.raw"), F.lit(100.0)).alias("score"), (F.col("s.raw") / 100).alias("confidence")))
