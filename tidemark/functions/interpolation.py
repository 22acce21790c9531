"""Piecewise-linear interpolation in a table of breakpoints, as a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolate(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Value at ``x`` on the line through ``points``; the end values beyond both ends, null for null and NaN.

    The table becomes a balanced tree of comparisons, so a row costs the logarithm of the table's size.
    """
    table = sorted((float(a), float(b)) for a, b in points)
    if not table or len({a for a, _ in table}) < len(table):
        raise ValueError("points need distinct places, one at least")

    def between(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            (x0, y0), (x1, y1) = table[lo], table[hi]
            return F.lit(y0) + (x - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(table[mid][0]), between(lo, mid)).otherwise(between(mid, hi))

    inside = between(0, len(table) - 1) if len(table) > 1 else F.lit(table[0][1])
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(x <= table[0][0], F.lit(table[0][1]))
            .when(x >= table[-1][0], F.lit(table[-1][1])).otherwise(inside))
