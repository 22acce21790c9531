"""Bar panels: normalising, deriving, building, resampling, upserting, adjusting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.windows import CODE, DATE, FOL, UNB, asof_backward, lag, wc

# Standard column order and accepted spellings of the columns.
STANDARD = ["code", "trade_date", "open", "high", "low", "close", "volume", "amount",
            "preclose", "pct_chg", "turnover"]
ALIASES = {
    "date": "trade_date", "pre_close": "preclose", "preClose": "preclose",
    "pctChg": "pct_chg", "pct_change": "pct_chg", "change_pct": "pct_chg", "turn": "turnover", "turnover_rate": "turnover",
}

BAR_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("trade_date", T.DateType(), False),
    *[T.StructField(c, T.DoubleType(), False) for c in ("open", "high", "low", "close")],
    T.StructField("volume", T.LongType(), False),
    *[T.StructField(c, T.DoubleType(), True) for c in ("amount", "preclose", "pct_chg", "turnover")],
])

FACTOR_INPUT = ["code", "trade_date", "open", "high", "low", "close", "volume"]


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def normalize_names(df: DataFrame) -> DataFrame:
    """Rename known variants where the standard name is absent."""
    taken, renames = set(df.columns), {}
    for old, new in ALIASES.items():
        if old in df.columns and new not in taken:
            renames[old] = new
            taken.add(new)
    return df.withColumnsRenamed(renames)


def ensure_code(df: DataFrame, code: str | None = None) -> DataFrame:
    """Add ``code``: a given value, or the stem of the file a row came from."""
    if CODE in df.columns:
        return df
    value = F.lit(code) if code else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)*$", 1)
    return df.withColumn(CODE, value)


def derive_change(df: DataFrame) -> DataFrame:
    """Derive ``preclose`` from ``pct_chg`` or ``pct_chg`` from ``preclose``."""
    if "preclose" not in df.columns and "pct_chg" in df.columns:
        return df.withColumn("preclose", F.expr("try_divide(close, 1 + pct_chg / 100)"))
    if "pct_chg" not in df.columns and "preclose" in df.columns:
        return df.withColumn("pct_chg", F.expr("try_divide(close - preclose, preclose) * 100"))
    return df


def with_change(df: DataFrame) -> DataFrame:
    """``preclose`` and ``pct_chg`` from the previous bar of the code."""
    return derive_change(df.withColumn("preclose", lag("close")))


def standard_order(df: DataFrame) -> DataFrame:
    head = [c for c in STANDARD if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def clean_identity(df: DataFrame, dates: Sequence[str] = ("trade_date", "date")) -> DataFrame:
    """One ``trade_date`` from several date columns; codes without exchange prefix."""
    have = [c for c in dates if c in df.columns]
    day = F.coalesce(*[F.to_date(F.col(c)) for c in have])
    bare = F.regexp_replace("code", r"^(sh|sz|bj)\.", "")
    rest = [c for c in df.columns if c not in have and c != "code"]
    return df.select(bare.alias("code"), day.alias("trade_date"), *rest)


def parse_date(c: str | Column) -> Column:
    """A date from a date, timestamp, ``yyyy-MM-dd`` or ``yyyyMMdd`` value."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(
        F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")).cast("date"),
        F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date"))


def numeric_or_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Doubles from text, null where it is no number; the type letters that Java reads after one (``1d``, ``2F``) make it none."""
    def number(c: str) -> Column:
        s = F.col(c).cast("string")
        return F.when(~s.rlike(r"[0-9.][dDfF]\s*$"), s.try_cast("double"))

    return df.withColumns({c: number(c) for c in cols})


def narrow_types(df: DataFrame, floats: bool = False) -> DataFrame:
    """Cast integers to the smallest type holding their range (one aggregate pass)."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    out = df
    if ints:
        row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in ints], *[F.max(c).alias(f"hi_{c}") for c in ints]).first()
        for c in ints:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            if lo is None:
                continue
            for name, bits in (("byte", 8), ("short", 16), ("int", 32)):
                if -(1 << (bits - 1)) <= lo and hi < (1 << (bits - 1)):
                    out = out.withColumn(c, F.col(c).cast(name))
                    break
    if floats:
        doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
        out = out.withColumns({c: F.col(c).cast("float") for c in doubles})
    return out


def with_expressions(df: DataFrame, exprs: dict[str, str | Column]) -> DataFrame:
    """User expressions by name, as SQL text or ``Column``."""
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in exprs.items()})


def fill_factors(df: DataFrame, prefix: str = "factor_", value: float = 0.0) -> DataFrame:
    names = [c for c in df.columns if c.startswith(prefix)]
    return df.withColumns({c: F.when(F.isnan(c) | F.col(c).isNull(), value).otherwise(F.col(c)) for c in names})


# Exchange boards by code prefix and their daily price limits (%).
BOARD_PREFIXES = {
    "star": ["688", "689"],
    "growth": ["300", "301"],
    "beijing": ["43", "83", "87", "88", "92", "4", "8"],
}
BOARD_LIMITS = {"star": 20.0, "growth": 20.0, "beijing": 30.0, "main": 10.0}


def board(code: str | Column = CODE) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    out = None
    for name, prefixes in BOARD_PREFIXES.items():
        cond = c.rlike("^(" + "|".join(prefixes) + ")")
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("main"))


def board_limit(code: str | Column = CODE) -> Column:
    b = board(code)
    out = None
    for name, pct in BOARD_LIMITS.items():
        out = F.when(b == name, F.lit(pct)) if out is None else out.when(b == name, F.lit(pct))
    return out


def rebase(df: DataFrame, base: float = 100.0, col: str = "close", name: str = "normalized") -> DataFrame:
    first = F.first(col).over(wc().rowsBetween(UNB, 0))
    return df.withColumn(name, F.col(col) / first * F.lit(base))


def seat_alias(df: DataFrame, seats: DataFrame, broker: str = "broker_name") -> DataFrame:
    """Attach the group name of a known broker seat (exact name lookup)."""
    return df.join(seats.select(F.col("seat").alias(broker), "alias"), broker, "left")


# --------------------------------------------------------------------------
# building and resampling


def bars_from_trades(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    """Daily bars from priced legs ``code, trade_date, open, high, low, close, volume, amount``.

    First and last legs follow ``order``, so the result does not depend on how
    rows arrive.  All aggregates combine map-side: a hot code costs one row per
    task and day in the shuffle.  One numeric or date order column keeps the
    aggregation hash-based; several become a struct, which Spark sorts.
    """
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return trades.groupBy(CODE, DATE).agg(
        F.min_by("open", key).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", key).alias("close"), F.sum("volume").cast("long").alias("volume"),
        F.sum("amount").alias("amount"))


def resample(df: DataFrame, unit: str = "week") -> DataFrame:
    """Week, month or quarter bars per code, dated by the period's start."""
    return (df.groupBy(CODE, F.date_trunc(unit, F.col(DATE)).cast("date").alias("period"))
              .agg(F.min_by("open", DATE).alias("open"), F.max("high").alias("high"),
                   F.min("low").alias("low"), F.max_by("close", DATE).alias("close"),
                   F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
                   F.max(DATE).alias("last_date"), F.count(F.lit(1)).alias("days")))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = (CODE, DATE),
           sequence: str | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; inside ``new`` the last by ``sequence`` wins.

    Rows have no order of their own: without ``sequence``, a key that ``new`` holds twice is an error.
    """
    fresh = dedupe_last(new, keys, sequence) if sequence else unique_rows(new, keys)
    if sequence and sequence not in old.columns:
        fresh = fresh.drop(sequence)
    kept = old.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` as it is; the job fails where a key occurs twice."""
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"several rows for one key of {list(keys)}: name the column that orders them"))).otherwise(F.col("_r"))
    return once.select(*keys, checked.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def dedupe_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Newest row per key by ``sequence``: ``max_by`` combines map-side, so hot keys shrink early."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_r"))
              .select(*keys, "_r.*").select(*df.columns))


def adjust_prices(bars: DataFrame, factors: DataFrame, mode: str = "backward") -> DataFrame:
    """Adjusted prices; factors carry forward from the last change date.

    ``backward`` multiplies by the factor, ``forward`` by factor / newest factor.
    """
    rows = asof_backward(bars, factors, ["factor"])
    f = F.coalesce(F.col("factor"), F.lit(1.0))
    if mode == "forward":
        newest = F.last("factor", ignorenulls=True).over(wc().rowsBetween(UNB, FOL))
        f = f / F.coalesce(newest, F.lit(1.0))
    elif mode != "backward":
        raise ValueError(f"unknown mode {mode!r}")
    rows = rows.withColumn("adj", f)
    prices = {f"adj_{c}": F.col(c) * F.col("adj") for c in ("open", "high", "low", "close")}
    return rows.withColumns(prices).drop("asof_date", "factor", "adj")


# --------------------------------------------------------------------------
# calendar


def calendar(days: DataFrame, holidays: DataFrame | None = None, date: str = DATE) -> DataFrame:
    """Trading days between the first and last date of ``days``: weekdays that are no holiday."""
    span = days.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    cal = span.select(F.explode(F.sequence("a", "b")).alias(DATE)).where(F.weekday(DATE) < 5)
    if holidays is not None:
        cal = cal.join(holidays.select(F.col("holiday").alias(DATE)), DATE, "left_anti")
    return cal


def day_index(df: DataFrame, date: str = DATE) -> DataFrame:
    """Dense index of the distinct dates (a table of days, so one window is fine)."""
    return (df.select(date).distinct()
              .withColumn("day_no", F.row_number().over(Window.orderBy(date)).cast("long")))


def missing_dates(df: DataFrame, cal: DataFrame) -> DataFrame:
    """Calendar days inside a code's own span on which it has no bar."""
    span = df.groupBy(CODE).agg(F.min(DATE).alias("a"), F.max(DATE).alias("b"))
    want = span.select(CODE, F.explode(F.sequence("a", "b")).alias(DATE)).where(F.weekday(DATE) < 5)
    want = want.join(cal.select(DATE), DATE, "left_semi")
    return want.join(df.select(CODE, DATE), [CODE, DATE], "left_anti").select(CODE, DATE)
