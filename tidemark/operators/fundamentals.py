"""Statement ratios, checks, risk flags and valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import CODE, div

KEY = [CODE, "report_date"]


def with_columns_or_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in cols if c not in df.columns})


def ratios(bs: DataFrame, inc: DataFrame, cf: DataFrame) -> DataFrame:
    """Ratios per code and report date; growth against the previous report by ``lag``.

    A period missing from one statement keeps the ratios the others allow.
    """
    x = bs.join(inc, KEY, "full").join(cf, KEY, "full")
    x = x.withColumns({"_rev": F.coalesce("operating_revenue", "total_revenue"),
                       "_cost": F.coalesce("operating_cost", "total_cost")})
    w = Window.partitionBy(CODE).orderBy("report_date")
    c = F.col
    grown = {"revenue_growth": "_rev", "profit_growth": "net_profit", "net_profit_growth": "net_profit_parent",
             "asset_growth": "total_assets", "equity_growth": "total_equity", "receivable_growth": "accounts_receivable"}
    x = x.withColumns({f"_p_{n}": F.lag(s).over(w) for n, s in grown.items()})

    def pct(a: str, b: str) -> Column:
        return div(a, b) * 100

    growth = [F.when(c(f"_p_{n}") != 0, (c(s) - c(f"_p_{n}")) / F.abs(c(f"_p_{n}")) * 100).alias(n) for n, s in grown.items()]
    fcf = c("operating_cash_flow") - F.abs(F.coalesce(c("cash_for_fixed_assets"), F.lit(0.0)))
    return x.select(
        *KEY,
        pct("net_profit_parent", "total_equity").alias("roe"), pct("net_profit", "total_assets").alias("roa"),
        (div(c("_rev") - c("_cost"), c("_rev")) * 100).alias("gross_margin"), pct("net_profit", "_rev").alias("net_margin"),
        pct("operating_profit", "_rev").alias("operating_margin"),
        div("total_current_assets", "total_current_liabilities").alias("current_ratio"),
        div(c("total_current_assets") - c("inventory"), "total_current_liabilities").alias("quick_ratio"),
        div("cash_and_deposits", "total_current_liabilities").alias("cash_ratio"),
        pct("total_liabilities", "total_assets").alias("debt_to_asset"), pct("total_liabilities", "total_equity").alias("debt_to_equity"),
        div("total_assets", "total_equity").alias("equity_multiplier"),
        div("_cost", "inventory").alias("inventory_turnover"), div("_rev", "accounts_receivable").alias("receivable_turnover"),
        div("_rev", "total_assets").alias("total_asset_turnover"), div("_rev", "total_current_assets").alias("current_asset_turnover"),
        *growth,
        div("operating_cash_flow", "net_profit").alias("ocf_to_profit"), div("operating_cash_flow", "_rev").alias("ocf_to_revenue"),
        fcf.alias("free_cash_flow"), div(fcf, "net_profit").alias("fcf_to_profit"),
        c("basic_eps").alias("eps"), div("total_equity", "share_capital").alias("bps"),
        div("operating_cash_flow", "share_capital").alias("ocf_per_share"))


def validate_statements(bs: DataFrame, inc: DataFrame, cf: DataFrame, tol: float = 0.01) -> DataFrame:
    """One row per code, date and rule: pass flag and difference; null where an input is absent.

    Sums are compared within ``tol`` of the total.
    """
    x = bs.join(inc, KEY, "full").join(cf, KEY, "full")
    x = with_columns_or_null(
        x, "total_non_current_assets", "total_non_current_liabilities", "total_profit", "beginning_cash", "ending_cash",
        "net_cash_increase", "investing_cash_flow", "financing_cash_flow", "exchange_rate_effect")
    c = F.col

    def near(total: str, expected: Column) -> tuple[Column, Column]:
        d = c(total) - expected
        return F.when(c(total) == 0, True).otherwise(F.abs(d) <= F.abs(c(total)) * tol), d

    def zero(n: str) -> Column:
        return F.coalesce(c(n), F.lit(0.0))

    debt = F.when(c("total_assets") != 0, div("total_liabilities", "total_assets") * 100)
    op, tp, net = c("operating_profit"), c("total_profit"), c("net_profit")
    rev = F.coalesce("operating_revenue", "total_revenue")
    eps, npp = c("basic_eps"), c("net_profit_parent")
    rules: dict[str, tuple[Column, Column]] = {
        "accounting_equation": near("total_assets", c("total_liabilities") + c("total_equity")),
        "asset_composition": near("total_assets", c("total_current_assets") + c("total_non_current_assets")),
        "liability_composition": near("total_liabilities", c("total_current_liabilities") + c("total_non_current_liabilities")),
        "positive_assets": (c("total_assets") > 0, c("total_assets")),
        "debt_ratio_range": (debt.between(0, 100), debt),
        "profit_order": (((net <= tp) & (tp <= op)) | ((op <= tp) & (tp <= net)), op - net),
        "positive_revenue": (rev > 0, rev),
        "eps_sign": (F.when(eps != 0, F.signum(npp) == F.signum(eps)), eps),
        "cash_reconciliation": near("ending_cash", c("beginning_cash") + c("net_cash_increase")),
        "cash_composition": near("net_cash_increase", zero("operating_cash_flow") + zero("investing_cash_flow")
                                 + zero("financing_cash_flow") + zero("exchange_rate_effect")),
    }
    parts = F.array(*[F.struct(F.lit(k).alias("rule"), F.when(d.isNotNull(), ok).alias("passed"), d.alias("difference"))
                      for k, (ok, d) in rules.items()])
    return x.select(*KEY, F.explode(parts).alias("r")).select(*KEY, "r.*")


def risk_flags(ind: DataFrame, receivable: float = 50.0, inventory: float = -10.0, debt: float = 70.0,
               current: float = 1.0, cash: float = 0.5) -> DataFrame:
    """Named flags and level (high from three flags, medium from one); ``ind`` comes from :func:`ratios`.

    The inventory reading is the change of the turnover in percent.
    """
    prev = F.lag("inventory_turnover").over(Window.partitionBy(CODE).orderBy("report_date"))
    x = ind.withColumn("_it", F.when(prev != 0, (F.col("inventory_turnover") - prev) / F.abs(prev) * 100))
    flags = F.array_compact(F.array(
        F.when(F.col("receivable_growth") > receivable, "receivable_surge"), F.when(F.col("_it") < inventory, "inventory_slowdown"),
        F.when(F.col("debt_to_asset") > debt, "high_debt"), F.when(F.col("current_ratio") < current, "low_liquidity"),
        F.when(F.col("ocf_to_profit") < cash, "weak_cash")))
    x = x.withColumn("_f", flags)
    n = F.size("_f")
    return x.select(*KEY, F.array_join("_f", ",").alias("flags"), n.alias("n_flags"),
                    F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low").alias("risk_level"))


def valuation(df: DataFrame) -> DataFrame:
    """PE against the industry mean and absolute bands, PB/ROE, PEG; score and label.

    ``df``: ``code, industry, pe, pb, roe, growth``.  A stock without a positive
    industry mean is neutral on PE.
    """
    mean = df.groupBy("industry").agg(F.avg("pe").alias("industry_pe"))
    x = df.join(mean, "industry", "left")
    disc = F.when(F.col("industry_pe") > 0, (F.col("industry_pe") - F.col("pe")) / F.col("industry_pe"))
    pbroe = F.when(F.col("roe") > 0, F.col("pb") / F.col("roe"))
    peg = F.when(F.col("growth") > 0, F.col("pe") / F.col("growth"))
    x = x.withColumns({
        "pe_band": F.when(disc >= 0.2, "undervalued").when(disc <= -0.2, "overvalued").otherwise("neutral"),
        "pe_level": F.when(F.col("pe") < 15, "cheap").when(F.col("pe") < 30, "fair").otherwise("expensive"),
        "pb_band": F.when(pbroe < 0.1, "undervalued").when(pbroe > 0.2, "overvalued").otherwise("neutral"),
        "peg": peg,
        "peg_band": (F.when(peg.isNull(), "negative_growth").when(peg < 1, "undervalued").when(peg < 1.5, "fair")
                     .when(peg < 2, "slightly_overvalued").otherwise("overvalued"))})

    def points(c: str, p: int) -> Column:
        return F.when(F.col(c) == "undervalued", p).when(F.col(c) == "overvalued", -p).otherwise(0)

    peg_points = F.when(peg < 1, 15).when((peg > 2) | peg.isNull(), -15).otherwise(0)
    score = F.lit(50) + points("pe_band", 20) + points("pb_band", 15) + peg_points
    x = x.withColumn("valuation_score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    s = F.col("valuation_score")
    return x.withColumn("valuation_label", F.when(s >= 70, "buy").when(s >= 50, "hold").otherwise("watch"))


def codes_meeting(ind: DataFrame, ratio: str, minimum: float) -> DataFrame:
    """Date index of the codes that meet a threshold, in long form (no array grows with the data)."""
    return ind.where(F.col(ratio) >= minimum).select("report_date", CODE)
