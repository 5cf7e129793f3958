"""Yearly financial statements: normalisation, ratios, divergences, trends and growth. Rows are (entity_id, fy, fiscal_year, measures)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.exprs import amount_normal, cagr, fy_key, growth, nz, over, sdiv, unit_factor


def normalise(raw: DataFrame, measures: list[str], prefer_consolidated: bool = True, compat: bool = False) -> DataFrame:
    """raw (entity_id, fiscal_year, unit, statement_type, ordinal, measures as strings) in crore, one statement a year: consolidated
    before standalone (or the reverse) before the first seen; of equal ones the last. A row of an unknown unit is skipped.
    compat: cash conversion days are scaled like money."""
    factor = unit_factor(F.col("unit"))
    rank = F.when(F.col("statement_type") == "consolidated", 0 if prefer_consolidated else 1).when(F.col("statement_type") == "standalone", 1 if prefer_consolidated else 0).otherwise(2)
    best = Window.partitionBy("entity_id", "fiscal_year").orderBy("_rank", F.when(F.col("_rank") == 2, F.col("ordinal")).otherwise(-F.col("ordinal")))
    rows = raw.withColumn("_factor", factor).where("_factor is not null").withColumn("_rank", rank).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    plain = lambda m: F.lit(1.0) if m == "ccc_days" and not compat else F.col("_factor")
    return rows.select("entity_id", "fiscal_year", fy_key(F.col("fiscal_year")).alias("fy_key"), "statement_type", *[amount_normal(F.col(m), plain(m)).alias(m) for m in measures])


def ratios(years: DataFrame) -> DataFrame:
    """The 14 ratios of each year; null where a denominator isn't positive. Missing measures count as 0."""
    have = set(years.columns)
    m = lambda c: nz(c) if c in have else F.lit(0.0)
    revenue, cogs, ebitda, equity, debt = m("revenue"), m("cogs"), m("ebitda"), m("total_equity"), m("total_debt")
    gross = F.when((m("gross_profit") == 0) & (revenue > 0), revenue - cogs).otherwise(m("gross_profit"))
    ebit = F.when((m("ebit") == 0) & (ebitda > 0), ebitda - m("depreciation")).otherwise(m("ebit"))
    base = F.when(cogs > 0, cogs).otherwise(revenue * 0.7)
    dso, dio, dpo = sdiv(m("trade_receivables"), revenue, None) * 365, sdiv(m("inventory"), base, None) * 365, sdiv(m("trade_payables"), base, None) * 365
    out = {
        "gross_margin": sdiv(gross, revenue, None) * 100, "ebitda_margin": sdiv(ebitda, revenue, None) * 100, "pat_margin": sdiv(m("pat"), revenue, None) * 100,
        "asset_turnover": F.when(revenue > 0, sdiv(revenue, m("total_assets"), None)), "roe": sdiv(m("pat"), equity, None) * 100, "roce": sdiv(ebit, equity + debt, None) * 100,
        "debt_equity": sdiv(debt, equity, None), "current_ratio": sdiv(m("current_assets"), m("current_liabilities"), None),
        "quick_ratio": sdiv(m("current_assets") - m("inventory"), m("current_liabilities"), None), "interest_coverage": sdiv(ebitda, m("interest_expense"), None),
        "receivable_days": dso, "inventory_days": dio, "payable_days": dpo,
    }
    out["cash_conversion_cycle"] = F.when((dso != 0) & (dio != 0) & (dpo != 0), dio + dso - dpo)
    return years.select("*", *[c.alias(k) for k, c in out.items()])


def new_age_metrics(years: DataFrame) -> DataFrame:
    """Contribution margin, monthly burn, runway in whole months, revenue by user in rupees, take rate."""
    burn = F.when(F.col("cfo") < 0, F.abs("cfo") / 12)
    return years.select(
        "*", (sdiv(F.col("revenue") - nz("variable_costs"), F.col("revenue"), None) * 100).alias("contribution_margin"), burn.alias("monthly_burn"),
        sdiv(nz("cash"), burn, None).cast("int").alias("runway_months"), (sdiv(F.col("revenue"), nz("users"), None) * 1e7).alias("revenue_per_user"), (sdiv(F.col("revenue"), nz("gmv"), None) * 100).alias("take_rate"),
    )


def divergences(years: DataFrame) -> DataFrame:
    """Warnings (entity_id, fiscal_year, warning_type, severity, actual_value, threshold_value) from each year's second on."""
    w = over("entity_id", "fy")
    year = ratios(years)
    prior = lambda c: F.lag(c).over(w)
    gap = growth(F.col("p_recv"), F.col("trade_receivables")) - growth(F.col("p_rev"), F.col("revenue"))
    cash = sdiv(F.col("cfo"), F.col("ebitda"), None) * 100 if "cfo" in years.columns else F.lit(None).cast("double")
    piled, slower = F.col("inventory_days") - F.col("p_dio"), F.col("receivable_days") - F.col("p_dso")
    year = year.withColumns({"p_rev": prior("revenue"), "p_recv": prior("trade_receivables"), "p_dio": prior("inventory_days"), "p_dso": prior("receivable_days"), "_n": F.row_number().over(w)}).where("_n > 1")

    def warn(kind: str, when: object, value: object, critical: object, major: object, threshold: float) -> object:
        level = F.when(critical, "CRITICAL").when(major, "MAJOR")
        return F.when(when & level.isNotNull(), F.struct(F.lit(kind).alias("warning_type"), level.alias("severity"), value.alias("actual_value"), F.lit(threshold).alias("threshold_value")))

    found = F.array(
        warn("channel_stuffing", (F.col("p_rev") > 0) & (F.col("p_recv") > 0), gap, gap > 20, gap > 10, 10.0),
        warn("paper_profits", F.col("ebitda") > 0, cash, cash < 30, cash < 50, 50.0),
        warn("inventory_piling", (F.col("p_dio") != 0) & (F.col("inventory_days") != 0), piled, piled > 30, piled > 15, 15.0),
        warn("collection_stress", (F.col("p_dso") != 0) & (F.col("receivable_days") != 0), slower, F.lit(False), slower > 20, 10.0),
    )
    return year.select("entity_id", "fiscal_year", F.inline(F.filter(found, lambda x: x.isNotNull())))


def trends(years: DataFrame) -> DataFrame:
    """Per entity of two years or more: growth of revenue, ebitda and pat, and how margin, ROE, leverage and cash cycle moved from the first year to the last."""
    year = ratios(years)
    have = set(year.columns)
    kept = [c for c in ("revenue", "ebitda", "pat", "ebitda_margin", "roe", "debt_equity", "cash_conversion_cycle") if c in have]
    ends = year.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_years"), *[f(F.struct(c), "fy")[c].alias(f"{k}_{c}") for c in kept for k, f in (("first", F.min_by), ("last", F.max_by))]).where("n_years > 1")
    span = (F.col("n_years") - 1).cast("double")

    def label(c: str, step: float, up: str, down: str) -> object:
        d = F.col(f"last_{c}") - F.col(f"first_{c}")
        return F.when(d > step, up).when(d < -step, down).when(d.isNotNull(), "stable")

    return ends.select(
        "entity_id", "n_years", *[cagr(F.col(f"first_{c}"), F.col(f"last_{c}"), span, None).alias(f"{c}_cagr") for c in ("revenue", "ebitda", "pat") if c in kept],
        label("ebitda_margin", 2, "expanding", "contracting").alias("margin_trend"), label("roe", 3, "improving", "deteriorating").alias("roe_trend"),
        label("debt_equity", 0.3, "increasing", "decreasing").alias("debt_trend"), label("cash_conversion_cycle", 15, "worsening", "improving").alias("working_capital_trend"),
    )


def anomalies(years: DataFrame) -> DataFrame:
    """(entity_id, fiscal_year, kind, size): revenue up by over 50 %, ebitda margin down by over 5 points."""
    w = over("entity_id", "fy")
    year = ratios(years).withColumns({"p_rev": F.lag("revenue").over(w), "p_margin": F.lag("ebitda_margin").over(w)})
    spike, drop = (sdiv(F.col("revenue"), F.col("p_rev"), None) - 1) * 100, F.col("p_margin") - F.col("ebitda_margin")
    row = lambda kind, when, size: F.when(when, F.struct(F.lit(kind).alias("kind"), size.alias("size")))
    found = F.array(row("revenue_spike", spike > 50, spike), row("margin_drop", (drop > 5) & (F.col("p_margin") != 0) & (F.col("ebitda_margin") != 0), drop))
    return year.select("entity_id", "fiscal_year", F.inline(F.filter(found, lambda x: x.isNotNull())))


def yearly_trend(years: DataFrame, metric: str = "revenue") -> DataFrame:
    """(entity_id, fiscal_year, metric) of years that have it."""
    return years.where(F.col(metric).isNotNull()).select("entity_id", "fiscal_year", metric)


def latest_year(years: DataFrame, order: str = "fiscal_year") -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.desc(order))
    return years.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cagr_of(years: DataFrame, variant: str, metric: str = "revenue", periods: int | None = None) -> DataFrame:
    """(entity_id, cagr) by one of the reference definitions, which differ: normaliser (positive values only, of the last `periods`),
    projection (values that aren't 0), trend (first and last year), repository (a fraction, years ordered as text)."""
    order = "fiscal_year" if variant == "repository" else "fy"
    keep = {"normaliser": F.col(metric) > 0, "projection": F.col(metric) != 0, "trend": F.lit(True), "repository": F.col(metric).isNotNull()}[variant]
    rows = years.where(keep)
    if periods:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc(order)))).where(F.col("_n") <= periods)
    ends = rows.groupBy("entity_id").agg(F.min_by(metric, order).alias("a"), F.max_by(metric, order).alias("b"), F.count(F.lit(1)).alias("n"))
    digits, scale = {"normaliser": (2, 100.0), "projection": (2, 100.0), "trend": (None, 100.0), "repository": (None, 1.0)}[variant]
    return ends.select("entity_id", cagr(F.col("a"), F.col("b"), (F.col("n") - 1).cast("double"), digits, scale).alias("cagr"))


def merged_statements(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Three statements (entity_id, fy, measures) joined on the year; what a side lacks is 0."""
    keys = ["entity_id", "fy"]
    out = income.join(balance, keys, "full_outer").join(cash, keys, "full_outer")
    return out.select(*keys, *[nz(c).alias(c) for c in out.columns if c not in keys])
