"""Cash flow: free cash flow, burn and runway, capital spending, earnings quality, and the trend over years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.exprs import sdiv

INFINITE = float("inf")


def single_year(years: DataFrame, market_cap_floor: float | None = None, market_cap_cap: float | None = None) -> DataFrame:
    """Rows (entity_id, fy, cfo, cfi, cff, capex, revenue, ebitda, pat, depreciation, cash_and_equivalents, current_liabilities, working_capital_change)."""
    c = F.col
    out = years.withColumns({"net_cash_flow": c("cfo") + c("cfi") + c("cff"), "fcf": c("cfo") - c("capex")})
    burn = F.when(c("fcf") < 0, F.abs("fcf") / 12)
    ratio = lambda of: F.when(c(of) > 0, c("cfo") / F.when(c(of) > 0, c(of)) * 100).when((c(of) < 0) & (c("cfo") > 0), 100.0).otherwise(0.0)
    out = out.withColumns({
        "fcf_margin": sdiv(c("fcf"), c("revenue")) * 100,
        "fcf_yield_at_floor": sdiv(c("fcf"), F.lit(market_cap_floor).cast("double"), None) * 100, "fcf_yield_at_cap": sdiv(c("fcf"), F.lit(market_cap_cap).cast("double"), None) * 100,
        "is_burning": c("fcf") < 0, "monthly_burn": burn, "runway_months": sdiv(c("cash_and_equivalents"), burn, None),
    })
    status = F.when(~c("is_burning"), "PROFITABLE_FCF").when(c("pat") > 0, "PROFITABLE_NEGATIVE_FCF").when(c("runway_months") < 12, "CRITICAL_BURN").otherwise("CASH_BURNING")
    return out.withColumns({
        "burn_status": status, "capex_to_revenue": sdiv(c("capex"), c("revenue")) * 100,
        "capex_to_depreciation": F.when(c("depreciation") > 0, sdiv(c("capex"), c("depreciation"))).when(c("capex") > 0, INFINITE).otherwise(0.0),
        "maintenance_capex": F.least("depreciation", "capex"), "growth_capex": F.greatest(F.lit(0.0), c("capex") - c("depreciation")),
        "wc_change_to_revenue": sdiv(c("working_capital_change"), c("revenue")) * 100, "cfo_to_ebitda": ratio("ebitda"), "cfo_to_pat": ratio("pat"),
        "cash_to_current_liabilities": sdiv(c("cash_and_equivalents"), c("current_liabilities")),
    })


def trend(years: DataFrame) -> DataFrame:
    """Per entity: means, trend of free cash flow by halves, quality, spending pattern, years of burn up to the latest, and how many red flags."""
    w, back = Window.partitionBy("entity_id").orderBy("fy"), Window.partitionBy("entity_id").orderBy(F.desc("fy")).rowsBetween(Window.unboundedPreceding, 0)
    year = single_year(years).withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("entity_id")), "_calm": F.sum(F.when(~F.col("is_burning"), 1).otherwise(0)).over(back)})
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    out = year.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_years"), F.avg("fcf").alias("avg_fcf"), F.avg("fcf_margin").alias("avg_fcf_margin"), F.avg("cfo_to_ebitda").alias("avg_cfo_to_ebitda"), F.avg("capex_to_revenue").alias("avg_capex_intensity"),
        F.coalesce(F.avg(F.when(early, F.col("fcf"))), F.lit(0.0)).alias("_a"), F.avg(F.when(~early, F.col("fcf"))).alias("_b"), F.var_pop("fcf").alias("_var"), F.avg("capex_to_depreciation").alias("_spend"),
        F.count_if(F.col("_calm") == 0).alias("burn_years"), F.coalesce(F.sum(F.when(F.col("is_burning"), F.abs("fcf"))), F.lit(0.0)).alias("total_burned"), F.max_by(F.struct("is_burning", "runway_months"), "fy").alias("_last"),
    )
    c = F.col
    moved = F.when(c("n_years") < 2, "Insufficient data").when(c("_b") > c("_a") + 10, "Improving").when(c("_b") < c("_a") - 10, "Deteriorating").when(c("_var") > F.pow(F.abs("avg_fcf") * 0.5, F.lit(2.0)), "Volatile").otherwise("Stable")
    quality = F.when(c("avg_cfo_to_ebitda") >= 70, "High").when(c("avg_cfo_to_ebitda") >= 50, "Medium").otherwise("Low")
    pattern = F.when(c("_spend") > 1.5, "Growth mode").when(c("_spend") < 0.8, "Under-investment").otherwise("Maintenance mode")
    out = out.withColumns({"fcf_trend": moved, "earnings_quality": quality, "capex_pattern": pattern})
    low = c("_last")["is_burning"] & (c("_last")["runway_months"] < 18)
    flags = sum(F.when(x, 1).otherwise(0) for x in (c("burn_years") >= 2, c("earnings_quality") == "Low", low, c("fcf_trend") == "Deteriorating", c("total_burned") > 100))
    return out.withColumn("n_red_flags", flags).drop("_a", "_b", "_var", "_spend", "_last")
