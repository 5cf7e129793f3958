"""Assessments in words, out of the figures of the other operators; for many issuers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.exprs import nz, sdiv
from ledgerleaf.operators import cashflow, risk

# The words of the assessments below, and the thresholds that they name.


def fixed(x: Column | str, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f", F.col(x) if isinstance(x, str) else x)


def listed(*notes: Column) -> Column:
    """The notes that aren't null, in order."""
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


def three(x: Column, high: float, medium: float, *words: str) -> Column:
    return F.when(x > high, words[0]).when(x > medium, words[1]).otherwise(words[2])


def debt_notes(items: DataFrame, about: DataFrame) -> DataFrame:
    """Of each entity of debt items (see risk.debt_totals) a grade and its reason for leverage, interest_cost, refinancing, concentration,
    covenant and coverage. about: (entity_id, equity, any_breach, has_covenants, interest_cover); what is missing there counts as none, and
    without a cover, or with one of 0, coverage is null."""
    c, unit = F.col, lambda x: fixed(F.coalesce(F.col(x), F.lit(0.0)), 1)
    rows = risk.debt_totals(items).join(risk.debt_rates(items), "entity_id", "left").join(risk.lender_concentration(items), "entity_id").join(risk.maturity_profile(items).select("entity_id", "y_0_1"), "entity_id").join(about, "entity_id", "left")
    owed = c("total_debt") != 0
    near = F.when(owed, risk.grade(sdiv(c("y_0_1"), c("total_debt")) * 100, 50, 30)).otherwise("N/A")
    most = F.when(owed, risk.grade(c("top_pct"), 50, 30)).otherwise("N/A")
    cover = lambda words: F.concat(F.lit(words[0]), fixed("interest_cover", 2), F.lit(words[1]))
    known = F.coalesce(c("interest_cover"), F.lit(0.0)) != 0
    return rows.select(
        "entity_id",
        three(sdiv(c("total_debt"), nz("equity")), 2, 1, "HIGH - D/E ratio exceeds 2x", "MEDIUM - D/E ratio between 1-2x", "LOW - D/E ratio below 1x").alias("leverage"),
        three(nz("weighted_rate"), 12, 9, "HIGH - Weighted average rate exceeds 12%", "MEDIUM - Weighted average rate 9-12%", "LOW - Weighted average rate below 9%").alias("interest_cost"),
        F.concat(near, F.lit(" - "), unit("y_0_1"), F.lit(" Cr maturing within 1 year")).alias("refinancing"),
        F.concat(most, F.lit(" - Top lender "), "top_lender", F.lit(" has "), unit("top_amount"), F.lit(" Cr exposure")).alias("concentration"),
        F.when(c("any_breach"), "HIGH - Covenant breaches disclosed").when(c("has_covenants"), "MEDIUM - Financial covenants in place").otherwise("LOW - No restrictive covenants disclosed").alias("covenant"),
        F.when(known & (c("interest_cover") < 1.5), cover(("HIGH - Interest coverage ratio ", "x is below 1.5x"))).when(known & (c("interest_cover") < 3), cover(("MEDIUM - Interest coverage ratio ", "x is below 3x"))).when(known, cover(("LOW - Interest coverage ratio ", "x is healthy"))).alias("coverage"),
    )


def cash_assessment(years: DataFrame) -> DataFrame:
    """(entity_id, red_flags, assessment) of the years that cashflow.trend takes: the flags in words, and one sentence of all."""
    last = cashflow.single_year(years).groupBy("entity_id").agg(F.max_by(F.struct("is_burning", "runway_months"), "fy").alias("last"))
    rows = cashflow.trend(years).join(last, "entity_id")
    c, months = F.col, F.when(F.col("last.is_burning"), F.col("last.runway_months"))
    flags = listed(
        F.when(c("burn_years") >= 2, F.concat(F.lit("Negative FCF for "), "burn_years", F.lit(" consecutive years"))),
        F.when(c("earnings_quality") == "Low", F.concat(F.lit("Low earnings quality: CFO/EBITDA at "), fixed("avg_cfo_to_ebitda"), F.lit("%"))),
        F.when(months < 12, F.concat(F.lit("Critical cash runway: only "), fixed(months), F.lit(" months"))).when(months < 18, F.concat(F.lit("Low cash runway: "), fixed(months), F.lit(" months"))),
        F.when(c("fcf_trend") == "Deteriorating", "FCF trend deteriorating over time"),
        F.when(c("total_burned") > 100, F.concat(F.lit("Total cash burned: ₹"), fixed("total_burned"), F.lit(" Cr over the period"))),
    )
    rows = rows.withColumn("red_flags", flags)
    sign = F.when(c("avg_fcf") > 0, "positive").otherwise("negative")
    parts = listed(
        F.concat(F.lit("Average "), sign, F.lit(" FCF of ₹"), fixed(F.abs("avg_fcf")), F.lit(" Cr")), F.concat("earnings_quality", F.lit(" earnings quality")), F.concat(F.lit("Capex in "), F.lower("capex_pattern")),
        F.when(F.size("red_flags") > 0, F.concat(F.lit("Red flags: "), F.size("red_flags"))),
    )
    return rows.select("entity_id", "red_flags", F.concat(F.array_join(parts, ". "), F.lit(".")).alias("assessment"))


def working_capital_assessment(trends: DataFrame, latest: DataFrame) -> DataFrame:
    """(entity_id, assessment) of working_capital.trend's rows and of the latest year's variance (entity_id, ccc_variance_pct) from the sector."""
    c, years = F.col, lambda x: F.regexp_replace(x, ",", ", ")
    issues = listed(
        F.when(c("ccc_trend") == "Worsening", "Cash conversion cycle worsening over time"),
        F.when(c("stuffing_years") != "", F.concat(F.lit("Channel stuffing risk detected in "), years("stuffing_years"))), F.when(c("piling_years") != "", F.concat(F.lit("Inventory piling detected in "), years("piling_years"))),
        F.when(c("ccc_variance_pct") > 50, F.concat(F.lit("CCC "), fixed("ccc_variance_pct"), F.lit("% above sector average"))),
    )
    rows = trends.join(latest.select("entity_id", "ccc_variance_pct"), "entity_id", "left").withColumn("issues", issues)
    return rows.select("entity_id", F.when(F.size("issues") > 0, F.concat(F.lit("Concerns: "), F.array_join("issues", "; "))).otherwise("Working capital management appears healthy with no major concerns").alias("assessment"))


def issuer_risk(items: DataFrame, issuers: DataFrame) -> DataFrame:
    """Of every issuer (issuer, networth, contingent_pct) with litigation items (issuer, entity_type, case_type, amount_cr, cnt): litigation but
    that of group companies as a share of net worth, criminal cases of promoters, severity, veto and its reason. Issuers without items
    have none of it; items of unknown issuers are left out. What risk.risk_severity says of one issuer."""
    sums = items.where("entity_type <> 'Group Company'").groupBy("issuer").agg(F.sum("amount_cr").alias("amount_cr"), F.sum(F.when((F.col("entity_type") == "Promoter") & (F.col("case_type") == "Criminal"), F.col("cnt"))).alias("criminal"))
    rows = issuers.join(sums, "issuer", "left").withColumns({"litigation_pct": sdiv(F.coalesce("amount_cr", F.lit(0.0)), F.when(F.col("networth") > 0, F.col("networth"))) * 100, "criminal_promoter": F.coalesce("criminal", F.lit(0)).cast("long")})
    c = F.col
    large, crimes = c("litigation_pct") > 10, c("criminal_promoter") > 0
    reasons = listed(F.when(large, F.concat(F.lit("Litigation exposure ("), fixed("litigation_pct", 1), F.lit("%) exceeds 10.0% of net worth"))), F.when(crimes, F.concat(F.lit("Criminal cases against promoters: "), c("criminal_promoter").cast("string"))))
    both = c("litigation_pct") + F.coalesce("contingent_pct", F.lit(0.0))
    severity = F.when(large | crimes | (both > 15), "Critical").when(both > 5, "Major").otherwise("Minor")
    return rows.select("issuer", "litigation_pct", "criminal_promoter", severity.alias("severity"), (large | crimes).alias("veto"), F.array_join(reasons, "; ").alias("veto_reason"))


def issuer_litigation(items: DataFrame, issuers: DataFrame) -> DataFrame:
    """risk.litigation_rollup of every issuer at once: by issuer and entity type, counts by kind, amount and its share of net worth."""
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("cnt"))), F.lit(0)).cast("long")
    kinds = ("Civil", "Criminal", "Tax", "Regulatory")
    sums = items.groupBy("issuer", "entity_type").agg(F.sum("cnt").cast("long").alias("total"), *[n(F.col("case_type") == k).alias(f"{k.lower()}_count") for k in kinds], n(~F.col("case_type").isin(*kinds)).alias("other_count"), F.sum("amount_cr").alias("amount_cr"))
    rows = sums.join(issuers.select("issuer", "networth"), "issuer")
    return rows.withColumn("pct_networth", sdiv(F.col("amount_cr"), F.when(F.col("networth") > 0, F.col("networth"))) * 100).drop("networth")


def with_actuals(found: DataFrame, inputs: DataFrame) -> DataFrame:
    """Violations with the value that broke the rule, in words, out of the rules' inputs."""
    c, pct = F.col, lambda x: F.concat(fixed(x, 1), F.lit("%"))
    amount = F.concat(F.lit("₹"), fixed("total_litigation_cr", 1), F.lit(" Cr"))
    rule = lambda start: F.col("rule_id").startswith(start)
    actual = (
        F.when(rule("SKIN-001"), pct("promoter_post_issue_holding_pct")).when(rule("SKIN-002"), F.concat(F.lit("OFS="), pct("ofs_pct_of_issue"), F.lit(", Fresh="), pct("fresh_issue_pct_of_issue"))).when(rule("PLEDGE"), pct("promoter_pledge_pct"))
        .when(rule("RPT-001"), pct("rpt_revenue_pct")).when(rule("RPT-002"), pct("rpt_expense_pct")).when(rule("AUDIT-001") | rule("AUDIT-002"), "Yes").when(rule("AUDIT-003"), F.concat(c("caro_qualifications").cast("string"), F.lit(" qualifications")))
        .when(rule("LITIG"), F.when(c("post_issue_networth_cr") > 0, F.concat(pct(c("total_litigation_cr") / F.when(c("post_issue_networth_cr") > 0, c("post_issue_networth_cr")) * 100), F.lit(" ("), amount, F.lit(")"))).otherwise(amount))
        .when(rule("WC"), F.concat(fixed(c("receivable_days_growth") - c("revenue_cagr_3yr"), 1), F.lit("pp gap"))).otherwise("N/A")
    )
    return found.join(inputs, "entity_id").select(*found.columns, actual.alias("actual"))
