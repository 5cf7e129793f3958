"""Named queries over the tables of a folder, each with SQL that another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import exprs
from ledgerleaf.operators import cashflow, chunks, financials, offer, risk, store, text, vectors, working_capital
from ledgerleaf.sources import pages as scan
from ledgerleaf.sources.tables import plain, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


YEARS = plain("fin_year")
GUARD = "CASE WHEN {b} > 0 THEN {a} / {b} END"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN ({a}) / nullif({b}, 0) END)"


# ---- financial years ----

_W = "OVER (PARTITION BY entity_id ORDER BY fy)"
_GROWTH = lambda c: f"coalesce((CASE WHEN lag({c}) {_W} > 0 THEN {c} / nullif(lag({c}) {_W}, 0) END - 1) * 100, 0)"


@query("fin_ratio_trend", f"""
WITH y AS {YEARS}, r AS (SELECT *, (revenue - cogs) / revenue * 100 AS gross_margin, trade_receivables / revenue * 365 AS dso, {_GROWTH('trade_receivables')} - {_GROWTH('revenue')} AS gap, lag(fy) {_W} AS before FROM y)
SELECT entity_id, fiscal_year, round(revenue, 4) AS revenue, round(gross_margin, 4) AS gross_margin, round(dso, 4) AS dso, round(dso - lag(dso) {_W}, 4) AS dso_change,
       CASE WHEN before IS NULL THEN 'FIRST' WHEN gap > 20 THEN 'CRITICAL' WHEN gap > 10 THEN 'MAJOR' ELSE 'OK' END AS flag
FROM r""")
def fin_ratio_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = exprs.over("entity_id", "fy")
    years = view(spark, sf_dir, "fin_year")
    r = financials.ratios(years).withColumns({"gap": exprs.growth(F.lag("trade_receivables").over(w), F.col("trade_receivables")) - exprs.growth(F.lag("revenue").over(w), F.col("revenue")), "before": F.lag("fy").over(w), "dso_change": F.col("receivable_days") - F.lag("receivable_days").over(w)})
    flag = F.when(F.col("before").isNull(), "FIRST").when(F.col("gap") > 20, "CRITICAL").when(F.col("gap") > 10, "MAJOR").otherwise("OK")
    return rounded(r.select("entity_id", "fiscal_year", "revenue", "gross_margin", F.col("receivable_days").alias("dso"), "dso_change", flag.alias("flag")))


# a year's full statements, made of the same facts: some have no equity, gross profit or ebit of their own
_FULL = """(SELECT *, ebitda * 0.5 - tax_expense AS pat, revenue * 0.8 AS total_assets, CASE WHEN entity_id % 5 = 0 THEN 0.0 ELSE revenue * 0.4 END AS total_equity, revenue * 0.2 AS total_debt, trade_receivables + inventory AS current_assets, trade_payables AS current_liabilities,
  tax_expense * 0.1 AS interest_expense, inventory * 0.015 AS depreciation, CASE WHEN entity_id % 2 = 0 THEN 0.0 ELSE revenue * 0.25 END AS gross_profit, CASE WHEN entity_id % 3 = 0 THEN 0.0 ELSE ebitda * 0.8 END AS ebit FROM {y} y)"""


def full_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = F.col, F.col("entity_id")
    return view(spark, sf_dir, "fin_year").select(
        "*", (c("ebitda") * 0.5 - c("tax_expense")).alias("pat"), (c("revenue") * 0.8).alias("total_assets"), F.when(e % 5 == 0, 0.0).otherwise(c("revenue") * 0.4).alias("total_equity"), (c("revenue") * 0.2).alias("total_debt"), (c("trade_receivables") + c("inventory")).alias("current_assets"), c("trade_payables").alias("current_liabilities"),
        (c("tax_expense") * 0.1).alias("interest_expense"), (c("inventory") * 0.015).alias("depreciation"), F.when(e % 2 == 0, 0.0).otherwise(c("revenue") * 0.25).alias("gross_profit"), F.when(e % 3 == 0, 0.0).otherwise(c("ebitda") * 0.8).alias("ebit"),
    )


RATIOS = ("gross_margin", "ebitda_margin", "pat_margin", "asset_turnover", "roe", "roce", "debt_equity", "current_ratio", "quick_ratio", "interest_coverage", "receivable_days", "inventory_days", "payable_days", "cash_conversion_cycle")


@query("fin_ratios", f"""
WITH y AS {_FULL.format(y=YEARS)}, g AS (SELECT *, CASE WHEN gross_profit = 0 AND revenue > 0 THEN revenue - cogs ELSE gross_profit END AS gp, CASE WHEN ebit = 0 AND ebitda > 0 THEN ebitda - depreciation ELSE ebit END AS op, trade_receivables / revenue * 365 AS dso, inventory / cogs * 365 AS dio, trade_payables / cogs * 365 AS dpo FROM y)
SELECT entity_id, fy, round(gp / revenue * 100, 4) AS gross_margin, round(ebitda / revenue * 100, 4) AS ebitda_margin, round(pat / revenue * 100, 4) AS pat_margin, round({div('revenue', 'total_assets')}, 4) AS asset_turnover, round({div('pat', 'total_equity')} * 100, 4) AS roe,
       round({div('op', '(total_equity + total_debt)')} * 100, 4) AS roce, round({div('total_debt', 'total_equity')}, 4) AS debt_equity, round({div('current_assets', 'current_liabilities')}, 4) AS current_ratio, round({div('current_assets - inventory', 'current_liabilities')}, 4) AS quick_ratio,
       round({div('ebitda', 'interest_expense')}, 4) AS interest_coverage, round(dso, 4) AS receivable_days, round(dio, 4) AS inventory_days, round(dpo, 4) AS payable_days, CASE WHEN dso <> 0 AND dpo <> 0 AND dio <> 0 THEN round(dio + dso - dpo, 4) END AS cash_conversion_cycle FROM g""")
def fin_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(financials.ratios(full_years(spark, sf_dir)).select("entity_id", "fy", *RATIOS))


@query("revenue_trend", f"WITH y AS {YEARS} SELECT entity_id, fiscal_year, round(revenue, 4) AS revenue FROM y WHERE revenue IS NOT NULL")
def revenue_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(financials.yearly_trend(view(spark, sf_dir, "fin_year")))


@query("latest_year", f"WITH y AS {YEARS} SELECT entity_id, fiscal_year, round(revenue, 4) AS revenue, round(ebitda, 4) AS ebitda FROM y QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY fy DESC) = 1")
def latest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(financials.latest_year(view(spark, sf_dir, "fin_year"), "fy").select("entity_id", "fiscal_year", "revenue", "ebitda"))


def cagr_sql(keep: str, digits: int | None, scale: float, order: str = "fy", metric: str = "ebitda", digits_out: int = 4) -> str:
    x = f"(power(b / a, 1.0 / nullif(n - 1, 0)) - 1) * {scale}"
    x = f"round({x}, {digits})" if digits is not None else x
    return f"""
WITH y AS {YEARS}, e AS (SELECT entity_id, arg_min({metric}, {order}) AS a, arg_max({metric}, {order}) AS b, count(*) AS n FROM y WHERE {keep} GROUP BY entity_id)
SELECT entity_id, round(CASE WHEN a > 0 AND b > 0 AND n > 1 THEN {x} END, {digits_out}) AS cagr FROM e"""


for _variant, _sql in (
    ("normaliser", cagr_sql("ebitda > 0", 2, 100)), ("projection", cagr_sql("ebitda <> 0", 2, 100)), ("trend", cagr_sql("true", None, 100)), ("repository", cagr_sql("ebitda IS NOT NULL", None, 1, "fiscal_year")),
):
    query(f"cagr_{_variant}", _sql)(lambda spark, sf_dir, v=_variant: rounded(financials.cagr_of(view(spark, sf_dir, "fin_year"), v, "ebitda")))


@query("cagr_last_years", f"""
WITH y AS {YEARS}, t AS (SELECT * FROM y WHERE ebitda > 0 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY fy DESC) <= 3), e AS (SELECT entity_id, arg_min(ebitda, fy) AS a, arg_max(ebitda, fy) AS b, count(*) AS n FROM t GROUP BY entity_id)
SELECT entity_id, round(CASE WHEN a > 0 AND b > 0 AND n > 1 THEN round((power(b / a, 1.0 / nullif(n - 1, 0)) - 1) * 100, 2) END, 4) AS cagr FROM e""")
def cagr_last_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(financials.cagr_of(view(spark, sf_dir, "fin_year"), "normaliser", "ebitda", periods=3))


@query("divergence_flags", f"""
WITH y AS (SELECT *, ebitda * (entity_id % 10 + 0.5) / 10 AS cfo FROM {YEARS} x), r AS (SELECT *, {_GROWTH('trade_receivables')} - {_GROWTH('revenue')} AS gap, lag(revenue) {_W} AS p_rev, lag(trade_receivables) {_W} AS p_recv,
  inventory / cogs * 365 - lag(inventory / cogs * 365) {_W} AS piled, trade_receivables / revenue * 365 AS dso, trade_receivables / revenue * 365 - lag(trade_receivables / revenue * 365) {_W} AS slower, lag(trade_receivables / revenue * 365) {_W} AS p_dso FROM y)
SELECT entity_id, fiscal_year, 'channel_stuffing' AS warning_type, CASE WHEN gap > 20 THEN 'CRITICAL' ELSE 'MAJOR' END AS severity, round(gap, 4) AS actual_value, 10.0::DOUBLE AS threshold_value FROM r WHERE p_rev > 0 AND p_recv > 0 AND gap > 10
UNION ALL SELECT entity_id, fiscal_year, 'inventory_piling', CASE WHEN piled > 30 THEN 'CRITICAL' ELSE 'MAJOR' END, round(piled, 4), 15.0 FROM r WHERE piled > 15
UNION ALL SELECT entity_id, fiscal_year, 'collection_stress', 'MAJOR', round(slower, 4), 10.0 FROM r WHERE p_dso <> 0 AND dso <> 0 AND slower > 20
UNION ALL SELECT entity_id, fiscal_year, 'paper_profits', CASE WHEN entity_id % 10 < 3 THEN 'CRITICAL' ELSE 'MAJOR' END, round(cfo / ebitda * 100, 4), 50.0 FROM r WHERE p_rev IS NOT NULL AND ebitda > 0 AND entity_id % 10 < 5""")
def divergence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(financials.divergences(view(spark, sf_dir, "fin_year").withColumn("cfo", F.col("ebitda") * (F.col("entity_id") % 10 + 0.5) / 10)))


@query("trend_labels", f"""
WITH y AS {YEARS}, r AS (SELECT *, ebitda / revenue * 100 AS m, CASE WHEN trade_receivables <> 0 AND trade_payables <> 0 AND inventory <> 0 THEN inventory / cogs * 365 + trade_receivables / revenue * 365 - trade_payables / cogs * 365 END AS ccc FROM y),
e AS (SELECT entity_id, count(*) AS n, arg_min(revenue, fy) AS ra, arg_max(revenue, fy) AS rb, arg_max(m, fy) - arg_min(m, fy) AS dm,
      max(CASE WHEN fy = hi THEN ccc END) - max(CASE WHEN fy = lo THEN ccc END) AS dc FROM (SELECT *, min(fy) OVER (PARTITION BY entity_id) AS lo, max(fy) OVER (PARTITION BY entity_id) AS hi FROM r) GROUP BY entity_id)
SELECT entity_id, n AS n_years, round((power(rb / ra, 1.0 / (n - 1)) - 1) * 100, 4) AS revenue_cagr, CASE WHEN dm > 2 THEN 'expanding' WHEN dm < -2 THEN 'contracting' ELSE 'stable' END AS margin_trend,
       CASE WHEN dc > 15 THEN 'worsening' WHEN dc < -15 THEN 'improving' WHEN dc IS NOT NULL THEN 'stable' END AS working_capital_trend
FROM e WHERE n > 1""")
def trend_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(financials.trends(view(spark, sf_dir, "fin_year")).select("entity_id", "n_years", "revenue_cagr", "margin_trend", "working_capital_trend"))


@query("anomalies", f"""
WITH y AS {YEARS}, r AS (SELECT *, (revenue / nullif(lag(revenue) {_W}, 0) - 1) * 100 AS spike, lag(ebitda / revenue * 100) {_W} - ebitda / revenue * 100 AS fall FROM y)
SELECT entity_id, fiscal_year, 'revenue_spike' AS kind, round(spike, 4) AS size FROM r WHERE spike > 50 UNION ALL SELECT entity_id, fiscal_year, 'margin_drop', round(fall, 4) FROM r WHERE fall > 5""")
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(financials.anomalies(view(spark, sf_dir, "fin_year")))


_WC = f"""y AS {YEARS}, d AS (SELECT *, coalesce({div('trade_receivables', 'revenue')}, 0) * 365 AS dso, coalesce({div('inventory', 'cogs')}, 0) * 365 AS dio, coalesce({div('trade_payables', 'cogs')}, 0) * 365 AS dpo FROM y),
s AS (SELECT *, dso + dio - dpo AS ccc, coalesce(dio - lag(dio) {_W}, 0) AS dio_change, {_GROWTH('trade_receivables')} - {_GROWTH('revenue')} AS gap FROM d)"""


SECTOR_NAMES = ("Automobiles", "FMCG", "it services", "nothing known", "Auto", "Real Estate Trusts", "Pharma & Chemicals", "NBFC")
_NAMED = "[" + ", ".join(f"'{n}'" for n in SECTOR_NAMES) + "]"
_SECTOR_ROWS = ", ".join(f"({i}, '{r[0]}', {r[4]})" for i, r in enumerate(working_capital.SECTORS))


@query("wc_single_year", f"""
WITH {_WC}, b AS (SELECT name, k FROM (SELECT unnest({_NAMED}) AS name) n JOIN (VALUES {_SECTOR_ROWS}) v(i, sector, k) ON contains(lower(name), lower(sector)) OR contains(lower(sector), lower(name)) QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN name = sector THEN 0 ELSE 1 END, i) = 1)
SELECT entity_id, fiscal_year, round(dso, 4) AS receivable_days, round(dio, 4) AS inventory_days, round(dpo, 4) AS payable_days, round(ccc, 4) AS ccc, round(coalesce(ccc - lag(ccc) {_W}, 0), 4) AS ccc_change,
       round(gap, 4) AS growth_gap, gap > 10 AS channel_stuffing, dio_change > 15 AS inventory_piling, name AS sector_name, round((ccc - k) / nullif(k, 0) * 100, 4) AS ccc_variance_pct
FROM (SELECT *, {_NAMED}[entity_id % {len(SECTOR_NAMES)} + 1] AS name FROM s) s LEFT JOIN b USING (name)""")
def wc_single_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in SECTOR_NAMES])
    rows = working_capital.single_year(view(spark, sf_dir, "fin_year")).withColumn("sector_name", names[F.col("entity_id") % len(SECTOR_NAMES)])
    out = working_capital.sector_variance(working_capital.with_benchmark(rows))
    return rounded(out.select("entity_id", "fiscal_year", "receivable_days", "inventory_days", "payable_days", "ccc", "ccc_change", "growth_gap", "channel_stuffing", "inventory_piling", "sector_name", "ccc_variance_pct"))


@query("wc_trend", f"""
WITH {_WC}, e AS (SELECT entity_id, arg_min(ccc, fy) AS a, arg_max(ccc, fy) AS b, count(*) AS n, avg(ccc) AS m, string_agg(fiscal_year, ',' ORDER BY fy) FILTER (gap > 10) AS st, string_agg(fiscal_year, ',' ORDER BY fy) FILTER (dio_change > 15) AS pi FROM s GROUP BY entity_id)
SELECT entity_id, CASE WHEN n < 2 THEN '' WHEN b < a - 10 THEN 'Improving' WHEN b > a + 10 THEN 'Worsening' ELSE 'Stable' END AS ccc_trend, round(m, 4) AS avg_ccc, coalesce(st, '') AS stuffing_years, coalesce(pi, '') AS piling_years FROM e""")
def wc_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(working_capital.trend(view(spark, sf_dir, "fin_year")))


# a year's cash flows, made of the same facts
_CASH = f"(SELECT entity_id, fy, fiscal_year, revenue, ebitda, ebitda * 0.6 - trade_receivables * 0.2 AS cfo, -inventory * 0.1 AS cfi, trade_payables * 0.05 AS cff, inventory * 0.02 AS capex, ebitda * 0.5 - tax_expense AS pat, inventory * 0.015 AS depreciation, trade_payables * 0.3 AS cash_and_equivalents, trade_payables AS current_liabilities, trade_receivables * 0.1 AS working_capital_change FROM {YEARS} y)"


def cash_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return view(spark, sf_dir, "fin_year").select(
        "entity_id", "fy", "fiscal_year", "revenue", "ebitda", (c("ebitda") * 0.6 - c("trade_receivables") * 0.2).alias("cfo"), (-c("inventory") * 0.1).alias("cfi"), (c("trade_payables") * 0.05).alias("cff"), (c("inventory") * 0.02).alias("capex"),
        (c("ebitda") * 0.5 - c("tax_expense")).alias("pat"), (c("inventory") * 0.015).alias("depreciation"), (c("trade_payables") * 0.3).alias("cash_and_equivalents"), c("trade_payables").alias("current_liabilities"), (c("trade_receivables") * 0.1).alias("working_capital_change"),
    )


_CF = f"""c AS {_CASH}, s AS (SELECT *, cfo - capex AS fcf, coalesce({div('cfo - capex', 'revenue')}, 0) * 100 AS fcf_margin, cfo - capex < 0 AS burning,
  CASE WHEN cfo - capex < 0 THEN cash_and_equivalents / (abs(cfo - capex) / 12) END AS runway, CASE WHEN ebitda > 0 THEN cfo / ebitda * 100 WHEN ebitda < 0 AND cfo > 0 THEN 100 ELSE 0 END AS q,
  CASE WHEN depreciation > 0 THEN capex / depreciation WHEN capex > 0 THEN 'inf'::DOUBLE ELSE 0 END AS spend, coalesce({div('capex', 'revenue')}, 0) * 100 AS intensity FROM c)"""


@query("cash_flow_year", f"""
WITH {_CF} SELECT entity_id, fiscal_year, round(fcf, 4) AS fcf, round(fcf_margin, 4) AS fcf_margin, burning AS is_burning, round(runway, 4) AS runway_months,
  CASE WHEN NOT burning THEN 'PROFITABLE_FCF' WHEN pat > 0 THEN 'PROFITABLE_NEGATIVE_FCF' WHEN runway < 12 THEN 'CRITICAL_BURN' ELSE 'CASH_BURNING' END AS burn_status, round(q, 4) AS cfo_to_ebitda, round(spend, 4) AS capex_to_depreciation, round(greatest(0, capex - depreciation), 4) AS growth_capex FROM s""")
def cash_flow_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cashflow.single_year(cash_years(spark, sf_dir)).select("entity_id", "fiscal_year", "fcf", "fcf_margin", "is_burning", "runway_months", "burn_status", "cfo_to_ebitda", "capex_to_depreciation", "growth_capex"))


@query("cash_flow_trend", f"""
WITH {_CF}, n AS (SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY entity_id) AS n, sum(CASE WHEN burning THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY fy DESC ROWS UNBOUNDED PRECEDING) AS calm FROM s),
e AS (SELECT entity_id, count(*) AS n, avg(fcf) AS m, avg(q) AS q, coalesce(avg(fcf) FILTER (i <= floor(n / 2)), 0) AS a, avg(fcf) FILTER (i > floor(n / 2)) AS b, var_pop(fcf) AS v, avg(spend) AS sp, count(*) FILTER (calm = 0) AS burn, coalesce(sum(abs(fcf)) FILTER (burning), 0) AS burned FROM n GROUP BY entity_id)
SELECT entity_id, n AS n_years, round(m, 4) AS avg_fcf, CASE WHEN n < 2 THEN 'Insufficient data' WHEN b > a + 10 THEN 'Improving' WHEN b < a - 10 THEN 'Deteriorating' WHEN v > power(abs(m) * 0.5, 2) THEN 'Volatile' ELSE 'Stable' END AS fcf_trend,
  CASE WHEN q >= 70 THEN 'High' WHEN q >= 50 THEN 'Medium' ELSE 'Low' END AS earnings_quality, CASE WHEN sp > 1.5 THEN 'Growth mode' WHEN sp < 0.8 THEN 'Under-investment' ELSE 'Maintenance mode' END AS capex_pattern, burn AS burn_years, round(burned, 4) AS total_burned FROM e""")
def cash_flow_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cashflow.trend(cash_years(spark, sf_dir)).select("entity_id", "n_years", "avg_fcf", "fcf_trend", "earnings_quality", "capex_pattern", "burn_years", "total_burned"))


@query("merged_statements", f"""
WITH y AS {YEARS}, i AS (SELECT entity_id, fy, revenue FROM y WHERE fy % 3 <> 0), b AS (SELECT entity_id, fy, inventory FROM y WHERE fy % 3 <> 1), c AS (SELECT entity_id, fy, ebitda FROM y WHERE fy % 3 <> 2)
SELECT entity_id, fy, round(coalesce(revenue, 0), 4) AS revenue, round(coalesce(inventory, 0), 4) AS inventory, round(coalesce(ebitda, 0), 4) AS ebitda FROM i FULL JOIN b USING (entity_id, fy) FULL JOIN c USING (entity_id, fy)""")
def merged_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = view(spark, sf_dir, "fin_year")
    part = lambda k, c: y.where(F.col("fy") % 3 != k).select("entity_id", "fy", c)
    return rounded(financials.merged_statements(part(0, "revenue"), part(1, "inventory"), part(2, "ebitda")))


# ---- the offer ----

_PROJ = f"""l AS (SELECT entity_id, revenue, ebitda FROM {YEARS} y QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY fy DESC) = 1),
s AS (SELECT * FROM l, (VALUES ('Base', 1.0, 0.0, 1.0), ('Bull', 1.25, 2.0, 0.95), ('Stress', 0.6, -3.0, 1.1)) t(scenario, gf, ma, k)),
p AS (SELECT entity_id, scenario, i, revenue * power(1 + 15 * gf::DOUBLE / 100, i) AS r, ebitda / revenue * 100 + ma::DOUBLE AS m, 60 * k::DOUBLE AS ccc FROM s, range(1, 4) g(i) WHERE revenue > 0),
q AS (SELECT *, greatest(0, r * m / 100 - r * 0.7 * 0.03 - 50.0 * 0.10) * 0.75 AS pat FROM p), e AS (SELECT *, 300.0 + sum(pat * 0.7) OVER (PARTITION BY entity_id, scenario ORDER BY i) AS eq FROM q)"""


@query("projection_scenarios", f"""
WITH {_PROJ} SELECT entity_id, scenario, concat('FY', i, 'E') AS year, round(r, 2) AS revenue, round(r * m / 100, 2) AS ebitda, round(pat, 2) AS pat, round(pat * 1e7 / 50000000, 2) AS eps,
  round(CASE WHEN eq > 0 THEN pat / eq * 100 ELSE 0 END, 2) AS roe, round(CASE WHEN eq + 50 > 0 THEN pat / (eq + 50) * 100 ELSE 0 END, 2) AS roic, round(CASE WHEN r * m > 0 THEN 50.0 / (r * m / 100) ELSE 0 END, 2) AS net_debt_to_ebitda, round(ccc, 1) AS ccc FROM e""")
def projection_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = financials.latest_year(view(spark, sf_dir, "fin_year"), "fy").where("revenue > 0")
    given = {"total_equity": 200.0, "total_debt": 100.0, "ccc_days": 0.0, "hist_cagr": 12.0, "growth_guidance": 15.0, "margin_guidance": 0.0, "tax_rate": 0.25, "depreciation_rate": 0.03, "fresh_cr": 150.0, "repay_cr": 50.0}
    rows = last.select("entity_id", "revenue", "ebitda", *[F.lit(v).alias(k) for k, v in given.items()], F.lit(50_000_000).cast("long").alias("post_shares"))
    return offer.projections(rows)


@query("scenario_maps", f"WITH {_PROJ} SELECT entity_id, scenario, max(CASE WHEN i = 1 THEN round(pat, 2) END) AS first_pat, max(CASE WHEN i = 3 THEN round(pat, 2) END) AS last_pat FROM e GROUP BY entity_id, scenario")
def scenario_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = offer.scenario_maps(projection_scenarios(spark, sf_dir), "pat")
    return maps.select("entity_id", "scenario", F.col("by_year")["FY1E"].alias("first_pat"), F.col("by_year")["FY3E"].alias("last_pat"))


PEERS = plain("peers")
_MULT = f"(SELECT *, {div('market_cap', 'pat')} AS pe, {div('market_cap', 'net_worth')} AS pb, {div('market_cap + net_debt', 'ebitda')} AS ev FROM {PEERS} p)"


@query("peer_multiples", f"SELECT name, group_id, round(market_cap + net_debt, 4) AS enterprise_value, round(pe, 2) AS pe, round(pb, 2) AS pb, round(ev, 2) AS ev_ebitda FROM {_MULT} m")
def peer_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(offer.peer_multiples(view(spark, sf_dir, "peers")).select("name", "group_id", "enterprise_value", "pe", "pb", "ev_ebitda"))


_MED = f"(SELECT group_id, coalesce(round(median(round(pe, 2)) FILTER (round(pe, 2) > 0) + 1e-9, 2), 0) AS median_pe, coalesce(round(median(round(pb, 2)) FILTER (round(pb, 2) > 0) + 1e-9, 2), 0) AS median_pb, coalesce(round(median(round(ev, 2)) FILTER (round(ev, 2) > 0) + 1e-9, 2), 0) AS median_ev_ebitda FROM {_MULT} m GROUP BY group_id)"


@query("peer_medians", f"SELECT * FROM {_MED} x")
def peer_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer.peer_medians(view(spark, sf_dir, "peers"))


def _issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("entity_id"), F.col("n_nationkey").alias("group_id"), F.lit(100.0).alias("price_floor"), F.lit(110.0).alias("price_cap"), F.lit(50_000_000).cast("long").alias("shares_post_issue"), (F.col("n_nationkey") * 2.0).alias("pat_cr"), F.lit(200.0).alias("net_worth_cr"), F.lit(80.0).alias("ebitda_cr"), F.lit(50.0).alias("net_debt_cr"), F.lit(15.0).alias("pat_cagr_3yr"))


_ISS = f"(SELECT n_nationkey AS entity_id, point, price * 50000000 / 1e7 AS mc, coalesce({div('price * 5.0', 'n_nationkey * 2.0')}, 0) AS pe FROM nation, (VALUES ('floor', 100.0), ('cap', 110.0)) v(point, price))"


@query("issuer_multiples", f"SELECT entity_id, point, round(mc, 2) AS market_cap, round(pe, 2) AS pe, round(mc / 200, 2) AS pb, round((mc + 50) / 80, 2) AS ev_ebitda, round(pe / 15, 2) AS peg FROM {_ISS} i")
def issuer_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer.issuer_multiples(_issuers(spark, sf_dir))


@query("issuer_premium", f"""
SELECT entity_id, coalesce(round(({div('round(pe, 2)', 'median_pe')} - 1) * 100, 2), 0) AS pe_premium, coalesce(round(({div('2.75', 'median_pb')} - 1) * 100, 2), 0) AS pb_premium, coalesce(round(({div('7.5', 'median_ev_ebitda')} - 1) * 100, 2), 0) AS ev_ebitda_premium
FROM {_ISS} i JOIN {_MED} m ON i.entity_id = m.group_id WHERE point = 'cap'""")
def issuer_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = offer.peer_medians(view(spark, sf_dir, "peers")).withColumnRenamed("group_id", "entity_id")
    return offer.premium(offer.issuer_multiples(_issuers(spark, sf_dir)), medians, "entity_id")


@query("missing_peers", "SELECT c_name AS name, c_custkey AS ordinal FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE lower(replace(s_name, 'Supplier', 'Customer')) = lower(c_name))")
def missing_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("name"))
    return offer.missing_peers(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("ordinal")), known)


HIST = plain("capital_history")


@query("preipo_holdings", f"SELECT investor, cast(sum(shares) AS bigint) AS shares, round(sum(shares * price), 2) AS cost, cast(min(entry_date) AS varchar) AS entry_date, round(sum(shares * price) / sum(shares), 4) AS entry_price FROM {HIST} h GROUP BY investor")
def preipo_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer.holdings(view(spark, sf_dir, "capital_history")).select("investor", "shares", F.round("cost", 2).alias("cost"), F.col("entry_date").cast("string").alias("entry_date"), F.round("entry_price", 4).alias("entry_price"))


@query("preipo_returns", f"""
WITH h AS (SELECT investor, sum(shares * price) / sum(shares) AS p, min(entry_date) AS d FROM {HIST} h GROUP BY investor), s AS (SELECT c_name AS investor, c_custkey % 7 * 100 AS ofs FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT *, (year(DATE '2001-12-15') - year(d)) * 12 + 12 - month(d) - CASE WHEN 15 < day(d) THEN 1 ELSE 0 END AS mo FROM h)
SELECT m.investor, mo AS holding_months, round(3000 / p, 4) AS return_multiple, round((power(3000 / p, 12.0 / nullif(mo, 0)) - 1) * 100, 4) AS irr_pct, round(coalesce(ofs, 0) * 3000.0 / 1e7, 6) AS ofs_value_cr FROM m LEFT JOIN s ON m.investor = s.investor""")
def preipo_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("investor"), F.col("c_custkey").alias("ordinal"), (F.col("c_custkey") % 7 * 100).alias("ofs_shares"))
    out = offer.investor_returns(view(spark, sf_dir, "capital_history"), 3000.0, "2001-12-15", sales=sales)
    return out.select("investor", "holding_months", F.round("return_multiple", 4).alias("return_multiple"), F.round("irr_pct", 4).alias("irr_pct"), F.round("ofs_value_cr", 6).alias("ofs_value_cr"))


HOLD = plain("shareholders")
_FLOAT = f"""h AS {HOLD}, t AS (SELECT entity_id, cast(sum(shares_pre_ipo) AS bigint) AS pre, cast(sum(shares_pre_ipo) AS bigint) // 4 AS fresh FROM h GROUP BY entity_id),
g AS (SELECT entity_id, sum(CASE WHEN category = 'Promoter' THEN shares_locked ELSE 0 END) AS pr, sum(CASE WHEN category = 'ESOP Trust' THEN shares_locked ELSE 0 END) AS es, sum(CASE WHEN category = 'Anchor Investor' THEN shares_locked ELSE 0 END) AS an,
  sum(CASE WHEN category NOT IN ('Promoter', 'ESOP Trust', 'Anchor Investor') THEN shares_locked ELSE 0 END) AS ot, sum(CASE WHEN lock_in_days BETWEEN 1 AND 180 AND category NOT IN ('Promoter', 'Anchor Investor') THEN shares_locked ELSE 0 END) AS a, sum(CASE WHEN lock_in_days BETWEEN 181 AND 365 AND category <> 'Promoter' THEN shares_locked ELSE 0 END) AS b FROM h GROUP BY entity_id)"""


def _issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    holders = view(spark, sf_dir, "shareholders")
    pre = F.sum("shares_pre_ipo").cast("long")
    return holders.groupBy("entity_id").agg(pre.alias("shares_pre_issue"), F.floor(pre / 4).cast("long").alias("fresh_issue_shares"), F.lit(0).alias("anchor_shares"), F.lit("2024-01-01").cast("date").alias("listing_date")), holders


@query("float_milestones", f"""
WITH {_FLOAT} SELECT g.entity_id, cast(pre + fresh - pr - es - an - ot AS bigint) AS day_1_shares, cast(pre + fresh - pr - es - ot AS bigint) AS day_90_shares, cast(pre + fresh - pr - es - ot + a AS bigint) AS day_180_shares, cast(pre + fresh - pr - es - ot + a + b AS bigint) AS year_1_shares,
  round((pre + fresh - pr - es - an - ot) / (pre + fresh) * 100, 4) AS day_1_pct, round(pr / (pre + fresh) * 100, 4) AS promoter_locked_pct, (pre + fresh - pr - es - an - ot) / (pre + fresh) * 100 < 5 AS low_float FROM g JOIN t ON g.entity_id = t.entity_id""")
def float_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(offer.float_milestones(*_issues(spark, sf_dir)).select("entity_id", "day_1_shares", "day_90_shares", "day_180_shares", "year_1_shares", "day_1_pct", "promoter_locked_pct", "low_float"))


@query("float_summary", f"""
WITH {_FLOAT}, s AS (SELECT g.entity_id, pr, (pre + fresh - pr - es - an - ot) / (pre + fresh) * 100 AS d1, (pre + fresh - pr - es - ot) / (pre + fresh) * 100 AS d90, pr / (pre + fresh) * 100 AS held, round_even((pre + fresh - pr - es - an - ot) / 250.0, 0) AS v FROM g JOIN t ON g.entity_id = t.entity_id)
SELECT entity_id, concat(CASE WHEN d1 < 5 THEN 'Very low' WHEN d1 < 15 THEN 'Moderate' ELSE 'Adequate' END, ' Day-1 float of ', printf('%.1f', d1), '%', CASE WHEN d1 < 5 THEN ' may cause high volatility' ELSE '' END, '. Promoters holding ', printf('%.1f', held), '% (', format('{{:,}}', cast(pr AS bigint)), ' shares) locked for 3 years. ',
  CASE WHEN d90 > d1 + 5 THEN concat('Significant float increase to ', printf('%.1f', d90), '% at Day 90 (anchor unlock). ') ELSE '' END, 'Estimated avg daily trading volume: ', format('{{:,}}', cast(v AS bigint)), ' shares.') AS summary FROM s""")
def float_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer.float_summary(offer.float_milestones(*_issues(spark, sf_dir)))


@query("lockin_calendar", f"""
WITH {_FLOAT}, f AS (SELECT h.entity_id, name, shares_locked, lock_in_days, pre + fresh AS total, (pre + fresh - sum(shares_locked) OVER (PARTITION BY h.entity_id)) / (pre + fresh) * 100 AS free FROM h JOIN t ON h.entity_id = t.entity_id)
SELECT entity_id, cast(cast(DATE '2024-01-01' + cast(lock_in_days AS int) AS date) AS varchar) AS event_date, lock_in_days AS days_from_listing, name, cast(shares_locked AS bigint) AS shares, round(shares_locked / total * 100, 4) AS pct,
  round(least(100, free + sum(shares_locked / total * 100) OVER (PARTITION BY entity_id ORDER BY lock_in_days, name ROWS UNBOUNDED PRECEDING)), 4) AS cumulative_pct FROM f WHERE shares_locked > 0""")
def lockin_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(offer.lock_in_calendar(*_issues(spark, sf_dir)).withColumn("event_date", F.col("event_date").cast("string")))


@query("objects_posture", """
WITH u AS (SELECT l_suppkey AS entity_id, CASE l_linenumber % 6 WHEN 0 THEN 'capex' WHEN 1 THEN 'debt_repayment' WHEN 2 THEN 'working_capital' WHEN 3 THEN 'acquisition' WHEN 4 THEN 'gcp' END AS b, l_extendedprice / 1e5 AS a FROM lineitem),
g AS (SELECT entity_id, coalesce(sum(a) FILTER (b = 'capex'), 0) AS capex, coalesce(sum(a) FILTER (b = 'debt_repayment'), 0) AS debt, coalesce(sum(a) FILTER (b = 'working_capital'), 0) AS wc, coalesce(sum(a) FILTER (b = 'gcp'), 0) AS gcp FROM u GROUP BY entity_id)
SELECT s_suppkey AS entity_id, round(capex, 4) AS capex, round(debt, 4) AS debt_repayment, round(gcp, 4) AS gcp, capex > debt AS growth_oriented, 100 + s_suppkey % 50 > 120 AS exit_oriented, debt > capex + wc AS deleveraging, gcp / 120 * 100 > 25 AS gcp_too_high FROM supplier JOIN g ON s_suppkey = entity_id""")
def objects_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Capital expenditure", "Repayment of loans", "Working needs", "Acquisitions, e.g. acquisition of units", "General corporate", "Other matters")])
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), names[F.col("l_linenumber") % 6].alias("category"), (F.col("l_extendedprice") / 1e5).alias("amount_cr"))
    issues = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit(120.0).alias("fresh_cr"), (F.col("s_suppkey") % 50 + 100.0).alias("ofs_cr"))
    out = offer.objects_posture(uses, issues).join(uses.select("entity_id").distinct(), "entity_id", "left_semi")
    return rounded(out.select("entity_id", "capex", "debt_repayment", "gcp", "growth_oriented", "exit_oriented", "deleveraging", "gcp_too_high"))


@query("order_book", """
WITH o AS (SELECT o_custkey, list(o_totalprice / 1e5 ORDER BY o_orderkey) AS l, sum(o_totalprice) / 1e5 AS t, max(o_totalprice) / 1e5 AS m FROM orders GROUP BY o_custkey)
SELECT o_custkey AS entity_id, round(t / 10, 4) AS book_to_revenue, round(list_sum(l[1:5]), 4) AS top5, round(list_sum(l[1:5]) / t * 100, 4) AS top5_pct, round(m / t * 100, 4) AS largest_pct, 40.0::DOUBLE AS executable_pct, round((t / 8.1 - 1) * 100, 4) AS growth_pct FROM o""")
def order_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice") / 1e5)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "v"))), lambda x: x["v"])
    rows = o.groupBy(F.col("o_custkey").alias("entity_id")).agg(ordered.alias("top_orders"), F.sum("v").alias("total_order_book")).withColumns({"sector": F.lit("EPC"), "largest_order": F.lit(None).cast("double"), "executable_12m": F.col("total_order_book") * 0.4, "book_year_ago": F.lit(8.1), "ltm_revenue": F.lit(10.0)})
    return rounded(offer.order_book(rows))


@query("stub_period", f"""
WITH y AS {YEARS}, p AS (SELECT *, lag(revenue) {_W} AS pr, lag(ebitda) {_W} AS pe, first(revenue) {_W} AS fr, row_number() {_W} AS n FROM y)
SELECT entity_id, fy, round((revenue / 2 / pr - 1) * 100, 2) AS revenue_growth, round(revenue / 2 * 12 / 6, 2) AS annualised_revenue, round((power(pr / fr, 1.0 / (n - 2)) - 1) * 100, 2) AS historical_cagr, ebitda / revenue * 100 - pe / pr * 100 < -2 AS margin_compression FROM p WHERE n > 2""")
def stub_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, c = exprs.over("entity_id", "fy"), F.col
    y = view(spark, sf_dir, "fin_year").withColumns({"prior_revenue": F.lag("revenue").over(w), "prior_ebitda": F.lag("ebitda").over(w), "first_revenue": F.first("revenue").over(w), "n": F.row_number().over(w)}).where("n > 2")
    rows = y.select((c("entity_id") * 10_000 + c("fy")).alias("entity_id"), F.lit(6).alias("months"), (c("revenue") / 2).alias("revenue"), (c("ebitda") / 2).alias("ebitda"), "prior_revenue", "prior_ebitda", "first_revenue", c("prior_revenue").alias("last_revenue"), (c("n") - 2).alias("span"))
    out = offer.stub_period(rows)
    return out.select(F.floor(c("entity_id") / 10_000).cast("int").alias("entity_id"), (c("entity_id") % 10_000).cast("int").alias("fy"), "revenue_growth", "annualised_revenue", "historical_cagr", "margin_compression")


# ---- risk ----

LIT, CON, DEBT, RULE = plain("litigation"), plain("contingent"), plain("debt_items"), plain("rule_inputs")


@query("litigation_rollup", f"""
SELECT entity_type, cast(sum(cnt) AS bigint) AS total, count(*) FILTER (case_type = 'Civil') AS civil_count, count(*) FILTER (case_type = 'Criminal') AS criminal_count, count(*) FILTER (case_type = 'Tax') AS tax_count, count(*) FILTER (case_type = 'Regulatory') AS regulatory_count,
  count(*) FILTER (case_type NOT IN ('Civil', 'Criminal', 'Tax', 'Regulatory')) AS other_count, round(sum(amount_cr), 2) AS amount_cr, round(sum(amount_cr) / 1e6 * 100, 4) AS pct_networth FROM {LIT} x GROUP BY entity_type""")
def litigation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.litigation_rollup(view(spark, sf_dir, "litigation"), 1e6).withColumn("amount_cr", F.round("amount_cr", 2)))


@query("risk_exposures", f"""
WITH g AS (SELECT entity_type, case_type, cast(sum(cnt) AS bigint) AS count, sum(amount_cr) AS a, arg_min(hearing_date, ordinal) FILTER (hearing_date IS NOT NULL) AS next_hearing FROM {LIT} x WHERE case_type IN ('Civil', 'Criminal', 'Tax', 'Regulatory') GROUP BY ALL)
SELECT entity_type, case_type, count, round(a, 2) AS amount_cr, cast(next_hearing AS varchar) AS next_hearing, round(a / 1e6 * 100, 4) AS pct_networth, CASE WHEN case_type = 'Criminal' OR a / 1e6 * 100 > 5 THEN 'Critical' WHEN a / 1e6 * 100 > 2 THEN 'Major' ELSE 'Minor' END AS severity FROM g""")
def risk_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.risk_exposures(view(spark, sf_dir, "litigation"), 1e6).withColumns({"amount_cr": F.round("amount_cr", 2), "next_hearing": F.col("next_hearing").cast("string")}))


@query("risk_severity", f"""
WITH g AS (SELECT sum(amount_cr) / 1e7 * 100 AS p, count(*) FILTER (entity_type = 'Promoter' AND case_type = 'Criminal') AS c FROM {LIT} x WHERE entity_type <> 'Group Company')
SELECT round(p, 4) AS litigation_pct, c AS criminal_promoter, p > 10 OR c > 0 AS veto, CASE WHEN p > 10 OR c > 0 OR p + 3 > 15 THEN 'Critical' WHEN p + 3 > 5 THEN 'Major' ELSE 'Minor' END AS severity FROM g""")
def risk_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.risk_severity(view(spark, sf_dir, "litigation"), 3.0, 1e7))


@query("hearings_due", f"SELECT count(*) AS matters, round(coalesce(sum(amount_cr), 0), 2) AS amount_cr FROM {LIT} x WHERE hearing_date <= DATE '2023-01-10' + 365")
def hearings_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.hearings(view(spark, sf_dir, "litigation"), "2023-01-10"), 2)


_CAT = "CASE WHEN category LIKE '%tax%' THEN 'tax_disputes' WHEN category LIKE '%customs%' THEN 'customs_excise' WHEN category LIKE '%civil%' THEN 'legal_claims' WHEN category LIKE '%bank%' THEN 'bank_guarantees' ELSE category END"


@query("contingent_by_category", f"SELECT {_CAT} AS category, round(sum(amount_cr), 2) AS amount_cr, count(*) AS n FROM {CON} x GROUP BY 1")
def contingent_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.contingent_by_category(view(spark, sf_dir, "contingent")), 2)


@query("contingent_weighted", f"""
WITH x AS (SELECT amount_cr AS a, coalesce(probability, 'medium') AS p FROM {CON} x WHERE amount_cr > 0)
SELECT round(sum(a), 2) AS total, round(sum(a) FILTER (p = 'high'), 2) AS high, round(sum(a) FILTER (p = 'medium'), 2) AS medium, round(sum(a) FILTER (p = 'low'), 2) AS low, round(sum(a * CASE p WHEN 'high' THEN 0.75 WHEN 'low' THEN 0.25 ELSE 0.5 END), 2) AS risk_weighted, round(sum(a) / 1e6 * 100, 2) AS pct_networth FROM x""")
def contingent_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.contingent_weighted(view(spark, sf_dir, "contingent"), 1e6, positive_only=True), 2)


@query("debt_totals", f"SELECT entity_id, round(sum(amount), 4) AS total_debt, round(coalesce(sum(amount) FILTER (is_secured), 0), 4) AS secured, round(coalesce(sum(amount) FILTER (NOT is_secured), 0), 4) AS unsecured, round(coalesce(sum(amount) FILTER (is_short_term), 0), 4) AS short_term, round(coalesce(sum(amount) FILTER (NOT is_short_term), 0), 4) AS long_term, round(coalesce(sum(amount) FILTER (is_secured), 0) / sum(amount) * 100, 4) AS secured_pct, round(coalesce(sum(amount) FILTER (is_short_term), 0) / sum(amount) * 100, 4) AS short_term_pct FROM {DEBT} d GROUP BY entity_id")
def debt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.debt_totals(view(spark, sf_dir, "debt_items")))


@query("debt_rates", f"SELECT entity_id, round(sum(interest_rate * amount) / sum(amount), 4) AS weighted_rate, min(interest_rate) AS lowest, max(interest_rate) AS highest FROM {DEBT} d WHERE interest_rate IS NOT NULL AND amount > 0 GROUP BY entity_id")
def debt_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.debt_rates(view(spark, sf_dir, "debt_items")))


_TOP = f"e AS (SELECT entity_id, lender, sum(amount) AS a, min(ordinal) AS o FROM {DEBT} d GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY a DESC, o) AS n, sum(a) OVER (PARTITION BY entity_id) AS s, count(*) OVER (PARTITION BY entity_id) AS k FROM e)"


@query("lender_concentration", f"WITH {_TOP} SELECT entity_id, k AS n_lenders, lender AS top_lender, round(a, 4) AS top_amount, round(a / s * 100, 4) AS top_pct FROM t WHERE n = 1")
def lender_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.lender_concentration(view(spark, sf_dir, "debt_items")))


@query("maturity_profile", f"SELECT entity_id, round(coalesce(sum(amount) FILTER (is_short_term), 0), 4) AS y_0_1, round(coalesce(sum(amount) FILTER (NOT is_short_term), 0), 4) AS y_1_3, 0.0::DOUBLE AS y_3_5, 0.0::DOUBLE AS y_5_up FROM {DEBT} d GROUP BY entity_id")
def maturity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.maturity_profile(view(spark, sf_dir, "debt_items").withColumn("bucket", F.lit(None).cast("string"))))


@query("debt_risk", f"""
WITH {_TOP}, d AS (SELECT entity_id, sum(amount) AS td, sum(interest_rate * amount) / sum(amount) AS r, sum(amount) FILTER (is_short_term) / sum(amount) * 100 AS st FROM {DEBT} d GROUP BY entity_id)
SELECT d.entity_id, CASE WHEN td / 500 > 2 THEN 'HIGH' WHEN td / 500 > 1 THEN 'MEDIUM' ELSE 'LOW' END AS leverage, CASE WHEN r > 12 THEN 'HIGH' WHEN r > 9 THEN 'MEDIUM' ELSE 'LOW' END AS interest_cost, CASE WHEN st > 50 THEN 'HIGH' WHEN st > 30 THEN 'MEDIUM' ELSE 'LOW' END AS refinancing, CASE WHEN a / s * 100 > 50 THEN 'HIGH' WHEN a / s * 100 > 30 THEN 'MEDIUM' ELSE 'LOW' END AS concentration FROM d JOIN t ON d.entity_id = t.entity_id AND n = 1""")
def debt_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    equity = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity_id"), F.lit(500.0).alias("equity"))
    return risk.debt_risk(view(spark, sf_dir, "debt_items"), equity)


@query("debt_impact", f"""
WITH d AS (SELECT entity_id, sum(amount) AS td FROM {DEBT} d GROUP BY entity_id)
SELECT entity_id, round(greatest(0, td - 150), 4) AS post_debt, 50.0::DOUBLE AS repay_pct, round(td / 200, 4) AS de_pre, round(greatest(0, td - 150) / 500, 4) AS de_post, round(td / 80, 4) AS debt_to_ebitda, 4.0::DOUBLE AS interest_cover FROM d""")
def debt_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.debt_totals(view(spark, sf_dir, "debt_items")).select("entity_id", "total_debt", *[F.lit(v).alias(k) for k, v in {"repay_cr": 150.0, "fresh_cr": 300.0, "equity": 200.0, "ebitda": 80.0, "interest": 20.0}.items()])
    return rounded(risk.debt_impact(rows))


def _rules_sql() -> str:
    parts = [f"SELECT entity_id, '{i}' AS rule_id, '{f}' AS family, '{s}' AS severity, '{t}' AS threshold FROM r WHERE coalesce({c.replace('==', '=').replace('True', 'true')}, false)" for i, f, s, c, t in risk.RULES]
    return f"WITH r AS {RULE}, v AS ({' UNION ALL '.join(parts)})"


@query("rule_violations", f"{_rules_sql()} SELECT * FROM v")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.violations(view(spark, sf_dir, "rule_inputs"))


@query("rule_severity_counts", f"{_rules_sql()} SELECT severity, count(*) AS n FROM v GROUP BY severity")
def rule_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.severity_counts(risk.violations(view(spark, sf_dir, "rule_inputs")))


@query("violation_citations", f"{_rules_sql()} SELECT entity_id, rule_id, CASE WHEN entity_id % 2 = 0 THEN concat('p. ', entity_id) ELSE '' END AS citation FROM v")
def violation_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk.violations(view(spark, sf_dir, "rule_inputs"))
    cited = found.where("entity_id % 2 = 0").select("entity_id", "rule_id", F.concat(F.lit("p. "), F.col("entity_id")).alias("citation"))
    return risk.with_citations(found, cited).select("entity_id", "rule_id", "citation")


@query("veto_flags", f"{_rules_sql()} SELECT r.entity_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'critical') > 0 AS veto FROM r LEFT JOIN v ON r.entity_id = v.entity_id GROUP BY r.entity_id")
def veto_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.veto_flags(view(spark, sf_dir, "rule_inputs"))


# ---- repository ----


@query("repo_ilike", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%ER#00000000%'")
def repo_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.contains_ci(table(spark, sf_dir, "customer"), "c_name", "ER#00000000").select("c_custkey", "c_name")


@query("repo_equal", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def repo_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.equal(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_totalprice")


@query("repo_in_list", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 15)")
def repo_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.in_list(table(spark, sf_dir, "part"), "p_size", [1, 7, 15]).select("p_partkey", "p_size")


_SPANS = "(SELECT page_id, page_id % 40 AS a, page_id % 40 + page_id % 9 AS b FROM pages)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", (p % 40).alias("a"), (p % 40 + p % 9).alias("b"))


@query("repo_page_stab", f"SELECT * FROM {_SPANS} s WHERE a <= 20 AND b >= 20")
def repo_page_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stabbed(_spans(spark, sf_dir), "a", "b", 20)


@query("repo_range", f"SELECT * FROM {_SPANS} s WHERE a >= 10 AND b <= 25")
def repo_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.contained(_spans(spark, sf_dir), "a", "b", 10, 25)


@query("repo_topn", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def repo_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_n(table(spark, sf_dir, "customer"), "c_acctbal", 10, "c_custkey").select("c_custkey", "c_acctbal")


@query("repo_recent", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def repo_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_n(table(spark, sf_dir, "orders"), "o_orderdate", 10, "o_orderkey").select("o_orderkey")


@query("repo_page_of_rows", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def repo_page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page_of_rows(table(spark, sf_dir, "customer"), "c_custkey", 20, 40).select("c_custkey")


@query("repo_severity_sort", f"{_rules_sql()} SELECT entity_id, rule_id, cast(row_number() OVER (PARTITION BY entity_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, rule_id) AS int) AS place FROM v")
def repo_severity_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = risk.violations(view(spark, sf_dir, "rule_inputs"))
    return v.select("entity_id", "rule_id", F.row_number().over(Window.partitionBy("entity_id").orderBy(store.severity_rank(F.col("severity")), "rule_id")).alias("place"))


@query("repo_eager_load", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS n_lines FROM customer")
def repo_eager_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    own = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "l_orderkey", "l_linenumber")
    loaded = store.with_children(c.select("c_custkey"), "c_custkey", orders=own, lines=lines)
    n = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long")
    return loaded.select("c_custkey", n("orders").alias("n_orders"), n("lines").alias("n_lines"))


@query("repo_cascade_delete", "SELECT o_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey")
def repo_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    left = store.deleted(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), o.where("o_orderstatus = 'P'"), "o_orderkey")
    return left.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("repo_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'changed' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT max(s_suppkey) + 1, 'new' FROM supplier")
def repo_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    new = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("changed").alias("s_name")).unionByName(s.agg((F.max("s_suppkey") + 1).alias("s_suppkey")).withColumn("s_name", F.lit("new")))
    return store.upserted(s, new, "s_suppkey")


@query("repo_status_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def repo_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.updated(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") % 5 == 0, o_orderstatus="done", unknown=1)


@query("repo_latest", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def repo_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("count_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("avg_and_sum", "SELECT user_id, round(avg(value) FILTER (event_type <> 'error'), 4) AS mean, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS total FROM events GROUP BY user_id")
def avg_and_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, total = F.avg(F.when(F.col("event_type") != "error", F.col("value"))), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")))
    return rounded(table(spark, sf_dir, "events").groupBy("user_id").agg(mean.alias("mean"), F.coalesce(total, F.lit(0.0)).alias("total")))


@query("distinct_agents", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def distinct_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderpriority").distinct()


@query("payload_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P', 'X') AND o_totalprice BETWEEN 20000 AND 150000 AND o_orderpriority = '1-URGENT'")
def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(store.payload_filter({"o_orderstatus": ["F", "P", "X"], "o_totalprice": [20000, 150000], "o_orderpriority": "1-URGENT", "other": None})).select("o_orderkey")


# ---- text ----

CHUNKS = plain("chunks")


@query("chunk_links", f"SELECT document_id, turn, chunk_type, char_count, token_count, lag(turn) OVER (PARTITION BY document_id ORDER BY turn) AS preceding, lead(turn) OVER (PARTITION BY document_id ORDER BY turn) AS following FROM {CHUNKS} c")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.linked(view(spark, sf_dir, "chunks"), "turn", "turn").select("document_id", "turn", "chunk_type", "char_count", "token_count", "preceding", "following")


@query("chunk_chain", f"SELECT document_id, turn, cast(row_number() OVER (PARTITION BY document_id ORDER BY turn) AS int) AS position FROM {CHUNKS} c WHERE turn >= 1")
def chunk_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chain(view(spark, sf_dir, "chunks"), 1).select("document_id", "turn", "position")


@query("chunk_tokens", f"SELECT document_id, chunk_type, cast(sum(token_count) AS bigint) AS tokens, count(*) AS n FROM {CHUNKS} c GROUP BY ALL")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "chunks").withColumn("token_count", text.tokens(F.col("text")))
    return c.groupBy("document_id", "chunk_type").agg(F.sum("token_count").alias("tokens"), F.count(F.lit(1)).alias("n"))


_SEC = "(SELECT page_id % 10 AS document_id, page_id AS section_id, 1 + (page_id // 10) * 3 AS start_page, CASE WHEN page_id // 10 % 5 = 0 THEN 1 WHEN page_id // 10 % 5 IN (1, 3) THEN 2 ELSE 3 END AS level FROM pages)"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id").withColumn("k", F.floor(F.col("page_id") / 10))
    return p.select((F.col("page_id") % 10).alias("document_id"), F.col("page_id").alias("section_id"), (1 + F.col("k") * 3).alias("start_page"), F.when(F.col("k") % 5 == 0, 1).when((F.col("k") % 5).isin(1, 3), 2).otherwise(3).alias("level"))


_ENDS = f"(SELECT *, greatest(start_page, coalesce(lead(start_page) OVER (PARTITION BY document_id ORDER BY start_page, section_id) - 1, start_page + 5)) AS end_page FROM {_SEC} s)"


def _ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir)
    return text.section_ends(s, s.groupBy("document_id").agg((F.max("start_page") + 5).alias("total_pages")))


@query("section_ends", f"SELECT document_id, section_id, start_page, end_page FROM {_ENDS} e")
def section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ended(spark, sf_dir).select("document_id", "section_id", "start_page", "end_page")


@query("section_tree", f"SELECT document_id, section_id, level, (SELECT arg_max(b.section_id, (b.start_page, b.section_id)) FROM {_SEC} b WHERE b.document_id = a.document_id AND b.level < a.level AND (b.start_page, b.section_id) < (a.start_page, a.section_id)) AS parent_id FROM {_SEC} a")
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.section_tree(_sections(spark, sf_dir)).select("document_id", "section_id", "level", "parent_id")


@query("section_range_join", f"SELECT section_id, count(*) AS n_pages, min(page_num) AS first_page FROM {_ENDS} e JOIN (SELECT DISTINCT page_id % 10 AS d, page_id // 10 + 1 AS page_num FROM pages) p ON d = document_id AND page_num BETWEEN start_page AND end_page GROUP BY section_id")
def section_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("document_id"), (F.floor(F.col("page_id") / 10) + 1).alias("page_num")).distinct()
    return text.page_sections(pages, _ended(spark, sf_dir)).groupBy("section_id").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_num").alias("first_page"))


_PAGE_TEXT = "CASE doc_id % 10 WHEN 0 THEN concat('DRAFT Prospectus ', text) WHEN 1 THEN concat('Table of Contents', repeat(concat(chr(10), 'A chapter of it 12'), 6)) WHEN 2 THEN concat('Table of Contents', repeat(concat(chr(10), 'A chapter of it 12'), 5)) ELSE text END"


@query("page_summary", f"""
WITH t AS (SELECT source AS document_id, doc_id % 12 + 1 AS page_num, {_PAGE_TEXT} AS text FROM documents),
p AS (SELECT *, CASE WHEN length(trim(text, ' ' || chr(10) || chr(9) || chr(13) || chr(160))) < 50 THEN 'blank' WHEN page_num <= 5 AND regexp_matches(text, '(?i)red herring prospectus|draft prospectus') THEN 'cover'
  WHEN regexp_matches(substr(text, 1, 500), '(?i)table of contents|contents') AND len(regexp_extract_all(text, '(?m)\\d+\\s*$')) > 5 THEN 'toc' WHEN regexp_matches(substr(text, 1, 200), '(?i)appendix|annexure|schedule') THEN 'appendix' ELSE 'text' END AS k FROM t)
SELECT document_id, count(*) AS n_pages, count(*) FILTER (k = 'blank') AS blank_pages, count(*) FILTER (k = 'cover') AS cover_pages, count(*) FILTER (k = 'toc') AS toc_pages, count(*) FILTER (k = 'appendix') AS appendix_pages, count(*) FILTER (k = 'text') AS text_pages, cast(sum(length(text)) AS bigint) AS chars FROM p GROUP BY document_id""")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    toc = lambda n: F.lit("Table of Contents" + "\nA chapter of it 12" * n)
    body = F.when(k == 0, F.concat(F.lit("DRAFT Prospectus "), "text")).when(k == 1, toc(6)).when(k == 2, toc(5)).otherwise(F.col("text"))
    pages = d.select(F.col("source").alias("document_id"), (F.col("doc_id") % 12 + 1).alias("page_num"), body.alias("text"))
    return text.page_summary(pages).select("document_id", "n_pages", "blank_pages", "cover_pages", "toc_pages", "appendix_pages", "text_pages", "chars")


@query("uncited_claims", "SELECT doc_id AS claim_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.uncited(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id")))


@query("validated_claims", "SELECT doc_id AS claim_id, doc_id IN (SELECT doc_id FROM labels) AS cited FROM documents")
def validated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.validated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id")))


@query("footnotes", """SELECT lang, doc_id AS claim_id, cast(row_number() OVER (PARTITION BY lang ORDER BY source, doc_id % 7, doc_id) AS int) AS n,
  concat('[^', row_number() OVER (PARTITION BY lang ORDER BY source, doc_id % 7, doc_id), ']: [', source, ', p. ', doc_id % 7, '] — "', substr(text, 1, 280), '"') AS note FROM documents""")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("ordinal"), F.col("source").alias("section"), (F.col("doc_id") % 7).alias("page"), F.col("text").alias("snippet"), "lang")
    return text.footnotes(rows, "lang").select("lang", "claim_id", "n", "note")


@query("point_ids", "SELECT doc_id, cast(('0x' || substr(sha256(source || '_' || doc_id), 1, 15)) AS bigint) AS point_id FROM documents")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", store.point_id(F.concat_ws("_", "source", F.col("doc_id").cast("string"))).alias("point_id"))


@query("content_hash", "SELECT conv_id, sha256(string_agg(text, '|||' ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.content_hash(table(spark, sf_dir, "conversations"), "conv_id", "text", "turn")


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))


def _topk_sql(where: str = "true", k: int | None = 10, score: str = _COS) -> str:
    ranked = f"SELECT q.vec_id AS query_id, e.vec_id, round({score}, 4) AS score, cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, e.vec_id) AS int) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {where}"
    return ranked if k is None else f"{ranked} QUALIFY rank <= {k}"


@query("vector_topk", _topk_sql())
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.search(*_vectors(spark, sf_dir)))


@query("vector_topk_filtered", _topk_sql("e.label IN (1, 2, 4)", 5))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.search(*_vectors(spark, sf_dir), k=5, where=store.payload_filter({"label": [1, 2, 4]})))


@query("vector_threshold", _topk_sql(f"{_COS} >= 0.2", None))
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that reach the threshold, each with its rank among its query's."""
    found = vectors.search(*_vectors(spark, sf_dir), k=None, threshold=0.2)
    return rounded(found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))))


@query("vector_topk_dot", _topk_sql(k=7, score="list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"))
def vector_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.search(*_vectors(spark, sf_dir), k=7, metric="dot"))


@query("vector_topk_euclid", _topk_sql("e.vec_id <> q.vec_id", k=7, score="(0 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]))"))
def vector_topk_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven nearest others: a query's own vector comes first and is left out."""
    found = vectors.search(*_vectors(spark, sf_dir), k=8, metric="euclid").where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rounded(found.withColumn("rank", F.row_number().over(w)).where("rank <= 7"))


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("sentence_split")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))


# ---- normalisation, parsers and headers ----


@query("normalised_history", """
WITH r AS (SELECT o_custkey AS entity_id, concat('FY', right(cast(year(o_orderdate) AS varchar), 2)) AS fiscal_year, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.01 WHEN 2 THEN 0.1 END AS f, CASE WHEN o_orderkey % 3 = 0 THEN 'consolidated' WHEN o_orderkey % 3 = 1 THEN 'standalone' ELSE 'other' END AS statement_type, o_orderkey AS k, o_totalprice AS v FROM orders),
p AS (SELECT *, CASE statement_type WHEN 'consolidated' THEN 0 WHEN 'standalone' THEN 1 ELSE 2 END AS rk FROM r WHERE f IS NOT NULL)
SELECT entity_id, fiscal_year, cast(right(fiscal_year, 2) AS int) AS fy_key, statement_type, round(v * f + 1e-9, 2) AS revenue FROM p QUALIFY row_number() OVER (PARTITION BY entity_id, fiscal_year ORDER BY rk, CASE WHEN rk = 2 THEN k ELSE -k END) = 1""")
def normalised_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.concat(F.lit("FY"), F.right(F.year("o_orderdate").cast("string"), F.lit(2))).alias("fiscal_year"), F.when(k % 4 == 0, "crore").when(k % 4 == 1, "lakh").when(k % 4 == 2, "million").otherwise("stones").alias("unit"),
        F.when(k % 3 == 0, "consolidated").when(k % 3 == 1, "standalone").otherwise("other").alias("statement_type"), k.alias("ordinal"), F.format_string("%.2f", "o_totalprice").alias("revenue"),
    )
    return financials.normalise(raw, ["revenue"]).withColumn("revenue", F.round("revenue", 2))


@query("amount_parsers", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 - v WHEN 1 THEN v WHEN 2 THEN v / 100 ELSE 0 END AS statement, CASE o_orderkey % 5 WHEN 0 THEN 0 - v WHEN 3 THEN 0 END AS cell
FROM (SELECT o_orderkey, cast(o_orderkey % 1000 AS double) AS v FROM orders)""")
def amount_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = (k % 1000).cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit("("), v, F.lit(")"))).when(k % 5 == 1, F.concat(F.lit("₹ "), v, F.lit(" Cr"))).when(k % 5 == 2, F.concat(v, F.lit(" Lakh"))).when(k % 5 == 3, "nil").otherwise("n.m.")
    return table(spark, sf_dir, "orders").select("o_orderkey", (exprs.amount_statement(raw) + 0.0).alias("statement"), (exprs.amount_cell(raw) + 0.0).alias("cell"))


@query("new_age_metrics", """
SELECT c_custkey, round((100 + c_custkey % 7 - c_custkey % 90) / (100.0 + c_custkey % 7) * 100, 4) AS contribution_margin, round(CASE WHEN c_acctbal < 0 THEN abs(c_acctbal) / 12 END, 4) AS monthly_burn, cast(trunc(CASE WHEN c_acctbal < 0 THEN 500 / (abs(c_acctbal) / 12) END) AS int) AS runway_months,
  round(CASE WHEN c_custkey % 4 > 0 THEN (100.0 + c_custkey % 7) / (c_custkey % 4) * 1e7 END, 4) AS revenue_per_user, round(CASE WHEN c_custkey % 5 > 0 THEN (100.0 + c_custkey % 7) / (c_custkey % 5 * 50.0) * 100 END, 4) AS take_rate FROM customer WHERE c_acctbal <> 0""")
def new_age_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_acctbal <> 0").select(k, F.col("c_acctbal").alias("cfo"), F.lit(500.0).alias("cash"), (k % 7 + 100.0).alias("revenue"), (k % 90).cast("double").alias("variable_costs"), (k % 4).cast("double").alias("users"), (k % 5 * 50.0).alias("gmv"))
    return rounded(financials.new_age_metrics(rows).select("c_custkey", "contribution_margin", "monthly_burn", "runway_months", "revenue_per_user", "take_rate"))


@query("skin_in_the_game", "SELECT s_name AS name, round(s_suppkey % 70 / 100.0 * 50000000 * 120 / 1e7, 4) AS stake_cr FROM supplier")
def skin_in_the_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 70).cast("double").alias("holding_pct"), F.lit(50_000_000).cast("long").alias("total_shares"))
    return rounded(offer.skin_in_the_game(s, 120.0).select("name", "stake_cr"))


@query("investor_kind", "SELECT s_suppkey, ['PE/VC', 'PE/VC', 'ESOP/Trust', 'Promoter', 'Other'][s_suppkey % 5 + 1] AS kind FROM supplier")
def investor_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("Alpha Growth Fund", "Beta Capital Trust", "ESOP pool", "Promoter group", "R. Kumar")])
    return table(spark, sf_dir, "supplier").select("s_suppkey", offer.investor_kind(names[F.col("s_suppkey") % 5]).alias("kind"))


@query("statement_melt", """
SELECT o_orderkey AS table_id, 'Revenue' AS metric, 'FY2023' AS fiscal_year, floor(o_totalprice) AS value FROM orders UNION ALL SELECT o_orderkey, 'Revenue', 'FY2024', o_custkey FROM orders UNION ALL SELECT o_orderkey, 'Loss', 'FY2023', 0 - cast(o_custkey AS double) FROM orders""")
def statement_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.melt_statement(_statements(spark, sf_dir)).select("table_id", "metric", "fiscal_year", (F.col("value") + 0.0).alias("value"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, other = F.floor("o_totalprice").cast("long").cast("string"), F.col("o_custkey").cast("string")
    rows = F.array(F.array(F.lit("Revenue"), price, other), F.array(F.lit(" "), F.lit(""), F.lit("")), F.array(F.lit("Loss"), F.concat(F.lit("("), other, F.lit(")")), F.lit("n.m.")), F.array(F.lit("Total"), price, price))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), F.array(*[F.lit(x) for x in ("Particulars", "FY2023", "FY2024")]).alias("headers"), rows.alias("rows"))


@query("table_growth", "SELECT o_orderkey AS table_id, 'Revenue' AS metric, 'FY2024' AS fiscal_year, round((o_custkey - floor(o_totalprice)) / floor(o_totalprice) * 100, 2) AS growth FROM orders WHERE floor(o_totalprice) <> 0")
def table_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.table_growth(text.melt_statement(_statements(spark, sf_dir)))


@query("unit_detect", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'crore' WHEN 1 THEN 'lakh' WHEN 2 THEN 'million' ELSE 'actual' END AS unit FROM part")
def unit_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("₹ in Crores", "in Lakhs", "USD million", "Amount")])
    none = F.array().cast("array<array<string>>")
    return table(spark, sf_dir, "part").select("p_partkey", text.unit_of(F.array(names[F.col("p_partkey") % 4]), none).alias("unit"))


@query("cache_misses", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit("m").alias("model"))
    return store.cache_misses(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0")).select("doc_id")


@query("page_validation", "SELECT page_id % 10 AS document_id, count(*) AS page_count, round(count(*) FILTER (page_id // 10 < 10 AND page_id % 3 = 0) / greatest(count(*) FILTER (page_id // 10 < 10), 1), 4) AS scanned_share FROM pages GROUP BY 1")
def page_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    rows = p.select((F.col("page_id") % 10).alias("document_id"), (F.floor(F.col("page_id") / 10) + 1).alias("page_num"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.repeat(F.lit("x"), 300)).alias("text"), F.lit(1).alias("image_count"), F.lit(0.1).alias("image_share"))
    return rounded(scan.validation(rows).select("document_id", "page_count", "scanned_share"))


@query("covenant_summary", "SELECT s_nationkey AS entity_id, count(*) AS n, bool_or(s_suppkey % 11 = 0) AS any_breach FROM supplier GROUP BY s_nationkey")
def covenant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.covenants(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entity_id"), (F.col("s_suppkey") % 11 == 0).alias("breached")))


@query("promoter_dossier", "SELECT s_name AS name, s_acctbal AS holding, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS directorships FROM supplier")
def promoter_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "name")
    return offer.dossier(s.select("name"), s.select("name", F.col("s_acctbal").alias("holding")), s.where("s_suppkey % 2 = 0").select("name", F.col("s_nationkey").alias("directorships")))
