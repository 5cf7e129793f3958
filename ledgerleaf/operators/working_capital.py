"""Working capital: days, growth against the year before, sector benchmarks, and the trend over years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.exprs import growth, over, sdiv

# Sector, receivable days, inventory days, payable days, cash conversion cycle; the order breaks ties.
SECTORS = [
    ("FMCG", 30, 45, 35, 40), ("Pharma", 90, 120, 30, 180), ("IT Services", 60, 0, 10, 50), ("Auto", 45, 60, 25, 80), ("Textiles", 60, 90, 30, 120), ("Capital Goods", 120, 90, 30, 180),
    ("Real Estate", 180, 365, 145, 400), ("Steel", 60, 45, 25, 80), ("Cement", 30, 30, 20, 40), ("Chemicals", 60, 75, 25, 110), ("EPC", 90, 60, 30, 120), ("Defense", 120, 90, 40, 170),
    ("Infrastructure", 120, 60, 60, 120), ("Retail", 10, 60, 45, 25), ("Banking", 0, 0, 0, 0), ("NBFC", 0, 0, 0, 0),
]


def sector_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(SECTORS)], "ordinal int, sector string, sector_dso int, sector_dio int, sector_dpo int, sector_ccc int")


def with_benchmark(rows: DataFrame, sector: str = "sector_name") -> DataFrame:
    """rows with the sector's figures: the exact name first, else the first that contains it or is contained, whatever the case."""
    own, known = F.lower(F.col(sector)), F.lower(F.col("sector"))
    names = rows.select(sector).distinct()
    like = (F.col(sector) == F.col("sector")) | own.contains(known) | known.contains(own)
    best = Window.partitionBy(sector).orderBy(F.desc(F.col(sector) == F.col("sector")), "ordinal")
    found = names.join(F.broadcast(sector_table(rows.sparkSession)), like).withColumn("_n", F.row_number().over(best)).where("_n = 1")  # 16 rows
    return rows.join(found.drop("_n", "ordinal"), sector, "left")


def single_year(years: DataFrame) -> DataFrame:
    """Days, cash cycle, change on the year before and flags; the first year's changes are 0. Rows are (entity_id, fy, measures)."""
    w = over("entity_id", "fy")
    dso, dio, dpo = sdiv(F.col("trade_receivables"), F.col("revenue")) * 365, sdiv(F.col("inventory"), F.col("cogs")) * 365, sdiv(F.col("trade_payables"), F.col("cogs")) * 365
    out = years.withColumns({"receivable_days": dso, "inventory_days": dio, "payable_days": dpo}).withColumn("ccc", F.col("receivable_days") + F.col("inventory_days") - F.col("payable_days"))
    change = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    out = out.withColumns({f"{c}_change": change(c) for c in ("receivable_days", "inventory_days", "payable_days", "ccc")})
    out = out.withColumns({"revenue_growth": growth(F.lag("revenue").over(w), F.col("revenue")), "receivable_growth": growth(F.lag("trade_receivables").over(w), F.col("trade_receivables"))})
    out = out.withColumn("growth_gap", F.col("receivable_growth") - F.col("revenue_growth"))
    return out.withColumns({"channel_stuffing": F.col("growth_gap") > 10, "days_worsening": F.col("receivable_days_change") > 10, "inventory_piling": F.col("inventory_days_change") > 15})


def sector_variance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ccc_variance_pct", F.when(F.col("sector_ccc") > 0, (F.col("ccc") - F.col("sector_ccc")) / F.col("sector_ccc") * 100))


def trend(years: DataFrame) -> DataFrame:
    """Per entity: how the cash cycle moved by more than 10 days, its mean, and the flagged years in order."""
    flagged = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c), F.struct("fy", "fiscal_year")))), lambda x: x["fiscal_year"])
    out = single_year(years).groupBy("entity_id").agg(F.min_by("ccc", "fy").alias("a"), F.max_by("ccc", "fy").alias("b"), F.count(F.lit(1)).alias("n"), F.avg("ccc").alias("avg_ccc"), flagged("channel_stuffing").alias("stuffing_years"), flagged("inventory_piling").alias("piling_years"))
    moved = F.when(F.col("n") < 2, "").when(F.col("b") < F.col("a") - 10, "Improving").when(F.col("b") > F.col("a") + 10, "Worsening").otherwise("Stable")
    return out.select("entity_id", moved.alias("ccc_trend"), "avg_ccc", F.array_join("stuffing_years", ",").alias("stuffing_years"), F.array_join("piling_years", ",").alias("piling_years"))
