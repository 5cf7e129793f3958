"""The offer: free float and lock-ins, projections, peer valuation, investors before the offer, use of proceeds, order book, stub period, promoters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.exprs import cagr, nz, sdiv, whole_months

PROMOTERS = ("Promoter", "Promoter Group")
ESOP, ANCHOR = "ESOP Trust", "Anchor Investor"


def float_milestones(issues: DataFrame, holders: DataFrame, compat: bool = True) -> DataFrame:
    """Free float on days 1, 90, 180 and 365 by entity. issues (entity_id, shares_pre_issue, fresh_issue_shares, anchor_shares), holders
    (entity_id, name, category, shares_locked, lock_in_days, shares_selling_ofs). compat: anchor blocks locked for over 180 days
    are counted again on day 365, as in the definition this follows."""
    c, locked = F.col, lambda when: F.coalesce(F.sum(F.when(when, F.col("shares_locked"))), F.lit(0)).cast("long")
    promoter, esop, anchor = c("category").isin(*PROMOTERS), c("category") == ESOP, c("category") == ANCHOR
    days = c("lock_in_days")
    late = ~promoter if compat else ~promoter & ~anchor
    sums = holders.groupBy("entity_id").agg(
        locked(promoter).alias("promoter_locked"), locked(esop).alias("esop_locked"), locked(anchor).alias("_anchor"), locked(~promoter & ~esop & ~anchor).alias("pre_ipo_locked"),
        locked((days > 0) & (days <= 180) & ~promoter & ~anchor).alias("_to180"), locked((days > 180) & (days <= 365) & late).alias("_to365"), F.coalesce(F.sum("shares_selling_ofs"), F.lit(0)).cast("long").alias("ofs_shares"),
    )
    out = issues.join(sums, "entity_id").withColumn("total_shares", c("shares_pre_issue") + c("fresh_issue_shares"))
    out = out.withColumn("anchor_locked", F.when(c("anchor_shares") > 0, c("anchor_shares")).otherwise(c("_anchor")))
    out = out.withColumn("day_1_shares", c("total_shares") - c("promoter_locked") - c("pre_ipo_locked") - c("esop_locked") - c("anchor_locked"))
    out = out.withColumn("day_90_shares", c("day_1_shares") + c("anchor_locked")).withColumn("day_180_shares", c("day_90_shares") + c("_to180")).withColumn("year_1_shares", c("day_180_shares") + c("_to365"))
    pct = lambda x: sdiv(c(x).cast("double"), c("total_shares").cast("double")) * 100
    out = out.withColumns({f"{k}_pct": pct(f"{k}_shares") for k in ("day_1", "day_90", "day_180", "year_1")})
    return out.withColumns({"promoter_locked_pct": pct("promoter_locked"), "daily_volume": c("day_1_shares") / 250.0, "low_float": c("day_1_pct") < 5}).drop("_anchor", "_to180", "_to365")


def float_summary(floats: DataFrame) -> DataFrame:
    """(entity_id, summary) of float_milestones in words."""
    pct = lambda x: F.format_string("%.1f%%", x)
    day1, kind = F.col("day_1_pct"), F.when(F.col("day_1_pct") < 5, "Very low").when(F.col("day_1_pct") < 15, "Moderate").otherwise("Adequate")
    first = F.concat(kind, F.lit(" Day-1 float of "), pct("day_1_pct"), F.when(day1 < 5, " may cause high volatility").otherwise(""))
    held = F.concat(F.lit("Promoters holding "), pct("promoter_locked_pct"), F.lit(" ("), F.format_number("promoter_locked", 0), F.lit(" shares) locked for 3 years"))
    later = F.when(F.col("day_90_pct") > day1 + 5, F.concat(F.lit("Significant float increase to "), pct("day_90_pct"), F.lit(" at Day 90 (anchor unlock)")))
    volume = F.concat(F.lit("Estimated avg daily trading volume: "), F.format_number("daily_volume", 0), F.lit(" shares"))
    return floats.select("entity_id", F.concat(F.concat_ws(". ", first, held, later, volume), F.lit(".")).alias("summary"))


def scenario_maps(projected: DataFrame, measure: str) -> DataFrame:
    """(entity_id, scenario, by_year): a map from each projected year to the measure."""
    return projected.groupBy("entity_id", "scenario").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", measure)))).alias("by_year"))


def lock_in_calendar(issues: DataFrame, holders: DataFrame) -> DataFrame:
    """Unlocking events by date with the running free float, 100 at most. issues also has listing_date; anchors unlock on day 90."""
    c = F.col
    base = issues.withColumn("total_shares", c("shares_pre_issue") + c("fresh_issue_shares"))
    locked = holders.groupBy("entity_id").agg(F.sum("shares_locked").alias("_locked"))
    base = base.join(locked, "entity_id").withColumn("_free", sdiv((c("total_shares") - c("_locked") - c("anchor_shares")).cast("double"), c("total_shares").cast("double")) * 100)
    anchors = base.where("anchor_shares > 0").select("entity_id", F.date_add("listing_date", 90).alias("event_date"), F.lit("Anchor Investors").alias("name"), c("anchor_shares").cast("long").alias("shares"), F.lit(0).alias("ordinal"))
    own = holders.where("shares_locked > 0 and lock_in_days > 0").join(base.select("entity_id", "listing_date"), "entity_id")
    own = own.select("entity_id", F.date_add("listing_date", c("lock_in_days")).alias("event_date"), "name", c("shares_locked").cast("long").alias("shares"), F.lit(1).alias("ordinal"))
    events = anchors.unionByName(own).join(base.select("entity_id", "listing_date", "total_shares", "_free"), "entity_id")
    events = events.withColumn("pct", sdiv(c("shares").cast("double"), c("total_shares").cast("double")) * 100)
    running = Window.partitionBy("entity_id").orderBy("event_date", "ordinal", "name").rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("cumulative_pct", F.least(F.lit(100.0), c("_free") + F.sum("pct").over(running)))
    return out.select("entity_id", "event_date", F.datediff("event_date", "listing_date").alias("days_from_listing"), "name", "shares", "pct", "cumulative_pct")


def projections(latest: DataFrame, years: int = 3) -> DataFrame:
    """Base, bull and stress years of each row of latest (entity_id, revenue, ebitda, total_equity, total_debt, ccc_days, hist_cagr,
    growth_guidance, margin_guidance, tax_rate, depreciation_rate, fresh_cr, repay_cr, post_shares). Guidance of 0 counts as none."""
    c, given = F.col, lambda x: F.when(F.col(x) != 0, F.col(x))
    base = latest.withColumns({
        "g": F.coalesce(given("growth_guidance"), given("hist_cagr"), F.lit(10.0)), "m": F.coalesce(given("margin_guidance"), F.when(c("revenue") != 0, nz("ebitda") / F.when(c("revenue") != 0, c("revenue")) * 100), F.lit(10.0)),
        "equity": nz("total_equity") + c("fresh_cr") - c("repay_cr"), "debt": F.greatest(F.lit(0.0), nz("total_debt") - c("repay_cr")), "ccc0": F.coalesce(given("ccc_days"), F.lit(60.0)),
    })
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), g.alias("growth"), m.alias("margin"), F.lit(k).alias("stretch")) for n, g, m, k in (("Base", c("g"), c("m"), 1.0), ("Bull", c("g") * 1.25, c("m") + 2.0, 0.95), ("Stress", c("g") * 0.6, c("m") - 3.0, 1.10))])
    rows = base.select("*", F.inline(cases))
    revenue = lambda i: nz("revenue") * F.pow(1 + c("growth") / 100, i)

    def pat(i: Column) -> Column:
        r = revenue(i)
        return F.greatest(F.lit(0.0), r * c("margin") / 100 - r * 0.7 * c("depreciation_rate") - c("debt") * 0.10) * (1 - c("tax_rate"))

    # a year needs the profit kept in all years up to it: an array walked once, not a join of years
    year = F.transform(F.sequence(F.lit(1), F.lit(years)), lambda i: F.struct(i.alias("i"), revenue(i.cast("double")).alias("revenue"), pat(i.cast("double")).alias("pat"),
        F.aggregate(F.sequence(F.lit(1), i), c("equity"), lambda a, k: a + pat(k.cast("double")) * 0.7).alias("equity")))
    out = rows.select("entity_id", "scenario", "margin", "stretch", "debt", "ccc0", "post_shares", F.explode(year).alias("y"))
    ebitda, p, e = c("y.revenue") * c("margin") / 100, c("y.pat"), c("y.equity")
    return out.select(
        "entity_id", "scenario", F.concat(F.lit("FY"), c("y.i"), F.lit("E")).alias("year"), F.round("y.revenue", 2).alias("revenue"), F.round(ebitda, 2).alias("ebitda"), F.round(p, 2).alias("pat"),
        F.round(sdiv(p * 1e7, c("post_shares").cast("double")), 2).alias("eps"), F.round(sdiv(p, e) * 100, 2).alias("roe"), F.round(sdiv(p, e + c("debt")) * 100, 2).alias("roic"),
        F.round(sdiv(c("debt"), ebitda), 2).alias("net_debt_to_ebitda"), F.round(c("ccc0") * c("stretch"), 1).alias("ccc"),
    )


# ---- valuation ----


def peer_multiples(peers: DataFrame) -> DataFrame:
    """Peers with pe, pb and ev_ebitda, computed where they aren't given and their denominators are positive."""
    have, c = set(peers.columns), F.col
    ev = c("market_cap") + nz("net_debt")
    fill = {"pe": sdiv(c("market_cap"), c("pat"), None), "pb": sdiv(c("market_cap"), c("net_worth"), None), "ev_ebitda": sdiv(ev, c("ebitda"), None)}
    return peers.withColumns({"enterprise_value": ev} | {k: F.coalesce(c(k), F.round(x, 2)) if k in have else F.round(x, 2) for k, x in fill.items()})


def peer_medians(peers: DataFrame, by: str = "group_id") -> DataFrame:
    """Medians of positive multiples, 0 without any."""
    middle = lambda k: F.coalesce(F.round(F.median(F.when(F.col(k) > 0, F.col(k))), 2), F.lit(0.0)).alias(f"median_{k}")
    return peer_multiples(peers).groupBy(by).agg(*[middle(k) for k in ("pe", "pb", "ev_ebitda")])


def issuer_multiples(issuers: DataFrame) -> DataFrame:
    """Both price points of issuers (entity_id, price_floor, price_cap, shares_post_issue, pat_cr, net_worth_cr, ebitda_cr, net_debt_cr, pat_cagr_3yr)."""
    c = F.col
    points = F.array(*[F.struct(F.lit(k).alias("point"), c(f"price_{k}").alias("price")) for k in ("floor", "cap")])
    out = issuers.select("*", F.inline(points)).withColumn("market_cap", c("price") * c("shares_post_issue") / 1e7)
    pe = sdiv(c("market_cap"), c("pat_cr"))
    return out.select("entity_id", "point", F.round("market_cap", 2).alias("market_cap"), F.round(pe, 2).alias("pe"), F.round(sdiv(c("market_cap"), c("net_worth_cr")), 2).alias("pb"), F.round(sdiv(c("market_cap") + c("net_debt_cr"), c("ebitda_cr")), 2).alias("ev_ebitda"), F.round(sdiv(pe, c("pat_cagr_3yr")), 2).alias("peg"))


def premium(multiples: DataFrame, medians: DataFrame, by: str) -> DataFrame:
    """By how much the issuer's multiples at the cap price exceed the medians, in percent; 0 without a median."""
    cap = multiples.where("point = 'cap'").join(medians, by)
    return cap.select("entity_id", *[F.round((sdiv(F.col(k), F.col(f"median_{k}"), None) - 1) * 100, 2).alias(f"{k}_premium") for k in ("pe", "pb", "ev_ebitda")]).fillna(0.0)


def missing_peers(expected: DataFrame, peers: DataFrame) -> DataFrame:
    """Names of expected (name, ordinal) that no peer has, whatever the case."""
    known = peers.select(F.lower("name").alias("_k")).distinct()
    return expected.join(known, F.lower(F.col("name")) == F.col("_k"), "left_anti")


# ---- investors before the offer ----


def investor_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("fund|capital|partners|ventures"), "PE/VC").when(low.rlike("trust|esop"), "ESOP/Trust").when(low.contains("promoter"), "Promoter").otherwise("Other")


def holdings(history: DataFrame) -> DataFrame:
    """Shares, cost and mean entry price of each investor, and the first date."""
    out = history.groupBy("investor").agg(F.sum("shares").alias("shares"), F.sum(F.col("shares") * F.col("price")).alias("cost"), F.min("entry_date").alias("entry_date"))
    return out.withColumns({"entry_price": sdiv(F.col("cost"), F.col("shares").cast("double")), "kind": investor_kind(F.col("investor"))})


def investor_returns(history: DataFrame, price_cap: float, listing: str, sales: DataFrame | None = None, locks: DataFrame | None = None) -> DataFrame:
    """holdings with multiple and annual return at the cap price, shares offered and lock-in. Of several rows of an investor in
    sales (investor, ordinal, ofs_shares) or locks (investor, ordinal, lock_in_days) the last counts."""
    out = holdings(history)
    for extra, name in ((sales, "ofs_shares"), (locks, "lock_in_days")):
        if extra is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            last = extra.groupBy("investor").agg(F.max_by(name, "ordinal").cast("long").alias(name))
            out = out.join(last, "investor", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    months = whole_months(F.col("entry_date"), F.lit(listing).cast("date"))
    times = sdiv(F.lit(float(price_cap)), F.col("entry_price"), None)
    yearly = F.when(months > 0, (F.pow(times, F.lit(12.0) / F.when(months > 0, months)) - 1) * 100)
    return out.withColumns({"holding_months": months, "return_multiple": times, "irr_pct": yearly, "ofs_value_cr": F.col("ofs_shares") * price_cap / 1e7})


# ---- order book, objects, stub period, promoters ----

# Sectors whose order book counts.
ORDER_BOOK_SECTORS = ("epc", "defense", "infrastructure", "capital goods", "engineering", "construction", "it services", "industrial services")


def order_book(rows: DataFrame) -> DataFrame:
    """rows (entity_id, sector, total_order_book, largest_order, executable_12m, book_year_ago, top_orders, ltm_revenue) of applicable
    sectors. The five top orders are the first five given."""
    c = F.col
    rows = rows.where(F.lower("sector").isin(*ORDER_BOOK_SECTORS))
    top5 = F.aggregate(F.slice("top_orders", 1, 5), F.lit(0.0), lambda a, x: a + x)
    total = c("total_order_book")
    return rows.select("entity_id", sdiv(total, c("ltm_revenue")).alias("book_to_revenue"), top5.alias("top5"), (sdiv(top5, total) * 100).alias("top5_pct"), (sdiv(F.coalesce(c("largest_order"), F.array_max("top_orders")), total) * 100).alias("largest_pct"), (sdiv(c("executable_12m"), total) * 100).alias("executable_pct"), ((sdiv(total, c("book_year_ago"), None) - 1) * 100).alias("growth_pct"))


# Buckets of use of proceeds and the words that name them, in order.
OBJECTS = [("capex", ("capex", "capital expenditure", "expansion")), ("debt_repayment", ("debt", "loan", "repayment")), ("working_capital", ("working", "wc")), ("acquisition", ("acquisition", "investment")), ("gcp", ("general", "gcp")), ("issue_expenses", ("issue expense", "offer expense", "ofer"))]


def object_bucket(category: Column) -> Column:
    """The first bucket one of whose words the category contains; null if none."""
    out, low = F.when(F.lit(False), ""), F.lower(category)
    for name, words in OBJECTS:
        out = out.when(low.rlike("|".join(words)), name)
    return out


def objects_posture(uses: DataFrame, issues: DataFrame) -> DataFrame:
    """Use of proceeds by bucket from uses (entity_id, category, amount_cr), and the posture given issues (entity_id, fresh_cr, ofs_cr)."""
    total = lambda b: F.coalesce(F.sum(F.when(object_bucket(F.col("category")) == b, F.col("amount_cr"))), F.lit(0.0)).alias(b)
    out = issues.join(uses.groupBy("entity_id").agg(*[total(b) for b, _ in OBJECTS]), "entity_id", "left").fillna(0.0)
    c = F.col
    return out.withColumns({"growth_oriented": c("capex") > c("debt_repayment"), "exit_oriented": c("ofs_cr") > c("fresh_cr"), "deleveraging": c("debt_repayment") > c("capex") + c("working_capital"), "gcp_too_high": sdiv(c("gcp"), c("fresh_cr")) * 100 > 25})


def stub_period(rows: DataFrame) -> DataFrame:
    """rows (entity_id, months, revenue, ebitda, pat, prior_revenue, prior_ebitda, first_revenue, last_revenue, span)."""
    c = F.col
    margin, before = sdiv(c("ebitda"), c("revenue")) * 100, sdiv(c("prior_ebitda"), c("prior_revenue")) * 100
    g = F.round((sdiv(c("revenue"), c("prior_revenue"), None) - 1) * 100, 2)
    past = cagr(c("first_revenue"), c("last_revenue"), c("span").cast("double"))
    return rows.select("entity_id", g.alias("revenue_growth"), F.round(margin, 2).alias("ebitda_margin"), F.round(c("revenue") * 12 / F.greatest(c("months"), F.lit(1)), 2).alias("annualised_revenue"), past.alias("historical_cagr"), F.coalesce(g < past, F.lit(False)).alias("below_history"), (margin - before < -2).alias("margin_compression"))


def dossier(profiles: DataFrame, *parts: DataFrame) -> DataFrame:
    """profiles joined with each part by name; a promoter that a part lacks keeps nulls."""
    for part in parts:
        profiles = profiles.join(part, "name", "left")
    return profiles


def skin_in_the_game(holders: DataFrame, price_cap: float) -> DataFrame:
    """holders (name, holding_pct, total_shares) with their stake at the cap price in crore."""
    return holders.withColumn("stake_cr", F.col("holding_pct") / 100 * F.col("total_shares") * price_cap / 1e7)
