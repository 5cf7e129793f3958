"""Litigation, contingent liabilities, debt and governance rules."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.exprs import nz, sdiv

# ---- litigation ----


def litigation_rollup(items: DataFrame, networth: float) -> DataFrame:
    """By entity type of items (ordinal, entity_type, case_type, amount_cr, cnt, hearing_date): counts by kind, amount, share of net worth."""
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("cnt"))), F.lit(0)).cast("long")
    kinds = ("Civil", "Criminal", "Tax", "Regulatory")
    out = items.groupBy("entity_type").agg(F.sum("cnt").cast("long").alias("total"), *[n(F.col("case_type") == k).alias(f"{k.lower()}_count") for k in kinds], n(~F.col("case_type").isin(*kinds)).alias("other_count"), F.sum("amount_cr").alias("amount_cr"))
    return out.withColumn("pct_networth", sdiv(F.col("amount_cr"), F.lit(float(networth))) * 100)


def risk_exposures(items: DataFrame, networth: float) -> DataFrame:
    """By entity and case type, of the four kinds that are reported: severity and the first hearing given."""
    rows = items.where(F.col("case_type").isin("Civil", "Criminal", "Tax", "Regulatory"))
    out = rows.groupBy("entity_type", "case_type").agg(F.sum("cnt").cast("long").alias("count"), F.sum("amount_cr").alias("amount_cr"), F.min_by("hearing_date", F.when(F.col("hearing_date").isNotNull(), F.col("ordinal"))).alias("next_hearing"))
    pct = sdiv(F.col("amount_cr"), F.lit(float(networth))) * 100
    severity = F.when(F.col("case_type") == "Criminal", "Critical").when(pct > 5, "Critical").when(pct > 2, "Major").otherwise("Minor")
    return out.withColumns({"pct_networth": pct, "severity": severity})


def risk_severity(items: DataFrame, contingent_pct: float, networth: float) -> DataFrame:
    """One row: litigation but that of group companies as a share of net worth, criminal cases of promoters, veto and severity."""
    own = items.where("entity_type <> 'Group Company'").agg(F.coalesce(F.sum("amount_cr"), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when((F.col("entity_type") == "Promoter") & (F.col("case_type") == "Criminal"), F.col("cnt"))), F.lit(0)).cast("long").alias("criminal_promoter"))
    out = own.withColumn("litigation_pct", sdiv(F.col("a"), F.lit(float(networth))) * 100)
    veto = (F.col("litigation_pct") > 10) | (F.col("criminal_promoter") > 0)
    both = F.col("litigation_pct") + contingent_pct
    return out.select("litigation_pct", "criminal_promoter", veto.alias("veto"), F.when(veto | (both > 15), "Critical").when(both > 5, "Major").otherwise("Minor").alias("severity"))


def hearings(items: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row: matters with a hearing, and their amount; with as_of those due within a year of it, past ones included."""
    due = F.col("hearing_date").isNotNull() if as_of is None else F.col("hearing_date") <= F.date_add(F.lit(as_of).cast("date"), 365)
    return items.where(due).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("matters"), F.coalesce(F.sum("amount_cr"), F.lit(0.0)).alias("amount_cr"))


# ---- contingent liabilities ----


def contingent_category(category: Column) -> Column:
    low = F.lower(category)
    has = lambda *words: F.lit(False) if not words else sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0
    return F.when(has("tax"), "tax_disputes").when(has("customs", "excise"), "customs_excise").when(has("legal", "civil"), "legal_claims").when(has("bank", "guarantee"), "bank_guarantees").when(has("labor", "employee"), "labor_disputes").when(has("environment"), "environmental").when(has("regulatory", "sebi"), "regulatory_fines").otherwise(category)


def probability(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("medium")))
    return F.when(low.contains("high"), "high").when(low.contains("low"), "low").otherwise("medium")


WEIGHTS = {"high": 0.75, "medium": 0.5, "low": 0.25}


def contingent_by_category(items: DataFrame, positive_only: bool = False) -> DataFrame:
    rows = items.where("amount_cr > 0") if positive_only else items
    return rows.groupBy(contingent_category(F.col("category")).alias("category")).agg(F.sum("amount_cr").alias("amount_cr"), F.count(F.lit(1)).alias("n"))


def contingent_weighted(items: DataFrame, networth: float, positive_only: bool = False) -> DataFrame:
    """One row: total, by probability, and weighted by it."""
    rows = (items.where("amount_cr > 0") if positive_only else items).withColumn("p", probability(F.col("probability")))
    part = lambda k: F.coalesce(F.sum(F.when(F.col("p") == k, F.col("amount_cr"))), F.lit(0.0))
    total = F.coalesce(F.sum("amount_cr"), F.lit(0.0))
    return rows.agg(total.alias("total"), *[part(k).alias(k) for k in WEIGHTS], sum((part(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)).alias("risk_weighted"), (sdiv(total, F.lit(float(networth))) * 100).alias("pct_networth"))


# ---- debt ----


# Kinds of facility and of covenant, and their patterns in order; short ones match inside words too.
FACILITIES = [("Term Loan", r"term\s*loan|TL|long\s*term\s*loan"), ("Working Capital", r"working\s*capital|WC|cash\s*credit|CC|overdraft|OD"), ("Ncd", r"non[- ]?convertible\s*debenture|NCD"), ("Ecb", r"external\s*commercial\s*borrowing|ECB"), ("Vehicle Loan", r"vehicle\s*loan|equipment\s*loan"), ("Unsecured Loan", r"unsecured\s*loan|inter[- ]?corporate")]
COVENANTS = [("dscr", r"debt\s*service\s*coverage|DSCR"), ("debt_equity", r"debt[/-]?equity|D/E|DE\s*ratio"), ("current_ratio", r"current\s*ratio|CR"), ("interest_coverage", r"interest\s*coverage|ICR"), ("total_debt_ebitda", r"(total\s*)?debt[/-]?EBITDA"), ("fixed_asset_coverage", r"fixed\s*asset\s*coverage|FAC"), ("tangible_net_worth", r"tangible\s*net\s*worth|TNW|minimum\s*net\s*worth")]


def first_kind(c: Column, kinds: list[tuple[str, str]]) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in kinds:
        out = out.when(c.rlike(f"(?i){pattern}"), name)
    return out


def facility(c: Column) -> Column:
    """Kind of a facility by its first pattern; blank: Other; none: the text itself."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "Other").otherwise(F.coalesce(first_kind(c, FACILITIES), c))


def covenant_kind(c: Column) -> Column:
    return F.coalesce(first_kind(c, COVENANTS), F.lit("other"))


# Fixed value: what sets a covenant's threshold in running text.
_THRESHOLD = r"(>=?|<=?|at\s*least|not\s*exceed)[^.]*?([\d.]+)"


def covenants_in_text(texts: DataFrame) -> DataFrame:
    """(id, covenant_type, description, threshold) of texts (id, text): each kind of covenant followed, in its sentence, by a threshold."""

    def one_kind(kind: str, pattern: str) -> Column:
        inner = re.sub(r"\((?!\?)", "(?:", pattern)  # groups of the pattern's own don't count
        each = lambda g: F.regexp_extract_all("text", F.lit(rf"(?i)(?:{inner})[^.]*?{_THRESHOLD}"), F.lit(g))
        rows = F.arrays_zip(each(0).alias("d"), each(1).alias("o"), each(2).alias("n"))
        return F.transform(rows, lambda x: F.struct(F.lit(kind.upper()).alias("covenant_type"), x["d"].alias("description"), F.concat_ws(" ", x["o"], x["n"]).alias("threshold")))

    found = [one_kind(*x) for x in COVENANTS]
    return texts.select("id", F.inline(F.concat(*found)))


def debt_totals(items: DataFrame, by: str = "entity_id") -> DataFrame:
    part = lambda when: F.coalesce(F.sum(F.when(when, F.col("amount"))), F.lit(0.0))
    secured, short = F.coalesce("is_secured", F.lit(True)), F.coalesce("is_short_term", F.lit(False))
    out = items.groupBy(by).agg(F.sum("amount").alias("total_debt"), part(secured).alias("secured"), part(~secured).alias("unsecured"), part(short).alias("short_term"), part(~short).alias("long_term"))
    pct = lambda c: sdiv(F.col(c), F.col("total_debt")) * 100
    return out.withColumns({"secured_pct": pct("secured"), "short_term_pct": pct("short_term")})


def debt_rates(items: DataFrame, by: str = "entity_id") -> DataFrame:
    """Mean rate weighted by amount, lowest and highest, of items with a rate and a positive amount."""
    rows = items.where("interest_rate is not null and amount > 0")
    return rows.groupBy(by).agg((F.sum(F.col("interest_rate") * F.col("amount")) / F.sum("amount")).alias("weighted_rate"), F.min("interest_rate").alias("lowest"), F.max("interest_rate").alias("highest"))


def lender_concentration(items: DataFrame, by: str = "entity_id") -> DataFrame:
    """Lenders, and the one with most debt; of equal ones that named first."""
    name = F.when(F.coalesce(F.trim("lender"), F.lit("")) == "", "Unknown").otherwise(F.col("lender"))
    each = items.groupBy(by, name.alias("lender")).agg(F.sum("amount").alias("amount"), F.min("ordinal").alias("ordinal"))
    out = each.groupBy(by).agg(F.count(F.lit(1)).alias("n_lenders"), F.sum("amount").alias("_total"), F.max(F.struct("amount", -F.col("ordinal"), "lender")).alias("_top"))
    return out.select(by, "n_lenders", F.col("_top.lender").alias("top_lender"), F.col("_top.amount").alias("top_amount"), (sdiv(F.col("_top.amount"), F.col("_total")) * 100).alias("top_pct"))


def maturity_profile(items: DataFrame, by: str = "entity_id") -> DataFrame:
    """Amounts by time to maturity. Without a bucket, short-term debt falls within a year and other debt in one to three."""
    bucket = F.coalesce("bucket", F.when(F.coalesce("is_short_term", F.lit(False)), "0-1y").otherwise("1-3y"))
    part = lambda k: F.coalesce(F.sum(F.when(bucket == k, F.col("amount"))), F.lit(0.0)).alias("y_" + k.replace("-", "_").replace("+", "_up").rstrip("y"))
    return items.groupBy(by).agg(*[part(k) for k in ("0-1y", "1-3y", "3-5y", "5+y")])


def debt_impact(rows: DataFrame) -> DataFrame:
    """rows (entity_id, total_debt, repay_cr, fresh_cr, equity, ebitda, interest): leverage before and after the offer."""
    c = F.col
    post = F.greatest(F.lit(0.0), c("total_debt") - c("repay_cr"))
    cover = F.when(c("ebitda") > 0, sdiv(c("ebitda"), c("interest"), None))
    return rows.select("entity_id", post.alias("post_debt"), (sdiv(c("repay_cr"), c("fresh_cr")) * 100).alias("repay_pct"), sdiv(c("total_debt"), c("equity")).alias("de_pre"), sdiv(post, c("equity") + c("fresh_cr")).alias("de_post"), sdiv(c("total_debt"), c("ebitda")).alias("debt_to_ebitda"), cover.alias("interest_cover"))


def grade(x: Column, high: float, medium: float) -> Column:
    return F.when(x > high, "HIGH").when(x > medium, "MEDIUM").otherwise("LOW")


def debt_risk(items: DataFrame, equity: DataFrame) -> DataFrame:
    """Grades of leverage, cost, refinancing and concentration by entity; equity is (entity_id, equity)."""
    out = debt_totals(items).join(debt_rates(items), "entity_id", "left").join(lender_concentration(items), "entity_id").join(equity, "entity_id", "left")
    c = F.col
    return out.select("entity_id", grade(sdiv(c("total_debt"), nz("equity")), 2, 1).alias("leverage"), grade(nz("weighted_rate"), 12, 9).alias("interest_cost"), grade(c("short_term_pct"), 50, 30).alias("refinancing"), grade(c("top_pct"), 50, 30).alias("concentration"))


# ---- governance ----

# Rule, family, severity, condition, threshold.
RULES = [
    ("SKIN-001", "shareholder_skin_in_game", "critical", "promoter_post_issue_holding_pct < 51", "≥51%"),
    ("SKIN-002", "shareholder_skin_in_game", "major", "ofs_pct_of_issue > fresh_issue_pct_of_issue", "OFS ≤ Fresh Issue"),
    ("PLEDGE-001", "pledge_encumbrance", "critical", "promoter_pledge_pct > 25", "≤25%"),
    ("PLEDGE-002", "pledge_encumbrance", "major", "promoter_pledge_pct > 0", "0%"),
    ("RPT-001", "related_party", "major", "rpt_revenue_pct > 20", "≤20%"),
    ("RPT-002", "related_party", "major", "rpt_expense_pct > 20", "≤20%"),
    ("AUDIT-001", "audit_quality", "critical", "auditor_resigned == True", "No resignation"),
    ("AUDIT-002", "audit_quality", "critical", "modified_audit_opinion == True", "Unqualified opinion"),
    ("AUDIT-003", "audit_quality", "major", "caro_qualifications > 0", "No qualifications"),
    ("LITIG-001", "litigation", "critical", "post_issue_networth_cr > 0 and (total_litigation_cr / post_issue_networth_cr * 100) > 10", "≤10%"),
    ("WC-001", "working_capital", "major", "(receivable_days_growth - revenue_cagr_3yr) > 10", "Gap ≤10pp"),
]


def compiled(condition: str, fields: set[str]) -> Column:
    """A condition as a Column. Only names among fields, constants, arithmetic, comparisons and and/or/not are allowed; what
    can't be parsed or computed is false."""

    def value(node: ast.expr) -> Column:
        match node:
            case ast.Name(id=name) if name in fields:
                return F.col(name)
            case ast.Constant(value=v) if isinstance(v, (bool, int, float, str)):
                return F.lit(v)
            case ast.BoolOp(op=op, values=parts):
                out = value(parts[0])
                for p in parts[1:]:
                    out = out & value(p) if isinstance(op, ast.And) else out | value(p)
                return out
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~value(x)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.BinOp(left=a, op=op, right=b):
                a, b = value(a), value(b)
                how = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.Mod: lambda: F.try_mod(a, b)}
                return how[type(op)]()
            case ast.Compare(left=left, ops=ops, comparators=rest):
                sides, out = [value(left), *map(value, rest)], None
                how = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
                for op, a, b in zip(ops, sides, sides[1:], strict=False):
                    out = how[type(op)](a, b) if out is None else out & how[type(op)](a, b)
                return out
        raise ValueError(f"not allowed in a rule: {ast.dump(node)[:80]}")

    try:
        return F.coalesce(value(ast.parse(condition, mode="eval").body), F.lit(False))
    except (ValueError, SyntaxError, KeyError):
        return F.lit(False)


def violations(inputs: DataFrame, rules: list[tuple[str, str, str, str, str]] | None = None) -> DataFrame:
    """(entity_id, rule_id, family, severity, threshold) of each rule that an input breaks: one pass, each rule an expression."""
    fields = set(inputs.columns)
    broken = [F.when(compiled(cond, fields), F.struct(F.lit(i).alias("rule_id"), F.lit(f).alias("family"), F.lit(s).alias("severity"), F.lit(t).alias("threshold"))) for i, f, s, cond, t in rules or RULES]
    return inputs.select("entity_id", F.inline(F.filter(F.array(*broken), lambda x: x.isNotNull())))


def with_citations(found: DataFrame, citations: DataFrame) -> DataFrame:
    """Violations with the citation (entity_id, rule_id, citation) of each one's rule; without any, an empty one."""
    return found.join(citations.select("entity_id", "rule_id", "citation"), ["entity_id", "rule_id"], "left").withColumn("citation", F.coalesce("citation", F.lit("")))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def veto_flags(inputs: DataFrame) -> DataFrame:
    """Every input with its critical and major violations; one critical is a veto."""
    n = violations(inputs).groupBy("entity_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "major").alias("major"))
    return inputs.select("entity_id").join(n, "entity_id", "left").fillna(0).withColumn("veto", F.col("critical") > 0)


def covenants(rows: DataFrame, by: str = "entity_id") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("breached"), F.lit(False)).alias("any_breach"))


# Fields of an indebtedness table and the words of their headers, in order.
DEBT_HEADERS = [("lender", ("lender", "bank", "institution")), ("facility_type", ("facility", "type", "nature")), ("interest_rate", ("rate", "interest")), ("amount", ("outstanding", "amount", "sanctioned")), ("security", ("security", "secured"))]


def indebtedness(tables: DataFrame) -> DataFrame:
    """(table_id, row_no, lender, facility_type, amount, interest_rate, is_secured) of rows with a positive amount. A header names the first
    field one of whose words it has; of several headers of a field the last counts."""
    from ledgerleaf.functions.exprs import amount_debt, rate

    def field(header: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, words in DEBT_HEADERS:
            out = out.when(F.lower(header).rlike("|".join(words)), name)
        return out

    fields = tables.withColumn("_f", F.transform("headers", field))
    rows = fields.select("table_id", "_f", F.posexplode("rows").alias("row_no", "cells")).where(F.size("cells") >= 2)
    place = lambda name: F.size("_f") - F.array_position(F.reverse("_f"), name)
    cell = lambda name: F.when(F.array_contains("_f", name), F.get("cells", place(name).cast("int")))
    out = rows.select(
        "table_id", "row_no", F.coalesce(F.nullif(F.trim(cell("lender")), F.lit("")), F.lit("Unknown")).alias("lender"), facility(cell("facility_type")).alias("facility_type"), amount_debt(cell("amount")).alias("amount"),
        rate(cell("interest_rate")).alias("interest_rate"), (~F.coalesce(F.lower(F.array_join("cells", " ")).contains("unsecured"), F.lit(False))).alias("is_secured"),
    )
    return out.where("amount > 0")
