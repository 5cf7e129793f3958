"""Column expressions that the operators share. Money is in crore, as DOUBLE; every division is guarded, since ANSI mode raises."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# Crore by unit of money.
UNIT_FACTORS = {"cr": 1.0, "crore": 1.0, "crores": 1.0, "crs": 1.0, "cro": 1.0, "lakh": 0.01, "lakhs": 0.01, "lac": 0.01, "lacs": 0.01, "million": 0.1, "millions": 0.1, "mn": 0.1, "billion": 100.0, "billions": 100.0}

STRIP = r"^[\s\x{A0}]+|[\s\x{A0}]+$"


def nz(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0))


def sdiv(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b where b is positive."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(otherwise).cast("double"))


def growth(prior: Column, current: Column) -> Column:
    """Percent from prior to current; 0 without a positive prior."""
    return F.coalesce((sdiv(current, prior, None) - 1) * 100, F.lit(0.0))


def over(entity: str, order: str) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(order)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def fy_key(label: Column) -> Column:
    """The last two digits of a fiscal year's label; without digits 0."""
    digits = F.regexp_replace(label, "[^0-9]", "")
    return F.coalesce(F.right(digits, F.lit(2)).try_cast("int"), F.lit(0))


def number(c: Column) -> Column:
    """A string as DOUBLE, null where it isn't one."""
    return c.try_cast("double")


def cagr(first: Column, last: Column, years: Column, digits: int | None = 2, scale: float = 100.0) -> Column:
    """Compound growth from first to last over years, of positive ends only; null otherwise."""
    fine = (first > 0) & (last > 0) & (years > 0)
    x = F.when(fine, (F.pow(F.when(fine, last) / F.when(fine, first), F.lit(1.0) / F.when(fine, years)) - 1) * scale)
    return x if digits is None else F.round(x, digits)


# ---- amounts: four parsers, each with its own treatment of blanks and units ----


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[₹$,\s()]", "")


def amount_statement(c: Column) -> Column:
    """Statements: null and what is no number are 0; parentheses or a leading minus negate; lakh is a hundredth."""
    text = stripped(c)
    negative = text.rlike(r"^\(.*\)$") | text.startswith("-")
    body = F.regexp_replace(_bare(text), "^-", "")
    lakh = F.lower(body).rlike(r"(lakhs?|l)$")
    value = number(F.regexp_replace(body, r"(?i)(crores?|cr\.?|lakhs?|l)$", ""))
    value = F.when(lakh, value / 100).otherwise(value)
    return F.coalesce(F.when(negative, -value).otherwise(value), F.lit(0.0))


def amount_cell(c: Column) -> Column:
    """Table cells: blank is null; nil, na and dashes are 0; parentheses or a minus negate; anything else is null."""
    text = stripped(c)
    negative = text.rlike(r"^\(.*\)$") | text.startswith("-")
    value = number(F.regexp_replace(F.regexp_replace(text, r"(?i)₹|rs\.?|inr|[,\s()]", ""), "^-", ""))
    return F.when(text == "", None).when(F.lower(text).isin("nil", "na", "n/a", "n.a.", "-", "–", "—"), 0.0).when(negative, -value).otherwise(value)


def amount_debt(c: Column) -> Column:
    """Debt tables: the first number, a hundredth of it where lakh is named; without a unit the whole must be a number."""
    first = number(F.regexp_extract(F.regexp_replace(c, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1))
    low = F.lower(c)
    return F.coalesce(F.when(low.contains("cr"), first).when(low.contains("lakh"), first / 100).otherwise(number(F.regexp_replace(c, r"[₹,\s]", ""))), F.lit(0.0))


def amount_normal(c: Column, factor: Column) -> Column:
    """The normaliser's: a number times the unit's factor to 4 places; parentheses negate; anything else is null."""
    text = stripped(c)
    value = number(F.regexp_replace(text, r"(?i)₹|rs\.?|inr|[,\s()]", ""))
    return F.round(F.when(text.rlike(r"^\(.*\)$"), -value).otherwise(value) * factor, 4)


def rate(c: Column) -> Column:
    """The first number of a string."""
    return number(F.regexp_extract(c, r"([0-9.]+)", 1))


def unit_factor(c: Column) -> Column:
    pairs = [F.lit(x) for kv in UNIT_FACTORS.items() for x in kv]
    return F.create_map(*pairs)[F.lower(stripped(F.coalesce(c, F.lit("cr"))))]


def whole_months(start: Column, end: Column) -> Column:
    """Whole months from start to end, by day of month; null if end isn't later."""
    n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)
    return F.when(end > start, n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where either has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return sdiv(dot(a, b), norm)
