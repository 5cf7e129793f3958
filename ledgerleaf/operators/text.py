"""Document text: extracted tables, sections, entities, chunks, citations and vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.exprs import amount_cell, stripped
from ledgerleaf.operators.spans import points_in_spans
from ledgerleaf.sources.scratch import written

# ---- tables ----

# Kinds of table and the words that mark them; the order breaks ties.
TABLE_WORDS = [
    ("income_statement", ("revenue", "income", "profit", "loss", "ebitda", "expenses", "statement of profit", "profit and loss", "p&l", "operating income", "restated statement", "restated consolidated", "restated standalone")),
    ("balance_sheet", ("assets", "liabilities", "equity", "balance sheet", "net worth", "total assets", "current assets", "non-current", "shareholders", "restated assets", "statement of assets")),
    ("cash_flow", ("cash flow", "operating activities", "investing activities", "financing activities", "cash and cash equivalents", "net cash")),
    ("shareholding_pattern", ("shareholding", "shareholder", "promoter", "holding pattern", "pre-issue", "post-issue", "category of shareholders", "public holding")),
    ("object_of_issue", ("object of the issue", "use of proceeds", "objects of the offer", "net proceeds", "deployment", "objects of the issue")),
    ("related_party", ("related party", "related parties", "rpt", "transactions with", "key managerial", "promoter group")),
    ("key_metrics", ("key ratios", "financial ratios", "key performance", "operating metrics", "kpi", "roce", "roe")),
    ("peer_comparison", ("peer comparison", "comparable companies", "basis for issue price", "peer group", "industry peers", "listed peers")),
    ("indebtedness", ("indebtedness", "borrowings", "outstanding debt", "loan", "secured", "unsecured", "debt structure")),
    ("litigation_summary", ("litigation", "outstanding legal", "legal proceedings", "pending cases", "material litigations")),
    ("contingent_liabilities", ("contingent liabilities", "contingent", "guarantees", "commitments", "claims against")),
]


def classify_tables(tables: DataFrame) -> DataFrame:
    """tables (table_id, headers, rows) with table_type and confidence: the kind with most of its words in the headers and first five
    rows; full confidence at three tenths of the words; none found: other, 0."""
    text = F.lower(F.concat_ws(" ", F.array_join("headers", " "), F.array_join(F.flatten(F.slice("rows", 1, 5)), " ")))
    rows = tables.select("table_id", text.alias("_text"))  # made once a table, not once a word
    held = lambda words: sum((F.contains("_text", F.lit(w)).cast("int") for w in words), F.lit(0))
    hits = [F.struct(held(words).alias("hits"), F.lit(-i).alias("rank"), F.lit(kind).alias("kind"), F.lit(len(words)).alias("of")) for i, (kind, words) in enumerate(TABLE_WORDS)]
    rows = rows.select("table_id", F.greatest(*hits).alias("best"))
    best, found = F.col("best"), F.col("best.hits") > 0
    return rows.select("table_id", F.when(found, best["kind"]).otherwise("other").alias("table_type"), F.when(found, F.least(F.lit(1.0), best["hits"] / (best["of"] * 0.3))).otherwise(0.0).alias("confidence"))


def unit_of(headers: Column, rows: Column, compat: bool = False) -> Column:
    """The unit that headers and first three rows name. compat: million is taken for crore."""
    text = F.lower(F.concat_ws(" ", F.array_join(headers, " "), F.array_join(F.flatten(F.slice(rows, 1, 3)), " ")))
    return F.when(text.contains("crore") | text.contains(" cr"), "crore").when(text.contains("lakh"), "lakh").when(text.contains("million"), "crore" if compat else "million").otherwise("actual")


def is_year_header(c: Column) -> Column:
    return c.rlike(r"(?i)FY\s*'?\d{2,4}|\d{4}\s*-\s*\d{2,4}|(march|mar)\D*\d{4}|^\s*\d{4}\s*$")


def melt_statement(tables: DataFrame) -> DataFrame:
    """(table_id, metric, fiscal_year, value, raw_value) of each metric row and year column; totals and headings are left out."""
    cell = tables.select("table_id", "headers", F.posexplode("rows").alias("row_no", "cells"))
    years = F.filter(F.arrays_zip("headers", F.sequence(F.lit(0), F.size("headers") - 1).alias("at")), lambda x: is_year_header(x["headers"]))
    out = cell.withColumn("metric", F.try_element_at(F.filter(F.transform("cells", lambda x: stripped(x)), lambda x: x != ""), F.lit(1))).select("table_id", "metric", "cells", F.explode(years).alias("y"))
    raw = F.get("cells", F.col("y.at"))
    return out.where(F.col("metric").isNotNull() & ~F.lower("metric").isin("particulars", "description", "total", "sub-total")).select("table_id", "metric", F.col("y.headers").alias("fiscal_year"), amount_cell(raw).alias("value"), raw.alias("raw_value")).where("value is not null")


def table_growth(facts: DataFrame) -> DataFrame:
    """Growth of each metric on the year before by label, in percent of the prior's size; none from 0 or null."""
    prior = F.lag("value").over(Window.partitionBy("table_id", "metric").orderBy("fiscal_year"))
    rows = facts.withColumn("p", prior).where("p is not null and p <> 0")
    return rows.select("table_id", "metric", "fiscal_year", F.round((F.col("value") - F.col("p")) / F.abs("p") * 100, 2).alias("growth"))


def markdown(headers: Column, rows: Column) -> Column:
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"\|", r"\\|"), r"\n", " ")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, clean), " | "), F.lit(" |"))
    return F.concat_ws("\n", line(headers), F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |")), F.array_join(F.transform(rows, line), "\n"))


def extracted(raw: DataFrame) -> DataFrame:
    """Tables of raw ones (table_id, cells): the first row is the header, cells are trimmed and null cells empty. A table of fewer than
    two rows, or without anything in its data rows, is dropped."""
    clean = F.transform("cells", lambda r: F.transform(r, lambda c: F.coalesce(stripped(c), F.lit(""))))
    rows = raw.where(F.size("cells") >= 2).withColumn("_c", clean)
    some = rows.where(F.exists(F.slice("_c", 2, 1_000_000_000), lambda r: F.exists(r, lambda c: c != "")))
    return some.select(*[c for c in raw.columns if c != "cells"], F.get("_c", F.lit(0)).alias("headers"), F.slice("_c", 2, 1_000_000_000).alias("rows"))


def table_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tables of the first extractor, and those of the second on pages (document_id, page_num) where the first has none."""
    pages = first.select("document_id", "page_num").distinct()
    return first.unionByName(second.join(pages, ["document_id", "page_num"], "left_anti").select(*first.columns))


def of_type(tables: DataFrame, kind: str, least: float = 0.3) -> DataFrame:
    """Classified tables (table_type, confidence) of a kind, at least so sure."""
    return tables.where((F.col("table_type") == kind) & (F.col("confidence") >= least))


def statement_kind(table_type: Column) -> Column:
    """Which statement a table's type names: income, balance or cash flow; else null."""
    low, has = F.lower(table_type), lambda *w: F.lower(table_type).rlike("|".join(w))
    return F.when(has("income", "p&l", "profit"), "income").when(has("balance", "position"), "balance").when(low.contains("cash") & low.contains("flow"), "cash_flow")


def to_rupees(value: Column, unit: Column) -> Column:
    return F.when(unit == "crore", value * 1e7).when(unit == "lakh", value * 1e5).otherwise(value)


def with_shape(tables: DataFrame) -> DataFrame:
    """Tables with row_count and col_count: of the headers or, without any, of the first row."""
    return tables.withColumns({"row_count": F.size("rows"), "col_count": F.when(F.size("headers") > 0, F.size("headers")).when(F.size("rows") > 0, F.size(F.get("rows", F.lit(0)))).otherwise(0)})


def csv_text(headers: Column, rows: Column) -> Column:
    """Headers and rows as lines of CSV: cells with a comma, a quote or a line break are quoted."""
    cell = lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    line = lambda r: F.array_join(F.transform(r, lambda c: cell(F.coalesce(c, F.lit("")))), ",")
    return F.array_join(F.concat(F.array(line(headers)), F.transform(rows, line)), "\n")


def tables_summary(tables: DataFrame) -> DataFrame:
    """Of classified tables (table_type, confidence, page_num, rows): how many of each type, on how many pages, their rows and mean confidence."""
    return tables.groupBy("table_type").agg(F.count(F.lit(1)).alias("n_tables"), F.countDistinct("page_num").alias("n_pages"), F.sum(F.size("rows")).cast("long").alias("n_rows"), F.avg("confidence").alias("confidence"))


# ---- pages and sections ----


def page_kind(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_num, text) with page_type: blank, cover, toc, appendix or text."""
    text = F.coalesce("text", F.lit(""))
    numbers = F.regexp_count(text, F.lit(r"(?m)\d+\s*$"))
    kind = (
        F.when(F.length(stripped(text)) < 50, "blank").when((F.col("page_num") <= 5) & text.rlike(r"(?i)red herring prospectus|draft prospectus"), "cover")
        .when(F.substring(text, 1, 500).rlike(r"(?i)table of contents|contents") & (numbers > 5), "toc").when(F.substring(text, 1, 200).rlike(r"(?i)appendix|annexure|schedule"), "appendix").otherwise("text")
    )
    return pages.withColumn("page_type", kind)


def page_summary(pages: DataFrame) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return page_kind(pages).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"), *[F.count_if(F.col("page_type") == k).alias(f"{k}_pages") for k in ("blank", "cover", "toc", "appendix", "text")], F.sum(words).cast("long").alias("words"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chars"))


def section_ends(sections: DataFrame, last_pages: DataFrame) -> DataFrame:
    """sections (document_id, section_id, start_page, level) with the page where each ends: before the next starts, the last one at the document's end."""
    after = F.lead("start_page").over(Window.partitionBy("document_id").orderBy("start_page", "section_id"))
    rows = sections.withColumn("_next", after).join(last_pages, "document_id")
    return rows.withColumn("end_page", F.greatest("start_page", F.coalesce(F.col("_next") - 1, "total_pages"))).drop("_next", "total_pages")


def section_tree(sections: DataFrame, depth: int | None = None) -> DataFrame:
    """Each section's parent: the nearest before it with a smaller level. depth: the largest level, found by a pass over sections if not given."""
    depth = depth or sections.agg(F.max("level")).first()[0] or 1
    w = Window.partitionBy("document_id").orderBy("start_page", "section_id").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.last(F.when(F.col("level") == k, F.struct("start_page", "section_id")), ignorenulls=True).over(w) for k in range(1, depth)]
    rows = sections.withColumns({f"_b{k}": b for k, b in enumerate(before, 1)})
    if depth < 2:
        return sections.withColumn("parent_id", F.lit(None).cast(dict(sections.dtypes)["section_id"]))
    nearest = F.greatest(*[F.when(F.col("level") > k, F.col(f"_b{k}")) for k in range(1, depth)]) if depth > 2 else F.when(F.col("level") > 1, F.col("_b1"))
    return rows.withColumn("parent_id", nearest["section_id"]).drop(*[f"_b{k}" for k in range(1, depth)])


def page_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages joined with every section that covers them, by bins of the sections' own widths."""
    spans = sections.select("document_id", "section_id", F.col("start_page").alias("_start"), F.col("end_page").alias("_end"))
    return points_in_spans(pages, spans, ["document_id"], "page_num", "_start", "_end").drop("_start", "_end")


def document_text(pages: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"]), "\n\n")
    return pages.groupBy("document_id").agg(joined.alias("text"))


# ---- entities ----

# Patterns of amounts, years, dates and names; case does not count in the first six.
_CURRENCY, _NUMBER = r"[₹Rs\.?\s]*", r"(\d+(?:,\d+)*(?:\.\d+)?)"
CRORE = rf"{_CURRENCY}{_NUMBER}\s*(?:crores?|cr\.?)"
LAKH = rf"{_CURRENCY}{_NUMBER}\s*(?:lakhs?|lacs?)"
PRICE_BAND = rf"{_CURRENCY}{_NUMBER}\s*(?:to|-)\s*{_CURRENCY}{_NUMBER}"
FISCAL_YEAR = r"\b(?:FY|F\.Y\.?|Fiscal Year)\s*(?:(?:20)?(\d{2})(?:-(?:20)?(\d{2}))?)|\b(?:20)?(\d{2})(?:-(?:20)?(\d{2}))\b"
PERCENTAGE = r"(\d+(?:\.\d+)?)\s*%"
COMPANY = r"\b[A-Za-z]{3,}\s+(?:limited|ltd\.?|pvt\.?|private|inc\.?|corporation|corp)(?:\b|$)"
DAY = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\b"
PERSON = r"\b(?i:mr|ms|mrs|dr|prof)\b\.?\s*[A-Za-z]{2,}(?:\s+[A-Za-z]{2,})?"
REGULATOR = r"\b(?:SEBI|RBI|NCLT|NCLAT|ROC|MCA)\b"


def plain_number(x: Column) -> Column:
    """A double as text, with one digit after the point at least."""
    return F.when(F.abs(x) < 1e7, x.cast("string")).otherwise(F.format_string("%.1f", x))


def entities(texts: DataFrame) -> DataFrame:
    """(id, entity_type, text, normalized, value, confidence) of texts (id, text): money in crores, in lakhs and as price bands,
    percentages, fiscal years, days, and, by their honorifics, suffixes or names, persons, companies and regulators."""
    t = F.col("text")
    each = lambda pattern, g, case=False: F.regexp_extract_all(t, F.lit(pattern if case else f"(?i){pattern}"), F.lit(g))
    # a text is searched once a pattern; a match's groups are found in the match
    of = lambda pattern, x, g: x if g == 0 else F.regexp_extract(x, f"(?i){pattern}", g)
    zipped = lambda pattern, *groups: F.transform(each(pattern, 0), lambda x: F.struct(*[of(pattern, x, g).alias(f"g{g}") for g in (0, *groups)]))
    number = lambda x: F.regexp_replace(x, ",", "").try_cast("double")

    def row(kind: str, raw: Column, norm: Column, val: Column, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("entity_type"), raw.alias("text"), norm.alias("normalized"), val.cast("double").alias("value"), F.lit(confidence).alias("confidence"))

    none = F.lit(None).cast("string")
    money = lambda pattern, unit, factor: F.transform(zipped(pattern, 1), lambda x: row("MONEY", x["g0"], F.concat(F.lit("₹"), plain_number(number(x["g1"])), F.lit(f" {unit}")), number(x["g1"]) * factor, 0.95))
    band = F.transform(zipped(PRICE_BAND, 1, 2), lambda x: row("MONEY", x["g0"], F.concat(F.lit("₹"), plain_number(number(x["g1"])), F.lit("-₹"), plain_number(number(x["g2"]))), (number(x["g1"]) + number(x["g2"])) / 2, 0.9))
    percent = F.transform(zipped(PERCENTAGE, 1), lambda x: row("PERCENTAGE", x["g0"], F.concat(plain_number(number(x["g1"])), F.lit("%")), number(x["g1"]), 0.95))
    second = lambda x: F.concat(x["g2"], x["g4"])
    years = F.transform(zipped(FISCAL_YEAR, 1, 2, 3, 4), lambda x: row("FISCAL_YEAR", x["g0"], F.concat(F.lit("FY"), x["g1"], x["g3"], F.when(second(x) != "", F.concat(F.lit("-"), second(x))).otherwise("")), none, 0.95))
    day = lambda x: F.try_to_date(F.concat_ws("/", x["g1"], x["g2"], x["g3"]), "d/M/yyyy").cast("string")
    dates = F.filter(F.transform(zipped(DAY, 1, 2, 3), lambda x: row("DATE", x["g0"], day(x), none, 0.9)), lambda x: x["normalized"].isNotNull())
    named = lambda kind, pattern, case: F.transform(each(pattern, 0, case), lambda x: row(kind, x, normal_name(x, F.lit(kind)), none, 1.0))
    parts = [money(CRORE, "Cr", 1e7), money(LAKH, "Lakh", 1e5), band, percent, years, dates, named("PERSON", PERSON, True), named("COMPANY", COMPANY, False), named("ORG", REGULATOR, True)]
    return texts.select("id", F.inline(F.concat(*parts)))


def title_case(x: Column) -> Column:
    """Each run of letters with a capital first and small letters after."""
    runs = F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def normal_name(name: Column, kind: Column) -> Column:
    own = stripped(name)
    suffix = r"(?i)\s+(Private\s+Limited|Pvt\.?\s*Ltd\.?|Private|Pvt\.?|Limited|Ltd\.?|Inc\.?|Corporation|Corp\.?)\s*$"
    company = title_case(stripped(F.regexp_replace(F.regexp_replace(own, suffix, ""), r"\s+", " ")))
    person = title_case(F.regexp_replace(own, r"(?i)^(Mr\.?|Ms\.?|Mrs\.?|Dr\.?|Prof\.?)\s+", ""))
    return F.when(kind == "COMPANY", company).when(kind == "PERSON", person).when(kind == "LOCATION", title_case(own)).otherwise(own)


def dedupe_entities(found: DataFrame) -> DataFrame:
    """found (ordinal, name, entity_type, page, confidence) by normal name and type: mentions, aliases, pages, and the confidence that
    running pairwise means in order give."""
    rows = found.withColumn("normalized", normal_name(F.col("name"), F.col("entity_type")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "confidence"))), lambda x: x["confidence"])
    running = F.aggregate(F.slice(ordered, 2, 1_000_000_000), F.element_at(ordered, 1), lambda a, x: (a + x) / 2)
    return rows.groupBy("normalized", "entity_type").agg(F.count(F.lit(1)).alias("mentions"), F.array_sort(F.collect_set("name")).alias("aliases"), F.array_sort(F.collect_set("page")).alias("pages"), running.alias("confidence"))


def alike(a: Column, b: Column) -> Column:
    """Names that are equal, contain one another, or share four fifths of the shorter one's words."""
    words = lambda x: F.array_distinct(F.split(F.lower(x), r"\s+"))
    shared = F.size(F.array_intersect(words(a), words(b))) / F.least(F.size(words(a)), F.size(words(b)))
    return (F.lower(a) == F.lower(b)) | F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)) | (shared >= 0.8)


def resolve_entities(merged: DataFrame, compat: bool = False) -> DataFrame:
    """Each entity's canonical one: of its type, the most mentioned that is alike, itself included; of equally mentioned ones the first by name. compat: only the canonical entity
    that is most mentioned of each type stays. Candidates meet by shared words and by what a name begins with, not by every pair."""
    own = merged.select("normalized", "entity_type", "mentions")
    if compat:
        w = Window.partitionBy("entity_type").orderBy(F.desc("mentions"), "normalized")
        return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("normalized", "entity_type", F.col("normalized").alias("canonical"))
    every = own.withColumns({"low": F.lower("normalized"), "words": F.array_distinct(F.split(F.lower("normalized"), r"\s+"))})
    # two names that share four fifths of the shorter one's words share one of its rarest: as many as may be missing, and one
    word = every.select("*", F.explode("words").alias("word"))
    counts = word.groupBy("entity_type", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("entity_type", "normalized").orderBy("n", "word"))
    rare = word.join(counts, ["entity_type", "word"]).withColumn("_r", rank).where(F.col("_r") <= F.size("words") - F.ceil(F.size("words") * 0.8) + 1)
    by_word = rare.select("entity_type", F.col("word").alias("key"), F.col("normalized").alias("a"))
    # a name within another begins at one of its places: they meet by the first HEAD characters of the shorter
    by_head = every.where("low <> ''").select("entity_type", F.concat(F.lit("\n"), F.substring("low", 1, HEAD)).alias("key"), F.col("normalized").alias("a"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("low")))
    windows = F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.concat(F.lit("\n"), F.substring(F.col("low"), i, n))))))
    probes = word.select("entity_type", F.col("word").alias("key"), F.col("normalized").alias("b"), "mentions").unionByName(every.where("low <> ''").select("entity_type", F.explode(windows).alias("key"), F.col("normalized").alias("b"), "mentions"))
    met = by_word.unionByName(by_head).join(probes.select("entity_type", "key", "b"), ["entity_type", "key"]).where(alike(F.col("a"), F.col("b")))
    pairs = met.select("entity_type", "a", "b").unionByName(met.select("entity_type", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own.select("entity_type", F.col("normalized").alias("a"), F.col("normalized").alias("b"))).distinct()
    known = own.select("entity_type", F.col("normalized").alias("b"), "mentions")
    best = pairs.join(known, ["entity_type", "b"]).groupBy(F.col("a").alias("normalized"), "entity_type").agg(F.min_by("b", F.struct(-F.col("mentions"), F.col("b"))).alias("canonical"))
    return best


HEAD = 8  # characters


# ---- chunks ----


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: stripped(x)), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(stripped(text), r"(?<=[.!?।])\s+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def linked(chunks: DataFrame, order: str, key: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy("document_id").orderBy(order)
    return chunks.withColumns({"preceding": F.lag(key).over(w), "following": F.lead(key).over(w)})


def chain(chunks: DataFrame, start: object, order: str = "turn", document: object | None = None) -> DataFrame:
    """Each document's chunks from one on, or one document's, in order: one ordered scan in place of a query for each link."""
    rows = chunks if document is None else chunks.where(F.col("document_id") == document)
    return rows.where(F.col(order) >= start).withColumn("position", F.row_number().over(Window.partitionBy("document_id").orderBy(order)))


# ---- citations ----


def citation_set(citations: DataFrame) -> DataFrame:
    """Of citations (claim_id, ordinal, section, page, snippet) the last of each claim; rows without a claim are skipped."""
    return citations.where("claim_id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("ordinal")))).where("_n = 1").drop("_n")


def distinct_citations(citations: DataFrame, by: str) -> DataFrame:
    """Each group's different citations, in order."""
    return citations.groupBy(by).agg(F.array_sort(F.collect_set("citation")).alias("citations"))


def uncited(claims: DataFrame, citations: DataFrame) -> DataFrame:
    return claims.join(citations.select("claim_id").distinct(), "claim_id", "left_anti")


def validated(claims: DataFrame, citations: DataFrame) -> DataFrame:
    have = citations.select("claim_id").distinct().withColumn("_h", F.lit(True))
    return claims.select("claim_id").join(have, "claim_id", "left").select("claim_id", F.col("_h").isNotNull().alias("cited"))


def numbered(rows: DataFrame, by: str, order: Sequence[str], n: str = "n") -> DataFrame:
    """rows with n, their number within their group in order, from 1. Rows are dealt by ranges of group and order, so that a group of any size
    is many tasks' work; each range's numbers follow those of the ranges before it. Equal rows are of one range."""
    ranges = rows.repartitionByRange(F.col(by), *[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "ranges")  # so that the ranges are those that were counted
    before = ranges.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(F.col(by).alias("_by"), F.col("_range").alias("_at"), F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range", by).orderBy(*order))
    met = ranges.withColumn("_own", own).join(F.broadcast(before), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_at")))
    return met.withColumn(n, (F.col("_before") + F.col("_own")).cast("int")).select(*rows.columns, n)


def footnotes(citations: DataFrame, by: str) -> DataFrame:
    """Numbered notes of each group, by section and page. Of snippets only what a note shows is moved."""
    short = citations.withColumn("snippet", F.substring("snippet", 1, 280))
    rows = numbered(citation_set(short), by, ["section", "page", "claim_id"])
    return rows.withColumn("note", F.concat(F.lit("[^"), F.col("n"), F.lit("]: ["), F.col("section"), F.lit(", p. "), F.col("page"), F.lit('] — "'), F.col("snippet"), F.lit('"')))


# ---- vectors ----


def unit_vector(v: Column) -> Column:
    d = v.cast("array<double>")
    n = F.sqrt(F.aggregate(F.transform(d, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)


# ---- lookups, maps and JSON ----


def section_boundaries(sections: DataFrame) -> DataFrame:
    """A map from title to (start_page, end_page) for each document; of equal titles the last counts."""
    last = sections.groupBy("document_id", "title").agg(F.max_by(F.struct("start_page", "end_page"), F.struct("start_page", "section_id")).alias("span"))
    return last.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("title", "span")))).alias("boundaries"))


def find_section(sections: DataFrame, title: str) -> DataFrame:
    """In each document the first section whose title is this one, contains it or is contained in it, whatever the case."""
    own, low = F.lower("title"), title.lower()
    like = (own == low) | F.contains(own, F.lit(low)) | F.contains(F.lit(low), own)
    return sections.where(like).withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("start_page", "section_id"))).where("_n = 1").drop("_n")


def by_type(found: DataFrame) -> DataFrame:
    """(entity_type, entities): each type's normal names in order."""
    return found.groupBy("entity_type").agg(F.array_sort(F.collect_set("normalized")).alias("entities"))


def exported(citations: DataFrame) -> DataFrame:
    """The citation set as one JSON document a row."""
    rows = citation_set(citations)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def imported(lines: DataFrame, schema: str = "claim_id string, ordinal long, section string, page int, snippet string") -> DataFrame:
    """Citations from JSON documents; those without a claim, or that are no JSON, are skipped."""
    return lines.select(F.from_json("json", schema).alias("c")).select("c.*").where("claim_id is not null")
