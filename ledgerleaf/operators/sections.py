"""Section headers in page text: scores, levels, names and kinds; and document names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.exprs import stripped
from ledgerleaf.operators.spans import points_in_spans

# Kinds of section and the patterns of their titles, in order; case does not count.
SECTION_PATTERNS = [
    ("summary", (r"^\s*SUMMARY\s+OF\s+(?:THE\s+)?(?:OFFER|PROSPECTUS)\s*$", r"^\s*SUMMARY\s+OF\s+BUSINESS\s*$", r"^\s*SUMMARY\s*$")),
    ("definitions", (r"^\s*DEFINITIONS\s+AND\s+ABBREVIATIONS?\s*$", r"^\s*CONVENTIONAL\s+AND\s+GENERAL\s+TERMS?\s*$", r"^\s*DEFINITIONS?\s*$")),
    ("risk_factors", (r"^\s*RISK\s+FACTORS?\s*$", r"^\s*RISKS?\s+RELATING\s+TO\s*")),
    ("introduction", (r"^\s*INTRODUCTION\s*$", r"^\s*GENERAL\s+INFORMATION\s*$")),
    ("the_issue", (r"^\s*THE\s+ISSUE\s*$", r"^\s*ISSUE\s+DETAILS?\s*$", r"^\s*TERMS\s+OF\s+THE\s+ISSUE\s*$")),
    ("capital_structure", (r"^\s*CAPITAL\s+STRUCTURE\s*$", r"^\s*SHARE\s+CAPITAL\s*$")),
    ("objects_of_issue", (r"^\s*OBJECTS?\s+OF\s+THE\s+(?:ISSUE|OFFER)\s*$", r"^\s*USE\s+OF\s+(?:ISSUE\s+)?PROCEEDS?\s*$")),
    ("basis_for_issue_price", (r"^\s*BASIS\s+FOR\s+(?:ISSUE\s+)?(?:PRICE|PRICING)\s*$", r"^\s*PRICE\s+JUSTIFICATION\s*$")),
    ("business", (r"^\s*(?:OUR\s+)?BUSINESS\s*$", r"^\s*(?:ABOUT\s+)?OUR\s+COMPANY\s*$", r"^\s*DESCRIPTION\s+OF\s+(?:OUR\s+)?BUSINESS\s*$", r"^\s*BUSINESS\s+OVERVIEW\s*$")),
    ("industry_overview", (r"^\s*INDUSTRY\s+(?:OVERVIEW|ANALYSIS)\s*$", r"^\s*MARKET\s+OVERVIEW\s*$", r"^\s*SECTOR\s+OVERVIEW\s*$")),
    ("management", (r"^\s*(?:OUR\s+)?MANAGEMENT\s*$", r"^\s*BOARD\s+OF\s+DIRECTORS?\s*$", r"^\s*KEY\s+MANAGERIAL?\s+PERSONNEL\s*$", r"^\s*(?:OUR\s+)?PROMOTERS?\s*$")),
    ("financial_information", (r"^\s*FINANCIAL\s+(?:INFORMATION|STATEMENTS?)\s*$", r"^\s*RESTATED\s+(?:CONSOLIDATED\s+)?FINANCIAL\s+(?:INFORMATION|STATEMENTS?)\s*$", r"^\s*AUDITOR(?:'?S)?\s+REPORT\s*$")),
    ("legal_information", (r"^\s*LEGAL\s+(?:AND\s+OTHER\s+)?INFORMATION\s*$", r"^\s*OUTSTANDING\s+LITIGATION\s*$", r"^\s*LEGAL\s+PROCEEDINGS?\s*$", r"^\s*MATERIAL\s+DEVELOPMENTS?\s*$")),
    ("regulatory_disclosures", (r"^\s*(?:OTHER\s+)?REGULATORY\s+(?:AND\s+STATUTORY\s+)?DISCLOSURES?\s*$", r"^\s*STATUTORY\s+(?:AND\s+OTHER\s+)?INFORMATION\s*$")),
    ("articles_of_association", (r"^\s*MAIN\s+PROVISIONS\s+OF\s+(?:THE\s+)?ARTICLES?\s*", r"^\s*ARTICLES?\s+OF\s+ASSOCIATION\s*$", r"^\s*MEMORANDUM\s+(?:AND|&)\s+ARTICLES?\s*")),
]

# Standard names of sections and the titles that they go by, in order.
STANDARD_NAMES = [
    ("Summary of the Issue", ("SUMMARY OF PROSPECTUS", "SUMMARY OF THE OFFER", "SUMMARY")),
    ("Definitions and Abbreviations", ("DEFINITIONS AND ABBREVIATIONS", "CONVENTIONAL AND GENERAL TERMS", "DEFINITIONS")),
    ("Risk Factors", ("RISK FACTORS", "RISKS")),
    ("Introduction", ("INTRODUCTION", "GENERAL INFORMATION")),
    ("The Issue", ("THE ISSUE", "ISSUE DETAILS", "TERMS OF THE ISSUE")),
    ("Capital Structure", ("CAPITAL STRUCTURE", "SHARE CAPITAL")),
    ("Objects of the Issue", ("OBJECTS OF THE ISSUE", "OBJECTS OF THE OFFER", "USE OF PROCEEDS")),
    ("Basis for Issue Price", ("BASIS FOR ISSUE PRICE", "BASIS FOR PRICING", "PRICE JUSTIFICATION")),
    ("Our Business", ("OUR BUSINESS", "ABOUT OUR COMPANY", "DESCRIPTION OF BUSINESS", "BUSINESS")),
    ("Industry Overview", ("INDUSTRY OVERVIEW", "INDUSTRY ANALYSIS", "MARKET OVERVIEW", "SECTOR OVERVIEW")),
    ("Our Management", ("OUR MANAGEMENT", "BOARD OF DIRECTORS", "KEY MANAGERIAL PERSONNEL", "MANAGEMENT")),
    ("Our Promoters", ("OUR PROMOTERS", "PROMOTERS", "OUR PROMOTER AND PROMOTER GROUP")),
    ("Financial Information", ("FINANCIAL INFORMATION", "FINANCIAL STATEMENTS", "RESTATED FINANCIAL INFORMATION", "AUDITOR'S REPORT")),
    ("Legal and Other Information", ("LEGAL AND OTHER INFORMATION", "OUTSTANDING LITIGATION", "LEGAL PROCEEDINGS", "MATERIAL DEVELOPMENTS")),
    ("Other Regulatory Disclosures", ("OTHER REGULATORY DISCLOSURES", "REGULATORY AND STATUTORY DISCLOSURES", "STATUTORY INFORMATION")),
    ("Main Provisions of Articles", ("MAIN PROVISIONS OF THE ARTICLES", "ARTICLES OF ASSOCIATION", "MEMORANDUM AND ARTICLES")),
]

BODY_SIZE = 10.0  # of a document whose font sizes are not known
LARGE, MAJOR = 1.15, 1.3  # a header's font size by the body's


def section_kind(title: Column) -> Column:
    """The first kind of which a pattern fits the title, else other."""
    out = F.when(F.lit(False), "")
    for kind, patterns in SECTION_PATTERNS:
        out = out.when(title.rlike("(?i)" + "|".join(patterns)), kind)
    return out.otherwise("other")


def standard_name(title: Column) -> Column:
    """The first standard name of which a title is in this one or the other way round; the title itself where there is none."""
    own = F.upper(stripped(title))
    out = F.when(F.lit(False), "")
    for name, known in STANDARD_NAMES:
        fits = F.lit(False)
        for k in known:
            fits = fits | F.contains(own, F.lit(k)) | F.contains(F.lit(k), own)
        out = out.when(fits, name)
    return out.otherwise(title)


def is_upper(line: Column) -> Column:
    return (F.upper(line) == line) & (F.lower(line) != line)


def is_title(line: Column) -> Column:
    """Whether every run of letters begins with a capital and goes on in small ones."""
    return line.rlike(r"^\P{L}*(?:\p{Lu}\p{Ll}*(?:\P{L}+|$))+$")


def is_numbered(line: Column) -> Column:
    return line.rlike(r"^\d+\.?\s+|^[IVXLCDM]+\.?\s+")


def header_score(line: Column, font_ratio: Column | None = None) -> Column:
    """Weights of what marks a header: a known title 3, capitals 2, a number 1, title case a half, and a large font 1.5 or 1."""
    add = lambda condition, weight: F.when(condition, weight).otherwise(0.0)
    score = add(section_kind(line) != "other", 3.0) + add(is_upper(line) & (F.length(line) < 80), 2.0) + add(is_numbered(line), 1.0) + add(is_title(line) & ~is_upper(line), 0.5)
    if font_ratio is not None:
        score = score + F.when(font_ratio >= MAJOR, 1.5).when(font_ratio >= LARGE, 1.0).otherwise(0.0)
    return F.when(F.length(line).between(3, 150), score).otherwise(0.0)


def header_level(line: Column, font_ratio: Column | None = None) -> Column:
    """By depth of the number that a line begins with, 3 at most; without one by font."""
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)", 1)
    plain = F.lit(3) if font_ratio is None else F.when(font_ratio >= MAJOR, 1).when(font_ratio >= LARGE, 2).otherwise(3)
    return F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(3))).otherwise(plain)


def headers(pages: DataFrame, least: float = 2.0) -> DataFrame:
    """(document_id, position, page_num, title, score, level, section_type, font_size) of lines that score enough, in order of page and
    score, each title of a page once. Where pages have font_sizes, the largest of a page counts against the document's body size."""
    columns = ["document_id", "page_num", "text"]
    if "font_sizes" in pages.columns:
        sizes = pages.select("document_id", "page_num", F.posexplode("font_sizes").alias("at", "size")).select("document_id", F.struct("page_num", "at").alias("ordinal"), "size")
        body = pages.select("document_id").distinct().join(baseline_font(sizes), "document_id", "left").select("document_id", F.coalesce("size", F.lit(BODY_SIZE)).alias("body"))
        pages = pages.join(body, "document_id").select(*columns, F.coalesce(F.array_max("font_sizes"), "body").alias("font_size"), "body")
    else:
        pages = pages.select(*columns, F.lit(BODY_SIZE).alias("font_size"), F.lit(BODY_SIZE).alias("body"))
    ratio = F.col("font_size") / F.col("body")
    lines = pages.select("document_id", "page_num", "font_size", "body", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("title", stripped(F.col("raw")))
    scored = lines.withColumn("score", header_score(F.col("title"), ratio)).where(F.col("score") >= least)
    first = Window.partitionBy("document_id", "page_num", F.regexp_replace(F.lower("title"), r"\s+", " ")).orderBy("line_no")
    once = scored.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("document_id").orderBy("page_num", F.desc("score"), "line_no")
    return once.select("document_id", F.row_number().over(order).alias("position"), "page_num", "title", "score", header_level(F.col("title"), ratio).alias("level"), section_kind(F.col("title")).alias("section_type"), "font_size")


def sections_of(headers: DataFrame, last_pages: DataFrame) -> DataFrame:
    """Sections (document_id, section_id, title, level, section_type, start_page, end_page) of headers in order: each ends on the page
    before the next one's, but not before it starts; the last with the document (document_id, total_pages)."""
    after = F.lead("page_num").over(Window.partitionBy("document_id").orderBy("position"))
    rows = headers.withColumn("_next", after).join(last_pages, "document_id")
    end = F.when(F.col("_next").isNull(), F.col("total_pages")).otherwise(F.greatest("page_num", F.col("_next") - 1))
    return rows.select("document_id", F.col("position").alias("section_id"), "title", "level", "section_type", F.col("page_num").alias("start_page"), end.alias("end_page"))


def section_content(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Of each section its pages' texts, words and whether any has tables. pages: (document_id, page_num, text, word_count, has_tables)."""
    spans = sections.select("document_id", "section_id", F.col("start_page").alias("_start"), F.col("end_page").alias("_end"))
    each = points_in_spans(pages, spans, ["document_id"], "page_num", "_start", "_end")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"]), "\n\n")
    return each.groupBy("document_id", "section_id").agg(joined.alias("content"), F.sum("word_count").cast("long").alias("word_count"), F.coalesce(F.bool_or("has_tables"), F.lit(False)).alias("has_tables"))


def deepest_first(page_sections: DataFrame) -> DataFrame:
    """Rows of pages and the sections that cover them (document_id, page_num, section_id, level) with each one's place: the deepest first."""
    w = Window.partitionBy("document_id", "page_num").orderBy(F.desc("level"), "section_id")
    return page_sections.withColumn("place", F.row_number().over(w))


def baseline_font(sizes: DataFrame) -> DataFrame:
    """The most frequent font size of each document, to a half; of equal ones that seen first. sizes is (document_id, ordinal, size)."""
    each = sizes.groupBy("document_id", (F.round(F.col("size") * 2) / 2).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    return each.groupBy("document_id").agg(F.min_by("size", F.struct(-F.col("n"), F.col("first"))).alias("size"))


def document_name(file_name: Column) -> Column:
    """A file's stem with only word characters, 100 at most; empty: document."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r'[<>:"/\\|?*\s-]', "_"), r"(?U)[^\w]", "_"), r"_+", "_")
    clean = F.substring(F.regexp_replace(clean, r"^_+|_+$", ""), 1, 100)
    return F.when(clean == "", "document").otherwise(clean)


# ---- promoters ----

# What in a section's title sends it to which extractors.
ROUTES = [
    ("profiles", ("our promoter", "promoter and promoter group", "promoters")), ("directorships", ("directorship",)), ("common_pursuits", ("common pursuit", "interest of promoter")),
    ("financial_interests", ("payment of benefit", "remuneration", "interest")), ("litigation", ("litigation", "legal proceeding")), ("shareholding", ("capital structure", "shareholding")),
]
# Degrees and designations, in order.
DEGREES = ("B.E.", "B.Tech", "M.E.", "M.Tech", "MBA", "CA", "CS", "PhD", "Bachelor", "Master")
DESIGNATIONS = ("Managing Director", "Chairman", "Director", "CEO", "CFO", "MD")

_FIELDS = {
    "din": (r"DIN\s*[:\-]?\s*(\d{8})", "string"), "age": (r"aged?\s*[:\-]?\s*(\d{2})", "int"), "experience_years": (r"(\d+)\+?\s*years?\s+of\s+experience", "int"),
    "qualification": (r"\b((?:" + "|".join(d.replace(".", r"\.") for d in DEGREES) + r")[^.]*)", "string"), "designation": (r"\b(" + "|".join(DESIGNATIONS) + r")\b", "string"),
}


def routed(sections: DataFrame) -> DataFrame:
    """sections with the extractors that each one's title calls for, in order; none: an empty list."""
    title = F.lower("title")
    return sections.withColumn("extractors", F.filter(F.array(*[F.when(title.rlike("|".join(words)), name) for name, words in ROUTES]), lambda x: x.isNotNull()))


def promoters(sections: DataFrame) -> DataFrame:
    """(id, name and _FIELDS) of each person that a section (id, text) names with an honorific, or on a line of its own. A field is the
    first after the name and before the next person's."""
    person = r"[A-Z][a-z]+(?:[ ]+[A-Z][a-z]+)"
    names = F.regexp_extract_all("text", F.lit(rf"(?:Mr|Ms|Mrs)\.?\s+({person}+)"), F.lit(1))
    alone = F.regexp_extract_all("text", F.lit(rf"\n({person}{{1,3}})(?=\n)"), F.lit(1))
    each = sections.select("id", F.posexplode(F.array_distinct(F.concat(names, alone))).alias("n", "name"), F.col("text"))
    after = F.expr("substring(text, instr(text, name) + length(name))")
    own = F.regexp_replace(after, rf"(?s)(?:(?:Mr|Ms|Mrs)\.?\s+[A-Z][a-z]+\s+[A-Z]|\n{person}{{1,3}}\n).*$", "")
    value = lambda p, t: F.nullif(F.trim(F.regexp_extract(own, f"(?i){p}", 1)), F.lit("")).cast(t)
    return each.select("id", "name", *[value(p, t).alias(k) for k, (p, t) in _FIELDS.items()])


def litigation_counts(promoters: DataFrame, cases: DataFrame) -> DataFrame:
    """promoters (name) with the cases (party, kind, amount) that name each: how many are criminal, civil or regulatory, and the sum of all
    amounts. Names match whatever the case."""
    kinds = [F.count_if(F.lower("kind") == k).alias(c) for k, c in (("criminal", "criminal_cases"), ("civil", "civil_cases"), ("regulatory", "regulatory_actions"))]
    sums = cases.groupBy(F.lower("party").alias("_p")).agg(*kinds, F.sum("amount").alias("amount"))
    joined = promoters.join(sums, F.lower("name") == F.col("_p"), "left")
    return joined.select(*promoters.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("criminal_cases", "civil_cases", "regulatory_actions")], F.coalesce("amount", F.lit(0.0)).alias("total_litigation_amount"))
