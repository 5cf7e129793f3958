"""Named queries of the document operators: sections, entities, tables, chunks of sections and the vector store's lookups. QUERIES and
SQL hold those of the registry and of structures too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import exprs
from ledgerleaf.operators import chunks, risk, sections, store, text, vectors
from ledgerleaf.plans import structures
from ledgerleaf.plans.registry import QUERIES, SQL, query, rounded
from ledgerleaf.sources import pages as scan
from ledgerleaf.sources.tables import table


__all__ = ["QUERIES", "SQL", "structures"]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(xs: list[str]) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def pick(xs: list[str], n: Column) -> Column:
    return F.array(*[F.lit(x) for x in xs])[n.cast("int")]


# ---- sections ----

LINES = [
    "RISK FACTORS", "Risk Factors", "RISKS RELATING TO OUR BUSINESS", "The management believes that this matters", "THE ISSUE", "Terms of the Issue", "1. OUR BUSINESS", "1.2.1 Overview of the Plant", "IV. OVERVIEW", "Objects of the Offer",
    "we run a business in many towns", "ARTICLES OF ASSOCIATION", "Memorandum and Articles of the Firm", "TOTAL ASSETS 2023", "12 Main Street", "Our Promoters", "AUDITOR'S REPORT", "Summary", "Other Regulatory Disclosures", "ok", "BASIS FOR PRICING", "Sector Overview",
]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document: one of LINES, twice for some, in fonts of which a third are large and a third larger."""
    d, n = table(spark, sf_dir, "documents").select("doc_id"), len(LINES)
    line = pick(LINES, F.col("doc_id") % n)
    fonts = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(10.0), F.lit(10.1))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(10.0), F.lit(11.6))).otherwise(F.array(F.lit(13.2), F.lit(9.9)))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(line, F.lit("\nplain words\n  "), F.lower(line), F.lit(" "))).otherwise(line)
    return d.select((F.col("doc_id") % 7).alias("document_id"), F.col("doc_id").alias("page_num"), body.alias("text"), fonts.alias("font_sizes"))


_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, {quoted('(?i)' + '|'.join(p))}) THEN {quoted(k)}" for k, p in sections.SECTION_PATTERNS) + " ELSE 'other' END"
_TITLE_SQL = r"regexp_matches(line, '^\PL*(?:\p{Lu}\p{Ll}*(?:\PL+|$))+$')"
_UPPER_SQL = "(upper(line) = line AND lower(line) <> line)"


@query("section_headers", rf"""
WITH p AS (SELECT doc_id % 7 AS document_id, doc_id AS page_num, {sql_list(LINES)}[doc_id % {len(LINES)} + 1] AS x, CASE doc_id % 3 WHEN 0 THEN 1.01 WHEN 1 THEN 1.16 ELSE 1.32 END AS ratio, CASE doc_id % 3 WHEN 0 THEN 10.1 WHEN 1 THEN 11.6 ELSE 13.2 END AS font_size FROM documents),
l AS (SELECT *, unnest(CASE WHEN page_num % 5 = 0 AND lower(x) = x THEN [x, 'plain words'] WHEN page_num % 5 = 0 THEN [x, 'plain words', lower(x)] ELSE [x] END) AS line FROM p),
o AS (SELECT * FROM l WHERE NOT (page_num % 5 = 0 AND line = lower(x) AND line <> x)),
s AS (SELECT *, {_KIND_SQL} AS section_type FROM o),
t AS (SELECT *, CASE WHEN section_type <> 'other' THEN 3.0 ELSE 0 END + CASE WHEN {_UPPER_SQL} THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(line, '^\d+\.?\s+|^[IVXLCDM]+\.?\s+') THEN 1.0 ELSE 0 END
  + CASE WHEN {_TITLE_SQL} AND NOT {_UPPER_SQL} THEN 0.5 ELSE 0 END + CASE WHEN ratio >= 1.3 THEN 1.5 WHEN ratio >= 1.15 THEN 1.0 ELSE 0 END AS score FROM s WHERE length(line) BETWEEN 3 AND 150)
SELECT document_id, cast(row_number() OVER (PARTITION BY document_id ORDER BY page_num, score DESC) AS int) AS position, page_num, line AS title, cast(score AS double) AS score,
  cast(CASE WHEN regexp_matches(line, '^\d') THEN least(len(string_split(regexp_extract(line, '^(\d+(?:\.\d+)*)', 1), '.')), 3) WHEN ratio >= 1.3 THEN 1 WHEN ratio >= 1.15 THEN 2 ELSE 3 END AS int) AS level, section_type, cast(font_size AS double) AS font_size
FROM t WHERE score >= 2""")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.headers(_lines(spark, sf_dir))


@query("section_name", f"""
SELECT doc_id, CASE {" ".join("WHEN " + " OR ".join(f"contains(upper(trim(line)), {quoted(k)}) OR contains({quoted(k)}, upper(trim(line)))" for k in known) + f" THEN {quoted(name)}" for name, known in sections.STANDARD_NAMES)} ELSE line END AS name
FROM (SELECT doc_id, {sql_list(LINES)}[doc_id % {len(LINES)} + 1] AS line FROM documents)""")
def section_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sections.standard_name(pick(LINES, F.col("doc_id") % len(LINES))).alias("name"))


@query("baseline_font", """
WITH s AS (SELECT l_orderkey % 20 AS document_id, l_orderkey * 10 + l_linenumber AS ordinal, round(l_quantity / 4 * 2) / 2 AS size FROM lineitem)
SELECT document_id, size FROM (SELECT document_id, size, count(*) AS n, min(ordinal) AS f FROM s GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f) = 1""")
def baseline_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return sections.baseline_font(l.select((F.col("l_orderkey") % 20).alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), (F.col("l_quantity") / 4).cast("double").alias("size")))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of ten pages within documents of a hundred: every third has a parent, the one before."""
    p, k = table(spark, sf_dir, "pages").select("page_id"), F.floor(F.col("page_id") % 100 / 10)
    s = p.where("page_id % 10 = 0").select(F.floor(F.col("page_id") / 100).alias("document_id"), F.col("page_id").alias("section_id"), k.alias("k"))
    return s.select("document_id", "section_id", F.when(F.col("k") % 3 == 1, F.col("section_id") - 10).alias("parent_id"), F.when(F.col("k") % 3 == 1, 2).otherwise(1).alias("level"), pick(["Risk Factors", "Our Business", "Legal"], F.col("k") % 3).alias("title"), (F.col("k") * 10).alias("start_page"), (F.col("k") * 10 + 9).alias("end_page"))


_SPANS = "(SELECT page_id // 100 AS document_id, page_id AS section_id, page_id % 100 // 10 AS k, page_id % 100 // 10 * 10 AS start_page, page_id % 100 // 10 * 10 + 9 AS end_page, CASE WHEN page_id % 100 // 10 % 3 = 1 THEN 2 ELSE 1 END AS level, CASE WHEN page_id % 100 // 10 % 3 = 1 THEN page_id - 10 END AS parent_id FROM pages WHERE page_id % 10 = 0)"
_PAGES = "(SELECT page_id // 100 AS document_id, page_id % 100 AS page_num, concat('page ', page_id % 100) AS text, page_id % 4 AS words, page_id % 7 = 0 AS has_tables FROM pages)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 100
    return table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 100).alias("document_id"), n.alias("page_num"), F.concat(F.lit("page "), n).alias("text"), (F.col("page_id") % 4).alias("word_count"), (F.col("page_id") % 7 == 0).alias("has_tables"))


@query("section_content", f"""SELECT s.section_id, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS content, cast(sum(words) AS bigint) AS word_count, bool_or(has_tables) AS has_tables FROM {_SPANS} s JOIN {_PAGES} p ON p.document_id = s.document_id AND page_num BETWEEN start_page AND end_page GROUP BY s.section_id""")
def section_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section_content(_spans(spark, sf_dir), _pages(spark, sf_dir)).select("section_id", "content", "word_count", "has_tables")


@query("table_section_join", f"SELECT table_id, section_id FROM (SELECT page_id AS table_id, page_id // 100 AS document_id, page_id % 100 AS page_num FROM pages WHERE page_id % 5 = 0) t JOIN {_SPANS} s ON s.document_id = t.document_id AND page_num BETWEEN start_page AND end_page")
def table_section_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").where("page_id % 5 = 0").select(F.col("page_id").alias("table_id"), F.floor(F.col("page_id") / 100).alias("document_id"), (F.col("page_id") % 100).alias("page_num"))
    return chunks.table_sections(t, _spans(spark, sf_dir)).select("table_id", "section_id")


@query("section_chunks", f"""
WITH s AS (SELECT *, coalesce(parent_id, section_id) AS root FROM {_SPANS} x), t AS (
SELECT document_id, root, section_id, 1 AS o, page_num AS p, concat('| A |', chr(10), '| --- |', chr(10), '| ', table_id, ' |') AS text, 'table' AS chunk_type, s.start_page, s.end_page FROM (SELECT page_id AS table_id, page_id // 100 AS d, page_id % 100 AS page_num FROM pages WHERE page_id % 5 = 0) JOIN s ON d = document_id AND page_num BETWEEN start_page AND end_page
UNION ALL SELECT document_id, root, section_id, 2, 0, (SELECT string_agg(text, chr(10) || chr(10) ORDER BY page_num) FROM {_PAGES} p WHERE p.document_id = s.document_id AND page_num BETWEEN start_page AND end_page), 'narrative', start_page, end_page FROM s)
SELECT document_id, section_id, cast(row_number() OVER (PARTITION BY document_id ORDER BY root, section_id, o, p) AS int) AS seq, chunk_type, text, length(text) // 4 AS token_count, start_page AS page_start, end_page AS page_end FROM t""")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    content = sections.section_content(s, _pages(spark, sf_dir)).select("document_id", "section_id", "content")
    t = table(spark, sf_dir, "pages").where("page_id % 5 = 0").select(
        F.floor(F.col("page_id") / 100).alias("document_id"), F.col("page_id").alias("table_id"), (F.col("page_id") % 100).alias("page_num"), F.array(F.lit("A")).alias("headers"), F.array(F.array(F.col("page_id").cast("string"))).alias("rows"), F.lit("other").alias("table_type"),
    )
    out = chunks.chunk_sections(s.join(content, ["document_id", "section_id"]).withColumn("section_type", F.lit("other")), t)
    return out.select("document_id", "section_id", "seq", "chunk_type", "text", "token_count", "page_start", "page_end")


@query("sections_of_page", f"SELECT p.document_id, page_num, section_id, cast(row_number() OVER (PARTITION BY p.document_id, page_num ORDER BY level DESC, section_id) AS int) AS place FROM {_PAGES} p JOIN {_SPANS} s ON s.document_id = p.document_id AND page_num BETWEEN start_page AND end_page")
def sections_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = text.page_sections(_pages(spark, sf_dir), _spans(spark, sf_dir).select("document_id", "section_id", "start_page", "end_page"))
    levels = _spans(spark, sf_dir).select("document_id", "section_id", "level")
    return sections.deepest_first(met.join(levels, ["document_id", "section_id"])).select("document_id", "page_num", "section_id", "place")


@query("top_level_sections", f"SELECT document_id, section_id, cast(row_number() OVER (PARTITION BY document_id ORDER BY start_page, section_id) AS int) AS place FROM {_SPANS} s WHERE level = 1")
def top_level_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_level(_spans(spark, sf_dir)).select("document_id", "section_id", "place")


# ---- entities ----

SENTENCES = [
    "The issue is of Rs. 1,250.50 crores and 100 Cr for growth.", "A loan of 5 lacs and ₹ 20 Lakhs at 9.5 % a year.", "Price band of Rs. 100 to Rs. 120 in FY 2023-24.", "Audited for FY23 and 22-23; signed on 12/03/2024.",
    "Mr. Ravi Kumar of Acme Limited met SEBI and RBI.", "Growth was 12.5% in Fiscal Year 2022, and 31.02.2023 is no day.", "Nothing of the kind is here.", "Beta Steel Pvt. Ltd. owes Dr Asha 3 crore",
]


def _matches_sql(kind: str, pattern: str, groups: int, norm: str, value: str, confidence: float, where: str = "true", case: bool = False) -> str:
    p = quoted(pattern if case else "(?i)" + pattern)
    lists = ", ".join(f"unnest(regexp_extract_all(text, {p}, {g})) AS g{g}" for g in range(groups + 1))
    return f"SELECT id, {quoted(kind)} AS entity_type, g0 AS text, {norm} AS normalized, cast({value} AS double) AS value, cast({confidence} AS double) AS confidence FROM (SELECT id, {lists} FROM t) WHERE {where}"


_NUM = lambda g: f"cast(replace(g{g}, ',', '') AS double)"
_MONEY = lambda unit, factor: (f"concat('₹', {_NUM(1)}, ' {unit}')", f"{_NUM(1)} * {factor}")
_DAY = "try_strptime(concat(g1, '/', g2, '/', g3), '%d/%m/%Y')"


@query("entity_regex", f"WITH t AS (SELECT doc_id AS id, {sql_list(SENTENCES)}[doc_id % {len(SENTENCES)} + 1] AS text FROM documents) " + " UNION ALL ".join([
    _matches_sql("MONEY", text.CRORE, 1, *_MONEY("Cr", "1e7"), 0.95), _matches_sql("MONEY", text.LAKH, 1, *_MONEY("Lakh", "1e5"), 0.95), _matches_sql("MONEY", text.PRICE_BAND, 2, f"concat('₹', {_NUM(1)}, '-₹', {_NUM(2)})", f"({_NUM(1)} + {_NUM(2)}) / 2", 0.9),
    _matches_sql("PERCENTAGE", text.PERCENTAGE, 1, f"concat({_NUM(1)}, '%')", _NUM(1), 0.95), _matches_sql("FISCAL_YEAR", text.FISCAL_YEAR, 4, "concat('FY', g1, g3, CASE WHEN concat(g2, g4) <> '' THEN concat('-', g2, g4) ELSE '' END)", "NULL", 0.95),
    _matches_sql("DATE", text.DAY, 3, f"strftime({_DAY}, '%Y-%m-%d')", "NULL", 0.9, f"{_DAY} IS NOT NULL"), _matches_sql("ORG", text.REGULATOR, 0, "g0", "NULL", 1.0, case=True),
]))
def entity_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over sentences of every form; persons and companies, whose names are normalised, are left to a unit test."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), pick(SENTENCES, F.col("doc_id") % len(SENTENCES)).alias("text"))
    return text.entities(d).where(~F.col("entity_type").isin("PERSON", "COMPANY"))


@query("entity_documents")
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.entities(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("entity_dedupe", """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS g, concat('firm ', s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN ' Limited' WHEN 1 THEN ' Pvt. Ltd.' ELSE '' END) AS name, cast(0.5 + (s_suppkey % 4) / 10.0 AS double) AS c FROM supplier),
l AS (SELECT g, list(c ORDER BY k) AS cs, list_sort(list(DISTINCT name)) AS aliases, list_sort(list(DISTINCT k % 5)) AS pages, count(*) AS mentions FROM s GROUP BY g)
SELECT concat('Firm ', g) AS normalized, mentions, array_to_string(aliases, '; ') AS aliases, array_to_string(pages, ' ') AS pages, round(list_reduce(cs, lambda a, x: (a + x) / 2), 6) AS confidence FROM l""")
def entity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.concat(F.lit("firm "), "s_nationkey", F.when(k % 3 == 0, " Limited").when(k % 3 == 1, " Pvt. Ltd.").otherwise(""))
    found = text.dedupe_entities(s.select(k.alias("ordinal"), name.alias("name"), F.lit("COMPANY").alias("entity_type"), (k % 5).alias("page"), (0.5 + (k % 4) / 10).alias("confidence")))
    return found.select("normalized", "mentions", F.array_join("aliases", "; ").alias("aliases"), F.array_join(F.transform("pages", lambda x: x.cast("string")), " ").alias("pages"), F.round("confidence", 6).alias("confidence"))


_NAMES = "(SELECT concat(['Steel', 'Steelworks', 'Steel Holdings', 'North Steel Holdings'][s_suppkey % 4 + 1], ' ', s_nationkey) AS n, count(*) AS m FROM supplier GROUP BY 1)"
_WORDS = lambda x: f"list_distinct(string_split(lower({x}), ' '))"


@query("entity_resolve", f"""
SELECT a.n AS normalized, arg_min(b.n, (0 - b.m, b.n)) AS canonical FROM {_NAMES} a JOIN {_NAMES} b ON contains(lower(a.n), lower(b.n)) OR contains(lower(b.n), lower(a.n)) OR len(list_intersect({_WORDS('a.n')}, {_WORDS('b.n')})) >= 0.8 * least(len({_WORDS('a.n')}), len({_WORDS('b.n')})) GROUP BY a.n""")
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.concat(pick(["Steel", "Steelworks", "Steel Holdings", "North Steel Holdings"], F.col("s_suppkey") % 4), F.lit(" "), "s_nationkey")
    merged = s.groupBy(name.alias("normalized")).agg(F.count(F.lit(1)).alias("mentions")).withColumn("entity_type", F.lit("COMPANY"))
    return text.resolve_entities(merged).select("normalized", "canonical")


@query("entities_by_type", "SELECT c_mktsegment AS entity_type, array_to_string(list_sort(list(DISTINCT concat('Firm ', c_nationkey))), ', ') AS entities FROM customer GROUP BY c_mktsegment")
def entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("entity_type"), F.concat(F.lit("Firm "), "c_nationkey").alias("normalized"))
    return text.by_type(c).select("entity_type", F.array_join("entities", ", ").alias("entities"))


# ---- tables ----

HEADERS = [
    "Revenue from operations", "Total assets and current assets", "Cash flow from operating activities", "Category of shareholders", "Use of proceeds", "Related party transactions with", "ROE and ROCE", "Listed peers", "Secured borrowings", "Pending cases", "Contingent guarantees",
    "Profit and equity", "Nothing at all", "loan litigation",
]


def _hits(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"cast(contains(x, {quoted(w)}) AS int)" for w in words) + ")"


@query("table_classify", f"""
WITH t AS (SELECT p_partkey AS table_id, lower(concat({sql_list(HEADERS)}[p_partkey % {len(HEADERS)} + 1], ' ', 'x', ' y')) AS x FROM part),
h AS (SELECT table_id, unnest([{", ".join(f"{{'h': {_hits(w)}, 'r': {-i}, 'k': {quoted(k)}, 'n': {len(w)}}}" for i, (k, w) in enumerate(text.TABLE_WORDS))}]) AS e FROM t),
b AS (SELECT table_id, max((e.h, e.r, e.k, e.n)) AS m FROM h GROUP BY table_id)
SELECT table_id, CASE WHEN m[1] > 0 THEN m[3] ELSE 'other' END AS table_type, round(CASE WHEN m[1] > 0 THEN least(1.0, m[1] / (m[4] * 0.3)) ELSE 0 END, 6) AS confidence FROM b""")
def table_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.array(pick(HEADERS, F.col("p_partkey") % len(HEADERS))).alias("headers"), F.array(F.array(F.lit("x"), F.lit("y"))).alias("rows"))
    return text.classify_tables(t).withColumn("confidence", F.round("confidence", 6))


@query("table_extract", """
SELECT p_partkey AS table_id, concat('Name,', p_size) AS headers, concat(p_size, ',', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'x' END) AS first_row FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""")
def table_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables, a fifth of them of one row, a seventh without data."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    head, blank = F.array(F.lit(" Name "), size), F.array(F.lit(" "), F.lit(None).cast("string"))
    row = F.array(F.concat(F.lit(" "), size), F.when(k % 3 != 0, "x"))
    cells = F.when(k % 5 == 0, F.array(head)).when(k % 7 == 0, F.array(head, blank)).otherwise(F.array(head, row))
    out = text.extracted(table(spark, sf_dir, "part").select(k.alias("table_id"), cells.alias("cells")))
    return out.select("table_id", F.array_join("headers", ",").alias("headers"), F.array_join(F.col("rows")[0], ",").alias("first_row"))


@query("tables_by_type", "SELECT p_partkey AS table_id, p_size / 50.0 AS confidence FROM part WHERE p_partkey % 3 = 1 AND p_size / 50.0 >= 0.3")
def tables_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), pick(["income_statement", "balance_sheet", "cash_flow"], F.col("p_partkey") % 3).alias("table_type"), (F.col("p_size") / 50.0).alias("confidence"))
    return text.of_type(t, "balance_sheet").select("table_id", "confidence")


@query("statement_router", "SELECT p_partkey AS table_id, ['income', 'income', 'balance', 'cash_flow', NULL][p_partkey % 5 + 1] AS statement, p_size * [1e7, 1e5, 1.0][p_partkey % 3 + 1] AS rupees FROM part")
def statement_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = pick(["Income Statement", "P&L account", "Statement of financial position", "Cash Flow", "Peers"], k % 5)
    return table(spark, sf_dir, "part").select(k.alias("table_id"), text.statement_kind(kind).alias("statement"), text.to_rupees(F.col("p_size").cast("double"), pick(["crore", "lakh", "actual"], k % 3)).alias("rupees"))


@query("table_csv", 'SELECT p_partkey AS table_id, concat(\'Name,"a, b"\', chr(10), p_size, \',"say ""x"""\') AS csv FROM part')
def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), text.csv_text(F.array(F.lit("Name"), F.lit("a, b")), F.array(F.array(F.col("p_size").cast("string"), F.lit('say "x"')))).alias("csv"))


@query("tables_summary", "SELECT p_brand AS table_type, count(*) AS n_tables, count(DISTINCT p_size) AS n_pages, cast(count(*) * 2 AS bigint) AS n_rows, round(avg(p_size / 50.0), 4) AS confidence FROM part GROUP BY p_brand")
def tables_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(F.array(F.lit("a")), F.array(F.lit("b")))
    return rounded(text.tables_summary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_type"), (F.col("p_size") / 50.0).alias("confidence"), F.col("p_size").alias("page_num"), rows.alias("rows"))))


# ---- the vector store ----

_POINT = "cast(('0x' || substr(sha256(cast(doc_id AS varchar)), 1, 15)) AS bigint)"


@query("vectors_by_section", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {_POINT}, doc_id) AS n FROM documents)
SELECT doc_id, source AS section, 1.0::DOUBLE AS score, cast(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id % 9, doc_id % 9 + 1, cast(doc_id AS varchar)) AS int) AS place FROM k WHERE n <= 5""")
def vectors_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document (a language here) and section (a source), five chunks at most: those with the lowest point ids, by page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("document_id"), F.col("source").alias("section"), F.col("doc_id").cast("string").alias("chunk_id"), (F.col("doc_id") % 9).alias("page_start"), (F.col("doc_id") % 9 + 1).alias("page_end"))
    return vectors.each_section(d, 5).select("doc_id", "section", "score", "place")


@query("hits_formatted", """SELECT doc_id, round(doc_id / 7.0, 4) AS score, CASE WHEN length(text) > 50 THEN concat(substr(text, 1, 50), '...') ELSE text END AS text, concat('[', source, ', Pages ', doc_id % 9, '-', doc_id % 9 + 2, ']') AS citation FROM documents""")
def hits_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") / 7.0).alias("score"), "text", F.col("source").alias("section"), (F.col("doc_id") % 9).alias("page_start"), (F.col("doc_id") % 9 + 2).alias("page_end"))
    return vectors.formatted(d, 50).select("doc_id", "score", "text", "citation")


@query("cosine_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    double = lambda c: F.col(c).cast("array<double>")
    return rounded(e.join(after, "vec_id").select("vec_id", exprs.cosine(double("embedding"), double("next")).alias("cosine")))


@query("unit_vectors", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS first, 1.0::DOUBLE AS norm FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", text.unit_vector(F.col("embedding")).alias("v"))
    return rounded(e.select("vec_id", F.col("v")[0].alias("first"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))


# ---- repository rows ----


@query("failed_agents", "SELECT user_id AS document_id, event_type AS agent_name, cast(event_id AS varchar) AS error_message FROM events WHERE event_type = 'error'")
def failed_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return store.failed_agents(e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("agent_name"), F.col("event_id").cast("string").alias("error_message"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status")))


@query("not_boilerplate", "SELECT doc_id FROM labels WHERE toxic = 0")
def not_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.flagged(table(spark, sf_dir, "labels"), "toxic").select("doc_id")


@query("cascade_delete", """SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'lines', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'parents', count(*) FROM customer WHERE c_custkey % 10 <> 0""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    o = o.withColumnRenamed("o_custkey", "c_custkey")
    lines = l.join(o.select("c_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    left = store.deleted_with_children(c.where("c_custkey % 10 = 0"), "c_custkey", c, orders=o, lines=lines)
    out = None
    for name, rows in left.items():
        n = rows.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


# ---- pages, citations and narratives ----


@query("page_fonts", """SELECT l_orderkey % 50 AS document_id, l_linenumber AS page_num, array_to_string(list_sort(list(DISTINCT l_returnflag)), ' ') AS fonts, array_to_string(list_reverse_sort(list(DISTINCT round(l_quantity / 8, 1)) FILTER (l_quantity > 0)), ' ') AS font_sizes FROM lineitem GROUP BY ALL""")
def page_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("document_id"), F.col("l_linenumber").alias("page_num"), F.col("l_returnflag").alias("font"), (F.col("l_quantity") / 8).cast("double").alias("size"))  # noqa: E741
    return scan.page_fonts(l).select("document_id", "page_num", F.array_join("fonts", " ").alias("fonts"), F.array_join(F.transform("font_sizes", lambda x: x.cast("string")), " ").alias("font_sizes"))


@query("page_counts", "SELECT page_id % 10 AS document_id, count(*) AS page_count FROM pages GROUP BY 1")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.page_counts(table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("document_id")))


@query("table_sources", "SELECT p_partkey AS table_id, p_size AS page_num FROM part WHERE p_partkey % 3 = 0 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 3 = 0 AND q.p_size = part.p_size AND q.p_brand = part.p_brand)")
def table_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.col("p_brand").alias("document_id"), F.col("p_size").alias("page_num"))
    return text.table_sources(p.where("table_id % 3 = 0"), p.where("table_id % 3 <> 0")).select("table_id", "page_num")


@query("distinct_citations", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ' ') AS citations FROM documents GROUP BY lang")
def distinct_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.distinct_citations(table(spark, sf_dir, "documents").withColumnRenamed("source", "citation"), "lang").select("lang", F.array_join("citations", " ").alias("citations"))


COVENANT_TEXTS = ["The Company shall keep DSCR at least 1.25 times. Its current ratio must be >= 1.33.", "Total debt/EBITDA shall not exceed 3.5 at any time.", "No ratio is set here. Interest coverage is good.", "Tangible net worth of at least 500 crore and debt-equity <= 2."]


@query("covenants_in_text", """
WITH t AS (SELECT s_suppkey AS id, s_suppkey % 4 AS k FROM supplier), f(k, covenant_type, threshold) AS (VALUES (0, 'DSCR', 'at least 1.25'), (0, 'CURRENT_RATIO', 'at least 1.25'), (0, 'CURRENT_RATIO', '>= 1.33.'), (3, 'CURRENT_RATIO', '<= 2.'), (1, 'TOTAL_DEBT_EBITDA', 'not exceed 3.5'), (3, 'TANGIBLE_NET_WORTH', 'at least 500'), (3, 'DEBT_EQUITY', '<= 2.'))
SELECT id, covenant_type, threshold FROM t JOIN f USING (k)""")
def covenants_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the patterns have it, the CR of DSCR and of crore is taken for a current ratio too."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), pick(COVENANT_TEXTS, F.col("s_suppkey") % 4).alias("text"))
    return risk.covenants_in_text(rows).select("id", "covenant_type", "threshold")
