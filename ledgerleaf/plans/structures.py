"""Named queries of the operators over indexes, links, spans and layouts, beside those of the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.operators import assessments, coreference, links, mentions, page_tables, risk, spans, text, variants, working_capital
from ledgerleaf.operators.block_index import BlockIndex
from ledgerleaf.operators.layout import DocumentStore, page_after
from ledgerleaf.plans.registry import _CF, _COS, _TOP, DEBT, LIT, SQL, _rules_sql, _topk_sql, _vectors, cash_years, query, rounded
from ledgerleaf.sources.scratch import new_path
from ledgerleaf.sources.tables import table, view

# ---- search through an index of blocks ----

_DOT, _FAR = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", "(0 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]))"


def _index(spark: SparkSession, sf_dir: str) -> tuple[BlockIndex, DataFrame]:
    """Labels stand for sections and every fiftieth vector starts a page."""
    e, q = _vectors(spark, sf_dir)
    rows = e.select("vec_id", "vector", F.col("label").alias("section"), (F.col("vec_id") % 50).alias("page_start"))
    return BlockIndex.build(rows, payload=["section", "page_start"]), q


def _hits(found: DataFrame) -> DataFrame:
    return rounded(found.withColumnRenamed("key", "vec_id"))


@query("index_topk", _topk_sql())
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir)
    return _hits(index.search(q))


@query("index_topk_dot", _topk_sql(k=7, score=_DOT))
def index_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir)
    return _hits(index.search(q, k=7, metric="dot"))


@query("index_topk_euclid", _topk_sql(k=6, score=_FAR))
def index_topk_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir)
    return _hits(index.search(q, k=6, metric="euclid"))


@query("index_threshold", f"SELECT query_id, vec_id, score FROM ({_topk_sql(f'{_COS} >= 0.25', None)})")
def index_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir)
    return _hits(index.search(q, k=None, threshold=0.25))


@query("search_by_section", _topk_sql("e.label = 3", 5))
def search_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir)
    return _hits(index.search(q, k=5, filters={"section": 3}))


@query("search_by_page_range", _topk_sql("e.vec_id % 50 BETWEEN 10 AND 24", 5))
def search_by_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir)
    return _hits(index.search(q, k=5, filters={"page_start": [10, 24]}))


@query("search_filtered_threshold", _topk_sql(f"e.label IN (1, 2, 4) AND e.vec_id % 50 = 7 AND {_COS} >= 0.1", 3))
def search_filtered_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir)
    return _hits(index.search(q, k=3, filters={"section": [1, 2, 4], "page_start": 7, "none": None}, threshold=0.1))


# ---- chains and trees ----

# every third conversation refers to a missing turn now and then; in every seventh the first turn refers to the last
_TURNS = """(SELECT conv_id, turn, conv_id * 1000 + turn AS chunk_id,
  CASE WHEN conv_id % 3 = 0 AND turn % 4 = 2 THEN conv_id * 1000 + 900 WHEN turn > lo THEN conv_id * 1000 + turn - 1 WHEN conv_id % 7 = 0 THEN conv_id * 1000 + hi END AS preceding
  FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) OVER (PARTITION BY conv_id) AS hi FROM (SELECT DISTINCT conv_id, turn FROM conversations)))"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = Window.partitionBy("conv_id")
    t, conv = F.col("turn"), F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumns({"lo": F.min("turn").over(of), "hi": F.max("turn").over(of)})
    before = F.when((conv % 3 == 0) & (t % 4 == 2), conv * 1000 + 900).when(t > F.col("lo"), conv * 1000 + t - 1).when(conv % 7 == 0, conv * 1000 + F.col("hi"))
    return rows.select("conv_id", "turn", (conv * 1000 + t).alias("chunk_id"), before.alias("preceding"))


@query("chunk_chains", f"""
WITH RECURSIVE t AS (SELECT x.*, EXISTS (SELECT 1 FROM {_TURNS} y WHERE y.chunk_id = x.preceding) AS linked FROM {_TURNS} x),
r AS (SELECT chunk_id, chunk_id AS head, 0 AS place FROM t WHERE NOT linked UNION ALL SELECT t.chunk_id, r.head, r.place + 1 FROM r JOIN t ON t.preceding = r.chunk_id),
c AS (SELECT conv_id, min(chunk_id) AS head FROM t WHERE chunk_id NOT IN (SELECT chunk_id FROM r) GROUP BY conv_id)
SELECT t.chunk_id, coalesce(r.head, c.head) AS head, cast(r.place AS bigint) AS place, r.chunk_id IS NULL AS cyclic, preceding IS NOT NULL AND NOT linked AS broken FROM t LEFT JOIN r ON r.chunk_id = t.chunk_id LEFT JOIN c ON c.conv_id = t.conv_id AND r.chunk_id IS NULL""")
def chunk_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = links.walked(_turns(spark, sf_dir), "chunk_id", "preceding")
    return out.select(F.col("id").alias("chunk_id"), F.col("end").alias("head"), F.col("steps").alias("place"), "cyclic", "broken")


@query("chain_ends", f"""
WITH RECURSIVE t AS (SELECT chunk_id, CASE WHEN turn > lo THEN chunk_id - 1 END AS p, CASE WHEN turn < hi THEN chunk_id + 1 END AS f, lo, hi, turn, conv_id FROM (SELECT DISTINCT conv_id, turn, conv_id * 1000 + turn AS chunk_id, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) OVER (PARTITION BY conv_id) AS hi FROM conversations)),
b AS (SELECT chunk_id, chunk_id AS head, 0 AS place FROM t WHERE p IS NULL OR p NOT IN (SELECT chunk_id FROM t) UNION ALL SELECT t.chunk_id, b.head, b.place + 1 FROM b JOIN t ON t.p = b.chunk_id),
a AS (SELECT chunk_id, chunk_id AS tail, 0 AS remaining FROM t WHERE f IS NULL OR f NOT IN (SELECT chunk_id FROM t) UNION ALL SELECT t.chunk_id, a.tail, a.remaining + 1 FROM a JOIN t ON t.f = a.chunk_id)
SELECT chunk_id, head, cast(place AS bigint) AS place, tail, cast(remaining AS bigint) AS remaining FROM b JOIN a USING (chunk_id)""")
def chain_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions at once, by links to the turns before and after."""
    of, own = Window.partitionBy("conv_id"), F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumns({"lo": F.min("turn").over(of), "hi": F.max("turn").over(of)})
    rows = rows.select(own.alias("chunk_id"), F.when(F.col("turn") > F.col("lo"), own - 1).alias("preceding"), F.when(F.col("turn") < F.col("hi"), own + 1).alias("following"))
    return links.chunk_chains(rows).select("chunk_id", "head", "place", "tail", "remaining")


# sections of five levels, ten of them a page of a document of a hundred
_LEVELS = "CASE WHEN k % 50 = 0 THEN 1 WHEN k % 10 = 0 THEN 2 WHEN k % 5 = 0 THEN 3 WHEN k % 2 = 0 THEN 4 ELSE 5 END"
_NODES = f"(SELECT page_id AS section_id, page_id // 100 AS document_id, page_id % 100 AS k, page_id % 100 // 10 AS start_page, {_LEVELS} AS level, length(url) AS words FROM (SELECT page_id, page_id % 100 AS k, url FROM pages))"


@query("section_subtrees", f"""
WITH RECURSIVE s AS (SELECT * FROM {_NODES}), p AS (SELECT a.section_id, a.words, a.start_page, (SELECT max(b.section_id) FROM s b WHERE b.document_id = a.document_id AND b.section_id < a.section_id AND b.level < a.level) AS parent_id FROM s a),
r AS (SELECT section_id, section_id AS top, 0 AS d FROM p UNION ALL SELECT r.section_id, p.parent_id, r.d + 1 FROM r JOIN p ON p.section_id = r.top WHERE p.parent_id IS NOT NULL),
w AS (SELECT section_id, max(d) AS depth, string_agg(top::VARCHAR, '/' ORDER BY d DESC) AS path FROM r GROUP BY section_id),
z AS (SELECT r.top, count(*) AS n, sum(words)::BIGINT AS words, max(start_page) AS last_page FROM r JOIN p ON p.section_id = r.section_id GROUP BY r.top)
SELECT p.section_id, p.parent_id, cast(depth AS bigint) AS depth, path, z.n AS subtree_size, z.words AS subtree_words, cast(z.last_page AS bigint) AS last_start_page FROM p JOIN w ON w.section_id = p.section_id JOIN z ON z.top = p.section_id""")
def section_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, level = F.col("page_id") % 100, F.when(F.col("page_id") % 50 == 0, 1).when(F.col("page_id") % 10 == 0, 2).when(F.col("page_id") % 5 == 0, 3).when(F.col("page_id") % 2 == 0, 4).otherwise(5)
    s = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 100).alias("document_id"), F.col("page_id").alias("section_id"), F.floor(k / 10).alias("start_page"), level.alias("level"), F.length("url").cast("long").alias("words"), F.col("page_id").alias("place"))
    # sections of one page are ordered by their ids
    tree = text.section_tree(s)
    out = links.subtrees(tree, ["document_id", "section_id"], "parent_id", sums=["words"], most=["start_page"])
    return out.select("section_id", "parent_id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "subtree_size", "subtree_words", "last_start_page")


# ---- spans ----

# a quarter of the spans hold a point, a quarter fifty, a quarter four thousand and a quarter a million
_SPAN = "(SELECT p_partkey AS span_id, p_partkey % 5 AS document_id, p_partkey * 37 % 900 AS low, p_partkey * 37 % 900 + [0, 49, 3999, 999999][p_partkey % 4 + 1] AS high FROM part)"
_AT = "(SELECT s_suppkey AS point_id, s_suppkey % 5 AS document_id, s_suppkey * 101 % 5000 AS spot FROM supplier)"


def _span_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, low = F.col("p_partkey"), F.col("p_partkey") * 37 % 900
    wide = F.element_at(F.array(*[F.lit(v) for v in (0, 49, 3999, 999999)]), (k % 4 + 1).cast("int"))
    s = table(spark, sf_dir, "part").select(k.alias("span_id"), (k % 5).alias("document_id"), low.alias("low"), (low + wide).alias("high"))
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 5).alias("document_id"), (F.col("s_suppkey") * 101 % 5000).alias("at"))
    return s, p


@query("spans_covering", f"SELECT span_id, count(*) AS n, min(point_id) AS first, max(spot) AS furthest FROM {_SPAN} s JOIN {_AT} p ON p.document_id = s.document_id AND spot BETWEEN low AND high GROUP BY span_id")
def spans_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = _span_rows(spark, sf_dir)
    join = lambda points, wanted: spans.points_in_spans(points, wanted, ["document_id"], "at", "low", "high")
    totals = {"n": F.count(F.lit(1)), "first": F.min("point_id"), "furthest": F.max("at")}
    merged = {"n": F.sum("n"), "first": F.min("first"), "furthest": F.max("furthest")}
    return spans.totals_of(join, p, ["document_id", "at"], totals, s, "span_id", ["document_id", "low", "high"], merged)


_ASKED = "(SELECT s_suppkey AS asked_id, s_suppkey % 5 AS document_id, s_suppkey * 13 % 800 AS lo, s_suppkey * 13 % 800 + [5, 200, 100000][s_suppkey % 3 + 1] AS hi FROM supplier)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lo = F.col("s_suppkey"), F.col("s_suppkey") * 13 % 800
    return table(spark, sf_dir, "supplier").select(k.alias("asked_id"), (k % 5).alias("document_id"), lo.alias("lo"), (lo + F.element_at(F.array(*[F.lit(v) for v in (5, 200, 100000)]), (k % 3 + 1).cast("int"))).alias("hi"))


def _asked_totals(spark: SparkSession, sf_dir: str, joined: Callable[..., DataFrame]) -> DataFrame:
    join = lambda rows, wanted: joined(rows, wanted, ["document_id"], ("low", "high"), ("lo", "hi"))
    totals, merged = {"n": F.count(F.lit(1)), "ids": F.sum("span_id")}, {"n": F.sum("n"), "ids": F.sum("ids")}
    return spans.totals_of(join, _span_rows(spark, sf_dir)[0], ["document_id", "low", "high"], totals, _asked(spark, sf_dir), "asked_id", ["document_id", "lo", "hi"], merged)


@query("spans_within", f"SELECT asked_id, count(*) AS n, sum(span_id)::BIGINT AS ids FROM {_ASKED} a JOIN {_SPAN} s ON a.document_id = s.document_id AND low >= lo AND high <= hi GROUP BY asked_id")
def spans_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked_totals(spark, sf_dir, spans.spans_within)


@query("spans_overlapping", f"SELECT asked_id, count(*) AS n, sum(span_id)::BIGINT AS ids FROM {_ASKED} a JOIN {_SPAN} s ON a.document_id = s.document_id AND low <= hi AND lo <= high GROUP BY asked_id")
def spans_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked_totals(spark, sf_dir, spans.spans_overlapping)


# ---- coreference ----

_FIRST = ["Steel", "Steelworks", "North Steel", "St", "North Holdings of India", "N", "Acme Steel Works of North India", "Works", "Acme"]
_NAMED = f"""(SELECT c_nationkey % 5 AS document_id, concat([{", ".join(f"'{x}'" for x in _FIRST)}][c_custkey % {len(_FIRST)} + 1], CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(' ', c_custkey % 11) END) AS name FROM customer)"""


def _greedy_sql(names: str) -> str:
    """m: names by document with their mentions and ranks; g: each one's canonical name, decided in order of rank."""
    return f"""
WITH RECURSIVE m AS (SELECT document_id, name, count(*) AS mentions, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, name) AS r FROM {names} GROUP BY document_id, name),
g AS (SELECT document_id, 1 AS r, [name] AS chosen, name AS canonical, name, mentions FROM m WHERE r = 1 UNION ALL
  SELECT x.document_id, x.r, CASE WHEN x.c IS NULL THEN list_append(x.chosen, x.name) ELSE x.chosen END, coalesce(x.c, x.name), x.name, x.mentions FROM (
    SELECT m.document_id, m.r, m.name, m.mentions, g.chosen, list_filter(g.chosen, lambda c: contains(lower(c), lower(m.name)) OR contains(lower(m.name), lower(c))
      OR len(list_intersect(list_distinct(string_split(lower(c), ' ')), list_distinct(string_split(lower(m.name), ' ')))) >= 0.8 * least(len(list_distinct(string_split(lower(c), ' '))), len(list_distinct(string_split(lower(m.name), ' ')))))[1] AS c
    FROM g JOIN m ON m.document_id = g.document_id AND m.r = g.r + 1) x)"""


@query("entity_canonical", f"{_greedy_sql(_NAMED)} SELECT document_id, name, mentions, canonical FROM g")
def entity_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    first = F.element_at(F.array(*[F.lit(x) for x in _FIRST]), (k % len(_FIRST) + 1).cast("int"))
    name = F.concat(first, F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" "), (k % 11).cast("string"))))
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("document_id"), name.alias("name"), F.lit(1).alias("mentions"))
    return coreference.canonical_names(rows, ["document_id"])


_FIRMS = "(SELECT s_nationkey % 6 AS document_id, s_suppkey AS k, concat('firm ', s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN ' Limited' WHEN 1 THEN ' Pvt. Ltd.' ELSE '' END) AS alias, concat('Firm ', s_nationkey) AS name FROM supplier)"


@query("entity_merged", f"""{_greedy_sql(_FIRMS)}
SELECT s.document_id, canonical, count(*) AS mentions, array_to_string(list_sort(list(DISTINCT alias)), '; ') AS aliases, cast(min(k) AS bigint) AS first FROM {_FIRMS} s JOIN g ON g.document_id = s.document_id AND g.name = s.name GROUP BY ALL""")
def entity_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firms such as 1, 13 and 19 are alike by name; a document holds every sixth nation's."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("firm "), "s_nationkey", F.when(k % 3 == 0, " Limited").when(k % 3 == 1, " Pvt. Ltd.").otherwise(""))
    found = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 6).alias("document_id"), k.alias("ordinal"), name.alias("name"), F.lit("COMPANY").alias("entity_type"), (k % 5).alias("page"), F.lit(1.0).alias("confidence"))
    out = coreference.merged_entities(found)
    return out.select("document_id", "canonical", "mentions", F.array_join("aliases", "; ").alias("aliases"), F.col("first").cast("long").alias("first"))


# ---- mentions with places ----

_SAID = [
    "The issue is of Rs. 1,250.50 crores and 100 Cr for growth.", "A loan of 5 lacs and ₹ 20 Lakhs at 9.5 % a year.", "Price band of Rs. 100 to Rs. 120 in FY 2023-24.", "Audited for FY23 and 22-23; signed on 12/03/2024.",
    "Mr. Ravi Kumar of Acme Limited met SEBI and RBI.", "Growth was 12.5% in Fiscal Year 2022, and 31.02.2023 is no day.", "Nothing of the kind is here.", "Beta Steel Pvt. Ltd. owes Dr Asha 3 crore",
]
_LITERAL = lambda x: "'" + x.replace("'", "''") + "'"
_SPOKEN = f"(SELECT doc_id AS id, concat(substr(text, 1, doc_id % 50), ' ', [{', '.join(map(_LITERAL, _SAID))}][doc_id % {len(_SAID)} + 1], ' ', text) AS text FROM documents)"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each with a sentence that names something put in near its start. A null text is empty."""
    d, k, body = table(spark, sf_dir, "documents"), F.col("doc_id"), F.coalesce("text", F.lit(""))
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (k % len(_SAID) + 1).cast("int"))
    whole = F.concat(F.substring(body, F.lit(1), (k % 50).cast("int")), F.lit(" "), said, F.lit(" "), body)
    return d.select(k.alias("id"), (k % 30).cast("int").alias("page"), whole.alias("text"))


def _places_sql() -> str:
    parts = []
    for n, (kind, pattern, case, _) in enumerate(mentions.PATTERNS):
        p = _LITERAL(pattern if case else f"(?i){pattern}")
        parts.append(f"SELECT id, text, {n} AS rank, '{kind}' AS entity_type, m[i] AS own, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start "
                     f"FROM (SELECT id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, text, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS g FROM t))")  # fmt: skip
    return f"WITH t AS {_SPOKEN}, f AS ({' UNION ALL '.join(parts)}), a AS (SELECT *, start + length(own) AS stop FROM f WHERE entity_type <> 'DATE' OR try_strptime(regexp_replace(own, '[/.-]', '/', 'g'), '%d/%m/%Y') IS NOT NULL)"


@query("entity_mentions", f"""{_places_sql()}
SELECT id, entity_type, own AS text, cast(start AS int) AS start, cast(stop AS int) AS stop, regexp_replace(substr(text, greatest(0, start - 40)::BIGINT + 1, (stop + 40 - greatest(0, start - 40))::BIGINT), '[ \\t\\n\\x0B\\f\\r]', ' ', 'g') AS context,
  EXISTS (SELECT 1 FROM a o WHERE o.id = a.id AND o.start <= a.start AND o.stop >= a.stop AND (o.stop - o.start > a.stop - a.start OR o.rank < a.rank)) AS nested FROM a""")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.mentions(_spoken(spark, sf_dir)).select("id", "entity_type", "text", "start", F.col("end").alias("stop"), "context", "nested")


@query("known_names", """
WITH t AS (SELECT doc_id AS id, concat('of ', c_name, ', and ', lower(replace(c_name, '#', ' ')), 's') AS text, c_name FROM documents JOIN customer ON c_custkey = doc_id % 97 + 1)
SELECT id, c_name AS name, 3 AS start, 3 + length(c_name) AS stop FROM t""")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name, looked for in a text that each document makes of one: once as it is, and once as part of a longer word."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 97 + 1).alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    said = F.concat(F.lit("of "), "c_name", F.lit(", and "), F.lower(F.regexp_replace("c_name", "#", " ")), F.lit("s"))
    found = mentions.gazetteer(d.join(c, "c_custkey").select("id", said.alias("text")), c.select(F.col("c_name").alias("name")))
    return found.select("id", "name", "start", F.col("end").alias("stop"))


# ---- tables out of blocks, and variants ----

_LINES = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey, l_suppkey, cast(l_quantity AS int) AS q FROM lineitem)"


@query("block_tables", f"""
SELECT l_orderkey AS page_num, concat('Line|Part key|Quantity|Supplier', chr(10), string_agg(concat(n, '|', CASE WHEN n > 1 AND l_partkey % 3 = 0 THEN '' ELSE l_partkey::VARCHAR END, '|', q, '|s ', l_suppkey), chr(10) ORDER BY n)) AS cells FROM {_LINES} l GROUP BY l_orderkey""")
def block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a page: a line of text, and a table of its lines as words with their boxes, out of which the table is made again."""
    of = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(of))
    word = lambda x, column, shift=0: F.struct(x.cast("string").alias("text"), F.lit(60.0 * column + shift).alias("x0"))
    part = F.when(~((F.col("n") > 1) & (F.col("l_partkey") % 3 == 0)), F.col("l_partkey"))
    body = [word(F.col("n"), 0), word(part, 1, 3), word(F.col("l_quantity").cast("int"), 2, 9), word(F.lit("s"), 3), word(F.col("l_suppkey"), 3, 8)]
    titles = [word(F.lit(t), c, shift) for t, c, shift in (("Line", 0, 0), ("Part", 1, 0), ("key", 1, 25), ("Quantity", 2, 0), ("Supplier", 3, 0))] + [F.struct(F.lit("Lines of the order").alias("text"), F.lit(-1.0).alias("x0"))]
    box = lambda w, y: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), (w["x0"] + 5 * F.length(w["text"])).alias("x1"), y.alias("y0"), (y + 10).alias("y1"))
    y = (F.col("n") * 14 + F.col("l_partkey") % 3).cast("double")
    body, titles = [box(w, y) for w in body], [box(w, F.lit(y0)) for w, y0 in zip(titles, [0.0] * 5 + [-40.0])]
    # a line's words stay together; an order's first brings the titles and the line of text
    words = F.when(F.col("n") == 1, F.array(*titles, *body)).otherwise(F.array(*body))
    out = page_tables.tables_of_parts(lines.select(F.lit(0).alias("document_id"), F.col("l_orderkey").alias("page_num"), words.alias("blocks")))
    return out.select("page_num", F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "\n").alias("cells"))


@query("variant_fields", """
SELECT doc_id, lang, n_chars, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 9 END AS page, CASE WHEN doc_id % 5 IN (0, 1) THEN 0 ELSE doc_id % 5 END AS n_flags, CASE WHEN doc_id % 5 IN (0, 1) THEN NULL ELSE concat(source, 0) END AS first_flag FROM documents WHERE doc_id % 6 <> 5
UNION ALL SELECT doc_id, NULL, NULL, NULL, 0, NULL FROM documents WHERE doc_id % 6 = 5""")
def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' findings as JSON text, a sixth of it malformed, a fifth of its lists empty and a fifth no list, read by typed paths."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    flags = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(k % 5 - 1, F.lit(0)).cast("int")), lambda i: F.concat("source", i.cast("string"))))
    about = F.to_json(F.struct("lang", "n_chars", F.struct(F.when(k % 4 != 0, k % 9).alias("page")).alias("place"), flags.alias("flags")), {"ignoreNullFields": "false"})
    about = F.when(k % 5 == 1, F.regexp_replace(about, r'"flags":\[[^\]]*\]', '"flags":"none"')).otherwise(about)
    stored = d.select("doc_id", F.when(k % 6 == 5, F.concat(F.lit("{"), about)).otherwise(about).alias("json")).withColumn("v", variants.parsed(F.col("json")))
    flat = variants.items(F.col("v"), "string", "$.flags")
    out = variants.typed(stored, "v", {"lang": ("$.lang", "string"), "n_chars": ("$.n_chars", "bigint"), "page": ("$.place.page", "bigint")})
    return out.select("doc_id", "lang", "n_chars", "page", F.size(flat).alias("n_flags"), F.get(flat, F.lit(0)).alias("first_flag"))


@query("variant_items", "SELECT order_id, position, part, qty FROM (SELECT l_orderkey AS order_id, l_partkey AS part, cast(l_quantity AS int) AS qty, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1 AS int) AS position FROM lineitem)")
def variant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines kept as a variant each, and a row for each item again."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("qty")))).alias("lines"))
    stored = rows.select(F.col("l_orderkey").alias("order_id"), variants.packed("lines").alias("v"))
    flat = variants.flattened(stored, "v", "$.lines")
    return variants.typed(flat, "item", {"part": ("$.l_partkey", "bigint"), "qty": ("$.qty", "int")}).select("order_id", "position", "part", "qty")


# ---- a store laid out by document ----


@query("store_writes", """
SELECT o_custkey AS document_id, o_orderkey AS id, CASE WHEN o_custkey % 10 = 4 THEN 'done' WHEN o_orderkey % 9 = 0 AND o_custkey < 40 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_custkey <> 7
UNION ALL SELECT o_custkey, -1, CASE WHEN o_custkey % 10 = 4 THEN 'done' ELSE 'added' END FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey < 40 AND o_custkey <> 7)""")
def store_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: some upserted, some updated, a customer's deleted."""
    path = new_path(spark, "store")
    store = DocumentStore(spark, path, path.rpartition("/")[2].replace("-", "_"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    store.create("orders", rows)
    some = rows.where("document_id < 40")
    store.upsert("orders", some.where("id % 9 = 0").withColumn("status", F.lit("new")).unionByName(some.select("document_id").distinct().select("document_id", F.lit(-1).cast("long").alias("id"), F.lit("added").alias("status"))), "id")
    store.update("orders", F.col("document_id") % 10 == 4, {"status": "done"})
    store.delete(7, "orders")
    return store.read("orders")


@query("keyset_page", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders)) WHERE n > 100 AND n <= 150")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty, each found by the last key of the one before."""
    rows, last = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct(), None
    for _ in range(2):
        last = page_after(rows, "o_orderkey", 50, last).agg(F.max("o_orderkey")).first()[0]
    return page_after(rows, "o_orderkey", 50, last)


# ---- assessments in words ----

_P = lambda x, digits=0: f"printf('%.{digits}f', {x})"


@query("debt_notes", f"""
WITH {_TOP}, d AS (SELECT entity_id, sum(amount) AS td, sum(interest_rate * amount) / sum(amount) AS r, coalesce(sum(amount) FILTER (is_short_term), 0) AS y, entity_id % 6 * 0.75 AS cover FROM {DEBT} d GROUP BY entity_id)
SELECT d.entity_id, CASE WHEN td / 500 > 2 THEN 'HIGH - D/E ratio exceeds 2x' WHEN td / 500 > 1 THEN 'MEDIUM - D/E ratio between 1-2x' ELSE 'LOW - D/E ratio below 1x' END AS leverage,
  CASE WHEN r > 12 THEN 'HIGH - Weighted average rate exceeds 12%' WHEN r > 9 THEN 'MEDIUM - Weighted average rate 9-12%' ELSE 'LOW - Weighted average rate below 9%' END AS interest_cost,
  concat(CASE WHEN y / td > 0.5 THEN 'HIGH' WHEN y / td > 0.3 THEN 'MEDIUM' ELSE 'LOW' END, ' - ', {_P('y', 1)}, ' Cr maturing within 1 year') AS refinancing, concat(CASE WHEN a / s > 0.5 THEN 'HIGH' WHEN a / s > 0.3 THEN 'MEDIUM' ELSE 'LOW' END, ' - Top lender ', lender, ' has ', {_P('a', 1)}, ' Cr exposure') AS concentration,
  CASE WHEN d.entity_id % 3 = 0 THEN 'HIGH - Covenant breaches disclosed' WHEN d.entity_id % 2 = 0 THEN 'MEDIUM - Financial covenants in place' ELSE 'LOW - No restrictive covenants disclosed' END AS covenant,
  CASE WHEN cover = 0 THEN NULL WHEN cover < 1.5 THEN concat('HIGH - Interest coverage ratio ', {_P('cover', 2)}, 'x is below 1.5x') WHEN cover < 3 THEN concat('MEDIUM - Interest coverage ratio ', {_P('cover', 2)}, 'x is below 3x') ELSE concat('LOW - Interest coverage ratio ', {_P('cover', 2)}, 'x is healthy') END AS coverage
FROM d JOIN t ON d.entity_id = t.entity_id AND n = 1""")
def debt_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    about = table(spark, sf_dir, "nation").select(k.alias("entity_id"), F.lit(500.0).alias("equity"), (k % 3 == 0).alias("any_breach"), (k % 2 == 0).alias("has_covenants"), (k % 6 * 0.75).cast("double").alias("interest_cover"))
    return assessments.debt_notes(view(spark, sf_dir, "debt_items").withColumn("bucket", F.lit(None).cast("string")), about)


@query("cash_assessment", f"""
WITH {_CF}, n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY fy) AS i, count(*) OVER (PARTITION BY entity_id) AS n, sum(CASE WHEN burning THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY fy DESC ROWS UNBOUNDED PRECEDING) AS calm FROM s),
e AS (SELECT entity_id, count(*) AS n, avg(fcf) AS m, avg(q) AS q, coalesce(avg(fcf) FILTER (i <= floor(n / 2)), 0) AS a, avg(fcf) FILTER (i > floor(n / 2)) AS b, avg(spend) AS sp, count(*) FILTER (calm = 0) AS burn, coalesce(sum(abs(fcf)) FILTER (burning), 0) AS burned, max(runway) FILTER (i = n AND burning) AS months FROM n GROUP BY entity_id),
f AS (SELECT *, list_filter([CASE WHEN burn >= 2 THEN concat('Negative FCF for ', burn, ' consecutive years') END, CASE WHEN q < 50 THEN concat('Low earnings quality: CFO/EBITDA at ', {_P('q')}, '%') END,
  CASE WHEN months < 12 THEN concat('Critical cash runway: only ', {_P('months')}, ' months') WHEN months < 18 THEN concat('Low cash runway: ', {_P('months')}, ' months') END, CASE WHEN n >= 2 AND NOT b > a + 10 AND b < a - 10 THEN 'FCF trend deteriorating over time' END,
  CASE WHEN burned > 100 THEN concat('Total cash burned: ₹', {_P('burned')}, ' Cr over the period') END], lambda x: x IS NOT NULL) AS flags FROM e)
SELECT entity_id, array_to_string(flags, '; ') AS red_flags, concat('Average ', CASE WHEN m > 0 THEN 'positive' ELSE 'negative' END, ' FCF of ₹', {_P('abs(m)')}, ' Cr. ', CASE WHEN q >= 70 THEN 'High' WHEN q >= 50 THEN 'Medium' ELSE 'Low' END, ' earnings quality. Capex in ',
  CASE WHEN sp > 1.5 THEN 'growth mode' WHEN sp < 0.8 THEN 'under-investment' ELSE 'maintenance mode' END, CASE WHEN len(flags) > 0 THEN concat('. Red flags: ', len(flags)) ELSE '' END, '.') AS assessment FROM f""")
def cash_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessments.cash_assessment(cash_years(spark, sf_dir)).withColumn("red_flags", F.array_join("red_flags", "; "))


@query("wc_assessment", f"""
WITH t AS ({SQL["wc_trend"]}), l AS (SELECT entity_id, entity_id % 5 * 24.0 AS v FROM t), f AS (SELECT t.entity_id, list_filter([CASE WHEN ccc_trend = 'Worsening' THEN 'Cash conversion cycle worsening over time' END, CASE WHEN stuffing_years <> '' THEN concat('Channel stuffing risk detected in ', replace(stuffing_years, ',', ', ')) END,
  CASE WHEN piling_years <> '' THEN concat('Inventory piling detected in ', replace(piling_years, ',', ', ')) END, CASE WHEN v > 50 THEN concat('CCC ', {_P('v')}, '% above sector average') END], lambda x: x IS NOT NULL) AS i FROM t JOIN l ON l.entity_id = t.entity_id)
SELECT entity_id, CASE WHEN len(i) > 0 THEN concat('Concerns: ', array_to_string(i, '; ')) ELSE 'Working capital management appears healthy with no major concerns' END AS assessment FROM f""")
def wc_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    trends = working_capital.trend(view(spark, sf_dir, "fin_year"))
    return assessments.working_capital_assessment(trends, trends.select("entity_id", (F.col("entity_id") % 5 * 24.0).alias("ccc_variance_pct")))


_ISSUED = f"(SELECT *, ordinal % 11 AS issuer FROM {LIT} x WHERE ordinal % 11 <> 4)"


def _issued(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = view(spark, sf_dir, "litigation").withColumn("issuer", F.col("ordinal") % 11).where("issuer <> 4")
    return items, table(spark, sf_dir, "nation").where("n_nationkey < 11").select(F.col("n_nationkey").cast("long").alias("issuer"), F.pow(F.lit(10.0), (F.col("n_nationkey") % 8).cast("double")).alias("networth"), (F.col("n_nationkey") % 8).cast("double").alias("contingent_pct"))


@query("issuer_risk", f"""
WITH s AS (SELECT issuer, sum(amount_cr) AS a, coalesce(sum(cnt) FILTER (entity_type = 'Promoter' AND case_type = 'Criminal' AND issuer % 2 = 0), 0) AS c FROM {_ISSUED} i WHERE entity_type <> 'Group Company' GROUP BY issuer),
g AS (SELECT n_nationkey AS issuer, coalesce(a, 0) / power(10.0, n_nationkey % 8) * 100 AS p, coalesce(c, 0) AS c, n_nationkey % 8 AS x FROM nation LEFT JOIN s ON issuer = n_nationkey WHERE n_nationkey < 11)
SELECT cast(issuer AS bigint) AS issuer, round(p, 4) AS litigation_pct, cast(c AS bigint) AS criminal_promoter, CASE WHEN p > 10 OR c > 0 OR p + x > 15 THEN 'Critical' WHEN p + x > 5 THEN 'Major' ELSE 'Minor' END AS severity, p > 10 OR c > 0 AS veto,
  array_to_string(list_filter([CASE WHEN p > 10 THEN concat('Litigation exposure (', {_P('p', 1)}, '%) exceeds 10.0% of net worth') END, CASE WHEN c > 0 THEN concat('Criminal cases against promoters: ', c) END], lambda y: y IS NOT NULL), '; ') AS veto_reason FROM g""")
def issuer_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven issuers at once, one without items; promoters of the odd ones have no criminal cases."""
    items, issuers = _issued(spark, sf_dir)
    calm = (F.col("issuer") % 2 == 1) & (F.col("case_type") == "Criminal") & (F.col("entity_type") == "Promoter")
    return rounded(assessments.issuer_risk(items.withColumn("case_type", F.when(calm, "Civil").otherwise(F.col("case_type"))), issuers))


@query("issuer_litigation", f"""
SELECT cast(issuer AS bigint) AS issuer, entity_type, cast(sum(cnt) AS bigint) AS total, count(*) FILTER (case_type = 'Criminal') AS criminal_count, count(*) FILTER (case_type NOT IN ('Civil', 'Criminal', 'Tax', 'Regulatory')) AS other_count, round(sum(amount_cr), 2) AS amount_cr, round(sum(amount_cr) / power(10.0, issuer % 8) * 100, 2) AS pct_networth FROM {_ISSUED} i GROUP BY issuer, entity_type""")
def issuer_litigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assessments.issuer_litigation(*_issued(spark, sf_dir)).select("issuer", "entity_type", "total", "criminal_count", "other_count", "amount_cr", "pct_networth"), 2)


@query("rule_actuals", f"""{_rules_sql()}
SELECT v.entity_id, v.rule_id, CASE WHEN v.rule_id = 'SKIN-001' THEN concat({_P('promoter_post_issue_holding_pct', 1)}, '%') WHEN v.rule_id = 'SKIN-002' THEN concat('OFS=', {_P('ofs_pct_of_issue', 1)}, '%, Fresh=', {_P('fresh_issue_pct_of_issue', 1)}, '%') WHEN v.rule_id LIKE 'PLEDGE%' THEN concat({_P('promoter_pledge_pct', 1)}, '%')
  WHEN v.rule_id = 'RPT-001' THEN concat({_P('rpt_revenue_pct', 1)}, '%') WHEN v.rule_id = 'RPT-002' THEN concat({_P('rpt_expense_pct', 1)}, '%') WHEN v.rule_id IN ('AUDIT-001', 'AUDIT-002') THEN 'Yes' WHEN v.rule_id = 'AUDIT-003' THEN concat(caro_qualifications, ' qualifications')
  WHEN v.rule_id = 'LITIG-001' THEN concat({_P('total_litigation_cr / post_issue_networth_cr * 100', 1)}, '% (₹', {_P('total_litigation_cr', 1)}, ' Cr)') ELSE concat({_P('receivable_days_growth - revenue_cagr_3yr', 1)}, 'pp gap') END AS actual FROM v JOIN r ON r.entity_id = v.entity_id""")
def rule_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = view(spark, sf_dir, "rule_inputs")
    return assessments.with_actuals(risk.violations(inputs), inputs).select("entity_id", "rule_id", "actual")
