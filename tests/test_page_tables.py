"""Tables out of blocks, and records in variants."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import page_tables, text, variants
from ledgerleaf.plans import structures

BLOCK = "document_id int, page_num int, text string, x0 double, x1 double, y0 double, y1 double"


def laid_out(cells, top=100.0, left=50.0, height=10.0, step=14.0, width=90.0, jitter=0, seed=1):
    """A block for each word of each cell, with its box; numbers are set to the right of their column."""
    rng, out = random.Random(seed), []
    for r, row in enumerate(cells):
        for c, cell in enumerate(row):
            words = cell.split()
            x = left + c * width
            if cell[:1].isdigit():
                x += width - 20 - 5 * len(cell)
            for w in words:
                dy = rng.uniform(-jitter, jitter)
                out.append((w, x, x + 5 * len(w), top + r * step + dy, top + r * step + height + dy))
                x += 5 * len(w) + 3
    return out


def found(spark, *pages):
    rows = [(1, p, *b) for p, blocks in enumerate(pages) for b in blocks]
    random.Random(2).shuffle(rows)
    out = page_tables.page_tables(spark.createDataFrame(rows, BLOCK))
    return {(r.page_num, r.table): r.cells for r in out.collect()}


A = [["Item", "FY 2023", "FY 2022", "Notes"], ["Total assets", "1,200", "900", ""], ["Equity", "", "15", "as restated"], ["Net worth of all", "7", "", ""], ["Cash", "12", "13,000.5", "a b"]]
B = [["Name", "Amount"], ["First loan", "10"], ["Second", "2,000"]]


@pytest.mark.parametrize("jitter", [0, 2.5])
def test_blocks_give_back_their_cells(spark, jitter):
    two = laid_out(A, jitter=jitter) + [("A line of text between the tables", 50.0, 300.0, 190.0, 200.0)] + laid_out(B, top=230.0, jitter=jitter)
    close = laid_out(B, jitter=jitter) + laid_out(B, top=300.0, jitter=jitter)
    text_only = [("Plain", 50.0, 80.0, 10.0, 20.0), ("words", 83.0, 110.0, 10.0, 20.0), ("and more of them", 50.0, 120.0, 24.0, 34.0), (" ", 50.0, 60.0, 40.0, 50.0), (None, 1.0, 2.0, 3.0, 4.0), ("box", None, 2.0, 3.0, 4.0)]
    got = found(spark, laid_out(A, jitter=jitter), two, close, text_only, laid_out(A[:1], jitter=jitter))
    assert got == {(0, 1): A, (1, 1): A, (1, 2): B, (2, 1): B, (2, 2): B}


def test_a_spanning_header_goes_where_its_middle_is(spark):
    blocks = [("All of the years", 60.0, 330.0, 0.0, 10.0), ("Notes", 400.0, 430.0, 0.0, 10.0)] + laid_out([["a", "1", "2", "x"], ["b", "3", "4", "y"]], top=14.0)
    assert found(spark, blocks) == {(0, 1): [["", "All of the years", "", "Notes"], ["a", "1", "2", "x"], ["b", "3", "4", "y"]]}


def test_kinds_of_tables_from_blocks(spark):
    rows = [(1, 1, *b) for b in laid_out(A)]
    tables = text.extracted(page_tables.page_tables(spark.createDataFrame(rows, BLOCK)))
    kind = text.classify_tables(tables).first()
    assert kind.table_type == "balance_sheet" and tables.first().headers == A[0]
    assert text.with_shape(tables).first().row_count == 4
    assert page_tables.page_tables(spark.createDataFrame([], BLOCK)).count() == 0


def test_pages_longer_than_a_batch_and_many_in_one(spark):
    long = [["Item", "Amount"], *[[f"Line {i}", str(10 * i)] for i in range(1, 60)]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = [laid_out(x) for x in (A, long, B, A[:1], long, B)]
    try:
        for n in (1, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert found(spark, *pages) == {(0, 1): A, (1, 1): long, (2, 1): B, (4, 1): long, (5, 1): B}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_page_without_a_number_keeps_its_table(spark):
    rows = [(1, None, *b) for b in laid_out(B)]
    assert [(r.page_num, r.table, r.cells) for r in page_tables.page_tables(spark.createDataFrame(rows, BLOCK)).collect()] == [(None, 1, B)]


def test_blocks_in_one_place_come_by_their_text(spark):
    twice = [("b", 50.0, 55.0, 0.0, 10.0), ("a", 50.0, 55.0, 0.0, 10.0), ("x", 90.0, 95.0, 0.0, 10.0), ("1", 50.0, 55.0, 14.0, 24.0), ("2", 90.0, 95.0, 14.0, 24.0)]
    assert found(spark, twice, twice[::-1]) == {(p, 1): [["a b", "x"], ["1", "2"]] for p in (0, 1)}


def test_orders_lines_are_moved_once(spark):
    plan = structures.block_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


VALUES = {
    "string": ["a", None, 'q"\n é', ""], "int": [1, None, -5, 0], "double": [0.5, None, -1e9, 0.0], "boolean": [True, None, False, True], "array<string>": [["a", None, "b,"], None, [], ["é"]], "array<int>": [[1, 2], None, [], [0]],
    "array<array<string>>": [[["a"], ["b", "c"]], None, [], [[]]], "map<string, string>": [{"k": "v"}, None, {}, {"é": "1"}],
}


@pytest.mark.parametrize("kind", sorted(variants.RECORDS))
def test_records_come_back(spark, kind):
    fields = variants.RECORDS[kind]
    rows = [tuple(VALUES[t][(i + k) % 4] for k, t in enumerate(fields.values())) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in fields.items()))
    stored = df.select(variants.text_of(variants.record(kind)).alias("json"))
    back = variants.unpacked(stored.select(variants.parsed(F.col("json")).alias("v")), "v", kind).drop("v")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_malformed_and_falsy_values(spark):
    texts = ['[1, 2]', "[]", "null", None, "", "{bad", '"text"', '{"a": [3]}', "0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", variants.parsed(F.col("t")))
    got = {r.i: (r.l, r.m, r.s) for r in df.select("i", variants.items(F.col("v"), "int").alias("l"), variants.entries(F.col("v"), "array<int>").alias("m"), variants.falsy_to_null(F.col("t")).alias("s")).collect()}
    assert [got[i][0] for i in range(9)] == [[1, 2], [], [], [], [], [], [], [], []]
    assert got[7][1] == {"a": [3]} and all(got[i][1] == {} for i in range(7)) and [got[i][2] for i in (0, 1, 2, 3, 4, 8)] == ["[1, 2]", None, None, None, None, None]
    flat = variants.flattened(df, "v").select("i", "position", variants.at(F.col("item"), "$", "int").alias("x")).collect()
    assert sorted(map(tuple, flat)) == [(0, 0, 1), (0, 1, 2)]
    assert "a" in variants.schemas(df.where("i = 7"), "v").first().schema
