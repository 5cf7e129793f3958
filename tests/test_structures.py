"""Chains, trees and spans on rows that queries' tables don't have."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import links, spans, text


def test_chains_broken_links_cycles_and_repeats(spark):
    """A long chain in any order, a link to nothing, to itself, two cycles, rows that run into a cycle, a repeated id and a null one."""
    n = 300
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(1000, 999), (1001, 1000), (1002, 1002), (2000, 2004), *[(2000 + i, 2000 + i - 1) for i in range(1, 5)], (3000, 2003), (3001, 3000), (1001, 1002), (None, 5), (4000, None)]
    random.Random(1).shuffle(rows)
    got = {r.id: (r.end, r.steps, r.cyclic, r.broken) for r in links.walked(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {i: (0, i, False, False) for i in range(n)} | {1000: (1000, 0, False, True), 1001: (1000, 1, False, False), 1002: (1002, None, True, False)} | {i: (2000, None, True, False) for i in (2000, 2001, 2002, 2003, 2004, 3000, 3001)} | {4000: (4000, 0, False, False)}


def test_a_chain_from_a_chunk(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None, f"c{i + 1}" if i < 6 else "gone", "t") for i in range(7)] + [("x", "y", "y", "t"), ("y", "x", "x", "t")]
    chunks = spark.createDataFrame(rows, "chunk_id string, preceding string, following string, text string")
    names = lambda df: [r.chunk_id for r in df.orderBy("position").collect()]
    assert names(links.chain_from(chunks, "c3")) == ["c3", "c4", "c5", "c6"] and names(links.chain_from(chunks, "c3", 2)) == ["c3", "c4"]
    assert names(links.chain_from(chunks, "zz")) == [] and names(links.chain_from(chunks, "x")) == ["x"]
    ends = {r.chunk_id: (r.head, r.place, r.tail, r.remaining, r.cyclic, r.broken) for r in links.chunk_chains(chunks).collect()}
    assert ends["c2"] == ("c0", 2, "c6", 4, False, False) and ends["c6"] == ("c0", 6, "c6", 0, False, True) and ends["x"] == ("x", None, "x", None, True, False)


def test_chains_of_nothing(spark):
    assert links.walked(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_subtrees_of_nine_levels_cycles_and_missing_parents(spark):
    rows = [("d", i, i - 1 if i else None, 10, i) for i in range(9)] + [("d", 20, 4, 1, 50), ("e", 0, None, 5, 3), ("e", 1, 77, 6, 4), ("e", 5, 6, 1, 1), ("e", 6, 5, 1, 1)]
    nodes = spark.createDataFrame(rows, "doc string, id long, parent long, words long, page long")
    got = {(r.doc, r.id): (r.depth, r.path, r.subtree_size, r.subtree_words, r.first_page, r.last_page) for r in links.subtrees(nodes, ["doc", "id"], "parent", ["words"], ["page"], ["page"]).collect()}
    assert got["d", 0] == (0, [0], 10, 91, 0, 50) and got["d", 4] == (4, [0, 1, 2, 3, 4], 6, 51, 4, 50) and got["d", 20] == (5, [0, 1, 2, 3, 4, 20], 1, 1, 50, 50) and got["d", 8][2] == 1
    assert got["e", 0] == (0, [0], 1, 5, 3, 3) and got["e", 1] == (0, [1], 1, 6, 4, 4) and got["e", 5] == (None, None, None, None, None, None)


def test_tree_of_seven_levels(spark):
    levels = [1, 2, 3, 4, 5, 6, 7, 6, 3, 7, 1, 5]
    s = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(levels)], "document_id long, section_id long, start_page long, level int")
    got = {r.section_id: r.parent_id for r in text.section_tree(s).collect()}
    assert got == {i: max((j for j in range(i) if levels[j] < v), default=None) for i, v in enumerate(levels)}


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_to_every_pair(spark, seed):
    rng = random.Random(seed)
    lengths = [0, 1, 2, 3, 4, 15, 16, 17, 255, 256, 1000, 10**6, 10**9]
    s = [(i, rng.choice("ab"), (low := rng.randrange(-300, 300)), low + rng.choice(lengths)) for i in range(150)] + [(900, "a", 5, 4), (901, "a", None, 5), (902, "a", 5, None), (903, None, 1, 2)]
    p = [(i, rng.choice("ab"), rng.randrange(-400, 2000)) for i in range(150)] + [(900, "a", None), (901, None, 1)]
    a = [(i, rng.choice("ab"), (low := rng.randrange(-300, 300)), low + rng.choice(lengths[:-1])) for i in range(80)] + [(800, "b", 7, 3)]
    fine = [r for r in s if r[1] and r[2] is not None and r[3] is not None and r[2] <= r[3]]
    ds, dp, da = spark.createDataFrame(s, "i long, k string, low long, high long"), spark.createDataFrame(p, "j long, k string, at long"), spark.createDataFrame(a, "q long, k string, lo long, hi long")
    got = sorted((r.j, r.i) for r in spans.points_in_spans(dp, ds, ["k"], "at", "low", "high").collect())
    assert got == sorted((q[0], r[0]) for q in p for r in fine if q[1] == r[1] and q[2] is not None and r[2] <= q[2] <= r[3])
    got = sorted((r.i, r.q) for r in spans.spans_within(ds, da, ["k"], ("low", "high"), ("lo", "hi")).collect())
    assert got == sorted((r[0], q[0]) for q in a for r in fine if q[1] == r[1] and q[2] <= r[2] and r[3] <= q[3])
    got = sorted((r.i, r.q) for r in spans.spans_overlapping(ds, da, ["k"], ("low", "high"), ("lo", "hi")).collect())
    assert got == sorted((r[0], q[0]) for q in a for r in fine if q[1] == r[1] and q[2] <= q[3] and r[2] <= q[3] and q[2] <= r[3])


def test_a_wide_span_makes_few_rows(spark):
    for low, length in [(0, 10**6), (3, 10**9), (-17, 1), (5, 4), (123_456, 777_777), (-(10**6), 10**6 + 1)]:
        rows = spark.createDataFrame([(low, low + length - 1)], "low long, high long")
        assert spans.binned(rows, "low", "high").count() <= spans.BINS
    one = spark.createDataFrame([(1, 0, 10**6)], "k int, low long, high long")
    points = spark.range(5).selectExpr("1 AS k", "id * 300000 AS at")
    assert spans.points_in_spans(points, one, ["k"], "at", "low", "high").count() == 4
    assert spans.points_in_spans(points, one.limit(0), ["k"], "at", "low", "high").count() == 0


def test_totals_of_spans_meet_each_place_once(spark):
    rng = random.Random(3)
    points = [(i, rng.randint(0, 1), rng.randint(0, 6)) for i in range(300)]
    asked = [(i % 150, rng.randint(0, 1), lo := rng.randint(-1, 5), lo + rng.choice([0, 3, 1000])) for i in range(200)]
    met = []

    def join(a, b):
        out = spans.points_in_spans(a, b, ["d"], "at", "lo", "hi")
        met.append(out.count())
        return out

    p = spark.createDataFrame(points, "id long, d int, at long")
    totals, merged = {"n": F.count(F.lit(1)), "least": F.min("id"), "ids": F.sum("id")}, {"n": F.sum("n"), "least": F.min("least"), "ids": F.sum("ids")}
    got = spans.totals_of(join, p, ["d", "at"], totals, spark.createDataFrame(asked, "k long, d int, lo long, hi long"), "k", ["d", "lo", "hi"], merged)
    want = {}
    for k, d, lo, hi in asked:
        want.setdefault(k, []).extend(i for i, e, at in points if e == d and lo <= at <= hi)
    assert {tuple(r) for r in got.collect()} == {(k, len(x), min(x), sum(x)) for k, x in want.items() if x}
    assert met[0] <= 2 * 7 * 7 * 3  # places of a document, whatever the points and spans


def test_span_queries_do_not_meet_pair_by_pair(spark, tmp_path, monkeypatch):
    from ledgerleaf.plans import structures

    spark.range(20_000).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(6000).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    pairs, plain = [], spans.points_in_spans

    def counted(*args):
        out = plain(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spans, "points_in_spans", counted)
    assert structures.spans_covering(spark, str(tmp_path)).count() > 0
    assert structures.spans_within(spark, str(tmp_path)).count() > 0
    assert structures.spans_overlapping(spark, str(tmp_path)).count() > 0
    # there are 900 different spans, 5000 places of points and 2400 different spans asked for
    assert max(pairs) <= 900 * 5000 // 5
