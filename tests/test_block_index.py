"""The block index gives the rows of a search through everything, and reads few blocks where vectors cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import block_index
from ledgerleaf.operators.block_index import BlockIndex

SCHEMA = "vec_id long, vector array<double>, section string, page int"


def clustered(n, groups, dims=16, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((groups, dims))[np.arange(n) % groups] * rng.uniform(0.5, 2, (n, 1)) + spread * rng.standard_normal((n, dims))
    return [(i, v, f"s{i % 4}", i % 40) for i, v in enumerate(x.tolist())]


def want(rows, queries, metric, k=None, threshold=None, keep=lambda r: True):
    out = {}
    for q, v in queries:
        found = []
        for key, x, *rest in rows:
            if x is None or not keep((key, x, *rest)):
                continue
            a, b = np.array(v), np.array(x)
            with np.errstate(all="ignore"):
                s = -np.linalg.norm(a - b) if metric == "euclid" else a @ b if metric == "dot" else a @ b / np.linalg.norm(a) / np.linalg.norm(b)
            if not np.isnan(s) and (threshold is None or s >= threshold):
                found.append((-round(float(s), 9), key))
        out[q] = [key for _, key in sorted(found)][:k]
    return {q: f for q, f in out.items() if f}


def got(found):
    out = {}
    rows = found.collect()
    for r in sorted(rows, key=lambda r: (-round(r.score, 9), r.key)):
        out.setdefault(r.query_id, []).append(r.key)
    return out


@pytest.fixture(params=[False, True])
def small(request, monkeypatch):
    """The second time, blocks, parts and queries' splits are so small that there are many of each."""
    if request.param:
        for name, value in (("BLOCK_ROWS", 8), ("PART_ROWS", 64), ("SPLIT_QUERIES", 5), ("FIRST_LISTS", (1, 2))):
            monkeypatch.setattr(block_index, name, value)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_rows_of_every_metric_filter_and_threshold(spark, small, metric):
    rows = clustered(600, 20) + [(2000 + i, [1.0] * 16, "s1", 5) for i in range(100)] + [(3000, [0.0] * 16, "s1", 5), (3001, None, "s1", 5), (3002, [float("nan")] * 16, "s1", 5), (3003, [1.0], "s1", 5), (3004, [1.0] * 16, None, None)]
    index = BlockIndex.build(spark.createDataFrame(rows, SCHEMA), payload=["section", "page"])
    fine = [r for r in rows if r[0] not in (3001, 3002, 3003)]
    queries = [(i, rows[i][1]) for i in range(0, 600, 97)] + [(5000, [1.0] * 16), (5001, [0.0] * 16)]
    asked = spark.createDataFrame([*queries, (5002, [1.0]), (5003, None)], "query_id long, query_vector array<double>")
    assert got(index.search(asked, k=7, metric=metric)) == want(fine, queries, metric, 7)
    floor = {"cosine": 0.9, "dot": 8.0, "euclid": -1.5}[metric]
    assert got(index.search(asked, k=None, threshold=floor, metric=metric)) == want(fine, queries, metric, threshold=floor)
    keep = lambda r: r[2] == "s1" and r[3] is not None and 3 <= r[3] <= 20
    assert got(index.search(asked, k=4, metric=metric, filters={"section": "s1", "page": [3, 20]})) == want(fine, queries, metric, 4, keep=keep)
    assert got(index.search(asked, k=4, metric=metric, filters={"section": ["s1", "s2", "zz"], "page": 5}, threshold=floor)) == want(fine, queries, metric, 4, floor, lambda r: r[2] in ("s1", "s2") and r[3] == 5)
    assert got(index.search(asked, k=4, metric=metric, filters={"section": "absent"})) == {}


def test_reads_few_blocks_where_vectors_cluster(spark, monkeypatch):
    monkeypatch.setattr(block_index, "BLOCK_ROWS", 16)
    rows = clustered(2000, 40, spread=0.02)
    index = BlockIndex.build(spark.createDataFrame(rows, SCHEMA), payload=["section", "page"])
    blocks = index.blocks().count()
    queries = [(i, rows[i][1]) for i in range(0, 2000, 61)]
    asked = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    for metric, most in (("cosine", 0.2), ("euclid", 0.15)):
        hits, reads = index.searched(asked, k=5, metric=metric)
        assert got(hits) == want(rows, queries, metric, 5)
        share = reads.agg(F.sum("read")).first()[0] / (blocks * len(queries))
        assert share < most, (metric, share)


def test_stored_index_and_no_one_key(spark, tmp_path, monkeypatch):
    """An index is read again from its folder; copies of one vector are spread over parts."""
    monkeypatch.setattr(block_index, "PART_ROWS", 50)
    rows = [(i, [1.0, 2.0], "s", 1) for i in range(500)]
    BlockIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"), payload=["section"])
    index = BlockIndex(spark, str(tmp_path / "index"))
    assert index.blocks().groupBy("list", "part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] < 100
    asked = spark.createDataFrame([(1, [3.0, 6.0])], "query_id long, query_vector array<double>")
    assert got(index.search(asked, k=3)) == {1: [0, 1, 2]} and len(got(index.search(asked, k=None, threshold=0.99))[1]) == 500


def test_empty_index_and_queries(spark):
    index = BlockIndex.build(spark.createDataFrame([], SCHEMA), payload=["section"])
    asked = spark.createDataFrame([(1, [3.0, 6.0])], "query_id long, query_vector array<double>")
    assert index.search(asked).count() == 0
    index = BlockIndex.build(spark.createDataFrame([(1, [1.0, 2.0], "s", 1)], SCHEMA))
    assert index.search(asked.limit(0)).count() == 0 and got(index.search(asked)) == {1: [1]}
    with pytest.raises(ValueError):
        index.search(asked, k=None)
