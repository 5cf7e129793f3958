"""Writes touch few partitions, reads few files, and joins by document need no exchange."""

import datetime
import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators.layout import PART, DocumentStore, page_after

SCHEMA = "document_id string, id long, v string, updated_at timestamp"


@pytest.fixture
def store(spark, tmp_path):
    out = DocumentStore(spark, str(tmp_path), "t" + os.path.basename(str(tmp_path)).replace("-", "_"), partitions=6, buckets=3)
    out.create("a", spark.createDataFrame([(f"d{i % 40}", i, f"v{i}", None) for i in range(200)], SCHEMA))
    out.create("b", spark.createDataFrame([(f"d{i}", i * 10) for i in range(40)], "document_id string, w long"))
    yield out
    for t in ("a", "b"):
        out.drop(t)


def files(store, table):
    top = f"{store.folder}/{table}"
    return {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, fs in os.walk(top) for f in fs if f.startswith("part")}


def parts(paths):
    return {p.split(f"{PART}=")[1].split("/")[0] for p in paths}


def rows(store, table="a"):
    return {(r.document_id, r.id): r.v for r in store.read(table).collect()}


def test_writes_rewrite_touched_partitions_alone(spark, store):
    before, want = files(store, "a"), rows(store)
    new = spark.createDataFrame([("d3", 3, "new", None), ("d3", 999, "x", None), ("d3", 999, "x", None)], SCHEMA)
    assert store.upsert("a", new, "id") == 1
    after = files(store, "a")
    gone = {p for p in before if p not in after}
    assert len(parts(gone)) == 1 and all(after[p] == before[p] for p in before if p not in gone)
    want |= {("d3", 3): "new", ("d3", 999): "x"}
    assert rows(store) == want
    assert store.update("a", (F.col("document_id") == "d5") & (F.col("id") > 100), {"v": "set", "nothing": 1}, "updated_at") == 1
    want |= {k: "set" for k in want if k[0] == "d5" and k[1] > 100}
    assert rows(store) == want
    stamped = store.read("a").where("updated_at IS NOT NULL").collect()
    assert {r.v for r in stamped} == {"set"} and all(abs((r.updated_at - datetime.datetime.now(datetime.UTC).replace(tzinfo=None)).days) < 2 for r in stamped)
    assert store.delete("d3", "a", "b") == {"a": 6, "b": 1} and store.delete("zz", "a") == {"a": 0}
    assert rows(store) == {k: v for k, v in want.items() if k[0] != "d3"} and store.of_document("b", "d3").count() == 0
    assert store.update("a", F.lit(False), {"v": "no"}) == 0


def test_an_emptied_partition_is_empty(spark, store):
    own = store.read("b").where(store.part_of(F.col("document_id")) == 2)
    gone = [r.document_id for r in own.collect()]
    for d in gone:
        store.delete(d, "b")
    assert gone and store.read("b").count() == 40 - len(gone) and "2" not in parts(files(store, "b"))
    store.upsert("b", spark.createDataFrame([(gone[0], 5)], "document_id string, w long"), "w")
    assert [tuple(r) for r in store.of_document("b", *gone).collect()] == [(gone[0], 5)]


def test_pruned_reads_and_joins_without_exchange(spark, store):
    plan = store.of_document("a", "d4")._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*{PART}#\d+ = \d", plan), plan
    assert store.of_document("a", "d4", "d9").count() == 10
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = store.read("a").join(store.read("b"), "document_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 200
        counted = store.read("a").groupBy("document_id").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString() and counted.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert store.info("a").agg(F.sum("n"), F.sum("documents")).first()[:] == (200, 40)
    with pytest.raises(ValueError):
        store.create("c", spark.createDataFrame([(None, 1)], "document_id string, w long"))


def test_keyset_pages(spark):
    rows, last, seen = spark.range(25).select((F.col("id") * 7 % 25).alias("k")), None, []
    while page := [r.k for r in page_after(rows, "k", 10, last).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == list(range(25))
    plan = page_after(rows, "k", 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
