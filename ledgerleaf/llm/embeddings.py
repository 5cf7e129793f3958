"""Embedding near-dedup with a random-projection tree forest.

Each tree splits the vectors by random directions, again and again. Vectors near a split go down both sides (spill
overlap), so that near ones seldom part. Vectors are compared within leaves only, exactly; links are joined by union.
The top of each tree is fitted on a bounded sample and has a bounded number of leaves, whatever the number of vectors; a leaf that
many vectors reach is split further by directions that all leaves share. Every vector goes down every tree.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.graph import Forest, components
from ledgerleaf.llm.scratch import written
from ledgerleaf.llm.streams import groups


@dataclass
class Settings:
    trees: int = 8
    sample: int = 16_384  # vectors that the trees are fitted on
    top_leaves: int = 1024  # of a tree, at most
    leaf_rows: int = 512
    overlap: float = 0.35  # half the spill band's width, in spreads of a linked pair's projected distance
    tile_rows: int = 4096  # a larger leaf is compared tile by tile
    seed: int = 5


DEEP = 40  # levels below a top leaf at most, a bit each


@dataclass
class Tree:
    """Inner nodes: a direction, where it splits, and two children; a child below 0 is leaf -1 - child. A leaf is split further on as
    many levels as it needs, about its centre, by the tree's shared directions. dense: most of a leaf's vectors link with each other."""

    direction: np.ndarray
    split: np.ndarray
    child: np.ndarray
    levels: np.ndarray
    center: np.ndarray
    dense: np.ndarray
    below: np.ndarray

    def route(self, x: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of all rows of x; a row within the band of a split is in both sides' leaves. A leaf's number holds
        the top leaf's above its DEEP lower bits."""
        row, leaf, todo = [], [], [(0 if len(self.split) else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                row.append(rows)
                leaf.append(np.full(len(rows), -1 - node))
                continue
            at = x[rows] @ self.direction[node] - self.split[node]
            todo += [(int(self.child[node, 0]), rows[at <= band]), (int(self.child[node, 1]), rows[at >= -band])]
        row, leaf = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (row, leaf))
        code = np.zeros(len(row), np.int64)
        for k in range(int(self.levels.max(initial=0))):
            deep = np.flatnonzero(self.levels[leaf] > k)
            at = np.einsum("ij,j->i", x[row[deep]] - self.center[leaf[deep]], self.below[k])
            code[deep[at > band]] |= 1 << k
            both = deep[np.abs(at) <= band]
            row, leaf, code = np.append(row, row[both]), np.append(leaf, leaf[both]), np.append(code, code[both] | 1 << k)
        return row, leaf << DEEP | code


def grown(sample: np.ndarray, n: int, least: float, band: float, settings: Settings, rng: np.random.Generator) -> Tree:
    """A tree for n vectors like those of the sample. The node that most of the sample reaches is split next, until there are
    top_leaves; a node is a leaf when about leaf_rows of the n would reach it, when the sample has too few to tell where to split, or when
    most of its vectors link with each other: no split could then help. A split lies where few vectors are, near the middle."""
    direction, split, child, leaves = [], [], [], []
    todo = [(-len(sample), 0, sample, None)]
    made = 1

    def dense(rows: np.ndarray) -> bool:
        some = rows[rng.choice(len(rows), min(len(rows), 64), replace=False)] if len(rows) else rows
        return len(some) > 8 and float((some @ some.T >= least).mean()) > 0.3

    while todo:
        _, _, rows, parent = heapq.heappop(todo)
        expected = n * len(rows) / max(1, len(sample))
        crowd = dense(rows)
        sides: list[np.ndarray] = []
        if expected > settings.leaf_rows and not crowd and len(rows) >= 16 and len(leaves) + len(todo) + 2 <= settings.top_leaves:
            d = rng.standard_normal(rows.shape[1])
            d /= np.linalg.norm(d)
            p = np.sort(rows @ d)
            middle = p[int(0.3 * len(p)) : int(0.7 * len(p)) + 1]
            near = np.searchsorted(p, middle + band) - np.searchsorted(p, middle - band)
            at = float(middle[np.lexsort((np.abs(middle - np.median(p)), near))[0]])
            q = rows @ d - at
            sides = [rows[q <= band], rows[q >= -band]]
        if sides and max(map(len, sides)) <= 0.95 * len(rows):
            number = len(split)
            direction.append(d)
            split.append(at)
            child.append([0, 0])
            for k, side in enumerate(sides):
                heapq.heappush(todo, (-len(side), made, side, (number, k)))
                made += 1
        else:
            number = -1 - len(leaves)
            deep = 0 if crowd else min(DEEP, max(0, math.ceil(math.log2(max(expected, 1) / settings.leaf_rows))))
            leaves.append((deep, rows.mean(0) if len(rows) else np.zeros(sample.shape[1]), crowd))
        if parent:
            child[parent[0]][parent[1]] = number
    levels = np.array([x[0] for x in leaves])
    below = rng.standard_normal((int(levels.max(initial=0)), sample.shape[1]))
    below /= np.linalg.norm(below, axis=1, keepdims=True)
    return Tree(np.array(direction), np.array(split), np.array(child, np.int64).reshape(-1, 2), levels, np.array([x[1] for x in leaves]), np.array([x[2] for x in leaves]), below)


def unit_rows(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(batches: Iterator[pa.RecordBatch], least: float, block: int = 512) -> Iterator[pa.RecordBatch]:
    """Of each group's vectors, the pairs at least so alike, as links that span what they join and as sums for each vector.
    A pair counts only in the first leaf that its vectors share. Role 1: another tile of the leaf, compared with role 0 only."""
    for table in groups(batches, "task"):
        role = table.column("role").to_numpy()
        table = table.take(pa.array(np.argsort(role, kind="stable")))
        home, n = int((role == 0).sum()), len(role)
        x = unit_rows(table.column("vector").combine_chunks())
        rid, size, leaf = table.column("rid").to_numpy(), table.column("size").to_numpy(), table.column("leaf")[0].as_py()
        lists = table.column("leaves").to_pylist()
        wide = max(map(len, lists))
        # padding differs between two vectors of a pair: no leaf is negative
        leaves = np.array([v + [-1 - i] * (wide - len(v)) for i, v in enumerate(lists)], np.int64)
        forest, links = Forest(n), np.zeros(n, np.int64)
        other = home < n
        for i in range(0, home, block):
            top = min(i + block, home)
            for j in range(home if other else i, n, block):
                a, b = np.nonzero(x[i:top] @ x[j : j + block].T >= least)
                a, b = a + i, b + j
                a, b = a[a < b], b[a < b]
                forest.join(a, b)
                for lo in range(0, len(a), 100_000):
                    u, v = a[lo : lo + 100_000], b[lo : lo + 100_000]
                    lu, lv = leaves[u], leaves[v]
                    first = np.full(len(u), np.iinfo(np.int64).max)
                    for k in range(wide):
                        mine = lu[:, k]
                        first = np.where((lv == mine[:, None]).any(1) & (mine >= 0), np.minimum(first, mine), first)
                    u, v = u[first == leaf], v[first == leaf]
                    links += np.bincount(u, size[v], n).astype(np.int64) + np.bincount(v, size[u], n).astype(np.int64)
        a, b = forest.links()
        some = np.flatnonzero(links)
        if len(a) + len(some):
            yield pa.record_batch(
                [pa.array(np.concatenate([rid[a], rid[some]])), pa.array(np.concatenate([rid[b], rid[some]])), pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]]))],
                names=["src", "dst", "n"],
            )


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, settings: Settings | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of vectors, linked where the cosine is `least` or more.

    Equal vectors are compared once, as one with a size. Null, zero and non-finite vectors, those with a null
    component or with another length than most, and rows with a null id link with nothing: component_id is their own id.
    Rows that repeat an id count as vectors of their own."""
    settings = settings or Settings()
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce(fine & F.col("id").isNotNull(), F.lit(False))).withColumn("length", F.size("vector"))
    usual = rows.where("fine").groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    length = usual.length if usual else 0
    fine = F.col("fine") & (F.col("length") == length)
    rows = rows.select("id", "vector", fine.alias("fine"), F.when(fine, F.xxhash64("vector")).alias("a"), F.when(fine, F.xxhash64(F.lit(1), "vector")).alias("b"))
    classes = written(rows.where("fine").groupBy("a", "b").agg(F.min("id").alias("rid"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector")), "vectors")
    n = classes.count()
    picked = classes.orderBy(F.xxhash64("rid"), "rid").limit(settings.sample).select("vector").toArrow().column("vector").combine_chunks()
    sample = unit_rows(picked) if n else np.zeros((0, 1))
    band = settings.overlap * math.sqrt(2 - 2 * least) / math.sqrt(max(1, length))
    rng = np.random.default_rng(settings.seed)
    trees = [grown(sample, n, least, band, settings, rng) for _ in range(settings.trees)]
    shared = spark.sparkContext.broadcast(trees)  # of a size that trees and top_leaves bound

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.concatenate([t.dense for t in shared.value])
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x, base, found = unit_rows(batch.column(2)), 0, []
                for tree in shared.value:
                    row, leaf = tree.route(x, band)
                    found.append((row, leaf + (base << DEEP)))
                    base += len(tree.levels)
                row, leaf = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                to = np.searchsorted(row, np.arange(batch.num_rows + 1))
                # of each leaf, the first dense one before it that the row is in: two rows of one such have met there
                crowd = np.where(dense[leaf >> DEEP], leaf, np.iinfo(np.int64).max)
                early = np.full(len(leaf), -1)
                rank = np.arange(len(leaf)) - to[row]
                for k in range(1, int(rank.max(initial=0)) + 1):
                    i = np.flatnonzero(rank == k)
                    early[i] = np.where(early[i - 1] >= 0, early[i - 1], np.where(crowd[i - 1] < np.iinfo(np.int64).max, crowd[i - 1], -1))
                lists = [pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(c, pa.int64())) for c in (leaf, early)]
                yield pa.record_batch([*batch.columns, *lists], names=["rid", "size", "vector", "leaves", "early"])

    kind = dict(classes.dtypes)["vector"]
    placed = written(classes.select("rid", "size", "vector").mapInArrow(route, f"rid long, size long, vector {kind}, leaves array<long>, early array<long>"), "placed")
    pair = F.explode(F.arrays_zip("leaves", "early")).alias("p")
    each = placed.select("rid", "size", "vector", "leaves", pair).select("rid", "size", "vector", "leaves", F.col("p.leaves").alias("leaf"), F.col("p.early").alias("early"))
    # a large leaf's rows are dealt to tiles by the dense leaf that they have met in before; tiles of one such don't meet again
    counts = placed.select(pair).groupBy(F.col("p.leaves").alias("leaf"), F.col("p.early").alias("early")).agg(F.count(F.lit(1)).alias("n"))
    large = counts.groupBy("leaf").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("early", F.ceil(F.col("n") / settings.tile_rows).cast("int").alias("tiles")))).alias("parts")).where(F.col("all") > settings.tile_rows)
    number = F.flatten(F.transform("parts", lambda x: F.array_repeat(x.early, x.tiles)))
    large = large.select("leaf", number.alias("of"))  # the early leaf of each tile
    one = F.array(F.lit(-1).cast("long"))
    joined = each.join(large, "leaf", "left").withColumn("of", F.coalesce("of", one)).withColumn("early", F.when(F.size("of") > 1, F.col("early")).otherwise(F.lit(-1)))
    first, own = F.array_position("of", F.col("early")) - 1, F.size(F.filter("of", lambda x: x == F.col("early")))
    joined = joined.withColumn("mine", (first + F.pmod(F.xxhash64("rid"), own)).cast("int"))
    met = F.filter(F.transform("of", lambda e, t: F.struct(F.least("mine", t).alias("i"), F.greatest("mine", t).alias("j"), F.when(F.col("mine") <= t, 0).otherwise(1).alias("role"), ((e == F.col("early")) & (e >= 0)).alias("done"))), lambda t: ~t.done)
    tasks = joined.select("rid", "size", "vector", "leaves", "leaf", F.explode(met).alias("t"))
    tasks = tasks.select(F.xxhash64("leaf", "t.i", "t.j").alias("task"), "rid", "size", "vector", "leaves", "leaf", F.col("t.role").alias("role"))
    found = written(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: compare(b, least), "src long, dst long, n long"), "found")
    joined = components(found.where("src <> dst").select("src", "dst"))
    links = found.where("src = dst").groupBy("src").agg(F.sum("n").alias("n"))
    of = classes.select("a", "b", "rid", "size").join(joined, F.col("rid") == F.col("id"), "left").drop("id").join(links, F.col("rid") == F.col("src"), "left")
    of = of.select("a", "b", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rid").alias("component_id"))
    out = rows.select("id", "a", "b").join(of, ["a", "b"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding) AND list_sum(list_transform(embedding::DOUBLE[], lambda e: e * e)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN m ON vec_id = id LEFT JOIN n ON vec_id = a
"""
