"""Approximate nearest neighbours by inner product: an adaptive dimension scan within probed lists.

Vectors are dealt to the lists of their nearest centroids; a query probes the lists whose centroids have the largest inner products with it.
Within a list, vectors get one more component that makes their norms equal, so that larger inner products are smaller distances, and are
rotated at random and cut into column blocks. After d of D columns, the share that a partial squared distance has of the whole one follows a
Beta(d/2, (D-d)/2) distribution over random rotations: a candidate whose partial distance would be too large, were it no farther than the
worst that a query keeps, is abandoned. What survives all blocks is scored on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import written


@dataclass
class Settings:
    sample: int = 16_384  # vectors that centroids and the number of probed lists are fitted on; and at most 64 MB of them
    lists: int = 1024  # at most; else the square root of the number of vectors
    recall: float = 0.965  # share of the sample's neighbours that lie in probed lists; decides how many lists are probed
    miss: float = 0.0005  # chance that a test abandons a neighbour
    columns: int = 16  # of a block
    tile_rows: int = 4096  # of a list that meet a query at once
    split_queries: int = 65_536  # of one list in a task, about
    chunk: int = 512  # rows scanned before thresholds are drawn tighter
    seed: int = 12


SPARE = 12  # more are kept than asked for, as a query's own row is dropped at the end


@dataclass
class Index:
    centroids: np.ndarray
    probes: int
    pivots: np.ndarray  # some vectors, with their lists: what a query's best of them score is a first threshold
    pivot_list: np.ndarray
    rotation: np.ndarray
    shares: np.ndarray  # by block: a neighbour's partial distance is at most this share of its whole one, but for `miss`

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T - (self.centroids**2).sum(1) / 2).argmax(1)


def fitted(sample: np.ndarray, n: int, k: int, settings: Settings) -> Index:
    """An index for n vectors like those of the sample."""
    rng = np.random.default_rng(settings.seed)
    lists = max(1, min(settings.lists, math.isqrt(n), len(sample) // 16))
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(8):
        of = (sample @ c.T - (c**2).sum(1) / 2).argmax(1)
        c = np.array([sample[of == i].mean(0) if (of == i).any() else c[i] for i in range(lists)])
    some = sample[rng.choice(len(sample), min(512, len(sample)), replace=False)]
    of = (sample @ c.T - (c**2).sum(1) / 2).argmax(1)
    near = np.argsort(-(some @ sample.T), axis=1)[:, : k + 1]
    place = np.argsort(np.argsort(-(some @ c.T), axis=1), axis=1)
    probes = int(np.quantile(np.take_along_axis(place, of[near], 1), settings.recall)) + 1
    wide = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((wide, wide)))[0]
    ends = range(settings.columns, wide, settings.columns)
    shares = np.array([np.quantile(rng.beta(d / 2, (wide - d) / 2, 400_000), 1 - settings.miss) for d in ends])
    pivots = sample[: max(1, min(len(sample), n // 8))]
    return Index(c, probes, pivots, of[: len(pivots)], rotation, shares)


def doubles(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added from the first component to the last, so that equal vectors score equally."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Tile:
    """Rows of a list, rotated and cut into column blocks."""

    def __init__(self, x: np.ndarray, index: Index, settings: Settings):
        self.x, self.index, self.settings = x, index, settings
        squares = (x * x).sum(1)
        self.most = squares.max()
        rotated = np.hstack([x, np.sqrt(np.maximum(self.most - squares, 0))[:, None]]) @ index.rotation
        self.blocks = [np.ascontiguousarray(rotated[:, lo : lo + settings.columns]) for lo in range(0, rotated.shape[1], settings.columns)]
        self.scored = 0

    def scan(self, q: np.ndarray, least: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of rows that score `least` or more and aren't below `keep` others, and of some below."""
        size, columns = self.settings.chunk, self.settings.columns
        rotated = np.hstack([q, np.zeros((len(q), 1))]) @ self.index.rotation
        own = [np.ascontiguousarray(rotated[:, lo : lo + columns]) for lo in range(0, rotated.shape[1], columns)]
        whole = (q * q).sum(1) + self.most
        best = np.full((len(q), keep), -np.inf)
        found = []
        for lo in range(0, len(self.x), size):
            limit = whole - 2 * np.maximum(least, best[:, 0])
            limit = np.where(np.isfinite(limit), np.maximum(limit, 0), np.inf)
            row, at = np.nonzero(np.ones((len(q), len(self.x[lo : lo + size])), bool))
            part = None
            for b, share in enumerate(self.index.shares):
                u, v = own[b], self.blocks[b][lo : lo + size]
                if part is None or len(row) > 0.3 * part.size:
                    more = (u * u).sum(1)[:, None] + (v * v).sum(1) - 2 * u @ v.T
                    part = more if part is None else part + more
                    far = part[row, at]
                else:
                    part[row, at] += ((u[row] - v[at]) ** 2).sum(1)
                    far = part[row, at]
                stay = far <= limit[row] * share + 1e-9 * whole[row]
                row, at = row[stay], at[stay]
            score = inner(q[row], self.x[lo + at])
            self.scored += len(row)
            stay = score >= np.maximum(least, best[:, 0])[row]
            row, at, score = row[stay], at[stay], score[stay]
            found.append((row, lo + at, score))
            order = np.lexsort((-score, row))
            place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            some = order[place < keep]
            fresh = np.full((len(q), keep), -np.inf)
            fresh[row[some], place[place < keep]] = score[some]
            best = np.sort(np.concatenate([best, fresh], 1), axis=1)[:, keep:]
        row, at, score = (np.concatenate(c) for c in zip(*found, strict=True))
        stay = score >= best[row, 0]
        return row[stay], at[stay], score[stay]


def best_of(query: np.ndarray, key: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Which to keep: of each query the `keep` largest scores, ties to smaller keys."""
    order = np.lexsort((key, -score, query))
    place = np.arange(len(query)) - np.searchsorted(query[order], query[order])
    return order[place < keep]


def scan_lists(batches: Iterator[pa.RecordBatch], index: Index, keep: int, settings: Settings) -> Iterator[pa.RecordBatch]:
    """Batches (task, role, cid, ids, vector, least) sorted by task and role: a task's rows (role 0) are held, its queries stream by."""
    now, held, tile = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tasks, roles = (batch.column(c).to_numpy() for c in (0, 1))
        cuts = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]) | (roles[1:] != roles[:-1])) + 1).tolist(), len(tasks)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if tasks[lo] != now:
                now, held, tile = tasks[lo], [], None
            piece = batch.slice(lo, hi - lo)
            if roles[lo] == 0:
                held.append(piece)
                continue
            if not held:
                continue
            if tile is None:
                rows = pa.Table.from_batches(held).combine_chunks()
                ids = rows.column("ids").combine_chunks()
                ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                tile = Tile(doubles(rows.column("vector").combine_chunks()), index, settings)
            for at in range(0, piece.num_rows, settings.chunk):
                some = piece.slice(at, settings.chunk)
                row, hit, score = tile.scan(doubles(some.column(4)), some.column(5).to_numpy(), keep)
                many = (ends[1:] - ends[:-1])[hit]
                row, score = np.repeat(row, many), np.repeat(score, many)
                key = flat[np.repeat(ends[:-1][hit] - np.cumsum(many) + many, many) + np.arange(len(row))]
                best = best_of(row, key, score, keep)
                yield pa.record_batch([pa.array(some.column(2).to_numpy()[row[best]]), pa.array(key[best]), pa.array(score[best])], names=["cid", "id", "score"])


def search(vectors: DataFrame, asked: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k vectors found with the largest inner products, nearest first, ties to smaller ids. Queries are the
    rows whose id is in asked (id), by default those whose id `every` divides; candidates are all rows with another id than the query's.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a null id and vectors of another length
    than most (ties: the longer). Equal vectors are scanned once; of each the smallest ids stand for all, which no cut is behind: no more can
    rank. Rows that repeat both id and vector count once; other rows that share an id are queries and candidates of their own. Of an empty
    table, or one with no query, no rows. Other columns, whatever their names, play no part."""
    settings = settings or Settings()
    spark, keep = vectors.sparkSession, k + SPARE
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine)
    usual = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    rows = rows.where(F.size("vector") == usual.length).withColumns({"a": F.xxhash64("vector"), "b": F.xxhash64(F.lit(1), "vector")})
    # copies: one vector each, with the smallest ids; the window's limit is applied before its shuffle too
    narrow = rows.select("a", "b", "id").distinct()
    first = narrow.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("n") <= keep)
    ids = first.groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    members = narrow.where(F.col("id") % every == 0) if asked is None else narrow.join(asked.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    members = written(members, "queries")
    one = rows.groupBy("a", "b").agg(F.first("vector").alias("vector"))
    one = one.join(ids, ["a", "b"]).join(members.select("a", "b", F.lit(True).alias("asked")).distinct(), ["a", "b"], "left")
    classes = written(one.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    bound = max(64, min(settings.sample, 2**26 // (8 * usual.length)))
    picked = classes.orderBy(F.xxhash64("a", "b"), "a", "b").limit(bound).select("vector").toArrow().column("vector").combine_chunks()
    index = fitted(doubles(picked), n, k, settings)
    shared = spark.sparkContext.broadcast(index)  # of a size that `sample` bounds

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(shared.value.lists_of(doubles(batch.column(4))).astype(np.int32))], names=["a", "b", "cid", "ids", "vector", "asked", "list"])

    kind = dict(classes.dtypes)["vector"]
    placed = classes.select("a", "b", "cid", "ids", "vector", "asked").mapInArrow(deal, f"a long, b long, cid long, ids array<long>, vector {kind}, asked boolean, list int")
    placed = written(placed, "lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    tiles = -(-sizes // settings.tile_rows)
    splits = max(1, -(-placed.where("asked").count() // settings.split_queries))
    start = np.concatenate([[0], np.cumsum(tiles)])  # a list's first tile

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each tile of the lists it probes: as many as the index says, or until they hold `keep` vectors."""
        index = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                q, split = doubles(batch.column(1)), batch.column(2).to_numpy()
                order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
                enough = np.cumsum(sizes[order], axis=1) - sizes[order] < keep
                probed = np.zeros(order.shape, bool)
                np.put_along_axis(probed, order, enough | (np.arange(order.shape[1]) < index.probes), 1)
                score = np.where(probed[:, index.pivot_list], q @ index.pivots.T, -np.inf)
                least = np.partition(score, -keep - 1, axis=1)[:, -keep - 1] if score.shape[1] > keep else np.full(len(q), -np.inf)
                row, of = np.nonzero(probed)
                many = tiles[of]
                row, tile = np.repeat(row, many), np.repeat(start[of] - np.cumsum(many) + many, many) + np.arange(many.sum())
                out = batch.take(pa.array(row))
                least = least - 1e-9 * np.abs(least)  # a pivot's own score may differ by rounding
                yield pa.record_batch([pa.array(tile * splits + split[row]), out.column(0), out.column(1), pa.array(least[row])], names=["task", "cid", "vector", "least"])

    split = F.pmod(F.xxhash64("cid"), F.lit(splits))
    queries = placed.where("asked").select("cid", "vector", split.alias("split")).mapInArrow(probe, f"task long, cid long, vector {kind}, least double")
    first_tile = F.array(*[F.lit(int(v)) for v in start[:-1]])[F.col("list")]
    count = F.array(*[F.lit(int(max(1, v))) for v in tiles])[F.col("list")]
    tile = first_tile + F.pmod(F.xxhash64("cid"), count)
    each = placed.select((tile * splits).alias("tile"), "cid", "ids", "vector").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    each = each.select((F.col("tile") + F.col("s")).cast("long").alias("task"), F.lit(0).alias("role"), "cid", "ids", "vector", F.lit(0.0).alias("least"))
    queries = queries.select("task", F.lit(1).alias("role"), "cid", F.lit(None).cast("array<long>").alias("ids"), "vector", "least")
    met = each.unionByName(queries).repartition("task").sortWithinPartitions("task", "role")
    found = met.mapInArrow(lambda batches: scan_lists(batches, shared.value, keep, settings), "cid long, id long, score double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "id"))).where(F.col("n") <= keep)
    best = best.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("hits"))
    best = placed.where("asked").select("a", "b", "cid").join(best, "cid").select("a", "b", "hits")
    # many queries may be equal: Spark may split this join's partitions
    out = members.select("a", "b", F.col("id").alias("query_id")).join(best, ["a", "b"])
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("id"), F.col("hit.score").alias("score"))


def op12_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
