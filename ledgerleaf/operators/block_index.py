"""Exact vector search over a stored index of blocks, pruned by bounds.

Vectors are dealt to lists by their nearest centroids, and each list is cut into blocks of near vectors by median splits. A block holds its
center, its radius, both also for its vectors of unit length, and the smallest and largest values of its payload; a list's bounds cover its
blocks. No vector of a block or list can score more than its center does with a query, and its radius beside it. A search reads each query's
best lists first, and then only those whose bounds reach the worst hit kept; so it does with the blocks of a list. Results are those of a
search through everything, whatever the data; how much is read depends on how they cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.operators.store import payload_filter
from ledgerleaf.operators.vectors import scores
from ledgerleaf.sources.scratch import new_path, written

SAMPLE, LISTS = 8192, 1024  # vectors that centroids are fitted on, and lists, at most
BLOCK_ROWS, PART_ROWS = 256, 32_768  # of a block, and of a list's part, about: what one task holds
SPLIT_QUERIES = 20_000  # that meet a part in one task, about
FIRST_LISTS = (2, 16)  # read by each query in the first rounds; the last round reads all that are left by their bounds


def whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def doubles(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def bounds(q: np.ndarray, center: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """The most that a vector within a radius of a center can score with each row of q, with room for rounding. cosine: of unit vectors."""
    if metric == "euclid":
        far = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (center * center).sum(1) - 2 * q @ center.T, 0))
        out = -np.maximum(far - radius, 0)
    else:
        q = unit(q) if metric == "cosine" else q
        out = q @ center.T + np.linalg.norm(q, axis=1)[:, None] * radius
    return out + 1e-7 * (1 + np.abs(out))


def halved(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of x in blocks of at most `rows`, split again and again at the median of the widest component."""
    todo, done = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= rows:
            done.append(own)
            continue
        order = own[np.argsort(x[own, np.ptp(x[own], axis=0).argmax()], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    rng = np.random.default_rng(3)
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(6):
        of = (sample @ c.T - (c * c).sum(1) / 2).argmax(1)
        c = np.array([sample[of == i].mean(0) if (of == i).any() else c[i] for i in range(lists)])
    return c


@dataclass
class Lists:
    """What the driver and tasks know of all lists: a bounded number of rows."""

    number: np.ndarray
    parts: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    unit_center: np.ndarray
    unit_radius: np.ndarray
    low: list[dict]
    high: list[dict]

    def ball(self, metric: str) -> tuple[np.ndarray, np.ndarray]:
        return (self.unit_center, self.unit_radius) if metric == "cosine" else (self.center, self.radius)


def _keeps(filters: Mapping[str, object], low: dict, high: dict) -> bool:
    """Whether rows between low and high can meet the filters: lists of values count by their ends."""
    for name, value in filters.items():
        if value is None:
            continue
        if low.get(name) is None:
            return False
        ends = (min(value), max(value)) if isinstance(value, (list, tuple)) else (value, value)
        if ends[1] < low[name] or ends[0] > high[name]:
            return False
    return True


class BlockIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, folder: str | None = None, key: str = "vec_id", vector: str = "vector", payload: Sequence[str] = ()) -> BlockIndex:
        """An index of vectors under a folder, by default one in the shared folder. Vectors that are null or empty or hold a null or
        non-finite component, and those of another length than most, are left out. payload: columns that filters may ask for, and that hits carry."""
        spark = vectors.sparkSession
        index = cls(spark, folder or new_path(spark, "index"))
        rows = vectors.where(whole(vector)).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in payload]).alias("payload"))
        usual = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
        length, n = (usual["length"], usual["count"]) if usual else (1, 0)
        rows = rows.where(F.size("x") == length)
        sample = rows.orderBy(F.xxhash64("key", "x"), "key").limit(min(SAMPLE, max(64, 2**26 // (8 * length)))).select("x").toArrow().column("x")
        c = centroids(doubles(sample), max(1, min(LISTS, -(-n // (4 * BLOCK_ROWS)), len(sample)))) if n else np.zeros((1, length))
        shared = spark.sparkContext.broadcast(c)  # of LISTS rows at most

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    c = shared.value
                    of = (doubles(batch.column(1)) @ c.T - (c * c).sum(1) / 2).argmax(1)
                    yield pa.record_batch([*batch.columns, pa.array(of.astype(np.int32))], names=["key", "x", "payload", "list"])

        kind = dict(rows.dtypes)["payload"]
        dealt = written(rows.mapInArrow(deal, f"key long, x array<double>, payload {kind}, list int"), "dealt")
        sizes = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))  # LISTS rows at most
        placed = dealt.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

        def pack(table: pa.Table) -> pa.Table:
            x, out = doubles(table.column("x")), []
            table = table.combine_chunks()
            keys = table.column("key").to_numpy()
            for number, own in enumerate(halved(x, BLOCK_ROWS)):
                own = own[np.argsort(keys[own], kind="stable")]
                y, u = x[own], unit(x[own])
                rows = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), table.column("payload").combine_chunks().take(pa.array(own)))
                mid, umid = y.mean(0), u.mean(0)
                out.append(pa.table({
                    "list": table.column("list")[:1], "part": table.column("part")[:1], "parts": table.column("parts")[:1], "block": pa.array([number], pa.int32()), "n": pa.array([len(own)], pa.int32()), "center": pa.array([mid.tolist()]), "radius": pa.array([float(np.linalg.norm(y - mid, axis=1).max())]),
                    "unit_center": pa.array([umid.tolist()]), "unit_radius": pa.array([float(np.linalg.norm(u - umid, axis=1).max())]), "keys": pa.array([keys[own].tobytes()], pa.binary()), "vectors": pa.array([y.tobytes()], pa.binary()), "payload": rows,
                }))
            return pa.concat_tables(out)

        schema = f"list int, part int, parts int, block int, n int, center array<double>, radius double, unit_center array<double>, unit_radius double, keys binary, vectors binary, payload array<{kind}>"
        blocks = placed.groupBy("list", "part").applyInArrow(pack, schema)
        ends = [F.struct(F.lit(0).alias("_"), *[f(f"payload.{c}").alias(c) for c in payload]) for f in (F.array_min, F.array_max)]
        blocks.select("*", ends[0].alias("low"), ends[1].alias("high")).write.mode("overwrite").parquet(f"{index.folder}/blocks")
        index._cover(list(payload))
        return index

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def _cover(self, payload: list[str]) -> None:
        """Writes each list's ball, which covers those of its blocks, and the range of its payload."""
        blocks = self.blocks()
        mean = lambda c, i: F.sum(F.col(c)[i] * F.col("n")) / F.sum("n")
        length = (blocks.agg(F.max(F.size("center"))).first()[0]) or 0
        own = blocks.groupBy("list").agg(F.array(*[mean("center", i) for i in range(length)]).cast("array<double>").alias("c"), F.array(*[mean("unit_center", i) for i in range(length)]).cast("array<double>").alias("u"))
        gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
        met = blocks.select("list", "parts", "n", "center", "radius", "unit_center", "unit_radius", "low", "high").join(F.broadcast(own), "list")
        ends = [F.struct(F.lit(0).alias("_"), *[f(f"{side}.{c}").alias(c) for c in payload]).alias(side) for f, side in ((F.min, "low"), (F.max, "high"))]
        out = met.groupBy("list").agg(F.first("parts").alias("parts"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"), F.first("c").alias("center"), F.max(gap("c", "center") + F.col("radius")).alias("radius"), F.first("u").alias("unit_center"), F.max(gap("u", "unit_center") + F.col("unit_radius")).alias("unit_radius"), *ends)
        out.write.mode("overwrite").parquet(f"{self.folder}/lists")

    def lists(self) -> Lists:
        rows = self.spark.read.parquet(f"{self.folder}/lists").orderBy("list").collect()
        column = lambda c, kind: np.array([r[c] for r in rows], kind)
        center = lambda c: np.array([r[c] for r in rows], np.float64).reshape(len(rows), len(rows[0][c]) if rows else 0)
        return Lists(column("list", np.int64), column("parts", np.int64), center("center"), column("radius", float), center("unit_center"), column("unit_radius", float), [r["low"].asDict() for r in rows], [r["high"].asDict() for r in rows])

    def search(self, queries: DataFrame, k: int | None = 10, metric: str = "cosine", filters: Mapping[str, object] | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, key, score, rank) of each of queries (query_id, query_vector): the k best, ties to smaller keys, or without a rank all
        that score the threshold or more where k is None. filters: see store.payload_filter; payload outside them is never compared.
        Queries that are null, of another length or not finite find nothing; by cosine, zero vectors neither find nor are found."""
        return self.searched(queries, k, metric, filters, threshold)[0]

    def searched(self, queries: DataFrame, k: int | None = 10, metric: str = "cosine", filters: Mapping[str, object] | None = None, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
        """search's hits, and (read): of each task, the pairs of a query and a block that were compared."""
        if k is None and threshold is None:
            raise ValueError("a search needs k or a threshold")
        filters, lists, spark = dict(filters or {}), self.lists(), self.spark
        length = lists.center.shape[1] if len(lists.number) else 0
        asked = queries.where(whole("query_vector") & (F.size("query_vector") == length)).select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("q"))
        asked = written(asked.withColumn("least", F.lit(threshold).cast("double")), "asked")
        kept = np.array([_keeps(filters, a, b) for a, b in zip(lists.low, lists.high, strict=True)], bool)
        splits = max(1, -(-asked.count() // SPLIT_QUERIES))
        shared = spark.sparkContext.broadcast((lists, kept))
        blocks = self.blocks()
        for name, value in filters.items():
            if value is not None:
                ends = (min(value), max(value)) if isinstance(value, (list, tuple)) else (value, value)
                blocks = blocks.where((F.col(f"low.{name}") <= F.lit(ends[1])) & (F.col(f"high.{name}") >= F.lit(ends[0])))
        mask = F.transform("payload", lambda p: F.coalesce(payload_filter(filters, of=lambda c: p[c]), F.lit(False)))
        base = F.concat_ws("/", "list", "part")
        side = blocks.select(base.alias("at"), "center", "radius", "unit_center", "unit_radius", "keys", "vectors", mask.alias("mask")).where(F.exists("mask", lambda m: m))
        side = side.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("task", F.concat_ws("/", "at", "s")).drop("at", "s")
        starts = [s for s in (0, *np.cumsum(FIRST_LISTS).tolist()) if s < kept.sum()] if k is not None else [0]
        hits = reads = None
        for lo, hi in zip(starts, [*starts, len(lists.number)][1:], strict=True):
            found = written(self._round(asked, side, shared, splits, lo, hi, k, metric), "hits")
            fresh, read = found.where("query_id is not null").select("query_id", "key", "score"), found.where("query_id is null").select("read")
            hits, reads = (fresh, read) if hits is None else (hits.unionByName(fresh), reads.unionByName(read))
            if k is None:
                return hits, reads
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
            hits = hits.withColumn("rank", place).where(F.col("rank") <= k)
            if hi < len(lists.number):
                hits = written(hits.drop("rank"), "best")
                worst = hits.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
                asked = written(asked.join(worst, "query_id", "left").select("query_id", "q", F.greatest("least", "worst").alias("least")), "asked")
        if hits is None:
            empty = spark.createDataFrame([], "query_id long, key long, score double, rank int, read long")
            return empty.drop("read"), empty.select("read")
        return hits, reads

    @staticmethod
    def _round(asked: DataFrame, side: DataFrame, shared: object, splits: int, lo: int, hi: int, k: int | None, metric: str) -> DataFrame:
        """Hits in the lists that are lo-th to hi-th best of a query and whose bounds reach its least score."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, kept = shared.value
            center, radius = lists.ball(metric)
            for whole_batch in batches:
                for at in range(0, whole_batch.num_rows, 512):
                    batch = whole_batch.slice(at, 512)
                    most = np.where(kept, bounds(doubles(batch.column(1)), center, radius, metric), -np.inf)
                    least = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                    order = np.argsort(-most, axis=1, kind="stable")[:, lo:hi]
                    row, j = np.nonzero((np.take_along_axis(most, order, 1) >= least[:, None]) & kept[order])
                    of = order[row, j]
                    many = lists.parts[of]
                    row, of = np.repeat(row, many), np.repeat(of, many)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    split = batch.column(0).to_numpy()[row] % splits
                    task = [f"{n}/{p}/{s}" for n, p, s in zip(lists.number[of].tolist(), part.tolist(), split.tolist(), strict=True)]
                    out = batch.take(pa.array(row, pa.int64()))
                    yield pa.record_batch([pa.array(task, pa.string()), *out.columns], names=["task", "query_id", "q", "least"])

        def compare(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
            ids, keys, score, read = [], [], [], 0
            if blocks.num_rows and pairs.num_rows:
                name = ("unit_center", "unit_radius") if metric == "cosine" else ("center", "radius")
                center, radius = doubles(blocks.column(name[0])), blocks.column(name[1]).to_numpy()
                held = [(np.frombuffer(b["keys"], np.int64), np.frombuffer(b["vectors"], np.float64), np.array(b["mask"])) for b in blocks.select(["keys", "vectors", "mask"]).to_pylist()]
                for at in range(0, pairs.num_rows, 1024):
                    some = pairs.slice(at, 1024)
                    q, own = doubles(some.column("q")), some.column("query_id").to_numpy()
                    least = np.nan_to_num(some.column("least").to_numpy().astype(float), nan=-np.inf)
                    most = bounds(q, center, radius, metric)
                    best = np.full((len(q), k or 1), -np.inf)  # the k best scores so far, the least first
                    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    for b in np.argsort(-most.max(0)).tolist():
                        worst = least if k is None else np.maximum(least, best[:, 0])
                        now = np.flatnonzero(most[:, b] >= worst)
                        if not len(now):
                            continue
                        read += len(now)
                        key, x, mask = held[b]
                        x, key = x.reshape(len(key), -1)[mask], key[mask]
                        s = scores(q[now], x, metric)
                        i, j = np.nonzero(s >= worst[now][:, None])  # nan is nowhere
                        found.append((now[i], key[j], s[i, j]))
                        if k is not None:
                            both = np.concatenate([best[now], np.where(np.isnan(s), -np.inf, s)], 1)
                            best[now] = np.sort(np.partition(both, -k, axis=1)[:, -k:], axis=1)
                    if found:
                        i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
                        stay = s >= (least if k is None else best[:, 0])[i]
                        ids.append(own[i[stay]])
                        keys.append(j[stay])
                        score.append(s[stay])
            flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            ids, keys, score = flat(ids, np.int64), flat(keys, np.int64), flat(score, np.float64)
            none = pa.nulls(len(ids), pa.int64())
            return pa.table({"query_id": pa.concat_arrays([pa.array(ids), pa.nulls(1, pa.int64())]), "key": pa.concat_arrays([pa.array(keys), pa.nulls(1, pa.int64())]), "score": pa.concat_arrays([pa.array(score), pa.nulls(1, pa.float64())]), "read": pa.concat_arrays([none, pa.array([read])])})

        pairs = asked.mapInArrow(probe, "task string, query_id long, q array<double>, least double")
        return side.groupBy("task").cogroup(pairs.groupBy("task")).applyInArrow(compare, "query_id long, key long, score double, read long")

