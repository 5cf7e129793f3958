"""A vector store over tables: search in blocks, lookups by payload, collections, upserts, and a cache of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.operators.store import content_hash, point_id, upserted

METRICS = ("cosine", "dot", "euclid")
QUERY_BLOCK, ROW_BLOCK, PARTS = 4096, 512, 32  # queries and rows that meet at once; parts of the rows


def sized(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(size, key, vector) of rows whose vectors have a component and finite ones alone."""
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(fine).select(F.size(vector).alias("size"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Of rows of a with rows of b; by cosine, a zero vector scores nan."""
    if metric == "euclid":
        return -np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
    out = a @ b.T
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            out = out / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(task, role, keys, vectors) of the runs of equal tasks and roles of sorted rows (task, role, key, vector)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        task, role, keys = (batch.column(i).to_numpy() for i in range(3))
        cuts = [0, *(np.flatnonzero((task[1:] != task[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), len(task)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            x = batch.column(3).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
            yield int(task[lo]), int(role[lo]), keys[lo:hi], x.reshape(hi - lo, -1)


class Best:
    """The k best of what a block of queries has met, or all that reach a threshold where k is None."""

    def __init__(self, k: int | None, threshold: float | None, metric: str):
        self.k, self.threshold, self.metric = k, threshold, metric
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        self.block: tuple[np.ndarray, np.ndarray] | None = None
        self.at, self.keys, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def ask(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.asked.append((ids.copy(), x.copy()))

    def meet(self, keys: np.ndarray, x: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
        if not self.asked:
            return
        if self.block is None:
            self.block = (np.concatenate([a[0] for a in self.asked]), np.concatenate([a[1] for a in self.asked]))
            self.least = np.full(len(self.block[0]), -np.inf)
        s = scores(self.block[1], x, self.metric)
        fits = ~np.isnan(s) if self.threshold is None else s >= self.threshold
        if self.k is None:
            i, j = np.nonzero(fits)
            yield self._rows(i, keys[j], s[i, j], name)
            return
        if self.k < len(keys):
            # no worse than the k-th of these rows
            s = np.where(fits, s, -np.inf)
            fits &= s >= np.partition(s, len(keys) - self.k, axis=1)[:, len(keys) - self.k, None]
        i, j = np.nonzero(fits & (s >= self.least[:, None]))
        at, own, score = np.concatenate([self.at, i]), np.concatenate([self.keys, keys[j]]), np.concatenate([self.scores, s[i, j]])
        order = np.lexsort((own, -score, at))
        at, own, score = at[order], own[order], score[order]
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < self.k
        self.at, self.keys, self.scores = at[keep], own[keep], score[keep]
        n = np.bincount(self.at, minlength=len(self.least))
        full = n >= self.k
        self.least[full] = self.scores[np.cumsum(n)[full] - 1]

    def rest(self, name: str) -> Iterator[pa.RecordBatch]:
        if len(self.at):
            yield self._rows(self.at, self.keys, self.scores, name)

    def _rows(self, i: np.ndarray, keys: np.ndarray, score: np.ndarray, name: str) -> pa.RecordBatch:
        assert self.block is not None
        return pa.record_batch([pa.array(self.block[0][i]), pa.array(keys), pa.array(score)], names=["query_id", name, "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int | None = 10, key: str = "vec_id", where: Column | None = None, threshold: float | None = None, metric: str = "cosine") -> DataFrame:
    """(query_id, key, score, rank): of each of queries (query_id, query_vector) the k best of vectors (key, vector), or without a rank all
    that reach a threshold where k is None. Filters apply before; ties are ranked by key. Vectors of other lengths than a query's, and null or non-finite
    ones, aren't found. A task holds a block of queries, reads a part of the rows after it, one by one and a few at a time, and passes on the
    k best of each query."""
    rows = vectors if where is None else vectors.where(where)
    # queries are dealt to blocks and rows to parts, by their ids; each block meets each part
    many = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = sized(queries, "query_id", "query_vector").select("*", dealt(many).alias("n"), every(PARTS).alias("part"), F.lit(0).alias("role"))
    held = sized(rows, key, "vector").select("*", every(many).alias("n"), dealt(PARTS).alias("part"), F.lit(1).alias("role"))
    task = (F.col("size") * many + F.col("n")) * PARTS + F.col("part")
    met = asked.unionByName(held).select(task.alias("task"), "role", "key", "vector").repartition("task").sortWithinPartitions("task", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        last = None
        for task, role, keys, x in _runs(batches):
            if task != last:
                if best is not None:
                    yield from best.rest(key)
                best, last = Best(k, threshold, metric), task
            assert best is not None
            if role == 0:
                best.ask(keys, x)
                continue
            for lo in range(0, len(keys), ROW_BLOCK):
                yield from best.meet(keys[lo : lo + ROW_BLOCK], x[lo : lo + ROW_BLOCK], key)
        if best is not None:
            yield from best.rest(key)

    found = met.mapInArrow(run, f"query_id long, `{key}` long, score double")
    if k is None:
        return found
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k)


def by_section(chunks: DataFrame, document: object, section: str, limit: int = 100) -> DataFrame:
    """A document's chunks of a section, scored 1: the first `limit` by point id, in order of pages."""
    rows = chunks.where((F.col("document_id") == document) & (F.col("section") == section))
    return rows.withColumn("_p", point_id(F.col("chunk_id"))).orderBy("_p", "chunk_id").limit(limit).drop("_p").withColumn("score", F.lit(1.0)).orderBy("page_start", "page_end", "chunk_id")


def each_section(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """by_section for every document and section at once, with each chunk's place."""
    of = Window.partitionBy("document_id", "section")
    kept = chunks.withColumn("_n", F.row_number().over(of.orderBy(point_id(F.col("chunk_id")), "chunk_id"))).where(F.col("_n") <= limit).drop("_n")
    return kept.withColumns({"score": F.lit(1.0), "place": F.row_number().over(of.orderBy("page_start", "page_end", "chunk_id"))})


def in_section(section: str) -> Column:
    return F.col("section") == section


def in_pages(low: int, high: int) -> Column:
    """Chunks that lie in a range of pages, both ends included."""
    return (F.col("page_start") >= low) & (F.col("page_end") <= high)


def formatted(hits: DataFrame, most: int = 500) -> DataFrame:
    """hits (query_id, rank, score, text, section, page_start, page_end) for display: scores of four digits, texts of `most` characters and a citation."""
    short = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text"))
    cited = F.concat(F.lit("["), "section", F.lit(", Pages "), "page_start", F.lit("-"), "page_end", F.lit("]"))
    return hits.withColumns({"score": F.round("score", 4), "text": short, "citation": cited})


# ---- collections: one folder of Parquet for each document ----


def collection_name(document: str, prefix: str = "doc") -> str:
    """Letters, digits and underscores only."""
    return f"{prefix}_" + "".join(c if c.isalnum() or c == "_" else "_" for c in document)


def _files(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Collections:
    """Points of documents under a folder: (point_id, chunk_id, vector and payload). Each write makes a new version, and a version counts
    only when it is complete, so that a reader never sees half of one."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str = "doc"):
        self.spark, self.folder, self.prefix = spark, folder.rstrip("/"), prefix

    def path(self, document: str) -> str:
        return f"{self.folder}/{collection_name(document, self.prefix)}"

    def version(self, document: str) -> int | None:
        fs, p = _files(self.spark, self.path(document))
        if not fs.exists(p):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [int(n[1:]) for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(document)}/{n}/_SUCCESS"))]
        return max(done, default=None)

    def exists(self, document: str) -> bool:
        return self.version(document) is not None

    def read(self, document: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path(document)}/v{self.version(document)}")

    def add(self, document: str, chunks: DataFrame, embeddings: DataFrame) -> int:
        """Upserts chunks (chunk_id and payload) with their embeddings (chunk_id, vector); returns how many. Without chunks nothing is
        written; ValueError if not every chunk has one embedding."""
        n = chunks.count()
        pairs = chunks.join(embeddings, "chunk_id")
        if n != embeddings.count() or n != pairs.count():
            raise ValueError("each chunk needs one embedding")
        if not n:
            return 0
        new = pairs.withColumn("point_id", point_id(F.col("chunk_id")))
        last = self.version(document)
        rows = new if last is None else upserted(self.read(document).select(*new.columns), new, "point_id")
        rows.write.parquet(f"{self.path(document)}/v{(last or 0) + 1}")
        return n

    def cleanup(self, document: str) -> int:
        """Removes all versions but the last whole one, for when nobody reads an older one or writes; how many. Until then they stay, as
        readers may scan them."""
        last = self.version(document)
        fs, p = _files(self.spark, self.path(document))
        old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() != f"v{last}"] if last is not None else []
        return sum(bool(fs.delete(x, True)) for x in old)

    def info(self, document: str) -> dict[str, int] | None:
        """How many points a collection holds, and the length of their vectors; None where there is none."""
        if not self.exists(document):
            return None
        found = self.read(document).agg(F.count(F.lit(1)).alias("points"), F.max(F.size("vector")).alias("dimension")).first()
        return {"points": found["points"], "dimension": found["dimension"] or 0}

    def drop(self, document: str) -> bool:
        fs, p = _files(self.spark, self.path(document))
        return bool(fs.delete(p, True))

    def names(self) -> list[str]:
        fs, p = _files(self.spark, self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


# ---- a cache of embeddings ----


class EmbeddingCache:
    """Embeddings of documents' texts, valid for the same texts, model and number of texts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, document: str) -> str:
        return f"{self.folder}/{collection_name(document, 'cache')}"

    def save(self, document: str, vectors: DataFrame, model: str) -> None:
        """vectors: (index, text, vector), of which the first 500 characters of each text are kept."""
        of = content_hash(vectors.withColumn("_all", F.lit(1)), "_all", "text", "index")
        about = of.crossJoin(vectors.agg(F.count(F.lit(1)).alias("chunk_count"))).select("content_hash", "chunk_count", F.lit(model).alias("model"))  # one row with one row
        vectors.select("index", F.substring("text", 1, 500).alias("text"), "vector").write.mode("overwrite").parquet(f"{self.path(document)}/vectors")
        about.write.mode("overwrite").json(f"{self.path(document)}/about")

    def load(self, document: str, texts: DataFrame, model: str) -> DataFrame | None:
        """(index, vector) where the cache holds these texts (index, text) for this model; else None."""
        fs, p = _files(self.spark, f"{self.path(document)}/about/_SUCCESS")
        if not fs.exists(p):
            return None
        about = self.spark.read.schema("content_hash string, chunk_count long, model string").json(f"{self.path(document)}/about").first()
        now = content_hash(texts.withColumn("_all", F.lit(1)), "_all", "text", "index").first()
        kept = self.spark.read.parquet(f"{self.path(document)}/vectors").select("index", "vector")
        n = texts.count()
        if about is None or now is None or (about.content_hash, about.model, about.chunk_count) != (now.content_hash, model, n) or kept.count() != n:
            return None
        return kept

    def clear(self, document: str) -> bool:
        """Whether there was anything."""
        fs, p = _files(self.spark, self.path(document))
        return bool(fs.delete(p, True))

    def clear_all(self) -> int:
        fs, p = _files(self.spark, self.folder)
        found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sum(bool(fs.delete(x, True)) for x in found if x.getName().startswith("cache_"))
