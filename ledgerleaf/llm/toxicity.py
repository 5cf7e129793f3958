"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts. Each backs off from pairs of words to words, by how many different words they follow,
to the words' first six and four bytes, by how many different words begin so. Discounts come from the counts of counts of each
level. How a stem's words, or the longer stems of a short one, share its probability is counted over both classes together,
and a pair's history leans on the lower levels: an expression that is rare in either class then counts for little.

A text's evidence is the difference of its log-likelihoods under the two, per word: over the whole text, and over the
share of it that speaks most for toxic, so that a long text hides nothing. A logistic curve, fitted on labelled
texts that the counts have not seen, makes it a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import written
from ledgerleaf.llm.textbytes import LOWER_ASCII, Words, hash_spans, mixed, pieces

PLAIN = LOWER_ASCII.copy()
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0x20
STEMS = (6, 4)  # bytes
SHARES = (0.02, 0.1)  # of a text's words, but LEAST at least, whose mean is evidence
LEAST = 3


@dataclass
class Settings:
    """Labelled texts that are read to fit the model: no more than these, chosen by a hash of their id, and none of more bytes."""

    toxic: int = 1500
    ordinary: int = 3000
    curve: int = 1000  # of either class
    most_bytes: int = 50_000
    leaning: float = 10_000.0  # contexts that a history's lower levels weigh more


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(PLAIN[data], offsets)
    return words, words.hashes()


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def before(words: Words, h: np.ndarray) -> np.ndarray:
    """The word before each; 0 at a text's start."""
    prior = np.concatenate([np.zeros(min(1, len(h)), np.uint64), h[:-1]])
    prior[words.first[:-1][words.counts > 0]] = 0
    return prior


def stems(words: Words) -> list[np.ndarray]:
    return [hash_spans(words.data, words.starts, np.minimum(words.ends, words.starts + k)) for k in STEMS]


def pair_counts(texts: DataFrame) -> tuple[pa.Table, pa.Table]:
    """(first, second, toxic, ordinary): after how many different words each pair of words occurs in texts (label, text) of either class; and
    (second, long, short): the stems of each second word. Counted so, what many copies of one text repeat weighs no more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in pieces(batch.column(1)):
                words, h = plain_words(data, offsets)
                toxic = label[lo:hi][words.text_of()] == 1
                prior = before(words, h)
                rows = np.unique(np.stack([before(words, prior) >> np.uint64(32), prior, h, toxic.astype(np.uint64), *stems(words)], 1), axis=0)
                columns = [rows[:, 0].astype(np.uint32).view(np.int32), *(rows[:, i].astype(np.int64) for i in (1, 2, 4, 5)), (rows[:, 3] == 1).astype(np.int8), (rows[:, 3] == 0).astype(np.int8)]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=["zero", "first", "second", "long", "short", "toxic", "ordinary"])

    counted = texts.mapInArrow(run, "zero int, first long, second long, long long, short long, toxic byte, ordinary byte")
    different = counted.repartition("first", "second").groupBy("zero", "first", "second").agg(F.min("long").alias("long"), F.min("short").alias("short"), F.max("toxic").alias("toxic"), F.max("ordinary").alias("ordinary"))
    different = written(different, "pairs")
    words = different.groupBy("second").agg(F.min("long").alias("long"), F.min("short").alias("short")).toArrow()
    return different.groupBy("first", "second").agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("ordinary").cast("int").alias("ordinary")).toArrow(), words


def discounts(n: np.ndarray) -> np.ndarray:
    """Of counts in either class, what Kneser and Ney take off: by how many things were counted once, and how many twice."""
    once, twice = (n == 1).sum(0), (n == 2).sum(0)
    return np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.5)


def found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of x is in keys (sorted), and whether it is there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def counted(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, x[:, k], size) for k in (0, 1)], 1).astype(float)


@dataclass
class Level:
    """Words or stems by hash: what each has of its own in either class, its share of what the level below gives its stem, and
    the same for what was never seen: what the level below leaves in all, and each stem's sum of counts."""

    keys: np.ndarray
    own: np.ndarray
    left: np.ndarray
    share: np.ndarray
    total: np.ndarray  # counts, over both classes, of what begins with this; for the level above

    def probability(self, x: np.ndarray, below: np.ndarray, total_below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In either class, and total for the level above."""
        at, hit = found(self.keys, x)
        share = np.where(hit, self.share[at], 0.5 / (total_below + 0.5)) if len(self.keys) else np.ones(len(x))
        own = np.where(hit[:, None], self.own[at], 0.0) if len(self.keys) else 0.0
        return own + self.left * below * share[:, None], np.where(hit, self.total[at], 0.0) if len(self.keys) else np.zeros(len(x))


def level(keys: np.ndarray, n: np.ndarray, stem: np.ndarray) -> Level:
    """From counts of keys in either class, and the number of each one's stem on the level below."""
    taken = np.minimum(n, discounts(n))
    sums = np.maximum(n.sum(0), 1)
    weight = n.sum(1) + 0.5
    of_stem = np.bincount(stem, weight) if len(stem) else np.zeros(0)
    return Level(keys, (n - taken) / sums, np.where(n.sum(0) > 0, taken.sum(0) / sums, 1.0), weight / (of_stem[stem] + 0.5), np.zeros(len(keys)))


@dataclass
class Model:
    levels: list[Level]  # from short stems to words
    root: float  # counts of all short stems
    histories: np.ndarray  # hashes in order, with the weight of what is below in either class
    rest: np.ndarray
    pairs: np.ndarray  # hashes in order, with what each pair adds, in either class
    two: np.ndarray
    curve: np.ndarray | None = None

    def log_ratio(self, words: Words, h: np.ndarray) -> np.ndarray:
        """Of each word after the one before: the log of its toxic by its ordinary probability."""
        if not len(h) or not len(self.pairs):
            return np.zeros(len(h))
        p, total = np.ones((len(h), 2)), np.full(len(h), self.root)
        for one, x in zip(self.levels, [*reversed(stems(words)), h], strict=True):
            p, total = one.probability(x, p, total)
        prior = before(words, h)
        at, hit = found(self.histories, prior)
        p *= np.where(hit[:, None], self.rest[at], 1.0)
        at, hit = found(self.pairs, pair_key(prior, h))
        p += np.where(hit[:, None], self.two[at], 0.0)
        return np.log(p[:, 0]) - np.log(p[:, 1])

    def features(self, words: Words, h: np.ndarray) -> np.ndarray:
        """Of each text: the mean log ratio of all words, and of each of SHARES of them, those with the highest. A text of
        fewer words than LEAST is taken to have so many, with no evidence in those that it lacks."""
        r, n = self.log_ratio(words, h), words.counts
        out = np.zeros((len(n), 1 + len(SHARES)))
        of = words.text_of()
        out[:, 0] = np.bincount(of, r, len(n)) / np.maximum(n, LEAST)
        order = np.lexsort((-r, of))
        rank = words.place()  # the order within a text is that of the sorted words
        for k, share in enumerate(SHARES):
            most = np.maximum(LEAST, np.ceil(share * n))
            some = rank < most[of]
            out[:, 1 + k] = np.bincount(of[some], r[order][some], len(n)) / most
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.curve[1:] + self.curve[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def kneser_ney(counts: tuple[pa.Table, pa.Table], leaning: float) -> Model:
    """From pair_counts."""
    hashes = lambda table, c: table.column(c).to_numpy().astype(np.int64).view(np.uint64)
    pairs, second_words = counts
    first, second = hashes(pairs, "first"), hashes(pairs, "second")
    n = np.stack([pairs.column(c).to_numpy().astype(np.float64) for c in ("toxic", "ordinary")], 1)
    words, word_of = np.unique(second, return_inverse=True)
    followed = counted(word_of, (n > 0).astype(float), len(words))  # continuation counts
    del word_of
    order = np.argsort(hashes(second_words, "second"))
    long, short = hashes(second_words, "long")[order], hashes(second_words, "short")[order]
    longs, long_at, long_of = np.unique(long, return_index=True, return_inverse=True)
    shorts, short_of = np.unique(short[long_at], return_inverse=True)
    begin_long = counted(long_of, (followed > 0).astype(float), len(longs))
    begin_short = counted(short_of, (begin_long > 0).astype(float), len(shorts))
    levels = [level(shorts, begin_short, np.zeros(len(shorts), np.int64)), level(longs, begin_long, short_of), level(words, followed, long_of)]
    for below, above, stem in zip(levels, (begin_long, followed), (short_of, long_of), strict=False):
        below.total = np.bincount(stem, above.sum(1) + 0.5, len(below.keys)) if len(stem) else below.total
    histories, first_at = np.unique(first, return_inverse=True)
    after = counted(first_at, n, len(histories)) + leaning
    taken = np.minimum(n, discounts(n))
    key = pair_key(first, second)
    order = np.argsort(key)
    return Model(levels, float((begin_short.sum(1) + 0.5).sum()), histories, (counted(first_at, taken, len(histories)) + leaning) / after, key[order], ((n - taken) / after[first_at])[order])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and slopes by Newton's method; without both classes, a constant."""
    if not len(y) or y.min() == y.max():
        rate = (float(y.sum()) + 0.5) / (len(y) + 1) if len(y) else 0.01
        return np.append(np.log(rate / (1 - rate)), np.zeros(x.shape[1]))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
        w = weight * p * (1 - p) + 1e-9
        penalty = ridge * np.append(0.0, np.ones(len(b) - 1)) * weight.sum() / len(y)
        step = np.linalg.solve((z * w[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (weight * (y - p)) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    slopes = b[1:] / spread
    return np.append(b[0] - slopes @ mean, slopes)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, settings: Settings) -> Model:
    """From labels (id, toxic): a text labelled both ways counts as toxic, one with a null label not at all."""
    known = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("label"))
    known = known.withColumn("deal", F.xxhash64("id")).withColumn("curve", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0)
    size = {(r.label, r.curve): r["count"] for r in known.groupBy("label", "curve").count().collect()}
    picks = [(1, False, settings.toxic), (0, False, settings.ordinary), (1, True, settings.curve), (0, True, settings.curve)]
    chosen = None
    for label, curve, most in picks:
        some = known.where((F.col("label") == label) & (F.col("curve") == curve)).orderBy("deal", "id").limit(most).select("id", "label", "curve")
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= settings.most_bytes)
    texts = texts.join(F.broadcast(chosen), "id")  # no more rows than picks allow
    model = kneser_ney(pair_counts(texts.where("not curve").select("label", "text")), settings.leaning)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                x = shared.value.features(*plain_words(data, offsets))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    rows = texts.where("curve").select(F.col("label").cast("int"), "text").mapInArrow(run, "label int, x array<double>").toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(y), 1 + len(SHARES))
    read = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    model.curve = logistic(x, y, np.where(y == 1, size.get((1, True), 0) / read[1], size.get((0, True), 0) / read[0]))
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, settings: Settings | None = None) -> DataFrame:
    """(id, score, predicted) of every row of docs, learning from labels (id, toxic) alone.

    Empty, blank and null texts are scored with evidence 0. Repeated ids and rows are scored one by one. Without labels
    of both classes all scores are the same. Other columns are left out; of labelled texts with equal hashes those with the
    smallest ids are read first."""
    model = fit(docs, labels, id_col, text_col, settings or Settings())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                s = shared.value.scores(shared.value.features(*plain_words(data, offsets)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = score(docs, labels.where(~held).select(F.col("doc_id").alias("id"), "toxic"))
    return scored.withColumnRenamed("id", "doc_id").select("doc_id", held.alias("held_out"), "score", "predicted")
