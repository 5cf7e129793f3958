"""Language-model scores from Brown class-based n-grams.

The most frequent words are clustered by exchange on their bigram counts. Every other word that is not truly rare then moves
to the class that its own neighbours' classes fit best: exchange against the class contexts, word by word in buckets, so that the
clustered vocabulary grows with the corpus. Truly rare and unknown words go where words of their ending go. A
word's probability is that of its class after the class before, times that of the word in its class, with a discount that leaves
room for words never seen.

Texts are read once and kept as numbered words, a piece to a row. Counts and classes of all words stay in buckets by hash; a
piece asks each bucket once for its different words. Only what has a fixed size is broadcast: the clustered symbols' tables
and the class bigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import buckets_for, text_bytes, with_key, written
from ledgerleaf.llm.streams import groups
from ledgerleaf.llm.textbytes import LOWER_ASCII, Words, mixed, pieces, planes, trim, unplanes

REST = 64  # symbols of endings
DISCOUNT = 0.7
UNKNOWN = 255


@dataclass
class Settings:
    symbols: int = 1024  # words that the driver clusters; all others are classed in buckets
    classes: int = 64  # 254 at most
    sweeps: int = 30  # at most; exchange ends when a sweep moves nothing
    fewest: int = 3  # times that a word must occur to be classed by its neighbours
    piece_bytes: int = 4 << 20
    bucket_bytes: int = 16 << 20  # of text, whose words a bucket holds
    branch_buckets: int = 8192  # for each, one more branch of pieces sums contexts before they meet in buckets


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words in lower case, their hashes and endings: by the last two bytes, all words with a digit together."""
    data = LOWER_ASCII[data]
    words = Words(data, offsets)
    h = words.hashes()
    last = data[words.ends - 1].astype(np.uint64) << np.uint64(8) | data[np.maximum(words.ends - 2, words.starts)]
    rest = (mixed(last) % np.uint64(REST - 1)).astype(np.uint8)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    rest[digits[words.ends] > digits[words.starts]] = REST - 1
    return words, h, rest


PIECES = "piece long, keys binary, learn binary, sizes binary, hashes binary, rests binary, words binary"


def as_pieces(keyed: DataFrame, piece_bytes: int) -> DataFrame:
    """PIECES: of a run of texts, their keys, whether to learn from each, how many words each has, their different words'
    hashes and endings, the frequent ones first, and the number of each word among those. piece is the first text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for lo, hi, data, offsets in pieces(batch.column(2), piece_bytes):
                words, h, rest = words_of(data, offsets)
                different, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                blobs = [keys[lo:hi].tobytes(), learn[lo:hi].tobytes(), planes(words.counts.astype(np.uint32)), different[order].tobytes(), rest[first[order]].tobytes(), planes(rank[back].astype(np.uint32))]
                yield pa.record_batch([pa.array([int(keys[lo])], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names=[x.split()[0] for x in PIECES.split(", ")])

    return written(keyed.select("_k", "in_training", "text").mapInArrow(run, PIECES), "words")


class Piece:
    """A row of PIECES."""

    def __init__(self, row: dict):
        self.number = row["piece"]
        self.keys, self.learn = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["learn"], np.uint8) > 0
        self.sizes = unplanes(row["sizes"], np.uint32).astype(np.int64)
        self.hashes, self.rests = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["rests"], np.uint8)
        self.words = unplanes(row["words"], np.uint32).astype(np.int64)

    def learned(self) -> np.ndarray:
        """Which of the words are of texts to learn from."""
        return np.repeat(self.learn, self.sizes)

    def with_ends(self, values: np.ndarray, end: int) -> np.ndarray:
        """Values of all texts' words, each text followed by `end`."""
        return np.insert(values, np.cumsum(self.sizes), end)


def each_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Piece(batch.slice(i, 1).to_pylist()[0])
        trim()


def by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices into h) of each bucket that any of h belongs to."""
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, at = np.unique(bucket[order], return_index=True)
    if len(some):
        yield from zip(some.tolist(), np.split(order, at[1:]), strict=True)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


COUNTED = "bucket int, hashes binary, counts binary, rests binary"


def vocabulary(texts: DataFrame, buckets: int, top: int) -> DataFrame:
    """One row a bucket: its words' hashes in order, counts in texts to learn from, and endings; and its most frequent, twice its
    share of `top`: words are dealt by hash, so those hold the `top` of all, or as frequent ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in each_piece(batches):
            n = np.bincount(p.words[p.learned()], minlength=len(p.hashes))
            some = np.flatnonzero(n)
            rows = [(b, p.hashes[i].tobytes(), planes(n[i].astype(np.uint64)), p.rests[i].tobytes()) for b, i in ((b, some[at]) for b, at in by_bucket(p.hashes[some], buckets))]
            yield batch_of(rows, COUNTED)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "bucket"):
            rows = table.to_pylist()
            h = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
            n = np.concatenate([unplanes(r["counts"], np.uint64) for r in rows]).astype(np.int64)
            rest = np.concatenate([np.frombuffer(r["rests"], np.uint8) for r in rows])
            order = np.argsort(h, kind="stable")
            h = h[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            h, n, rest = h[at], np.add.reduceat(n[order], at), rest[order][at]
            best = np.lexsort((h, -n))[: -(-2 * top // buckets)]
            yield pa.record_batch(
                [
                    pa.array([rows[0]["bucket"]], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([planes(n.astype(np.uint64))], pa.binary()), pa.array([rest.tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64()), pa.array([len(n)], pa.int64()),
                    pa.array([[{"n": int(n[i]), "h": int(h[i].astype(np.int64))} for i in best]], pa.list_(pa.struct([("n", pa.int64()), ("h", pa.int64())]))),
                ],
                names=["bucket", "hashes", "counts", "rests", "tokens", "types", "best"],
            )
            trim()

    counted = texts.mapInArrow(count, COUNTED).repartition("bucket").sortWithinPartitions("bucket")
    return written(counted.mapInArrow(add, f"{COUNTED}, tokens long, types long, best array<struct<n:long,h:long>>"), "vocabulary")


def found_in(h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of h is in keys (sorted), and whether it is there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def bigrams(texts: DataFrame, keys: np.ndarray, n_symbols: int, slices: int = 32) -> np.ndarray:
    """How often each symbol follows each over all texts to learn from: endings, then `keys`, then a text's start and end.
    The result has n_symbols squared cells, whatever the input."""
    end, cells = n_symbols - 1, n_symbols * n_symbols
    width = -(-cells // slices)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * slices, np.int64)
        for p in each_piece(batches):
            at, known = found_in(p.hashes, keys)
            line = p.with_ends(np.where(known, REST + at, p.rests)[p.words], end)
            to = np.flatnonzero(np.repeat(p.learn, p.sizes + 1))
            total[:cells] += np.bincount(np.append(end, line)[to] * n_symbols + line[to], minlength=cells)
        for s in range(slices):
            part = total[s * width : (s + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                yield batch_of([(s, planes(np.diff(at, prepend=0).astype(np.uint32)), planes(part[at].astype(np.uint64)))], "slice int, steps binary, counts binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "slice"):
            total = np.zeros(width, np.int64)
            for r in table.to_pylist():
                total[np.cumsum(unplanes(r["steps"], np.uint32).astype(np.int64))] += unplanes(r["counts"], np.uint64).astype(np.int64)
            yield batch_of([(table.column("slice")[0].as_py(), total.tobytes())], "slice int, counts binary")

    counted = texts.mapInArrow(count, "slice int, steps binary, counts binary").repartition("slice").sortWithinPartitions("slice")
    matrix = np.zeros((slices, width), np.int64)
    for row in counted.mapInArrow(add, "slice int, counts binary").toLocalIterator():
        matrix[row.slice] = np.frombuffer(row.counts, np.int64)
    return matrix.reshape(-1)[:cells].reshape(n_symbols, n_symbols)


def exchange(matrix: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each symbol but the last, which has class `classes` to itself. Each symbol in turn moves to the class
    where the class bigrams' likelihood is highest, until a sweep moves none, or for so many sweeps."""
    n = len(matrix) - 1
    m = matrix.astype(np.float64)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    seen = m.sum(1) + m.sum(0)
    of = np.zeros(n + 1, np.int64)
    of[np.argsort(-seen[:n], kind="stable")] = np.arange(n) % classes
    of[n] = classes
    k = classes + 1
    member = np.eye(k)[of]
    after, before = m @ member, member.T @ m  # symbol to class, class to symbol
    cc = member.T @ after
    out, into = m.sum(1), m.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(-seen[:n], kind="stable").tolist():
            if not seen[w]:
                continue
            g, loop = of[w], m[w, w]
            a, b = after[w].copy(), before[:, w].copy()
            a[g] -= loop
            b[g] -= loop
            cc[g] -= a
            cc[:, g] -= b
            cc[g, g] -= loop
            rows, columns = cc[:classes], cc[:, :classes].T
            gain = (f(rows + a) - f(rows)).sum(1) + (f(columns + b) - f(columns)).sum(1)
            d = np.arange(classes)
            gain += f(cc[d, d] + a[d] + b[d] + loop) - f(cc[d, d] + a[d]) - f(cc[d, d] + b[d]) + f(cc[d, d])
            total_out, total_in = cc.sum(1)[:classes], cc.sum(0)[:classes]
            gain -= f(total_out + out[w]) - f(total_out) + f(total_in + into[w]) - f(total_in)
            to = int(gain.argmax())
            if gain[to] <= gain[g] + 1e-9:
                to = g
            cc[to] += a
            cc[:, to] += b
            cc[to, to] += loop
            if to != g:
                moved += 1
                of[w] = to
                after[:, g] -= m[:, w]
                after[:, to] += m[:, w]
                before[g] -= m[w]
                before[to] += m[w]
        if not moved:
            break
    return of


CONTEXTS = f"{COUNTED}, branch int, cells binary, times binary"
CLASSED = "bucket int, hashes binary, counts binary, classes binary, class_tokens array<long>, class_types array<long>"


def narrow(x: np.ndarray) -> bytes:
    """x in the narrowest unsigned type that holds all of it."""
    return planes(x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8))


def widened(b: bytes, n: int) -> np.ndarray:
    """The n numbers that narrow has packed."""
    return unplanes(b, np.dtype(f"u{len(b) // n}")) if n else np.zeros(0, np.uint8)


def context_rows(h: np.ndarray, word: np.ndarray, cell: np.ndarray, n: np.ndarray, buckets: int, branch: int) -> list[tuple]:
    """Rows of CONTEXTS, one a bucket: the words of h that occur in `word` (ascending), how many cells each has, those cells and
    how often each was met."""
    there, first, size = np.unique(word, return_index=True, return_counts=True)
    rows = []
    for b, i in by_bucket(h[there], buckets):
        inside = np.arange(int(size[i].sum())) + np.repeat(first[i] - (np.cumsum(size[i]) - size[i]), size[i])
        rows.append((b, h[there[i]].tobytes(), planes(size[i].astype(np.uint16)), None, branch, narrow(cell[inside]), narrow(n[inside])))
    return rows


def contexts_summed(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket and branch of rows of CONTEXTS: a word has `cells` numbers at most, however often it occurs."""
    for table in groups(batches, "node"):
        rows = table.to_pylist()
        sizes = [unplanes(r["counts"], np.uint16).astype(np.int64) for r in rows]
        h, own = np.unique(np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows]), return_inverse=True)
        key = np.repeat(own, np.concatenate(sizes)) * cells + np.concatenate([widened(r["cells"], s.sum()) for r, s in zip(rows, sizes, strict=True)])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate([widened(r["times"], s.sum()) for r, s in zip(rows, sizes, strict=True)]).astype(np.int64)[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
        n = np.add.reduceat(n, at) if len(key) else n
        word, cell = np.divmod(key[at], cells)
        size = np.bincount(word, minlength=len(h))
        yield batch_of([(rows[0]["bucket"], h.tobytes(), planes(size.astype(np.uint16)), None, rows[0]["branch"], narrow(cell), narrow(n))], CONTEXTS)
        trim()


def classed(texts: DataFrame, words: DataFrame, buckets: int, keys: np.ndarray, of: np.ndarray, cc: np.ndarray, settings: Settings) -> DataFrame:
    """CLASSED: vocabulary's words with a class each, and sums of counts and of different words by class. A word that the driver has
    not clustered and that occurs `fewest` times or more goes where the likelihood of its neighbours' classes is highest; of equal
    classes to the first.

    A word's contexts are counts of the classes before and after it, summed in each piece, then over a branch of pieces, then in its
    bucket. There are a branch and one more for each `branch_buckets` buckets, so what meets in a bucket of a word that is a given share
    of all tokens stays within that share of so many buckets' words, or within 2 (classes + 1) counts a branch."""
    k = len(cc)
    shared = texts.sparkSession.sparkContext.broadcast((keys, of))
    branches = 1 + buckets // settings.branch_buckets
    p = cc + 0.5
    fit_ = np.log(p * p.sum() / p.sum(1, keepdims=True) / p.sum(0, keepdims=True))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of = shared.value
        for p in each_piece(batches):
            at, known = found_in(p.hashes, keys)
            symbol = np.where(known, REST + at, p.rests)
            line = p.with_ends(of[symbol][p.words], k - 1).astype(np.int64)
            own = p.with_ends(p.words, -1)
            some = np.flatnonzero((own >= 0) & np.repeat(p.learn, p.sizes + 1) & ~np.append(known, True)[own])
            word, prevs, nexts = own[some], np.append(k - 1, line)[some], line[some + 1]
            pair, n = np.unique(np.concatenate([word * 2 * k + prevs, (word * 2 + 1) * k + nexts]), return_counts=True)
            yield batch_of(context_rows(p.hashes, *np.divmod(pair, 2 * k), n, buckets, int(mixed(np.array([p.number]).astype(np.uint64))[0] % np.uint64(branches))), CONTEXTS)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of = shared.value
        for table in groups(batches, "bucket"):
            own_at = np.flatnonzero(table.column("rests").is_valid().to_numpy())
            if not len(own_at):
                continue
            row = lambda i: table.slice(i, 1).to_pylist()[0]  # noqa: E731, B023
            own = row(int(own_at[0]))
            h, n = np.frombuffer(own["hashes"], np.uint64), unplanes(own["counts"], np.uint64).astype(np.int64)
            cls = of[np.frombuffer(own["rests"], np.uint8)].astype(np.uint8)
            at, known = found_in(h, keys)
            cls[known] = of[REST + at[known]]
            busy = np.flatnonzero(~known & (n >= settings.fewest))
            slot = np.full(len(h), -1, np.int32)
            slot[busy] = np.arange(len(busy))
            seen = []  # of each row, its busy words' slots in order, cells and counts
            for i in range(table.num_rows):
                if i != own_at[0]:
                    r = row(i)
                    word = np.repeat(slot[found_in(np.frombuffer(r["hashes"], np.uint64), h)[0]], unplanes(r["counts"], np.uint16))
                    order = np.argsort(word, kind="stable")[np.count_nonzero(word < 0) :]
                    seen.append((word[order], widened(r["cells"], len(word))[order], widened(r["times"], len(word))[order]))
            seen = [(w, c, t) for w, c, t in seen if len(w)]
            step = 20_000
            for lo in range(0, len(busy), step):
                hi = min(lo + step, len(busy))
                met = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
                for word, cell, times in seen:
                    a, b = np.searchsorted(word, [lo, hi])
                    met[0].append((word[a:b].astype(np.int64) - lo) * 2 * k + cell[a:b])
                    met[1].append(times[a:b])
                total = np.bincount(np.concatenate(met[0]), np.concatenate(met[1]), (hi - lo) * 2 * k).reshape(-1, 2, k)
                cls[busy[lo:hi]] = (total[:, 0] @ fit_ + total[:, 1] @ fit_.T)[:, : k - 1].argmax(1)
            sums = np.bincount(cls, n, k).astype(np.int64), np.bincount(cls, minlength=k)
            yield batch_of([(own["bucket"], own["hashes"], own["counts"], cls.tobytes(), sums[0].tolist(), sums[1].tolist())], CLASSED)
            trim()

    met = texts.mapInArrow(contexts, CONTEXTS)
    if branches > 1:
        node = (F.col("bucket").cast("long") * branches + F.col("branch")).alias("node")
        met = met.select("*", node).repartition("node").sortWithinPartitions("node").mapInArrow(lambda b: contexts_summed(b, 2 * k), CONTEXTS)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("branch", "int"), ("cells", "binary"), ("times", "binary"))]
    met = met.unionByName(words.select("bucket", "hashes", "counts", "rests", *empty))
    return written(met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(assign, CLASSED), "classes")


@dataclass
class Learned:
    texts: DataFrame
    words: DataFrame  # CLASSED
    buckets: int
    ending_class: np.ndarray
    class_tokens: np.ndarray  # of each class, the end's last
    class_types: np.ndarray
    n_tokens: int
    n_types: int
    n_texts: int


def learn(keyed: DataFrame, settings: Settings) -> Learned:
    """From keyed (_k, text, in_training)."""
    buckets = buckets_for(text_bytes(keyed, "text"), settings.bucket_bytes)
    texts = as_pieces(keyed, settings.piece_bytes)
    words = vocabulary(texts, buckets, settings.symbols)
    n_texts = keyed.where("in_training").count()
    sums = words.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    best = words.select(F.explode("best").alias("b")).select("b.*").orderBy(F.desc("n"), "h").limit(settings.symbols).toPandas()
    keys = np.sort(best.h.to_numpy(np.int64).astype(np.uint64))
    matrix = bigrams(texts, keys, REST + len(keys) + 1)
    of = exchange(matrix, settings.classes, settings.sweeps)
    member = np.eye(settings.classes + 1)[of]
    found = classed(texts, words, buckets, keys, of, member.T @ matrix @ member, settings)
    k = settings.classes
    row = found.select(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("class_tokens", "class_types") for i in range(k)]).first()
    tokens, types = (np.array([row[f"{c}{i}"] or 0 for i in range(k)] + [n_texts if c == "class_tokens" else n_texts > 0], np.int64) for c in ("class_tokens", "class_types"))
    return Learned(texts, found, buckets, of[:REST], tokens, types, int(sums.n or 0) + n_texts, int(sums.v or 0) + (n_texts > 0), n_texts)


ASKED = "bucket int, piece long, hashes binary, counts binary, classes binary, places binary"
SUMS = "key long, learn boolean, n_tokens long, n_known long, base double, emission double, line binary"


def looked_up(model: Learned, classes: int) -> DataFrame:
    """SUMS of each text: its tokens, those known, its logs of counts and of words in their classes, and its classes in order."""
    buckets = model.buckets

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in each_piece(batches):
            yield batch_of([(b, p.number, p.hashes[i].tobytes(), None, None, planes(i.astype(np.uint32))) for b, i in by_bucket(p.hashes, buckets)], ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's words come first; each row of a piece is sent back with counts and classes in place of hashes."""
        bucket, h, n, cls = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["places"] is None:
                    bucket, h, n, cls = r["bucket"], np.frombuffer(r["hashes"], np.uint64), unplanes(r["counts"], np.uint64).astype(np.int64), np.frombuffer(r["classes"], np.uint8)
                    continue
                if r["bucket"] != bucket:  # of which no word was learned
                    bucket, h = r["bucket"], np.zeros(0, np.uint64)
                at, known = found_in(np.frombuffer(r["hashes"], np.uint64), h)
                c = np.where(known, n[at], 0) if len(h) else np.zeros(len(at), np.int64)
                g = np.where(known, cls[at], UNKNOWN) if len(h) else np.full(len(at), UNKNOWN)
                out.append((None, r["piece"], None, planes(c.astype(np.uint64)), g.astype(np.uint8).tobytes(), r["places"]))
            yield batch_of(out, ASKED)

    lists = model.words.select("bucket", F.lit(None).cast("long").alias("piece"), "hashes", "counts", "classes", F.lit(None).cast("binary").alias("places"))
    asked = model.texts.mapInArrow(ask, ASKED).unionByName(lists).repartition("bucket").sortWithinPartitions("bucket", F.col("places").isNotNull())
    answers = asked.mapInArrow(answer, ASKED).select("piece", "counts", "classes", "places")
    tokens, types = np.maximum(model.class_tokens.astype(float), 1), model.class_types.astype(float)
    ending_class, n_texts = model.ending_class, model.n_texts

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "piece"):
            rows = table.to_pylist()
            p = Piece(next(r for r in rows if r["places"] is None))
            c, cls = np.zeros(len(p.hashes), np.int64), np.zeros(len(p.hashes), np.int64)
            for r in rows:
                if r["places"] is not None:
                    i = unplanes(r["places"], np.uint32)
                    c[i], cls[i] = unplanes(r["counts"], np.uint64), np.frombuffer(r["classes"], np.uint8)
            del rows, table
            cls = np.where(c > 0, cls, ending_class[p.rests])
            # all words of a class never seen share what its discount leaves; in a class without any word, a word is its class
            emission = np.where(c > 0, np.log10(np.maximum(c - DISCOUNT, 0.1) / tokens[cls]), np.where(types[cls] > 0, np.log10(np.maximum(DISCOUNT * types[cls], 0.1) / tokens[cls]), 0.0))
            of, m = np.repeat(np.arange(len(p.sizes)), p.sizes), len(p.sizes)
            total = lambda x: np.bincount(of, x[p.words], m).astype(float)
            line = p.with_ends(cls[p.words], classes).astype(np.uint8).tobytes()
            to = np.cumsum(p.sizes + 1).tolist()
            yield pa.record_batch(
                [
                    pa.array(p.keys), pa.array(p.learn), pa.array(p.sizes + 1), pa.array(total((c > 0).astype(float)).astype(np.int64) + (n_texts > 0)),
                    pa.array(total(np.log10(c + 1.0)) + np.log10(n_texts + 1.0)), pa.array(total(emission)), pa.array([line[a:b] for a, b in zip([0, *to], to, strict=False)], pa.binary()),
                ],
                names=[x.split()[0] for x in SUMS.split(", ")],
            )
            trim()

    names = [x.split() for x in PIECES.split(", ")]
    left = model.texts.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("counts", "classes", "places")])
    right = answers.select("piece", *[F.lit(None).cast(t).alias(c) for c, t in names[1:]], "counts", "classes", "places")
    return written(left.unionByName(right).repartition("piece").sortWithinPartitions("piece").mapInArrow(sums, SUMS), "classed")


def transitions(lines: DataFrame, k: int) -> np.ndarray:
    """log10 of the probability of a class after a class: counts over texts to learn from, smoothed by how frequent the class is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            line = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            if len(line):
                total += np.bincount(np.append(k - 1, line[:-1]) * k + line, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = lines.where("learn").select("line").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cc = np.zeros(k * k)
    cc[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    cc, weight = cc.reshape(k, k), 5.0
    one = (cc.sum(0) + 1) / (cc.sum() + k)
    return np.log10((cc + weight * one) / (cc.sum(1, keepdims=True) + weight))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: str = "true", settings: Settings | None = None) -> DataFrame:
    """(id, in_training, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, where the SQL condition
    `training` chooses the rows to learn from. base_score: a unigram model with one added to each count; score: the class model.

    Null and blank texts consist of the end token alone. Repeated ids and rows are scored one by one; a null condition
    is false. With nothing to learn from, every base_score is 0. Words equally frequent are clustered in order of their hashes.
    Other columns are left out."""
    settings = settings or Settings()
    keyed = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.expr(training), F.lit(False)).alias("in_training")), "id")
    model = learn(keyed.select("_k", "text", "in_training"), settings)
    k = settings.classes + 1
    lines = looked_up(model, settings.classes)
    follows = docs.sparkSession.sparkContext.broadcast(transitions(lines, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("line").to_pylist()
            line = np.frombuffer(b"".join(own), np.uint8).astype(np.int64)
            steps = follows.value[np.append(k - 1, line[:-1]), line] if len(line) else np.zeros(0)
            at = np.cumsum([0, *map(len, own)])[:-1]
            total = np.add.reduceat(steps, at) if len(own) else np.zeros(0)
            yield pa.record_batch([*(batch.column(c) for c in ("key", "n_tokens", "n_known", "base")), pa.array(total + batch.column("emission").to_numpy())], names=["key", "n_tokens", "n_known", "base", "score"])

    sums = lines.select("key", "n_tokens", "n_known", "base", "emission", "line").mapInArrow(run, "key long, n_tokens long, n_known long, base double, score double")
    ids = keyed.select(F.col("_k").alias("key"), "id", "in_training")
    each = F.log10(F.lit(float(model.n_tokens + model.n_types + 1)))
    return ids.join(sums, "key").select("id", "in_training", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * each).alias("base_score"), "score")


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, training="crc32(cast(doc_id AS string)) % 7 <> 2")
    return scored.select(F.col("id").alias("doc_id"), (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
