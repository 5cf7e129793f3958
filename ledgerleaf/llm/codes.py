"""Vector code compression: parts of integer vectors become the numbers of their codebooks' nearest entries.

Codebooks are fitted by rounds of assignment and integer means over all vectors. The search for the nearest entry is filtered by lower bounds
from segment means, coarse to fine: a part and an entry are cut into segments, each with a mean and the norm of what is left; the squared
distance is at least the sum over segments of length * (difference of means)^2 + (difference of norms)^2. An entry is dropped only where its
bound, less a slack for rounding, exceeds an exact distance already found, and survivors are compared exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import written


@dataclass
class Settings:
    scale: int = 4096  # a component x becomes floor(scale * x)
    parts: int = 8
    entries: int = 16  # of each part's codebook
    rounds: int = 6
    rows: int = 4096  # compared at once
    salt: int = 16  # rows of one label meet its sum in so many groups


LARGEST = 2**26  # of a component, so that distances and a batch's sums stay exact in 64 bits
SLACK = 1e-9  # relative, many times what rounding in doubles can add to a bound


class Bounds:
    """Sums and residual norms of the segments of rows of x, from one segment to segments of two components."""

    def __init__(self, x: np.ndarray):
        self.levels = []
        count = 1
        while count == 1 or x.shape[1] // count >= 2:
            cuts = np.linspace(0, x.shape[1], count + 1).astype(int)
            length = np.diff(cuts)
            sums = np.add.reduceat(x, cuts[:-1], axis=1).astype(np.float64)
            mean = np.repeat(sums / length, length, axis=1)
            self.levels.append((sums / np.sqrt(length), np.sqrt(np.add.reduceat((x - mean) ** 2, cuts[:-1], axis=1))))
            count *= 2


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x the nearest row of book (ties to the lower number) and its squared distance; and how many distances were computed.
    Both hold integers, as int64."""
    mine, theirs = Bounds(x), Bounds(book)
    a, ra = mine.levels[0]
    b, rb = theirs.levels[0]
    low = (a[:, :1] - b[:, 0]) ** 2 + (ra[:, :1] - rb[:, 0]) ** 2
    guess = low.argmin(1)
    best = ((x - book[guess]) ** 2).sum(1)
    within = best * (1 + SLACK) + SLACK * (1 + ra[:, 0] ** 2 + a[:, 0] ** 2)
    row, entry = np.nonzero(low <= within[:, None])
    for (a, ra), (b, rb) in zip(mine.levels[1:], theirs.levels[1:], strict=True):
        low = ((a[row] - b[entry]) ** 2 + (ra[row] - rb[entry]) ** 2).sum(1)
        row, entry = (v[(low <= within[row]) | (entry == guess[row])] for v in (row, entry))
    exact = ((x[row] - book[entry]) ** 2).sum(1)
    order = np.lexsort((entry, exact, row))
    row, entry, exact = row[order], entry[order], exact[order]
    first = np.searchsorted(row, np.arange(len(x)))
    return entry[first], exact[first], len(row)


def parts_of(column: pa.Array, width: int, settings: Settings) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, part, rows of that part) of a column of integer vectors, some rows at a time."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), len(flat) // len(column)).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, settings.parts * width - x.shape[1])))
    for lo in range(0, len(x), settings.rows):
        for p in range(settings.parts):
            yield lo, p, x[lo : lo + settings.rows, p * width : (p + 1) * width]


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, settings: Settings) -> tuple[DataFrame, int]:
    """(id, label, x) of the rows that take part, and the length of x: floor(scale * component)."""
    whole = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & whole)
    rows = written(rows.select("id", "label", F.transform("vector", lambda v: F.floor(v * settings.scale).cast("long")).alias("x")), "integers")
    about = rows.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("most")).orderBy(F.desc("n"), F.desc("length")).limit(2).collect()
    if any(a.most is not None and a.most > LARGEST for a in about[:1]):
        raise ArithmeticError(f"a component is over {LARGEST / settings.scale:g}: distances would not fit 64 bits")
    length = about[0].length if about else 0
    return rows.where(F.size("x") == length), length


def first_codebooks(rows: DataFrame, width: int, settings: Settings) -> list[np.ndarray]:
    """The parts of the `entries` smallest ids; rows that share an id are taken by their components."""
    some = rows.orderBy(F.asc_nulls_last("id"), "x").limit(settings.entries).select("x").toArrow().column("x").combine_chunks()
    books = [np.zeros((0, width), np.int64)] * settings.parts
    for _, p, x in parts_of(some, width, settings) if len(some) else ():
        books[p] = x
    return books


def improved(rows: DataFrame, books: list[np.ndarray], width: int, settings: Settings) -> list[np.ndarray]:
    """Each entry as the integer mean of the parts that are nearest to it; entries without parts stay. A task passes on one row of sums for
    each entry and batch; a round's sums come to the driver as parts * entries rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = [np.zeros(b.shape, np.int64) for b in books]
            counts = [np.zeros(len(b), np.int64) for b in books]
            for _, p, x in parts_of(batch.column(0), width, settings):
                entry, _, _ = nearest(x, books[p])
                np.add.at(sums[p], entry, x)
                counts[p] += np.bincount(entry, minlength=len(books[p]))
            used = [(p, e) for p in range(settings.parts) for e in np.flatnonzero(counts[p]).tolist()]
            yield pa.record_batch([pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(counts[p][e]) for p, e in used], pa.int64()), pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = rows.select("x").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    out = [b.copy() for b in books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        out[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return out


def encoded(rows: DataFrame, books: list[np.ndarray], width: int, settings: Settings) -> DataFrame:
    """(id, label, code, error): code holds an entry's number for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.zeros((batch.num_rows, settings.parts), np.int16), np.zeros(batch.num_rows, np.int64)
            for lo, p, x in parts_of(batch.column(2), width, settings):
                code[lo : lo + len(x), p], far, _ = nearest(x, books[p])
                error[lo : lo + len(x)] += far
            codes = pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), settings.parts).cast(pa.list_(pa.int16()))
            yield pa.record_batch([batch.column(0), batch.column(1), codes, pa.array(error)], names=["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "x").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code array<short>, error long")


def with_label_error(codes: DataFrame, salt: int) -> DataFrame:
    """codes with label_error, the error summed over all rows of the label; a null label is one too. Sums are partial before they meet; rows
    look them up by label and a number of their own, so that no label's rows meet in one task."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("s"))
    dealt = codes.withColumn("at", F.pmod(F.xxhash64("id", "code"), F.lit(salt)).cast("int"))
    return dealt.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("at") == F.col("s"))).select(*codes.columns, "label_error")


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error, label_error) of every vector, and the final codebooks, one array of entries for each part.

    Vectors that are null or hold a null or non-finite component are left out, and so are those of another length than most (ties: the
    longer); empty vectors, where most are, have all-zero codes. A length that `parts` doesn't divide is filled up with zeros. With fewer
    vectors than entries, codebooks are smaller. Repeated rows and ids count as often as they occur; ids rank nulls last, and rows that
    share one rank by their components. Components over 2**26 after scaling raise ArithmeticError. Of an empty table, no rows. Other columns,
    whatever their names, play no part."""
    settings = settings or Settings()
    rows, length = integers(vectors, id_col, vector_col, label_col, settings)
    width = max(1, -(-length // settings.parts))
    books = first_codebooks(rows, width, settings)
    for _ in range(settings.rounds if len(books[0]) else 0):
        books = improved(rows, books, width, settings)
    return with_label_error(written(encoded(rows, books, width, settings), "codes"), settings.salt), books


def book_digest(books: list[np.ndarray]) -> Column:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return F.sha2(F.lit(",".join(str(v) for b in books for v in b.ravel().tolist())), 256)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return codes.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", book_digest(books).alias("codebooks_sha256"))


def _sql(rounds: int) -> str:
    """Rounds of assignment and floored means, a pair of tables each."""
    near = """a{k} AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM
  (SELECT x.r, x.p, c.e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{k} c ON c.p = x.p AND c.i = x.i GROUP BY x.r, x.p, c.e) GROUP BY r, p)"""
    mean = """c{n} AS (SELECT c.p, c.e, c.i, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT a.p, a.e, x.i, (CASE WHEN sum(x.v) < 0 THEN -((-sum(x.v) + count(*) - 1) // count(*)) ELSE sum(x.v) // count(*) END)::BIGINT AS v
  FROM a{k} a JOIN x ON x.r = a.r AND x.p = a.p GROUP BY a.p, a.e, x.i) m ON m.p = c.p AND m.e = c.e AND m.i = c.i)"""
    tables = [t for k in range(rounds) for t in (near.format(k=k), mean.format(k=k, n=k + 1))]
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS z, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r
  FROM embeddings WHERE len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
x AS (SELECT r, (j - 1) // (len(z) // 8) AS p, (j - 1) % (len(z) // 8) AS i, z[j] AS v FROM (SELECT r, z, unnest(range(1, len(z) + 1)) AS j FROM k)),
c0 AS (SELECT p, r - 1 AS e, i, v FROM x WHERE r <= 16),
{", ".join(tables)}, {near.format(k=rounds)},
f AS (SELECT r, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c{rounds})
SELECT k.vec_id, f.code, f.error, (sum(f.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.codebooks_sha256 FROM k JOIN f ON f.r = k.r CROSS JOIN h
"""


SQL = _sql(Settings.rounds)
