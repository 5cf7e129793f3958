"""SimHash near-dedup by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.graph import Forest, components
from ledgerleaf.llm.scratch import written
from ledgerleaf.llm.streams import groups
from ledgerleaf.llm.textbytes import mixed, trim
from ledgerleaf.llm.verified import verified

SEED = 42
#: Bits in which the first halves of two wide fingerprints may differ: at a similarity of 0.8, 19 do, give or take 4.
HALF = 40


def fingerprint(text: bytes, words: int) -> bytes:
    """The bytes, highest first, of a text's fingerprint of 64 bits; no word: zeros."""
    found = text.lower().split()
    if not found:
        return bytes(8)
    joined = b" ".join(found)
    if len(found) < words:
        shingles = [joined]
    else:
        size = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(size + 1) - 1
        shingles = [joined[s:e] for s, e in zip((ends - size).tolist(), ends[words - 1 :].tolist(), strict=False)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65_536):
        some = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles[at : at + 65_536], repeat(SEED))), np.uint8).reshape(-1, 8)
        total += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(shingles)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long): bit by bit the majority over XXH64 (seed 42) of each word shingle, repeats included,
    of the text with A-Z in lower case. A null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = b"".join(fingerprint(t.as_py() or b"", words) for t in texts)
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def parts_for(n: int) -> int:
    """Into how many equal parts to cut a fingerprint, so that a cell of equal population counts keeps few of n fingerprints."""
    return 4 if n < 4_000_000 else 8 if n < 1_000_000_000 else 16


def steps(parts: int, radius: int, width: int) -> list[int]:
    """How a cell's number changes to each cell whose population counts differ by radius in all, one of each two opposite ways."""
    found = [()]
    for _ in range(parts):
        found = [(*x, d) for x in found for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [sum(d << (width * i) for i, d in enumerate(x)) for x in found if any(x) and next(d for d in x if d) > 0]


def compare(batches: Iterator[pa.RecordBatch], radius: int, tile: int = 1024) -> Iterator[pa.RecordBatch]:
    """Of each group's fingerprints, all pairs of roles 0-0, 0-1 or 0-2 within the radius, as links that span what they join.
    Role 0: one tile of the cell; 1: another tile of it; 2: a neighbouring cell's fingerprints."""
    for table in groups(batches, "task"):
        fp = table.column("fp").to_numpy().astype(np.uint64)
        node, role = table.column("id").to_numpy(), table.column("role").to_numpy()
        order = np.argsort(role, kind="stable")
        fp, node = fp[order], node[order]
        home = int((role == 0).sum())
        forest = Forest(len(fp))
        for i in range(0, home, tile):
            mine = fp[i : min(i + tile, home)]
            inner = not (role == 1).any()
            for j in range(i if inner else home, len(fp), 2 * tile):
                near = np.bitwise_count(mine[:, None] ^ fp[None, j : j + 2 * tile]) <= radius
                a, b = np.nonzero(near)
                forest.join(a + i, b + j)
        a, b = forest.links()
        if len(a):
            yield pa.record_batch([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], names=["src", "dst"])


def near_links(prints: DataFrame, radius: int = 2, cell_rows: int = 20_000) -> DataFrame:
    """Links (src, dst) that join every two rows of prints (id, fp), fp distinct, within the radius.

    Fingerprints of equal population counts in each of their parts form a cell. Two within the radius lie in
    cells whose counts differ by the radius at most; other pairs of cells are never compared. A cell of more than
    cell_rows fingerprints is cut into tiles, and each pair of its tiles is a task of its own."""
    parts = parts_for(prints.count())
    size, width = 64 // parts, {4: 5, 8: 4, 16: 3}[parts]
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", size * i).bitwiseAND(F.lit((1 << size) - 1))).cast("long") * F.lit(1 << (width * i)) for i in range(parts)), F.lit(0).cast("long"))
    home = prints.select("id", "fp", cell.alias("cell"))
    large = home.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("tiles")).where("tiles > 1")
    probes = home.select("id", "fp", F.explode(F.array(*[F.col("cell") + F.lit(s) for s in steps(parts, radius, width)])).alias("cell"), F.lit(2).alias("role"))
    rows = home.select("id", "fp", "cell", F.lit(0).alias("role")).unionByName(probes).join(large, "cell", "left")
    tiles = F.coalesce("tiles", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), tiles)
    rows = rows.select(
        "id", "fp", "cell",
        F.explode(
            F.when(F.col("role") == 2, F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(t.cast("long").alias("i"), t.cast("long").alias("j"), F.lit(2).alias("role"))))
            .otherwise(F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(mine, t.cast("long")).alias("i"), F.greatest(mine, t.cast("long")).alias("j"), F.when(mine <= t, 0).otherwise(1).alias("role"))))
        ).alias("t"),
    )
    tasks = rows.select(F.xxhash64("cell", "t.i", "t.j").alias("task"), "id", "fp", F.col("t.role").alias("role"))
    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: compare(b, radius), "src long, dst long")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row of docs. component_id: the smallest id reachable by links between
    fingerprints that differ in `radius` bits or fewer; equal fingerprints link.

    Null and blank texts have fingerprint 0 and link like any other. Repeated ids and repeated rows each get a
    row. A row with a null id links with nothing: its component_id is null."""
    prints = written(fingerprints(docs, id_col, text_col, words), "prints")
    distinct = written(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    found = components(near_links(distinct, radius), spanning_already=True)
    of = distinct.join(found, "id", "left").select("fp", F.coalesce("component_id", "id").alias("component_id"))
    return prints.join(of, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


# ---- wide fingerprints, for similarity instead of copies ----


def shingle_set(text: bytes, words: int) -> tuple[list[bytes], np.ndarray]:
    """A text's distinct shingles and their 64-bit hashes in order, A-Z in lower case; a text of fewer words is one shingle."""
    found = text.lower().split()
    if not found:
        return [], np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    shingles = list({joined[s:e] for s, e in zip(starts.tolist(), last.tolist(), strict=False)})
    return shingles, np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, shingles, repeat(SEED))), np.uint64))


def wide_fingerprint(text: bytes, words: int) -> tuple[bytes, int]:
    """256 bits, each the majority over the text's distinct shingles, and a 64-bit sum that tells sets of shingles apart."""
    shingles, hashes = shingle_set(text, words)
    if not shingles:
        return bytes(32), 0
    total = np.zeros(256, np.int64)
    for at in range(0, len(shingles), 65_536):
        some = [np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles[at : at + 65_536], repeat(seed))), np.uint8).reshape(-1, 16) for seed in (SEED, SEED + 1)]
        total += np.unpackbits(np.concatenate(some, axis=1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(shingles)).tobytes(), int(mixed(hashes).sum(dtype=np.uint64).astype(np.int64))


def jaccard_at_least(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, as sorted arrays, share at least `least` of what they hold together."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < least * len(large) - 1e-9:
        return False
    if not len(large):
        return True
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def packed_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tile, with its fingerprints and ids as two blobs, so that a tile meets others as one row."""
    for table in groups(batches, "tile"):
        fps, ids = b"".join(table.column("fp").to_pylist()), table.column("id").to_numpy().tobytes()
        yield pa.record_batch([pa.array([table.column("tile")[0].as_py()], pa.int64()), pa.array([fps], pa.binary()), pa.array([ids], pa.binary())], names=["tile", "fps", "ids"])


def compare_wide(batches: Iterator[pa.RecordBatch], words: int, radius: int, block: int = 512) -> Iterator[pa.RecordBatch]:
    """All pairs of two tiles (roles 0 and 1), or of one with itself, within the radius, as links that span what they join. Two
    64-bit words of a fingerprint, that may differ in HALF bits, rule out nearly all pairs; the others are counted in full."""
    for table in groups(batches, "task"):
        rows = sorted(zip(table.column("role").to_pylist(), table.column("fps").to_pylist(), table.column("ids").to_pylist(), strict=True), key=lambda r: r[0])
        fp = np.concatenate([np.frombuffer(r[1], np.uint64).reshape(-1, words) for r in rows])
        node = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows])
        home = len(rows[0][2]) // 8
        forest, other = Forest(len(fp)), len(rows) > 1
        columns = [np.ascontiguousarray(fp[:, w]) for w in range(words)]
        for i in range(0, home, block):
            top = min(i + block, home)
            for j in range(home if other else i, len(fp), 2 * block):
                near = sum(np.bitwise_count(c[i:top, None] ^ c[None, j : j + 2 * block]) for c in columns[:2])
                a, b = np.nonzero(near <= min(radius, HALF))
                a, b = a + i, b + j
                full = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= radius
                forest.join(a[full], b[full])
        a, b = forest.links()
        if len(a):
            yield pa.record_batch([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], names=["src", "dst"])
        trim()


def tile_plan(counts: dict[int, int], radius: int, tile_rows: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of fingerprints in order of population count, (lowest, highest count, first tile, tiles, last tile that theirs meet):
    tiles of about tile_rows fingerprints, which meet those whose counts come within the radius. There are 257 runs at most."""
    runs: list[list[int]] = []
    for c in sorted(counts):
        if runs and runs[-1][2] + counts[c] <= tile_rows:
            runs[-1][1], runs[-1][2] = c, runs[-1][2] + counts[c]
        else:
            runs.append([c, c, counts[c]])
    many = [max(1, -(-n // tile_rows)) for _, _, n in runs]
    first = [sum(many[:i]) for i in range(len(runs))]
    last = [max(first[j] + many[j] - 1 for j in range(i, len(runs)) if runs[j][0] - runs[i][1] <= radius) for i in range(len(runs))]
    return [(lo, hi, f, m, t) for (lo, hi, _), f, m, t in zip(runs, first, many, last, strict=True)]


def near_groups(docs: DataFrame, id_col: str, text_col: str = "text", words: int = 5, radius: int = 56, least: float = 0.8, tile_rows: int = 20_000) -> DataFrame:
    """(id, component_id) of every row of docs with a unique id, linked where the sets of word shingles have a Jaccard similarity
    of `least` or more. Wide fingerprints that differ in `radius` bits or fewer only find the candidates: each link is verified on
    the exact sets. Null, empty and blank texts are alike, and a text of fewer words is one shingle. Other columns are left out.

    Of sets of shingles with the cosine c, each bit differs with probability arccos(c) / pi. A similarity of 0.8 is a cosine of
    0.89: 39 of 256 bits, give or take 6. Unrelated texts differ in 128, give or take 8. What candidates join is a group,
    in which links are verified tile by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t.as_py() or b"", words) for t in batch.column(1).cast(pa.large_binary())]
            counts = [int.from_bytes(x).bit_count() for x, _ in found]
            yield pa.record_batch([batch.column(0), pa.array([x for x, _ in found], pa.binary()), pa.array(counts, pa.int32()), pa.array([y for _, y in found], pa.int64())], names=["id", "fp", "n", "sum"])
            trim()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fp + shingle_set(t.as_py() or b"", words)[1].tobytes() for fp, t in zip(batch.column(2).to_pylist(), batch.column(3).cast(pa.large_binary()), strict=True)]
            yield pa.record_batch([*batch.columns[:2], pa.array(found, pa.binary())], names=["id", "group", "payload"])
            trim()

    def load(payloads: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.frombuffer(b"".join(p[:32] for p in payloads), np.uint64).reshape(-1, 4), [np.frombuffer(p, np.uint64, offset=32) for p in payloads]

    def near(state: tuple[np.ndarray, list[np.ndarray]], first: np.ndarray, second: np.ndarray) -> np.ndarray:
        fp, members = state
        out = np.bitwise_count(fp[first] ^ fp[second]).sum(1, dtype=np.int64) <= radius
        for k in np.flatnonzero(out).tolist():
            out[k] = jaccard_at_least(members[int(first[k])], members[int(second[k])], least)
        return out

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = written(texts.mapInArrow(run, "id long, fp binary, n int, sum long"), "wide")
    distinct = written(prints.groupBy("fp", "n", "sum").agg(F.min("id").alias("id")), "distinct")
    runs = tile_plan({r.n: r["count"] for r in distinct.groupBy("n").count().collect()}, radius, tile_rows)
    of = F.lit(-1).cast("long")
    for low, high, first, many, _ in runs:
        of = F.when(F.col("n").between(low, high), F.lit(first) + F.pmod(F.xxhash64("id"), F.lit(many))).otherwise(of)
    # a tile's pairs are listed by Spark, not by the driver
    plan = docs.sparkSession.createDataFrame([(f, m, t) for _, _, f, m, t in runs], "first long, many long, last long")
    pairs = plan.select("last", F.explode(F.expr("sequence(first, first + many - 1)")).alias("i")).select("i", F.explode(F.expr("sequence(i, last)")).alias("j"))
    both = F.array(F.struct(F.col("i").alias("tile"), F.lit(0).alias("role")), F.struct(F.col("j").alias("tile"), F.lit(1).alias("role")))
    tasks = pairs.select(F.xxhash64("i", "j").alias("task"), F.explode(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)).alias("t")).select("task", "t.tile", "t.role")
    packed = distinct.select("id", "fp", of.alias("tile")).repartition("tile").sortWithinPartitions("tile").mapInArrow(packed_tiles, "tile long, fps binary, ids binary")
    met = written(packed, "tiles").join(tasks, "tile").select("task", "role", "fps", "ids")
    candidates = components(met.repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: compare_wide(b, 4, radius), "src long, dst long"), spanning_already=True)
    member = written(distinct.join(candidates, "id").select("id", F.col("component_id").alias("group"), "fp"), "candidates")
    members = texts.join(member, "id").select("id", "group", "fp", "text").mapInArrow(sets, "id long, group long, payload binary")
    joined = distinct.join(verified(members, load, near), "id", "left").select("fp", "sum", F.coalesce("component_id", "id").alias("component_id"))
    return prints.join(joined, ["fp", "sum"]).select("id", "component_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedupe(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
