"""A Merkle manifest of a dataset, with an inclusion proof for every row.

Rows of one tree are numbered in order by a range sort, and cut into aligned blocks of whole subtrees. In a block, each level keeps the run
of siblings that the present leaf's path needs, and a treehash stack that makes the level's next run, one leaf a step (Merkle's traversal
schedule): memory is a few runs and stacks, whatever the block. Blocks' roots are leaves of the next stage, and a block's shared upper path
is appended to the paths of its leaves. The trees' roots are the leaves of a tree of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import written
from ledgerleaf.llm.streams import groups

ARITY = 8
BLOCK_LEVELS = 4  # a block has 8 ** 4 leaves
TASK_ROWS = 1_000_000  # of leaves, each about 150 bytes
PATH = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row: of each column `-` if null, else its length in bytes, `:` and its value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """A stack that takes leaves one by one and makes the nodes `level` levels above them: fewer than ARITY nodes wait on each level."""

    def __init__(self, level: int):
        self.waiting: list[list[str]] = [[] for _ in range(level)]
        self.run: list[str] = []

    def push(self, node: str) -> None:
        for nodes in self.waiting:
            nodes.append(node)
            if len(nodes) < ARITY:
                return
            node = parent(nodes)
            nodes.clear()
        self.run.append(node)

    def close(self) -> list[str]:
        """The run, when no more leaves come: what waits becomes nodes of fewer children."""
        node = None
        for nodes in self.waiting:
            if node is not None:
                nodes.append(node)
            node = parent(nodes) if nodes else None
            nodes.clear()
        if node is not None:
            self.run.append(node)
        return self.run


def treehash(leaves: Sequence[str], level: int) -> list[str]:
    stack = Treehash(level)
    for leaf in leaves:
        stack.push(leaf)
    return stack.close()


def traversal(leaves: Sequence[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """Of each leaf in turn, the siblings to the left and to the right of its path on each level."""
    span = [ARITY ** (h + 1) for h in range(levels)]
    runs = [treehash(leaves[: span[h]], h) for h in range(levels)]
    ahead, cursor = [Treehash(h) for h in range(levels)], list(span)
    path = [("", "".join(run[1:])) for run in runs]
    for j in range(1, len(leaves) + 1):
        yield list(path)
        for h in range(levels):
            if cursor[h] < len(leaves):
                ahead[h].push(leaves[cursor[h]])
                cursor[h] += 1
            if j % span[h] == 0:
                runs[h], ahead[h], cursor[h] = ahead[h].close(), Treehash(h), j + span[h]
            if j % (span[h] // ARITY) == 0:
                at = j // (span[h] // ARITY) % ARITY
                path[h] = ("".join(runs[h][:at]), "".join(runs[h][at + 1 :]))


def height(n: int, levels: int) -> int:
    """Levels from the leaves of a block to its root: all of them, but for the only block of a tree, whose root is where one node is left."""
    h = 0
    while h < levels and ARITY**h < n:
        h += 1
    return h


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes with i, a node's place in its tree (from 0), and n, the nodes of its tree. order: columns that no two nodes of a tree share.
    Ranges of all trees' nodes are sorted apart; a range's first place is the sum of the counts before it, a row for each range and tree."""
    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // TASK_ROWS))
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the row within it below
    rows = written(nodes.repartitionByRange(tasks, "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", at), "sorted").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("n"))
    return rows.join(parts, ["tree", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def block_key(block: int) -> Column:
    return F.concat_ws("/", F.floor(F.col("i") / block).cast("string"), "tree")


def raised(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, i, digest, n): the roots of the blocks of nodes (tree, i, digest, n)."""
    block = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "block"):
            tree, i, n = (table.column(c)[0].as_py() for c in ("tree", "i", "n"))
            root = treehash(table.column("digest").to_pylist(), height(n, levels))[0]
            yield pa.record_batch([pa.array([tree]), pa.array([i // block]), pa.array([root]), pa.array([-(-n // block)])], names=["tree", "i", "digest", "n"])

    own = nodes.select("tree", "i", "digest", "n", block_key(block).alias("block"))
    return own.repartition("block").sortWithinPartitions("block", "i").mapInArrow(run, "tree string, i long, digest string, n long")


def stages(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame | None]:
    """nodes, the roots of their blocks, the roots of those, and so on; and (tree, root, stage): each tree's root and the stage that made it."""
    found, roots = [nodes], None
    while True:
        blocks = written(raised(found[-1], levels), "blocks")
        done = blocks.where("n = 1").select("tree", F.col("digest").alias("root"), F.lit(len(found) - 1).alias("stage"))
        roots = done if roots is None else roots.unionByName(done)
        if (blocks.agg(F.max("n")).first()[0] or 0) <= 1:
            return found, roots
        found.append(blocks.where("n > 1"))


def with_paths(nodes: DataFrame, heads: DataFrame, levels: int) -> DataFrame:
    """(carried, tree, i, digest, root, path) of nodes (carried, tree, i, digest, n). heads: (block, root, path) for each block, the tree's
    root and the path of the block's own root; a row of a block's before its nodes, so that a node meets no path in a join."""
    block = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "block"):
            head, own = table.slice(0, 1), table.slice(1).combine_chunks()
            upper, root = head.column("path")[0].as_py(), head.column("digest")[0].as_py()
            up_left, up_right = [x["left"] for x in upper], [x["right"] for x in upper]
            count, high = own.num_rows, height(own.column("n")[0].as_py(), levels)
            wide = high + len(upper)
            left, right, at = [], [], 0
            for k, path in enumerate(traversal(own.column("digest").to_pylist(), high), 1):
                left += [x[0] for x in path] + up_left
                right += [x[1] for x in path] + up_right
                if k == count or k % 512 == 0:
                    runs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
                    paths = pa.ListArray.from_arrays(pa.array(np.arange(k - at + 1) * wide, pa.int32()), runs)
                    some = own.slice(at, k - at)
                    yield from pa.table({**{c: some.column(c) for c in ("carried", "tree", "i", "digest")}, "root": pa.array([root] * (k - at)), "path": paths}).combine_chunks().to_batches()
                    left, right, at = [], [], k

    kind = nodes.schema["carried"].dataType.simpleString()
    head = heads.select(F.lit(None).cast(kind).alias("carried"), F.lit(None).cast("string").alias("tree"), F.lit(-1).cast("long").alias("i"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("n"), "block", "path")
    own = nodes.select("carried", "tree", "i", "digest", F.col("n").cast("long").alias("n"), block_key(block).alias("block"), F.lit(None).cast(PATH).alias("path"))
    return own.unionByName(head).repartition("block").sortWithinPartitions("block", "i").mapInArrow(run, f"carried {kind}, tree string, i long, digest string, root string, path {PATH}")


def authenticated(found: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """with_paths of the first of `found` (see stages). tops: (tree, root, stage, path), the path of each tree's own root."""
    kind, below = found[0].schema["carried"].dataType.simpleString(), None
    for s in range(len(found) - 1, -1, -1):
        heads = tops.where(F.col("stage") == s).select(F.concat(F.lit("0/"), "tree").alias("block"), "root", "path")
        if below is not None:
            heads = heads.unionByName(below.select(F.concat_ws("/", F.col("i").cast("string"), "tree").alias("block"), "root", "path"))
        if not s:
            return with_paths(found[0], heads, levels)
        below = written(with_paths(found[s].withColumn("carried", F.lit(None).cast(kind)), heads, levels), "paths")
    raise AssertionError("no stages")


def manifest(rows: DataFrame, columns: Sequence[str], id_col: str = "doc_id", tree_col: str = "lang", presented: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(id, leaf, presented, subroot, root, path) of every row. leaf: the digest of `columns`, in that order. A tree holds the rows of one
    value of tree_col (null is a value) by id, nulls first and equal ids by leaf; its root is subroot. root: of the tree over all subroots,
    by tree_col (null first, bytewise). path: on each level, the siblings' digests to the left and to the right of the path. presented: the
    digest that is later shown as the row's leaf, an expression over rows; the leaf itself where none is given.

    Rows that repeat an id, or a whole row, are leaves of their own. Empty texts have a length of 0. Texts of any length are hashed where
    they are read and never shuffled. Of an empty table, no rows. Other columns of rows, whatever their names, play no part."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    leaf = digest([F.col(c) for c in columns])
    leaves = rows.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf.alias("digest"), (leaf if presented is None else presented).alias("presented"))
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    nodes = numbered(leaves, ["id", "digest", "row"]).withColumn("carried", F.struct("id", "presented"))
    found, roots = stages(nodes, levels)
    above = roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"), F.col("stage").alias("of_stage"))
    above = numbered(above, ["of"]).withColumn("carried", F.struct("of", "of_stage"))
    higher, top = stages(above, levels)
    tops = written(authenticated(higher, top.withColumn("path", F.array().cast(PATH)), levels), "subroots")
    out = authenticated(found, tops.select(F.col("carried.of").alias("tree"), F.col("digest").alias("root"), F.col("carried.of_stage").alias("stage"), "path"), levels)
    last = top.select("root").first()
    return out.select("carried.id", F.col("digest").alias("leaf"), "carried.presented", F.col("root").alias("subroot"), F.lit(last.root if last else None).cast("string").alias("root"), "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    shown = digest([tampered if c == "text" else F.col(c) for c in columns])
    out = manifest(docs, columns, presented=shown)
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded(F.col("presented"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE d AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r,
  list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
e AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS t FROM d),
f AS (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS p FROM e),
l AS (SELECT doc_id, r, lang, sha256(p || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(p || coalesce(strlen(t) || ':' || t, '-')) AS shown FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
a AS (SELECT lang, 0 AS h, i, n, leaf AS x FROM k UNION ALL SELECT lang, h + 1, i // 8, (n + 7) // 8, sha256(string_agg(x, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY lang, h, i // 8, n),
s AS (SELECT lang, h AS top, x AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS h, i, n, subroot AS x FROM s UNION ALL SELECT h + 1, i // 8, (n + 7) // 8, sha256(string_agg(x, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY h, i // 8, n),
w AS (SELECT k.r, a.h, a.i, a.x, k.i // (8 ** a.h)::BIGINT AS own FROM k JOIN a ON a.lang IS NOT DISTINCT FROM k.lang AND a.n > 1 AND a.i // 8 = k.i // (8 ** (a.h + 1))::BIGINT
  UNION ALL SELECT k.r, s.top + b.h, b.i, b.x, s.i // (8 ** b.h)::BIGINT FROM k JOIN s ON s.lang IS NOT DISTINCT FROM k.lang JOIN b ON b.n > 1 AND b.i // 8 = s.i // (8 ** (b.h + 1))::BIGINT),
q AS (SELECT r, h, coalesce(string_agg(x, '' ORDER BY i) FILTER (i < own), '') AS lo, coalesce(string_agg(x, '' ORDER BY i) FILTER (i > own), '') AS hi FROM w GROUP BY r, h),
g AS (SELECT r, 0 AS h, shown AS x FROM k UNION ALL SELECT g.r, g.h + 1, sha256(concat(q.lo, g.x, q.hi)) FROM g JOIN q ON q.r = g.r AND q.h = g.h),
z AS (SELECT r, arg_max(x, h) AS folded_root FROM g GROUP BY r),
o AS (SELECT r, sha256(string_agg(lo || hi, '' ORDER BY h)) AS proof FROM q GROUP BY r),
t AS (SELECT x AS root FROM b WHERE n = 1)
SELECT k.doc_id, k.leaf, s.subroot, t.root, coalesce(o.proof, sha256('')) AS proof_sha256, z.folded_root, z.folded_root = t.root AS verified
FROM k JOIN s ON s.lang IS NOT DISTINCT FROM k.lang CROSS JOIN t JOIN z ON z.r = k.r LEFT JOIN o ON o.r = k.r
"""
