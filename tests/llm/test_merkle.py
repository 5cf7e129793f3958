import hashlib
import random
import zlib

import duckdb
import pytest

from helpers import odd
from ledgerleaf.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """The root, and of each node its siblings to the left and right, level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append((run[: i % 8], run[i % 8 + 1 :]))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    own = {t: sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for t in order}
    climbed = {t: climb([leaf(r) for r in own[t]]) for t in order}
    root, above = climb([climbed[t][0] for t in order])
    out = []
    for t, upper in zip(order, above):
        subroot, paths = climbed[t]
        for row, path in zip(own[t], paths):
            path = path + upper
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            x = leaf([*row[:4], lowered(row[4]) if tampered else row[4]])
            for left, right in path:
                x = H(*left, x, *right)
            out.append((row[0], leaf(row), subroot, root, H(*[s for left, right in path for s in left + right]), x, x == root))
    return sorted(out, key=repr)


def run(spark, df, levels):
    from pyspark.sql import functions as F

    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    out = merkle.manifest(df, COLUMNS, presented=merkle.digest([shown if c == "text" else F.col(c) for c in COLUMNS]), levels=levels)
    rows = out.select("id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")), merkle.folded(F.col("presented"), F.col("path")).alias("f")).collect()
    return sorted((tuple(r) + (r.f == r.root,) for r in rows), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, i long, block string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 5, "b", "d") for r in rows], SCHEMA)


def made(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", None, "é"]), lang, rng.choice([None, i]), rng.choice([None, "", "Ab C é", "x" * 3000, f"Text {i}"])) for lang, n in sizes.items() for i in rng.sample(range(10 * n + 10), n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_equal_to_brute_force_on_trees_of_many_sizes(spark, levels):
    """Blocks of 8 and 64 leaves make up to four stages of blocks; the tree over the subroots has two levels."""
    rows = made({None: 9, "": 1, "de": 8, "en": 600, "es": 65, "fr": 64, "Z": 2, "é": 7, "zh": 513, "x1": 1, "x2": 72})
    assert run(spark, table(spark, rows), levels) == brute(rows)


def test_one_tree_and_one_row(spark):
    for rows in (made({"en": 1}), made({"en": 9}), made({None: 5000})):
        assert run(spark, table(spark, rows), 4) == brute(rows)


def test_repeated_rows_ids_and_odd_texts(spark):
    rows = [(7, "s", "en", 3, "Same")] * 20 + [(7, "s", "en", 3, f"other {i}") for i in range(5)] + [(None, None, "en", None, None)] * 2 + [(None, None, None, None, None), (1, "", "", 0, "")]
    assert run(spark, table(spark, rows), 1) == brute(rows)
    df = odd(spark)
    want = brute([tuple(r[c] for c in COLUMNS) for r in df.collect()])
    assert run(spark, df, 4) == want


def test_empty_table(spark):
    assert run(spark, table(spark, []), 4) == []


def test_traversal_keeps_few_nodes():
    """Waiting nodes and runs grow with the levels, not with the leaves."""
    leaves = [str(i) for i in range(8**4)]
    held = []
    original = merkle.Treehash.push

    def push(self, node):
        original(self, node)
        held.append(sum(map(len, self.waiting)) + len(self.run))

    merkle.Treehash.push = push
    try:
        paths = list(merkle.traversal(leaves, 4))
    finally:
        merkle.Treehash.push = original
    assert max(held) <= 4 * 8 and len(paths) == 8**4
    root, want = climb(leaves)
    assert merkle.treehash(leaves, 4) == [root]
    assert paths == [[("".join(a), "".join(b)) for a, b in p] for p in want]


def test_sql_gives_the_same(spark, tmp_path):
    rows = made({None: 3, "de": 8, "en": 90, "es": 1, "fr": 64, "it": 2, "nl": 3, "pl": 4, "pt": 5, "sv": 1})
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.SQL})").fetchall()
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) == brute(rows)
    assert 0 < sum(g[-1] for g in got) < len(got)
