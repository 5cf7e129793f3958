import numpy as np

from ledgerleaf.llm import embeddings
from ledgerleaf.llm.graph import Forest


def brute(ids, x, least=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    order = np.argsort(ids)
    forest = Forest(len(ids))
    a, b = np.nonzero(near[np.ix_(order, order)])
    forest.join(a, b)
    comp = np.empty(len(ids), np.int64)
    comp[order] = np.array(ids)[order][forest.label]
    return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), comp)}


def test_recall_and_precision(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((700, 32))
    close = base[rng.integers(0, 60, 500)] + 0.35 * rng.standard_normal((500, 32))
    x = np.concatenate([base, close, base[:50]])
    ids = list(range(len(x)))
    want = brute(ids, x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    for tile in (4096, 64):
        got = {r.id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, settings=embeddings.Settings(leaf_rows=64, sample=400, tile_rows=tile)).collect()}
        assert all(got[i][0] <= want[i][0] for i in ids)
        assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
        assert np.mean([got[i][1] == want[i][1] for i in ids]) > 0.95


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, []), (11, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, n int, leaf string")
    got = sorted((r.id is None, r.id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    alone = [(False, i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)]
    linked = [(False, 1, 3, 1, True), (False, 2, 3, 1, False), (False, 3, 3, 1, False), (False, 3, 3, 1, False)]
    assert got == sorted([*alone, *linked, (True, 0, 0, None, True)], key=str) or sorted(got, key=str) == sorted([*alone, *linked, (True, 0, 0, None, True)], key=str)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def near_pairs(seed, n, dims, crowd):
    """n random vectors, as many again at a cosine of 0.90 to 0.93 from one of them, and a crowd of near copies of one."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((n, dims))
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.93, (n, 1))
    return np.concatenate([base, c * base + np.sqrt(1 - c * c) * off, base[:1] + 0.01 * rng.standard_normal((crowd, dims))])


def link_ends(x, least=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(x[i : i + 1000] @ x.T >= least).sum(1) for i in range(0, len(x), 1000)]) - 1


def recall(spark, x, settings):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    want = link_ends(x)
    got = {r.id: r.n_links for r in embeddings.near_duplicates(df, settings=settings).collect()}
    assert all(got[i] <= want[i] for i in range(len(x)))
    return sum(got.values()) / want.sum(), sum(got[i] for i in range(1, 2 * len(x) // 5)) / max(1, want[1 : 2 * len(x) // 5].sum())


def test_recall_at_the_defaults_on_close_pairs(spark):
    assert min(recall(spark, near_pairs(2, 9000, 64, 2000), embeddings.Settings())) >= 0.97


def test_recall_below_few_top_leaves_and_in_tiled_crowds(spark):
    x = near_pairs(3, 2000, 48, 900)
    assert min(recall(spark, x, embeddings.Settings(sample=1000, top_leaves=6, leaf_rows=64, tile_rows=128))) >= 0.9


def test_trees_do_not_grow_with_the_vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (10_000, 10_000_000, 10_000_000_000):
        tree = embeddings.grown(x, n, 0.9, 0.03, embeddings.Settings(), np.random.default_rng(1))
        assert len(tree.levels) <= 1024 and len(tree.below) <= embeddings.DEEP
    row, leaf = tree.route(x[:50], 0.03)
    assert set(row) == set(range(50)) and len(set(zip(row.tolist(), leaf.tolist()))) == len(row)


def test_sql_gives_the_same_on_groups(spark, tmp_path):
    import duckdb

    x = near_pairs(6, 60, 16, 12)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(500, None), (501, [0.0] * 16), (502, x[0].tolist()), (503, x[0].tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    cursor = con.execute(embeddings.SQL)
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in cursor.fetchall())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.op3_embedding_near_dedup(spark, str(tmp_path)).collect())
    assert got == want and sum(g[1] for g in got) > 300
