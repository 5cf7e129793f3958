import numpy as np
import pyarrow.dataset as ds
import pytest

from ledgerleaf.llm import scan


def dot(a, b):
    s = 0.0
    for u, v in zip(a, b):
        s += u * v
    return s


def brute(rows, k=20, every=20):
    """{query: [(id, score)]} with plain loops; rows: (id, vector)."""
    out = {}
    for i, q in rows:
        if i % every == 0:
            out[i] = sorted(((j, dot(q, x)) for j, x in rows if j != i), key=lambda h: (-h[1], h[0]))[:k]
    return out


def found(df, **more):
    out = {}
    for r in sorted(scan.search(df, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.id, r.score))
    return out


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, x, 3, 1, 2, [1], "r", 0.5) for i, x in rows], f"vec_id long, embedding array<{kind}>, label int, id int, cid int, ids array<int>, rank string, score double")


def recall(got, want):
    return np.mean([len({h[0] for h in got.get(q, [])} & {h[0] for h in w}) / max(1, len(w)) for q, w in want.items()])


def scores_are_exact(got, rows):
    vectors = dict(rows)
    for q, hits in got.items():
        assert all(s == dot(vectors[q], vectors[j]) for j, s in hits)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0])) and q not in {h[0] for h in hits}


def test_recall_on_given_vectors(spark):
    """Of sf0.1, against brute force; scores are exact and every query has 20."""
    given = ds.dataset("/root/testdata/sf0.1/embeddings.parquet").to_table()
    rows = list(zip(given.column("vec_id").to_pylist(), given.column("embedding").to_pylist()))
    got, want = found(table(spark, rows)), brute(rows)
    assert set(got) == set(want) and all(len(h) == 20 for h in got.values())
    scores_are_exact(got, rows)
    assert recall(got, want) >= 0.93


@pytest.mark.parametrize("settings", [scan.Settings(), scan.Settings(lists=7, tile_rows=64, split_queries=10, chunk=32, columns=4)])
def test_recall_of_clusters_with_unequal_norms(spark, settings):
    """Norms over three magnitudes, many tiles and splits of queries."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24)) * 10 ** rng.uniform(-2, 1, (1500, 1)) + 3 * rng.standard_normal((30, 24))[rng.integers(0, 30, 1500)]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got, want = found(table(spark, rows), settings=settings), brute(rows)
    scores_are_exact(got, rows)
    assert set(got) == set(want) and recall(got, want) >= 0.93 and min(map(len, got.values())) == 20


def test_crowds_of_copies_and_ties(spark):
    """A third of all rows are one vector: its smallest ids rank, and each copy that asks drops itself."""
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(400)] + [(400 + i, v) for i, v in enumerate((rng.standard_normal((800, 4)) / 9).tolist())]
    rng.shuffle(rows)
    rows = [(int(i), list(map(float, v))) for i, v in rows]
    got, want = found(table(spark, rows)), brute(rows)
    scores_are_exact(got, rows)
    assert recall(got, want) >= 0.95
    for q in range(0, 400, 20):
        assert [h[0] for h in got[q]] == [i for i in range(21) if i != q][:20]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (40, None), (4, [0.0, 0.0]), (60, [0.0, -0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (80, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, []), (1, [0.5, 0.5]), (-20, [-1.0, 0.0])]
    got = found(table(spark, rows))
    assert got == {0: [(1, 0.5), (2, 0.5), (20, 0.0), (-20, -1.0)], 20: [(1, 0.5), (2, 0.5), (-20, 0.0), (0, 0.0)], -20: [(20, 0.0), (1, -0.5), (2, -0.5), (0, -1.0)]}


def test_an_id_of_two_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])]
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in scan.search(table(spark, rows)).collect())
    assert got == [(20, 1, 1, 1.0), (20, 1, 2, 2.0), (20, 2, 1, 1.0), (20, 2, 2, 0.0)]


def test_stated_queries_and_empty_tables(spark):
    rows = [(1, [1.0]), (2, [2.0]), (3, [-1.0])]
    assert found(table(spark, rows), asked=spark.createDataFrame([(1,), (9,)], "id long"), k=1) == {1: [(2, 2.0)]}
    assert found(table(spark, rows)) == {}
    assert found(table(spark, [])) == {} == found(table(spark, [(20, None)])) == found(table(spark, [(20, [1.0])]))


def test_tests_abandon_candidates_and_keep_neighbours():
    """Most pairs are dropped before they are scored, and at most one neighbour in a hundred."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 96))
    settings = scan.Settings()
    index = scan.fitted(x[:2000], len(x), 20, settings)
    tile = scan.Tile(x[:4000], index, settings)
    q = rng.standard_normal((300, 96))
    s = q @ x[:4000].T
    least = np.sort(s, axis=1)[:, -40]
    row, at, score = tile.scan(q, least, 20)
    want = np.argsort(-s, axis=1)[:, :20]
    have = [set(at[row == i]) for i in range(len(q))]
    assert np.mean([len(have[i] & set(want[i])) / 20 for i in range(len(q))]) > 0.99
    assert np.allclose(score, s[row, at]) and tile.scored < 0.1 * s.size
