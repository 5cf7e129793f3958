import hashlib
import math

import duckdb
import numpy as np
import pytest

from ledgerleaf.llm import codes


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label); with Python's own integers."""
    kept = [(i, [math.floor(4096 * v) for v in x], lab) for i, x, lab in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(kept[0][1]) // parts
    cut = [[x[p * wide : (p + 1) * wide] for p in range(parts)] for _, x, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    near = lambda part, book: min((dist(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            at = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a == k]
                if own:
                    new[p][k] = [sum(col) // len(own) for col in zip(*own)]
        books = new
    out = []
    for (i, _, lab), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = {lab: sum(o[3] for o in out if o[1] == lab) for lab in {o[1] for o in out}}
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, code, error, total[lab], sha) for i, lab, code, error in out), key=repr)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, x, lab, 1, [2], "c", 3, 4) for i, x, lab in rows], f"vec_id long, embedding array<{kind}>, label int, id int, x array<int>, code string, error int, entry int")


def op11(spark, rows, folder, kind="float"):
    vectors(spark, rows, kind).write.parquet(f"{folder}/embeddings.parquet")
    return sorted((tuple(r) for r in codes.op11_vector_codes(spark, str(folder)).collect()), key=repr)


def random_rows(n, dims=64, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dims)) / 8).astype(np.float32).tolist()
    return [(int(i), v, None if k % 11 == 0 else k % 3) for k, (i, v) in enumerate(zip(rng.permutation(5 * n)[:n], x))]


def test_equal_to_brute_force_and_sql(spark, tmp_path):
    rows = random_rows(150)
    rows += [(9_000 + k, rows[0][1], 1) for k in range(70)] + [(8_000, None, 1), (8_001, [float("nan")] * 64, 1), (8_002, [float("-inf")] + [0.0] * 63, 2), (8_003, [None] * 64, 2), (8_004, [0.0] * 64, None)]
    got = op11(spark, rows, tmp_path)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({codes.SQL})").fetchall()
    assert got == sorted(want, key=repr)


def test_few_vectors_ties_and_repeats(spark, tmp_path):
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (1, [0.25] * 8, None), (2, [-0.5] * 8, None), (None, [1.0] * 8, 2), (None, None, 2), (3, [0.5, -0.5] * 4, 2)]
    assert op11(spark, rows, tmp_path, "double") == brute(rows)


def test_many_rows_of_one_label_and_value(spark, tmp_path):
    rows = [(k, [((k % 5) - 2) / 7] * 16, 4) for k in range(1500)]
    got = op11(spark, rows, tmp_path)
    assert got == brute(rows) and len({g[3] for g in got}) == 1


def test_other_lengths_and_parts_that_do_not_divide(spark):
    rows = [(k, [k / 10] * 11, 0) for k in range(20)] + [(100, [1.0] * 64, 0), (101, [], 0)]
    out, books = codes.compressed(vectors(spark, rows))
    assert {r.id for r in out.collect()} == set(range(20)) and books[0].shape == (16, 2)
    padded = [(i, x + [0.0] * 5, lab) for i, x, lab in rows[:20]]
    got = sorted((r.id, "".join(f"{c:02x}" for c in r.code), r.error) for r in out.collect())
    assert got == [b[:3] for b in sorted(brute(padded))]


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")], 1)]):
        assert codes.compressed(vectors(spark, rows))[0].count() == 0
    assert [tuple(r) for r in codes.compressed(vectors(spark, [(1, [], 1)]))[0].collect()] == [(1, 1, [0] * 8, 0, 0)]


def test_too_large_components_raise(spark):
    with pytest.raises(ArithmeticError):
        codes.compressed(vectors(spark, [(1, [20_000.0] * 8, 1)]))


@pytest.mark.parametrize("wide", [1, 2, 3, 5, 8, 16])
def test_bounds_drop_no_nearest_entry(wide):
    """The filter keeps the nearest entry and the lowest of equals, and computes fewer distances than there are entries."""
    rng = np.random.default_rng(wide)
    for scale in (1, 3, 4096, 2**25):
        centers = rng.integers(-scale, scale + 1, (16, wide))
        centers[7] = centers[3]
        x = centers[rng.integers(0, 16, 500)] + rng.integers(-scale // 8 - 1, scale // 8 + 2, (500, wide))
        d = ((x[:, None].astype(object) - centers[None].astype(object)) ** 2).sum(2).astype(np.int64)
        entry, far, computed = codes.nearest(x, centers)
        assert (entry == d.argmin(1)).all() and (far == d.min(1)).all()
        if scale > 3 and wide > 2:
            assert computed < 0.5 * d.size
