"""Upserts by batches and streams, replays, and late rows."""

import datetime

import pytest

from ledgerleaf.streaming import windows
from ledgerleaf.streaming.upserts import UpsertTable

SCHEMA = "k long, v string, t long"


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_replayed_and_unchanged_batches_change_nothing(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=4)
    put = lambda batch, *rows, **more: table.upsert(spark.createDataFrame(rows, SCHEMA), batch, **more)
    assert table.read().count() == 0 and table.changes().count() == 0
    assert put(0, *[(i, f"v{i}", 0) for i in range(20)], (3, "v3", 0), (None, "x", 0)) == {"inserted": 20, "updated": 0}
    before, commits = rows_of(table), len(table.files.names("commits"))
    assert put(0, (1, "other", 0)) == {"inserted": 0, "updated": 0} and rows_of(table) == before, "a replay"
    assert len(table.files.names("commits")) == commits
    assert put(1, *[(i, f"v{i}", 0) for i in range(20)]) == {"inserted": 0, "updated": 0} and rows_of(table) == before, "the same content"
    folders = table.commit()["folders"]
    assert put(2, (5, "new", 1), (5, "new", 1), (50, None, 1), (6, "v6", 0)) == {"inserted": 1, "updated": 1}
    now = table.commit()["folders"]
    assert 1 <= sum(now[b] != folders[b] for b in folders) <= 2, "only touched buckets are rewritten"
    assert rows_of(table) == sorted([r for r in before if r[0] != 5] + [(5, "new", 1), (50, None, 1)])
    assert put(0, (7, "w", 0), writer="another") == {"inserted": 0, "updated": 1}
    assert [tuple(r) for r in table.lookup(k=50).collect()] == [(50, None, 1)] and table.lookup(k=51).count() == 0
    assert sorted((r.k, r.change, r.batch) for r in table.changes().collect())[-1] == (50, "inserted", 2) and table.changes().count() == 23


def test_a_batch_that_died_is_put_in_again(spark, tmp_path, monkeypatch):
    table = UpsertTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=2)
    first, second = spark.createDataFrame([(1, "a", 1)], SCHEMA), spark.createDataFrame([(1, "b", 2), (2, "c", 2)], SCHEMA)
    table.upsert(first, 0)
    with monkeypatch.context() as m:
        m.setattr(UpsertTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(second, 1)
    assert rows_of(table) == [(1, "a", 1)] and table.changes().count() == 1
    assert table.upsert(second, 1) == {"inserted": 1, "updated": 1}
    assert rows_of(table) == [(1, "b", 2), (2, "c", 2)] and table.changes().count() == 3
    last = table.commit()
    assert not table.files.claimed(f"commits/{last['number']:012d}.json", "{}"), "a commit is written once"
    assert table.cleanup() >= 1 and rows_of(table) == [(1, "b", 2), (2, "c", 2)]


def test_order_makes_batches_commute(spark, tmp_path):
    batches = [[(1, "late", 1), (2, "x", 5)], [(1, "last", 9), (3, "y", 1)], [(1, "mid", 4), (2, "w", 5)]]
    found = []
    for n, order in enumerate([(0, 1, 2), (2, 1, 0), (1, 0, 2)]):
        table = UpsertTable(spark, str(tmp_path / str(n)), SCHEMA, ["k"], order="t", buckets=2)
        for batch, b in enumerate(order):
            table.upsert(spark.createDataFrame(batches[b], SCHEMA), batch)
        found.append(rows_of(table))
    assert found[0] == found[1] == found[2] and (1, "last", 9) in found[0] and len(found[0]) == 3


def test_only_changed_rows_are_derived(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def derive(rows):
        def lengths(batches):
            import pyarrow as pa

            for b in batches:
                seen.add(b.num_rows)
                yield pa.record_batch([*b.columns, pa.array([len(v or "") for v in b.column(1).to_pylist()], pa.int64())], names=["k", "v", "n"])

        return rows.mapInArrow(lengths, "k long, v string, n long")

    table = UpsertTable(spark, str(tmp_path), "k long, v string, n long", ["k"], buckets=2)
    put = lambda batch, *rows: table.upsert(spark.createDataFrame(rows, "k long, v string"), batch, derive=derive, given=["k", "v"])
    put(0, *[(i, "a" * i) for i in range(10)])
    assert seen.value == 10
    put(1, *[(i, "a" * i) for i in range(10)])
    assert seen.value == 10
    put(2, (3, "bbbbb"), (4, "aaaa"), (11, None))
    assert seen.value == 12 and {r.k: r.n for r in table.read().collect()} == {i: i for i in range(10)} | {3: 5, 11: 0}


def day(hour, minute=0):
    return datetime.datetime(2024, 1, 2, hour, minute)


def written(spark, folder, *files):
    """Each file's rows by themselves, the older files first."""
    import os
    import time

    for n, rows in enumerate(files):
        spark.createDataFrame([(i, u, "a", t, 1.0) for i, u, t in rows], "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)
        new = [f for f in os.listdir(folder) if f.endswith(".parquet")]
        for f in new:
            path = os.path.join(folder, f)
            if os.path.getmtime(path) > time.time() - 3600:
                os.utime(path, (time.time() - 100_000 + n, time.time() - 100_000 + n))
    return folder


def test_late_rows_of_sessions_and_dedupe(spark, tmp_path):
    """The watermark is an hour behind 12:00 once the second file is read: in the third, a session from 8:30 to 10:30 is too late, one from
    11:30 is not."""
    files = [[(1, 1, day(8)), (2, 1, day(12))], [(8, 9, day(12))], [(3, 1, day(8, 30)), (4, 1, day(11, 30)), (5, 2, day(11, 30))], [(6, 3, day(23))], [(7, 3, day(23, 30))]]
    folder = written(spark, str(tmp_path / "in"), *files)
    got = windows.run_to_table(spark, folder, lambda rows: windows.sessions(rows, "2 hours"))
    assert sorted((r.user_id, r.start.hour, r.n) for r in got.collect()) == [(1, 8, 1), (1, 11, 2), (2, 11, 1), (9, 12, 1)], "user 3's is still open"
    first = windows.run_to_table(spark, folder, lambda rows: rows.dropDuplicatesWithinWatermark(["user_id"]).select("user_id", "event_id"))
    seen = sorted((r.user_id, r.event_id) for r in first.collect())
    # user 1 is forgotten when the watermark has passed 8:00 by an hour, and so is new again at 11:30; user 3 comes again within the hour
    assert seen == [(1, 1), (1, 4), (2, 5), (3, 6), (9, 8)]
