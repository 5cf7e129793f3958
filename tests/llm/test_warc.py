import hashlib

from pyspark.sql import functions as F

from ledgerleaf.llm import warc


def pages(spark):
    big = "é" * 900
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://b/\n4", "small"), (5, "http://b/5", "small"), (6, "x", None), (7, "x", ""), (None, "y", big), (8, "http://c", "WARC/1.1\r\n\r\n\x1f\x8b\x08" * 100), (3, None, big)]
    return spark.createDataFrame([(*r, "c", 1, "d") for r in rows], "page_id long, url string, html string, kept string, payload_bytes int, uri string")


def written(spark, tmp_path, **kw):
    path = f"file://{tmp_path}/archives"
    warc.write_warc(warc.page_records(pages(spark)), path, **kw)
    return path


def test_round_trip_and_revisits(spark, tmp_path):
    path = written(spark, tmp_path)
    for split in (64 << 20, 300):
        got = warc.read_warc(spark, path, split_bytes=split).where("record_type <> 'warcinfo'").collect()
        assert len(got) == 10
        by = {}
        for r in got:
            by.setdefault(r.record_id, []).append(r)
        for p in pages(spark).collect():
            data = (p.html or "").encode()
            for r in by[f"<urn:page:{p.page_id if p.page_id is not None else ''}>"]:
                assert r.payload_digest == hashlib.sha1(data).hexdigest() and r.declared_bytes == len(data)
                if r.record_type == "response":
                    assert bytes(r.payload) == data and r.payload_bytes == len(data)
        kinds = {r.record_id: (r.record_type, r.refers_to) for r in got}
        assert kinds["<urn:page:1>"] == ("revisit", "<urn:page:3>") and kinds["<urn:page:3>"] == ("response", None) and kinds["<urn:page:4>"] == ("response", None)


def test_filters_reach_the_headers(spark, tmp_path):
    path = written(spark, tmp_path)
    df = warc.read_warc(spark, path).where((F.col("record_type") == "response") & F.col("uri").startswith("http://b"))
    assert df.count() == 2
    reader = warc.Reader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("record_type", "EqualTo", "revisit")]
    decoded = []
    source = reader.row
    reader.row = lambda headers, block: decoded.append(headers["warc-type"]) or source(headers, block)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert set(decoded) == {"revisit"} and len(rows) == 2


def test_plain_archive_and_empty_table(spark, tmp_path):
    data = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(data)
    assert [bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path / "x.warc")).collect()] == [b"hello"]
    path = f"file://{tmp_path}/none"
    warc.write_warc(warc.page_records(pages(spark).limit(0)), path)
    assert warc.read_warc(spark, path).where("record_type = 'response'").count() == 0


def test_sql_gives_the_same_on_groups(spark, tmp_path):
    import duckdb

    big, other = "<p>é" * 400, "x" * 1000
    rows = [(i, f"http://h/{i}", [big, other, "small", "", None, other + "y"][i % 6]) for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = sorted(con.execute(f"SELECT {columns} FROM ({warc.SQL}) ORDER BY page_id").fetchall(), key=str)
    got = sorted((tuple(r) for r in warc.op1_warc(spark, str(tmp_path)).select(*columns.split(", ")).collect()), key=str)
    assert got == want and sum(r[3] == "revisit" for r in got) > 15
