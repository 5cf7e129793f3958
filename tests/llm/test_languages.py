import numpy as np
from helpers import docs, odd
from pyspark.sql import functions as F

from ledgerleaf.llm import languages

SF = "/root/testdata/sf0.001"


def rows(df, **kw):
    text = lambda c: F.lit(kw.get(c)).cast("string").alias(c)
    return df.select(F.col("doc_id").alias("id"), "text", text("declared"), text("suffix"), text("host"))


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = languages.fit(d.where(~held).select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text"), languages.Settings())
    got = languages.identify(rows(d.where(held & (F.length("text") > 40))), model).join(d.select(F.col("doc_id").alias("id"), "lang"), "id")
    n = got.count()
    assert got.where("language = lang").count() >= 0.97 * n and got.where("accepted").count() >= 0.97 * n


def test_evidence_moves_short_texts(spark):
    train = docs(spark, [(i, "the cat and the dog are here now") for i in range(20)]).withColumn("lang", F.lit("en")).unionByName(docs(spark, [(50 + i, "der hund und die katze sind jetzt hier") for i in range(20)]).withColumn("lang", F.lit("de")))
    model = languages.fit(train.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text"), languages.Settings())
    short = docs(spark, [(1, "x")])
    of = lambda **kw: languages.identify(rows(short, **kw), model).first().language
    assert of(declared="de-DE") == "de" and of(declared="en") == "en" and of(suffix="at") == "de" and of(suffix="uk") == "en"
    host = rows(docs(spark, [(i, "der hund und die katze sind hier") for i in range(10)] + [(99, "x")]), host="a.example.com")
    assert languages.identify(host, model).where("id = 99").first().language == "de"


def test_odd_rows_empty_tables_and_no_model(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.fit(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text"), languages.Settings())
    got = {(r.id, r.language == "und", r.accepted) for r in languages.identify(rows(odd(spark)), model).where("id in (2, 3, 4)").collect()}
    assert got == {(2, True, False), (3, True, False), (4, True, False)}
    assert languages.identify(rows(odd(spark)), model).count() == 11
    assert languages.identify(rows(docs(spark, [])), model).count() == 0
    none = languages.fit(odd(spark).limit(0).select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text"), languages.Settings())
    assert languages.identify(rows(odd(spark)), none).where("accepted").count() == 0


def test_page_parts(spark):
    p = spark.createDataFrame([(1, "https://u@www.Ex.co.uk:80/a?b", "<!doctype html><HTML class=x lang='en-GB'><script>var a='</p>'</script><p>Hi &amp; bye"), (2, None, None)], "page_id long, url string, html string")
    a, b = languages.page_evidence(p).orderBy("id").collect()
    assert (a.declared, a.suffix, a.host, a.text.split()) == ("en", "uk", "www.ex.co.uk", ["Hi", "bye"])
    assert (b.declared, b.suffix, b.host, b.text) == (None, None, None, None)


def fused(model, settings, texts):
    """Posteriors row by row: texts are (id, text, declared, suffix, host)."""
    k = len(model.names)
    logs, by_text = {}, {}
    for i, t, *_ in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        s, n = model.score(data, np.array([0, len(data)]))
        logs[i] = s[0] * min(1.0, settings.weigh / max(n[0], 1))
        if n[0] > 0:
            e = np.exp(logs[i] - logs[i].max())
            by_text[i] = e / e.sum()
    whole = sum(by_text.values())
    flat = (whole + 1) / (whole.sum() + k)
    out = {}
    for i, t, declared, suffix, host in texts:
        mine = by_text.get(i, np.zeros(k))
        own = lambda same, mine=mine: np.maximum(sum((by_text[j] for j, *x in texts if j in by_text and same(x[-1])), np.zeros(k)) - mine, 0)
        domain = lambda h: ".".join((h or "").split(".")[-2:]) if "." in (h or "") else ""
        at_domain = own(lambda h: domain(h) == domain(host)) if domain(host) else np.zeros(k)
        at_host = own(lambda h: h == host) if host else np.zeros(k)
        above = (at_domain + settings.strength * flat) / (at_domain.sum() + settings.strength)
        prior = (at_host + settings.strength * above) / (at_host.sum() + settings.strength)
        total = logs[i] + np.log(prior)
        for said, right in ((declared, settings.declared_right), (languages.SUFFIX_LANGUAGE.get(suffix), settings.suffix_right)):
            if said in model.names:
                total = total + np.log([right if x == said else (1 - right) / (k - 1) for x in model.names])
        e = np.exp(total - total.max())
        out[i] = e / e.sum()
    return out


def test_posteriors_row_by_row(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.fit(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text"), languages.Settings())
    some = d.select("doc_id", F.substring("text", 1, 25)).limit(60).collect()
    hosts, suffixes = ["a.one.com", "b.one.com", "two.de", "local", None], ["de", "fr", "com", None]
    texts = [(r[0], r[1], [None, "fr", "de", "xx"][i % 4], suffixes[i % 3], hosts[i % 5]) for i, r in enumerate(some)] + [(-1, "x", "es", None, "two.de"), (-2, "zz", None, "de", None)]
    want = fused(model, languages.Settings(), texts)
    for bound in (100_000, 0):  # host sums broadcast, and salted
        df = spark.createDataFrame(texts, "id long, text string, declared string, suffix string, host string")
        got = {r.id: r for r in languages.identify(df, model, languages.Settings(broadcast_hosts=bound)).collect()}
        for i, p in want.items():
            assert abs(got[i].posterior - p.max()) < 1e-9 and got[i].language == model.names[int(p.argmax())]


def test_rare_and_dirty_codes_and_ties(spark):
    rows = [(i, "the cat and the dog are here now") for i in range(30)]
    d = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 29, "zz9").when(F.col("doc_id") == 28, "?").otherwise(" EN-gb "))
    labelled = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text")
    assert languages.fit(labelled, languages.Settings(least_share=0.1)).names == ["en"]
    assert languages.fit(labelled, languages.Settings()).names == ["en", "zz"]
    same = labelled.where("id < 20").withColumn("language", F.when(F.col("id") % 2 == 0, "bb").otherwise("aa"))
    model = languages.fit(same, languages.Settings())
    assert languages.identify(rows_of(spark), model).first().language == "aa"


def rows_of(spark):
    return spark.createDataFrame([(1, "the cat and the dog", None, None, None)], "id long, text string, declared string, suffix string, host string")
