"""Hand-computed expectations of single operators."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import exprs
from ledgerleaf.operators import cashflow, chunks, financials, offer, risk, sections, store, text, vectors, working_capital
from ledgerleaf.plans import registry
from ledgerleaf.streaming import windows


def one(df):
    return df.collect()[0].asDict()


def test_normalise_units_and_preference(spark):
    raw = spark.createDataFrame([(1, "FY22", "lakh", "standalone", 1, "10,000"), (1, "FY22", "cr", "consolidated", 0, "(7)"), (1, "FY23", "million", "standalone", 2, "500"), (1, "FY24", "stones", "standalone", 3, "1")], "entity_id int, fiscal_year string, unit string, statement_type string, ordinal int, revenue string")
    got = {r.fiscal_year: r.revenue for r in financials.normalise(raw, ["revenue"]).collect()}
    assert got == {"FY22": -7.0, "FY23": 50.0}
    assert {r.revenue for r in financials.normalise(raw, ["revenue"], prefer_consolidated=False).collect()} == {100.0, 50.0}


def test_amount_parsers(spark):
    df = spark.createDataFrame([("(1,234.5)",), ("₹ 50 Cr",), ("250 Lakh",), ("nil",), ("-",), ("abc",), ("",), (None,), ("-7",)], "s string")
    got = df.select(exprs.amount_statement(F.col("s")), exprs.amount_cell(F.col("s")), exprs.amount_debt(F.col("s"))).collect()
    assert [r[0] for r in got] == [-1234.5, 50.0, 2.5, 0.0, 0.0, 0.0, 0.0, 0.0, -7.0]
    assert [r[1] for r in got] == [-1234.5, None, None, 0.0, 0.0, None, None, None, -7.0]
    assert [r[2] for r in got][1:3] == [50.0, 2.5]


def test_fiscal_year_key_rate_and_months(spark):
    df = spark.createDataFrame([("FY2023-24", "9.5% p.a.", "2020-02-29", "2020-03-31"), ("none", "x", "2020-01-31", "2020-01-31")], "f string, r string, a string, b string")
    got = df.select(exprs.fy_key(F.col("f")), exprs.rate(F.col("r")), exprs.whole_months(F.col("a").cast("date"), F.col("b").cast("date"))).collect()
    assert [tuple(r) for r in got] == [(24, 9.5, 1), (0, None, None)]


def test_growth_of_three_years(spark):
    y = spark.createDataFrame([(1, 22, "FY22", 100.0), (1, 23, "FY23", 120.0), (1, 24, "FY24", 144.0)], "entity_id int, fy int, fiscal_year string, revenue double")
    assert one(financials.cagr_of(y, "normaliser"))["cagr"] == 20.0
    assert one(financials.cagr_of(y, "repository"))["cagr"] == pytest.approx(0.2)


def test_working_capital_days(spark):
    y = spark.createDataFrame([(1, 24, "FY24", 1000.0, 700.0, 70.0, 100.0, 50.0)], "entity_id int, fy int, fiscal_year string, revenue double, cogs double, inventory double, trade_receivables double, trade_payables double")
    r = one(working_capital.single_year(y))
    assert (round(r["receivable_days"], 1), round(r["inventory_days"], 1), round(r["payable_days"], 1), round(r["ccc"], 1)) == (36.5, 36.5, 26.1, 46.9)
    assert r["ccc_change"] == 0.0


def test_free_cash_flow(spark):
    y = spark.createDataFrame([(1, 24, 100.0, -50.0, -20.0, 40.0, 500.0, 80.0, 50.0, 20.0, 30.0, 10.0, 5.0)], "entity_id int, fy int, cfo double, cfi double, cff double, capex double, revenue double, ebitda double, pat double, depreciation double, cash_and_equivalents double, current_liabilities double, working_capital_change double")
    r = one(cashflow.single_year(y))
    assert (r["fcf"], r["fcf_margin"], r["burn_status"]) == (60.0, 12.0, "PROFITABLE_FCF")


def test_day_one_float(spark):
    issues = spark.createDataFrame([(1, 80_000_000, 20_000_000, 5_000_000)], "entity_id int, shares_pre_issue long, fresh_issue_shares long, anchor_shares long")
    holders = spark.createDataFrame([(1, "P", "Promoter", 60_000_000, 1095, 0), (1, "F", "PE/VC", 20_000_000, 180, 0)], "entity_id int, name string, category string, shares_locked long, lock_in_days int, shares_selling_ofs long")
    assert one(offer.float_milestones(issues, holders))["day_1_pct"] == 15.0


def test_issuer_at_cap(spark):
    issuer = spark.createDataFrame([(1, 100.0, 110.0, 50_000_000, 50.0, 200.0, 80.0, 50.0, 15.0)], "entity_id int, price_floor double, price_cap double, shares_post_issue long, pat_cr double, net_worth_cr double, ebitda_cr double, net_debt_cr double, pat_cagr_3yr double")
    cap = one(offer.issuer_multiples(issuer).where("point = 'cap'"))
    assert (cap["pe"], cap["peg"]) == (11.0, 0.73)


def test_projection_base_year(spark):
    row = spark.createDataFrame([(1, 400.0, 80.0, 200.0, 100.0, None, None, 15.0, 22.0, 0.25, 0.03, 300.0, 0.0, 50_000_000)], "entity_id int, revenue double, ebitda double, total_equity double, total_debt double, ccc_days double, hist_cagr double, growth_guidance double, margin_guidance double, tax_rate double, depreciation_rate double, fresh_cr double, repay_cr double, post_shares long")
    got = {r.scenario: r.revenue for r in offer.projections(row).where("year = 'FY1E'").collect()}
    assert got["Base"] == 460.0 and got["Stress"] < got["Base"] < got["Bull"]


def test_order_book_and_objects(spark):
    book = spark.createDataFrame([(1, "EPC", 2500.0, 500.0, 1000.0, 2000.0, [500.0, 400.0, 350.0, 300.0, 250.0, 200.0], 1000.0), (2, "Bank", 1.0, 1.0, 1.0, 1.0, [1.0], 1.0)], "entity_id int, sector string, total_order_book double, largest_order double, executable_12m double, book_year_ago double, top_orders array<double>, ltm_revenue double")
    rows = offer.order_book(book).collect()
    assert [(r.book_to_revenue, r.top5, r.top5_pct, r.largest_pct, r.executable_pct, round(r.growth_pct, 6)) for r in rows] == [(2.5, 1800.0, 72.0, 20.0, 40.0, 25.0)]
    uses = spark.createDataFrame([(1, "Capex", 60.0), (1, "debt repayment", 40.0), (1, "Working capital", 20.0), (1, "GCP", 10.0)], "entity_id int, category string, amount_cr double")
    r = one(offer.objects_posture(uses, spark.createDataFrame([(1, 120.0, 80.0)], "entity_id int, fresh_cr double, ofs_cr double")))
    assert (r["growth_oriented"], r["exit_oriented"], r["gcp_too_high"], r["working_capital"]) == (True, False, False, 20.0)


def test_contingent_weights(spark):
    items = spark.createDataFrame([(50.0, "tax dispute", "high"), (20.0, "civil suit", "low")], "amount_cr double, category string, probability string")
    r = one(risk.contingent_weighted(items, 200.0))
    assert (r["total"], r["pct_networth"], r["risk_weighted"]) == (70.0, 35.0, 42.5)


def test_rules_compile_without_eval(spark):
    row = spark.createDataFrame([(1, 45.0, True)], "entity_id int, a double, b boolean")
    check = lambda c: row.select(risk.compiled(c, {"a", "b"})).first()[0]
    assert check("a < 51 and b == True") and not check("not b") and not check("a / 0 > 1")
    assert not check("__import__('os').system('true')") and not check("unknown > 1") and not check("a <")


def test_facility_and_covenant_kinds(spark):
    df = spark.createDataFrame([("Term loan",), ("Cash Credit",), ("  ",), ("Bonds",)], "s string")
    assert [r[0] for r in df.select(risk.facility(F.col("s"))).collect()] == ["Term Loan", "Working Capital", "Other", "Bonds"]
    assert spark.range(1).select(risk.covenant_kind(F.lit("Minimum DSCR of 1.2x"))).first()[0] == "dscr"


def test_payload_filter_list_modes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, s string")
    assert df.where(store.payload_filter({"s": ["a", "b"], "n": [2, 3]})).count() == 1
    assert df.where(store.payload_filter({"s": ["a", "b"]}, exact=True)).count() == 0


def test_table_classification_melt_and_growth(spark):
    t = spark.createDataFrame([("t", ["Particulars", "FY2023", "FY2024"], [["Revenue", "100", "150"], ["Profit and loss", "(10)", "nil"], ["Total", "1", "2"]])], "table_id string, headers array<string>, rows array<array<string>>")
    assert one(text.classify_tables(t))["table_type"] == "income_statement"
    facts = text.melt_statement(t)
    assert {(r.metric, r.fiscal_year): r.value for r in facts.collect()}[("Profit and loss", "FY2024")] == 0.0
    assert {r.metric: r.growth for r in text.table_growth(facts).collect()} == {"Revenue": 50.0, "Profit and loss": 100.0}


def test_entities_of_a_sentence(spark):
    s = "Raised Rs. 1,200 crore in FY24, up 12.5% on 31/02/2024 and 15-08-2023."
    got = {(r.entity_type, r.value or r.normalized) for r in text.entities(spark.createDataFrame([(1, s)], "id int, text string")).collect()}
    assert {("MONEY", 1.2e10), ("PERCENTAGE", 12.5), ("FISCAL_YEAR", "FY24"), ("DATE", "2023-08-15")} <= got and not any(v == "2024-02-31" for _, v in got)


def test_chunks_keep_every_paragraph(spark):
    body = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(30))
    sizes = chunks.Sizes(target=1000, overlap=100, least=100, most=1500)
    got = chunks.chunk_texts(spark.createDataFrame([(1, body)], "document_id int, text string"), sizes).orderBy("seq").collect()
    assert len(got) > 5 and all(any(f"Paragraph {i}." in c.text for c in got) for i in range(30))
    assert got[0].preceding is None and got[0].following == got[1].chunk_id and got[0].token_count == len(got[0].text) // 4


def test_chunk_boundaries_by_hand():
    small = chunks.Sizes(target=20, overlap=6, least=5, most=30)
    assert chunks.packed("aaaa bbbb\n\ncccc dddd\n \neeee", small) == [(0, "aaaa bbbb\n\ncccc dddd"), (18, "dddd\n\neeee")]
    # the tail starts after a blank in its first half
    assert chunks.tail("one two three", 9) == "three" and chunks.tail("one two three", 10) == " two three" and chunks.tail("onetwothree", 5) == "three" and chunks.tail("ab", 5) == "ab"
    # a long paragraph is cut by sentences, after what came before; what follows starts anew
    long = "First one here. Second one is. Third."
    assert chunks.packed("intro\n\n" + long + "\n\nout of it", small) == [(0, "intro"), (7, "First one here."), (16, "here. Second one is."), (33, "is. Third."), (46, "out of it")]
    # a short end joins the chunk before
    assert chunks.packed("aaaa bbbb cccc dddd\n\nee", chunks.Sizes(target=20, overlap=0, least=5, most=30)) == [(0, "aaaa bbbb cccc dddd\n\nee")]
    assert chunks.packed(" \n\n ", small) == []


def test_table_text_and_shape(spark):
    row = spark.createDataFrame([(["A|x", "B"], [["1", "2\n3"]], "debt")], "headers array<string>, rows array<array<string>>, table_type string")
    whole, short = row.select(chunks.table_text(1000), chunks.table_text(0)).first()
    assert whole == "| A\\|x | B |\n| --- | --- |\n| 1 | 2 3 |" and short == "[TABLE: debt]\nRows: 1, Columns: 2\nHeaders: A|x, B\nSample data:\n  1 | 2\n3"
    assert [(r.row_count, r.col_count) for r in text.with_shape(row).collect()] == [(1, 2)]


def test_vector_collections_and_cache(spark, tmp_path):
    store_ = vectors.Collections(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "S", "t1"), ("b", "S", "t2")], "chunk_id string, section string, text string")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, vector array<double>")
    assert not store_.exists("my doc/1") and store_.add("my doc/1", rows.limit(0), vecs.limit(0)) == 0 and not store_.exists("my doc/1")
    with pytest.raises(ValueError):
        store_.add("my doc/1", rows, vecs.limit(1))
    assert store_.add("my doc/1", rows, vecs) == 2 and store_.names() == ["doc_my_doc_1"]
    before = store_.read("my doc/1")
    assert store_.add("my doc/1", rows.where("chunk_id = 'a'").withColumn("text", F.lit("new")), vecs.where("chunk_id = 'a'")) == 1
    assert {r.text for r in before.collect()} == {"t1", "t2"}, "a reader of the version before isn't disturbed"
    assert store_.info("my doc/1") == {"points": 2, "dimension": 2} and store_.info("none") is None
    assert store_.cleanup("my doc/1") == 1 and store_.cleanup("my doc/1") == 0
    assert {r.chunk_id: r.text for r in store_.read("my doc/1").collect()} == {"a": "new", "b": "t2"}
    assert store_.drop("my doc/1") and not store_.exists("my doc/1") and not store_.drop("my doc/1")

    cache = vectors.EmbeddingCache(spark, str(tmp_path / "cache"))
    texts = spark.createDataFrame([(0, "x", [1.0]), (1, "y", [2.0])], "index long, text string, vector array<double>")
    assert cache.load("d", texts, "m") is None
    cache.save("d", texts, "m")
    assert [r.vector for r in cache.load("d", texts, "m").orderBy("index").collect()] == [[1.0], [2.0]]
    assert cache.load("d", texts, "other") is None and cache.load("d", texts.limit(1), "m") is None and cache.load("d", texts.withColumn("text", F.lit("z")), "m") is None
    assert cache.clear("d") and not cache.clear("d")
    cache.save("e", texts, "m")
    assert cache.clear_all() == 1


def test_search_skips_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0])], "vec_id long, vector array<double>")
    q = rows.where("vec_id in (1, 4)").selectExpr("vec_id AS query_id", "vector AS query_vector")
    assert sorted((r.query_id, r.vec_id, r.rank) for r in vectors.search(rows, q).collect()) == [(1, 1, 1), (1, 6, 2), (4, 4, 1)]


def test_repository_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    assert store.exists(df, s="a") and not store.exists(df, s="z") and store.count(df, s="b") == 1 and store.find(df, id=2).s == "b" and store.find(df, id=3) is None


def test_persons_companies_and_litigation(spark):
    s = "Mr. ravi o'neil met Acme Steel Limited and Dr Asha Rao of RBI."
    got = {(r.entity_type, r.text): r.normalized for r in text.entities(spark.createDataFrame([(1, s)], "id int, text string")).collect()}
    assert got[("COMPANY", "Steel Limited")] == "Steel" and got[("ORG", "RBI")] == "RBI" and got[("PERSON", "Dr Asha Rao")] == "Asha Rao"
    names = spark.createDataFrame([("Mr. o'neil  singh", "PERSON"), ("ACME  steel Pvt. Ltd.", "COMPANY"), ("new delhi", "LOCATION")], "n string, k string")
    assert [r[0] for r in names.select(text.normal_name(F.col("n"), F.col("k"))).collect()] == ["O'Neil  Singh", "Acme Steel", "New Delhi"]
    people = spark.createDataFrame([("Ravi Kumar",), ("Asha Rao",)], "name string")
    cases = spark.createDataFrame([("ravi kumar", "criminal", 2.0), ("RAVI KUMAR", "civil", 3.0)], "party string, kind string, amount double")
    out = {r.name: (r.criminal_cases, r.civil_cases, r.regulatory_actions, r.total_litigation_amount) for r in sections.litigation_counts(people, cases).collect()}
    assert out == {"Ravi Kumar": (1, 1, 0, 5.0), "Asha Rao": (0, 0, 0, 0.0)}


def test_resolved_entities(spark):
    merged = spark.createDataFrame([("Acme Steel", "COMPANY", 5), ("Acme Steelworks", "COMPANY", 1), ("Other", "COMPANY", 2)], "normalized string, entity_type string, mentions long")
    assert {r.normalized: r.canonical for r in text.resolve_entities(merged).collect()} == {"Acme Steel": "Acme Steel", "Acme Steelworks": "Acme Steel", "Other": "Other"}
    assert text.resolve_entities(merged, compat=True).count() == 1


def test_stream_gives_the_batch_windows(spark, tmp_path):
    path, source = "/root/testdata/sf0.001/events.parquet", str(tmp_path / "in")
    spark.read.parquet(path).write.parquet(source)
    got = windows.run_once(spark, source, windows.tumbling, str(tmp_path / "check"))
    want = windows.tumbling(windows.events(spark.read.parquet(path)))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stages_resume_with_their_data(spark, tmp_path):
    from ledgerleaf.plans import stages

    calls = []

    def step(name, f):
        return name, lambda df: calls.append(name) or f(df)

    plan = [step("double", lambda d: d.withColumn("x", F.col("x") * 2)), step("sum", lambda d: d.agg(F.sum("x").alias("x")))]
    source = spark.createDataFrame([(1,), (2,)], "x long")
    out, ran = stages.run(spark, str(tmp_path), source, plan)
    assert out.first().x == 6 and ran == ["double", "sum"]
    out, ran = stages.run(spark, str(tmp_path), source, plan)
    assert out.first().x == 6 and ran == [] and calls == ["double", "sum"]
    assert stages.run(spark, str(tmp_path), source.union(source), plan)[1] == ["double", "sum"]


def test_headers_levels_names_and_promoters(spark):
    p = spark.createDataFrame([(1, 1, "RISK FACTORS\nplain text of no interest at all\n1.2.1 OUR BUSINESS\n\nRISK  FACTORS"), (1, 2, "The management believes that this matters\nTHE ISSUE")], "document_id int, page_num int, text string")
    got = [(r.position, r.title, r.section_type, r.level, r.score) for r in sections.headers(p).orderBy("position").collect()]
    assert got == [(1, "RISK FACTORS", "risk_factors", 3, 5.0), (2, "1.2.1 OUR BUSINESS", "other", 3, 2.0), (3, "THE ISSUE", "the_issue", 3, 5.0)]
    spans = sections.sections_of(sections.headers(p), spark.createDataFrame([(1, 9)], "document_id int, total_pages int"))
    assert sorted((r.section_id, r.start_page, r.end_page) for r in spans.collect()) == [(1, 1, 1), (2, 1, 1), (3, 2, 9)]
    names = spark.createDataFrame([("My Report - Final (v2).pdf",), ("???.pdf",)], "f string").select(sections.document_name(F.col("f"))).collect()
    assert [r[0] for r in names] == ["My_Report_Final_v2", "document"]
    s = spark.createDataFrame([(1, "Mr. Ravi Kumar, aged 45, DIN: 01234567, has 20 years of experience. He is an MBA from Pune. Ms. Asha Rao, DIN 76543210.\nVijay Mallya Shah\nHe is the Managing Director.")], "id int, text string")
    people = {r.name: (r.din, r.age, r.experience_years, r.qualification, r.designation) for r in sections.promoters(s).collect()}
    assert people == {"Ravi Kumar": ("01234567", 45, 20, "MBA from Pune", None), "Asha Rao": ("76543210", None, None, None, None), "Vijay Mallya Shah": (None, None, None, None, "Managing Director")}
    titles = spark.createDataFrame([("OUR PROMOTERS",), ("Interest of Promoters",), ("Capital Structure",), ("Index",)], "title string")
    assert [r.extractors for r in sections.routed(titles).collect()] == [["profiles"], ["profiles", "common_pursuits", "financial_interests"], ["shareholding"], []]


def test_page_layout(spark):
    from ledgerleaf.sources import pages

    b = [(10.0, 5.0, 50.0, 20.0, "Head"), (12.0, 100.0, 60.0, 120.0, "12 34 56"), (300.0, 100.0, 400.0, 120.0, "1 2 3"), (350.0, 200.0, 400.0, 220.0, "9 9"), (15.0, 780.0, 60.0, 790.0, " Foot ")]
    df = spark.createDataFrame([(1, 1, "short", 1, 0.9, b, 600.0, 800.0)], "document_id long, page_num int, text string, image_count int, image_share double, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>, width double, height double")
    r = df.select(pages.has_tables(F.col("blocks")), pages.is_multi_column(F.col("blocks"), F.col("width")), pages.edge_text(F.col("blocks"), F.col("height"), True), pages.edge_text(F.col("blocks"), F.col("height"), False)).first()
    assert tuple(r) == (True, True, "Head", "Foot")
    assert pages.validation(df).first().mostly_scanned and pages.page_range(df, 0, 1).count() == 1 and pages.page_range(df, 1, 5).count() == 0


def test_indebtedness_rows(spark):
    t = spark.createDataFrame([("t", ["Name of lender", "Nature of facility", "Outstanding (Cr)", "Rate of interest"], [["HDFC", "Term loan", "100 Cr", "9.5%"], ["", "Unsecured loan", "5000 Lakh", "12"], ["X", "CC", "nil", ""], ["short"]])], "table_id string, headers array<string>, rows array<array<string>>")
    got = [(r.lender, r.facility_type, r.amount, r.interest_rate, r.is_secured) for r in risk.indebtedness(t).orderBy("row_no").collect()]
    assert got == [("HDFC", "Term Loan", 100.0, 9.5, True), ("Unknown", "Unsecured Loan", 50.0, 12.0, False)]


def test_sections_citations_and_table_text(spark):
    s = spark.createDataFrame([(1, 1, "Risk Factors", 1, 4), (1, 2, "Our Business", 5, 9), (1, 3, "Risk Factors", 10, 12)], "document_id int, section_id int, title string, start_page int, end_page int")
    assert text.section_boundaries(s).first().boundaries["Risk Factors"].start_page == 10
    assert text.find_section(s, "business").first().section_id == 2
    c = spark.createDataFrame([("a", 1, "S", 3, "old"), ("a", 2, "S", 3, "new"), (None, 3, "S", 1, "x")], "claim_id string, ordinal long, section string, page int, snippet string")
    back = text.imported(text.exported(c).unionByName(spark.createDataFrame([("{}",), ("no",)], "json string")))
    assert [(r.claim_id, r.snippet) for r in back.collect()] == [("a", "new")]


def test_config_layers(spark):
    from ledgerleaf.plans import config

    c = config.load({"search": {"top_k": 3}, "chunking": {"target": 2000, "most": 3000}}, environment={"LEDGERLEAF_SEARCH__METRIC": "dot", "LEDGERLEAF_MIN_TABLE_CONFIDENCE": "0.5"})
    assert (c.search.top_k, c.search.metric, c.chunking.target, c.min_table_confidence) == (3, "dot", 2000, 0.5)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0])], "vec_id long, vector array<double>")
    q = rows.where("vec_id = 2").selectExpr("vec_id AS query_id", "vector AS query_vector")
    assert [(r.vec_id, r.score) for r in config.searched(rows, q, c).orderBy("rank").collect()] == [(2, 25.0), (1, 3.0)]
    t = spark.createDataFrame([("a", "x", 0.4), ("b", "x", 0.5)], "table_id string, table_type string, confidence double")
    assert [r.table_id for r in config.typed_tables(t, "x", c).collect()] == ["b"]
    assert config.chunked(spark.createDataFrame([(1, "some text")], "document_id int, text string"), c).first().text == "some text"
    for bad in ({"chunking": {"overlap_chars": 9999}}, {"search": {"metric": "x"}}, {"nothing": 1}):
        with pytest.raises(ValueError):
            config.load(bad, environment={})


def test_vector_threshold_returns_every_match(spark, tmp_path):
    spark.range(1500).selectExpr("id AS vec_id", "array(1.0f, cast(id % 2 AS float)) AS embedding", "0 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.vector_threshold(spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {q: 1500 for q in range(0, 1500, 20)}


def test_vector_threshold_ranks_every_match(spark, tmp_path):
    from ledgerleaf.plans import registry

    spark.range(100).selectExpr("id AS vec_id", "array(1.0f, cast(id % 3 AS float)) AS embedding", "0 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in registry.vector_threshold(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60, 80} and all(sorted(x[0] for x in rows) == [*range(1, len(rows) + 1)] for rows in got.values())
    assert all(sorted(rows) == sorted(rows, key=lambda x: (-x[2], x[1])) for rows in got.values())


def test_numbers_of_a_large_group_come_of_many_tasks(spark):
    rows = spark.range(20_000, numPartitions=8).selectExpr("if(id % 50 = 0, null, 'one') AS g", "id % 7 AS a", "id AS b")
    out = text.numbered(rows, "g", ["a", "b"])
    count, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.a, r.b)):
        count[r.g] = count.get(r.g, 0) + 1
        want[r.b] = count[r.g]
    assert {r.b: r.n for r in out.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which makes one task of little data
    try:
        out = text.numbered(rows, "g", ["a", "b"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) > 1 and max(r["count"] for r in out) < 15_000


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_search_in_small_blocks_equals_brute_force(spark, monkeypatch, metric):
    import numpy as np

    for name, n in (("QUERY_BLOCK", 7), ("ROW_BLOCK", 4), ("PARTS", 3)):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(4)
    x = [[float(v) for v in rng.integers(-2, 3, 3 if i % 10 else 2)] for i in range(120)]
    x[5], x[6], x[7] = None, [1.0, float("nan"), 0.0], [0.0, 0.0, 0.0]
    rows = spark.createDataFrame([*enumerate(x)], "vec_id long, vector array<double>")
    queries = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    fine = [i for i in range(120) if i not in (5, 6)]
    want = {}
    for q in (i for i in fine if i % 5 == 0):
        hits = []
        for i in fine:
            if len(x[i]) == len(x[q]):
                score = vectors.scores(np.array([x[q]]), np.array([x[i]]), metric)[0, 0]
                if not np.isnan(score):
                    hits.append((-round(float(score), 9), i))
        want[q] = [i for _, i in sorted(hits)[:6]], sum(-h[0] >= 0.5 for h in hits)
    got = {}
    found = vectors.search(rows, queries, k=6, metric=metric).collect()
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(round(r.score, 6))
    score = lambda q, i: round(float(vectors.scores(np.array([x[q]]), np.array([x[i]]), metric)[0, 0]), 6)
    assert {q: v for q, v in got.items()} == {q: [score(q, i) for i in ids] for q, (ids, _) in want.items() if ids}
    if metric == "dot":  # whole numbers, so that ties are exact
        ids = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            ids.setdefault(r.query_id, []).append(r.vec_id)
        assert ids == {q: v for q, (v, _) in want.items()}
        reached = vectors.search(rows, queries, k=None, threshold=0.5, metric=metric).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in reached} == {q: n for q, (_, n) in want.items() if n}


def test_a_table_is_lowered_once_not_once_a_word(spark):
    rows = spark.createDataFrame([(1, ["Total Assets"], [["Equity", None]]), (2, None, None), (3, ["Loan"], [["x"]] * 5 + [["assets liabilities equity"]])], "table_id int, headers array<string>, rows array<array<string>>")
    out = text.classify_tables(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    got = {r.table_id: (r.table_type, round(r.confidence, 4)) for r in out.collect()}
    assert got == {1: ("balance_sheet", 0.9091), 2: ("other", 0.0), 3: ("indebtedness", round(1 / 2.1, 4))}


def test_a_match_groups_are_those_of_its_text(spark):
    import random

    rng = random.Random(6)
    parts = ["FY 202345", "fy2023-24", "F.Y. 22", "20-21", "2022-2023", "Rs. 1,250.50", "crores", "cr", "5 to 7", "₹12-₹ 13.5", "lakh", "12/03/2024", "1-2-3456", "31.02.2023", "7.25 %", "é23", "a", "-", "23a", " ", "9"]
    rows = spark.createDataFrame([(i, "".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(30))) for i in range(200)], "id int, text string")
    for pattern, groups in ((text.CRORE, 1), (text.LAKH, 1), (text.PRICE_BAND, 2), (text.PERCENTAGE, 1), (text.FISCAL_YEAR, 4), (text.DAY, 3)):
        for g in range(1, groups + 1):
            whole = F.regexp_extract_all("text", F.lit(f"(?i){pattern}"), F.lit(g))
            apart = F.transform(F.regexp_extract_all("text", F.lit(f"(?i){pattern}"), F.lit(0)), lambda x: F.regexp_extract(x, f"(?i){pattern}", g))  # noqa: B023
            assert rows.where(whole != apart).isEmpty() and not rows.where(F.size(whole) > 0).isEmpty()
    plan = text.entities(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") == 9  # one search a pattern
