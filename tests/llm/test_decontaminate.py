from helpers import docs, odd

from ledgerleaf.llm import decontaminate

ITEMS = [(1, "The farmer named Alice sold 12 apples to Bob for 30 dollars, and then Alice gave 12 pears to him in the old market."), (2, "Too short"), (3, None), (None, "an item without an id that nobody can name here"), (4, "a rather plain passage of the test set with no slots at all in it")]


def found(spark, rows, **kw):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {r.id: (r.contaminated, r.item_id, r.reparameterised) for r in decontaminate.contained(docs(spark, rows), items, **kw).collect()}


def test_verbatim_changed_and_inconsistent(spark):
    rows = [
        (1, "Before. " + ITEMS[0][1] + " After."),
        (2, "The farmer named Carol sold 15 apples to Dave for 99 euros, and then Carol gave 15 pears to him in the old market."),
        (3, "The farmer named Carol sold 15 apples to Dave for 99 euros, and then Erin gave 77 pears to him in the old market."),
        (4, ITEMS[4][1].upper() + "!!"),
        (5, "nothing of the kind is in this text, which is about other things"),
    ]
    for part in (20_000, 1):
        assert found(spark, rows, part_items=part) == {1: (True, 1, False), 2: (True, 1, True), 3: (False, None, False), 4: (True, 4, False), 5: (False, None, False)}


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contained(odd(spark), items).where("contaminated").count() == 0
    assert decontaminate.contained(odd(spark), items).count() == 11
    assert decontaminate.contained(docs(spark, []), items).count() == 0
    assert decontaminate.contained(odd(spark), items.limit(0)).count() == 11


def test_items_of_values_and_short_items(spark):
    items = [(1, "Compute 12 + 7 km minus 33 kg times 45 / 9 hours"), (2, "Paris"), (3, "Name the capital"), (4, "Anna met Carl and Eva in Rome"), (5, ""), (6, "--- !!!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "So far so good. Compute 12 + 7 km minus 33 kg times 45 / 9 hours. And then more."), (2, "He went to Paris in May."), (3, "Which one?\nParis\nLondon"), (4, "Please Name the capital of it."),
        (5, "Then anna met Carl and Eva in Rome, it seems"), (6, None), (7, "Compute 99 + 8 km minus 31 kg times 46 / 2 hours"),
    ]
    got = {r.id: (r.item_id, r.reparameterised) for r in decontaminate.contained(docs(spark, rows), table).collect()}
    # an item that is mostly values is not found with other values
    assert got == {1: (1, False), 2: (None, False), 3: (2, False), 4: (3, False), 5: (4, False), 6: (None, False), 7: (None, False)}


def test_every_item_verbatim_and_with_other_numbers(spark):
    """All items of the benchmark, each put into a text: by itself, and with every number changed to another."""
    import re

    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    changed = {i: re.sub(r"\d+", lambda m: str(int(m[0]) * 7 + 11), t) for i, t in texts.items()}
    rows = [(i, "What comes before. " + t + " What comes after.") for i, t in texts.items()] + [(100_000 + i, "What comes before. " + t + " What comes after.") for i, t in changed.items()]
    got = {r.id: r.n_items for r in decontaminate.contained(docs(spark, rows), items).collect()}
    assert all(got[i] > 0 for i in texts)
    assert sum(got[100_000 + i] > 0 for i in texts) >= 0.9 * len(texts)


def test_all_documents_against_brute_force(spark):
    """Every document in which half of an item's windows of eight words occur, compared word by word, is found."""
    import string

    def plain(t):
        return [w for w in ("".join(c.lower() if c.isascii() else c for c in x).strip(string.punctuation) for x in (t or "").split()) if w]

    def runs(w):
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    known = [(r.item_id, runs(plain(r.text))) for r in items.collect()]
    by = {}
    for i, own in known:
        for x in own:
            by.setdefault(x, set()).add(i)
    want = {}
    for r in texts.collect():
        here = runs(plain(r.text))
        for i in {i for x in here & by.keys() for i in by[x]}:
            own = dict(known)[i]
            if own and len(own & here) >= 0.5 * len(own):
                want.setdefault(r.doc_id, set()).add(i)
    got = {r.id: r.n_items for r in decontaminate.contained(texts, items).where("contaminated").collect()}
    assert want and set(want) <= set(got) and all(got[i] >= len(v) for i, v in want.items())
    assert len(got) <= 1.2 * len(want)
