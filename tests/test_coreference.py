"""Names are merged as one by one, the most mentioned first."""

import random

import pytest

from ledgerleaf.operators import coreference


def alike(a, b):
    a, b = a.lower(), b.lower()
    x, y = set(a.split(" ")), set(b.split(" "))
    return a == b or a in b or b in a or len(x & y) >= 0.8 * min(len(x), len(y))


def greedy(names):
    """names: {name: mentions}."""
    out, canonical = {}, []
    for name in sorted(names, key=lambda n: (-names[n], n)):
        out[name] = next((c for c in canonical if alike(c, name)), name)
        if out[name] == name:
            canonical.append(name)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_one_by_one(spark, seed):
    rng = random.Random(seed)
    words = ["Steel", "steelworks", "North", "Holdings", "A", "AB", "Acme", "of", "India", "Works", "Ltd", "x", "Abcdefgh", "Abcdefghij"]
    rows, want = [], {}
    for doc in (1, 2, 3):
        names = {" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 6]))): rng.randrange(1, 6) for _ in range(50)}
        rows += [(doc, n, m) for n, m in names.items()]
        want |= {(doc, n): c for n, c in greedy(names).items()}
    got = {(r.d, r.name): r.canonical for r in coreference.canonical_names(spark.createDataFrame(rows, "d int, name string, mentions long"), ["d"]).collect()}
    assert got == want
    assert all(got[d, c] == c for (d, _), c in got.items()), "no canonical name has another one"
    assert len(set(got.values())) < len(rows) / 3


def test_a_chain_of_decisions(spark):
    """Each name is alike to the next only: every other one becomes canonical, one decision after the other."""
    names = {f"w{i} w{i + 1}": 100 - i for i in range(0, 12)}
    extra = {f"w{i} w{i + 1} w{i + 2} w{i + 3}": 50 - i for i in range(0, 12, 3)}
    rows = [(1, n, m) for n, m in (names | extra).items()] + [(None, "a", 1), (1, None, 4), (2, "", 3), (2, "q", 1), (1, "w0 w1", 0)]
    got = {r.name: r.canonical for r in coreference.canonical_names(spark.createDataFrame(rows, "d int, name string, mentions long"), ["d"]).where("d = 1").collect()}
    assert got == greedy(names | extra)


def test_documents_are_apart_and_merged(spark):
    found = [(1, 0, "Acme Limited", "COMPANY", 4, 0.9), (1, 1, "ACME Ltd.", "COMPANY", 2, 0.7), (1, 2, "Acme Steel", "COMPANY", 2, 0.8), (2, 0, "Acme Steel", "COMPANY", 9, 1.0), (1, 3, "Mr. Ravi Rao", "PERSON", 1, 1.0), (1, 4, "Ravi Rao", "PERSON", None, 0.5), (1, 5, "SEBI", "ORG", 1, 1.0), (1, 6, "SEBI Board", "ORG", 1, 1.0), (None, 7, "x", "ORG", 1, 1.0)]
    rows = spark.createDataFrame(found, "document_id int, ordinal int, name string, entity_type string, page int, confidence double")
    got = {(r.document_id, r.entity_type, r.canonical): (r.mentions, r.aliases, r.pages, r.first, round(r.confidence, 6)) for r in coreference.merged_entities(rows).collect()}
    assert got == {
        (1, "COMPANY", "Acme"): (3, ["ACME Ltd.", "Acme Limited", "Acme Steel"], [2, 4], 0, 0.8), (2, "COMPANY", "Acme Steel"): (1, ["Acme Steel"], [9], 0, 1.0),
        (1, "PERSON", "Ravi Rao"): (2, ["Mr. Ravi Rao", "Ravi Rao"], [1], 3, 0.75), (1, "ORG", "SEBI"): (1, ["SEBI"], [1], 5, 1.0), (1, "ORG", "SEBI Board"): (1, ["SEBI Board"], [1], 6, 1.0),
    }


def test_no_names(spark):
    assert coreference.canonical_names(spark.createDataFrame([], "d int, name string, mentions long"), ["d"]).count() == 0
