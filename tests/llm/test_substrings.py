import hashlib
import random
from collections import Counter

from helpers import docs, odd, words

from ledgerleaf.llm import substrings


def brute(rows, window):
    w = [words(t) for _, t in rows]
    seen = Counter(tuple(x[p : p + window]) for x in w for p in range(len(x) - window + 1))
    out = []
    for (i, _), x in zip(rows, w):
        gone = [False] * len(x)
        for p in range(len(x) - window + 1):
            if seen[tuple(x[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(a for a, g in zip(x, gone) if not g)
        out.append((i is None, i or 0, len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, window=35):
    got = substrings.dedupe(docs(spark, rows), window=window).collect()
    assert sorted((r.id is None, r.id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, window)


def test_odd_rows_and_repeated_ids(spark):
    check(spark, [(r.doc_id, r.text) for r in odd(spark).collect()])


def test_random_repeats_at_every_offset(spark):
    rng = random.Random(1)
    pool = [[f"p{k}_{i}" for i in range(rng.randint(30, 60))] for k in range(8)]
    rows = []
    for i in range(60):
        own = [f"d{i}_{j}" for j in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(pool)
        rows.append((i, " ".join(own)))
    rows.append((100, "a " * 90))
    check(spark, rows)


def test_empty_table(spark):
    assert substrings.dedupe(docs(spark, [])).count() == 0
