import math
from collections import Counter

import numpy as np
from helpers import docs, odd, words

from ledgerleaf.llm import brown


SMALL = brown.Settings(symbols=8, classes=3, fewest=2, piece_bytes=200, bucket_bytes=400)


def check(spark, rows, training, keep):
    got = brown.score(docs(spark, rows), training=training, settings=SMALL).collect()
    line = lambda t: [*words("".join(c.lower() if c.isascii() else c for c in t or "")), "</s>"]
    c = Counter(x for i, t in rows if keep(i) for x in line(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, len(line(t)), sum(c[x] > 0 for x in line(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in line(t)), 4)) for i, t in rows)
    assert sorted((r.id is None, r.id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_odd_rows(spark):
    check(spark, [(r.doc_id, r.text) for r in odd(spark).collect()], "doc_id <> 1", lambda i: i is not None and i != 1)


def test_nothing_to_learn_from(spark):
    check(spark, [(1, "a b"), (2, None)], "false", lambda i: False)


def test_empty_table(spark):
    assert brown.score(docs(spark, [])).count() == 0


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    n = 12  # even symbols follow odd ones and the other way round
    m = np.zeros((n + 1, n + 1), np.int64)
    for _ in range(4000):
        a = rng.integers(n)
        m[a, rng.choice(np.arange(1 - a % 2, n, 2))] += 1
    m[n, :n] = m[:n, n] = 5
    of = brown.exchange(m, 2, 10)
    assert len({of[i] for i in range(0, n, 2)}) == 1 and len({of[i] for i in range(1, n, 2)}) == 1 and of[0] != of[1]


def plain_score(model, rows, keep, k):
    """Scores and class transitions word by word, from the learned words' classes and counts alone."""
    table = {}
    for r in model.words.collect():
        h, n, cls = np.frombuffer(r.hashes, np.uint64), brown.unplanes(r.counts, np.uint64), np.frombuffer(r.classes, np.uint8)
        table |= {int(x): (int(c), int(g)) for x, c, g in zip(h, n, cls)}
    lines = {}
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, h, rest = brown.words_of(data, np.array([0, len(data)]))
        lines[i] = [table.get(int(x), (0, int(model.ending_class[e]))) for x, e in zip(h, rest)] + [(model.n_texts, k - 1)]
    tokens, types = Counter(), Counter()
    for c, g in [*table.values(), (model.n_texts, k - 1)]:
        tokens[g] += c
        types[g] += 1
    pairs, first, second = Counter(), Counter(), Counter()
    for i, line in lines.items():
        if keep(i):
            for (_, a), (_, b) in zip([(0, k - 1), *line], line):
                pairs[a, b] += 1
                first[a] += 1
                second[b] += 1
    one = lambda b: (second[b] + 1) / (sum(second.values()) + k)
    follows = lambda a, b: (pairs[a, b] + 5 * one(b)) / (first[a] + 5)

    def emission(c, g):
        if g == k - 1:
            return 1.0  # the end is all of its class
        if c:
            return (c - 0.7) / tokens[g]
        return 0.7 * types[g] / tokens[g] if types[g] else 1.0

    assert all(math.isclose(sum(follows(a, b) for b in range(k)), 1) for a in range(k))
    for g in range(k - 1):
        if types[g]:
            assert math.isclose(sum(emission(*x) for x in table.values() if x[1] == g) + emission(0, g), 1)
    return {i: sum(math.log10(follows(a, b)) + math.log10(emission(c, b)) for (_, a), (c, b) in zip([(0, k - 1), *line], line)) for i, line in lines.items()}


def test_scores_word_by_word(spark):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["der", "die"]) + f" noun{rng.randrange(30)} " + rng.choice(["runs", "sleeps", "eats"]) + f" x{rng.randrange(60)}y" for _ in range(rng.randint(0, 12)))) for i in range(60)]
    df = docs(spark, rows)
    keep = lambda i: i % 5 != 0
    keyed = df.selectExpr("doc_id AS _k", "text", "doc_id % 5 <> 0 AS in_training")
    model = brown.learn(keyed, SMALL)
    want = plain_score(model, rows, keep, SMALL.classes + 1)
    got = {r.id: r.score for r in brown.score(df, training="doc_id % 5 <> 0", settings=SMALL).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)


def classes_of(words):
    of = {}
    for r in words.collect():
        of |= {int(x): int(g) for x, g in zip(np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.classes, np.uint8))}
    return of


def test_words_beyond_the_clustered_ones_get_the_class_of_their_like(spark):
    import random

    rng = random.Random(7)
    nouns, verbs = [f"n{i}q" for i in range(40)], [f"v{i}q" for i in range(40)]  # endings tell nothing
    rows = [(i, " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(30))) for i in range(60)]
    keyed = docs(spark, rows).selectExpr("doc_id AS _k", "text", "true AS in_training")
    model = brown.learn(keyed, brown.Settings(symbols=20, classes=2, piece_bytes=500, bucket_bytes=2000))
    of = classes_of(model.words)
    h = lambda w: int(brown.words_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0])
    assert len({of[h(w)] for w in nouns}) == 1 and len({of[h(w)] for w in verbs}) == 1 and of[h(nouns[0])] != of[h(verbs[0])]


def test_classes_are_those_that_contexts_fit_best(spark):
    import random
    from dataclasses import replace

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(70)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(70)], k=rng.randint(0, 40)))) for i in range(80)]
    keyed = docs(spark, rows).selectExpr("doc_id AS _k", "text", "doc_id % 4 <> 0 AS in_training")
    settings = replace(SMALL, fewest=2)
    h = lambda w: int(brown.words_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0])
    texts = brown.as_pieces(keyed, settings.piece_bytes)
    words = brown.vocabulary(texts, 8, settings.symbols)
    counts = Counter(w for i, t in rows if i % 4 for w in t.split())
    keys = np.sort(np.array([h(w) for w, _ in counts.most_common(settings.symbols)], np.uint64))
    matrix = brown.bigrams(texts, keys, brown.REST + len(keys) + 1)
    of = brown.exchange(matrix, settings.classes, settings.sweeps)
    member, k = np.eye(settings.classes + 1)[of], settings.classes + 1
    cc = member.T @ matrix @ member
    p = (cc + 0.5) / (cc + 0.5).sum()
    # word by word: the classes before and after it, each word by its own class or its ending's
    first = {w: int(of[brown.REST + np.searchsorted(keys, np.uint64(h(w)))]) if np.uint64(h(w)) in keys else int(of[int(brown.words_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[2][0])]) for w in vocabulary}
    fits = {w: np.zeros(k - 1) for w in counts}
    for i, t in rows:
        line = [k - 1, *(first[w] for w in t.split()), k - 1]
        for j, w in enumerate(t.split()):
            if i % 4:
                for g in range(k - 1):
                    fits[w][g] += math.log(p[line[j], g] / p[line[j]].sum() / p[:, g].sum()) + math.log(p[g, line[j + 2]] / p[g].sum() / p[:, line[j + 2]].sum())
    want = {h(w): first[w] if np.uint64(h(w)) in keys or counts[w] < 2 else int(fits[w].argmax()) for w in counts}
    for branch_buckets in (4096, 3):  # one branch, then three
        found = brown.classed(texts, words, 8, keys, of, cc, replace(settings, branch_buckets=branch_buckets))
        assert classes_of(found) == want


def test_a_word_has_as_many_contexts_as_there_are_cells():
    rng = np.random.default_rng(1)
    h, cells, n = np.array([5 << 32, 9 << 32], np.uint64), 6, 4000
    batches, total = [], Counter()
    for _ in range(20):
        word, cell = rng.integers(0, 2, n), rng.integers(0, cells, n)
        pair, times = np.unique(word * cells + cell, return_counts=True)
        total.update(dict(zip(pair.tolist(), times.tolist())))
        rows = brown.context_rows(h, *np.divmod(pair, cells), times, 1, 0)
        assert len(rows[0][5]) <= 2 * cells
        batches.append(brown.batch_of([(*r, 0) for r in rows], brown.CONTEXTS + ", node long"))
    (out,) = [b.to_pylist()[0] for b in brown.contexts_summed(iter(batches), cells)]
    size = brown.unplanes(out["counts"], np.uint16)
    cell, times = (brown.widened(out[c], int(size.sum())) for c in ("cells", "times"))
    assert len(cell) <= 2 * cells and {int(w * cells + c): int(t) for w, c, t in zip(np.repeat([0, 1], size), cell, times)} == total
