import math
import random
from collections import Counter, defaultdict

import numpy as np
from helpers import docs, odd, words

from ledgerleaf.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randint(20, 300))]
        bad = rng.random() < 0.3
        for _ in range(rng.randint(1, 4) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "wretch", "fiend"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900, 4)
    known = spark.createDataFrame([x for x in labels if x[0] % 3 != 1], "id long, toxic int")
    got = {r.id: r for r in toxicity.score(docs(spark, rows), known).collect()}
    held = [x for x in labels if x[0] % 3 == 1]
    caught = sum(got[i].predicted for i, y in held if y) / sum(y for _, y in held)
    wrong = sum(got[i].predicted for i, y in held if not y)
    assert caught >= 0.9 and wrong <= 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (4, None)], "id long, toxic int")
    got = toxicity.score(odd(spark), labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "id long, toxic int")
    assert len({r.score for r in toxicity.score(odd(spark), none).collect()}) == 1
    assert toxicity.score(docs(spark, []), none).count() == 0


def plain_ratios(texts, leaning):
    """A function that gives each word's log ratio, from dictionaries of what texts (label, text) hold."""
    followed, before_pair = [defaultdict(set), defaultdict(set)], [defaultdict(set), defaultdict(set)]
    for label, t in texts:
        w = ["", "", *words(t)]
        for a, b, c in zip(w, w[1:], w[2:]):
            before_pair[label][b, c].add(a)
            followed[label][c].add(b)
    longs, shorts = [defaultdict(set), defaultdict(set)], [defaultdict(set), defaultdict(set)]
    for k in (0, 1):
        for w in followed[k]:
            longs[k][w[:6]].add(w)
        for w in longs[k]:
            shorts[k][w[:4]].add(w)

    def discount(counts):
        c = Counter(len(v) for v in counts.values())
        return c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5

    both = lambda tables, w: sum(len(t[w]) for t in tables if w in t) + 0.5
    every = [{w for t in tables for w in t} for tables in (shorts, longs, followed)]

    def one_level(tables, k, w, below, mates, n_all):
        counts = tables[k]
        total, d = max(sum(map(len, counts.values())), 1), discount(counts)
        left = sum(min(len(v), d) for v in counts.values()) / total if counts else 1.0
        share = both(tables, w) / (mates + 0.5) if n_all else 0.5 / (mates + 0.5)
        return max(len(counts[w]) - d, 0) / total * (w in counts) + left * below * share

    def probability(k, prior, w):
        short, long = w[:4], w[:6]
        p = one_level(shorts, k, short, 1.0, sum(both(shorts, x) for x in every[0]), short in every[0])
        p = one_level(longs, k, long, p, sum(both(longs, x) for x in every[1] if x[:4] == short), long in every[1])
        p = one_level(followed, k, w, p, sum(both(followed, x) for x in every[2] if x[:6] == long), w in every[2])
        pairs = before_pair[k]
        d, own = discount(pairs), {x: v for x, v in pairs.items() if x[0] == prior}
        n = sum(map(len, own.values())) + leaning
        known = any(x[0] == prior for t in before_pair for x in t)
        p *= (sum(min(len(v), d) for v in own.values()) + leaning) / n if known else 1.0
        return p + (max(len(own.get((prior, w), ())) - d, 0) / n if (prior, w) in own else 0.0)

    return lambda t: [math.log(probability(1, a, b)) - math.log(probability(0, a, b)) for a, b in zip(["", *words(t)], words(t))]


def test_log_ratios_word_by_word(spark):
    rng = random.Random(3)
    vocabulary = [f"stem{i % 4}xy{i}" for i in range(20)] + [f"a{i}" for i in range(15)]
    texts = [(i % 2, " ".join(rng.choice(vocabulary[i % 2 :: 1 + i % 2]) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    model = toxicity.kneser_ney(toxicity.pair_counts(spark.createDataFrame(texts, "label int, text string")), 7.0)
    want = plain_ratios(texts, 7.0)
    for t in [t for _, t in texts[:6]] + ["stem1new stem1xy1 unheard of a3", "a1"]:
        data = np.frombuffer(t.encode(), np.uint8)
        got = model.log_ratio(*toxicity.plain_words(data, np.array([0, len(data)])))
        assert np.allclose(got, want(t))


def test_features_are_means(spark):
    class Fixed(toxicity.Model):
        def log_ratio(self, words, h):
            return np.arange(len(h), dtype=float) % 7

    model = Fixed([], 0.0, *(np.zeros(0),) * 4)
    data = np.frombuffer(b"a b c d e f g h" + b"x", np.uint8)
    got = model.features(*toxicity.plain_words(data, np.array([0, 15, 15, 16])))
    assert np.allclose(got, [[21 / 8, 15 / 3, 15 / 3], [0, 0, 0], [1 / 3] * 3])
