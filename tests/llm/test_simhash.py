import xxhash
from helpers import docs, odd, words

from ledgerleaf.llm import simhash, verified


def brute_print(t):
    w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    f = [(i, brute_print(t)) for i, t in rows]
    comp = {i: i for i, _ in f if i is not None}
    for _ in f:
        for i, a in f:
            for j, b in f:
                if None not in (i, j) and (a ^ b).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return sorted((i is None, i or 0, p, comp.get(i)) for i, p in f)


def check(spark, rows):
    got = simhash.dedupe(docs(spark, rows)).collect()
    assert sorted((r.id is None, r.id or 0, r.fp % (1 << 64), r.component_id) for r in got) == brute(rows)


def test_odd_rows(spark):
    check(spark, [(r.doc_id, r.text) for r in odd(spark).collect()])


def test_close_and_far_texts(spark):
    base = " ".join(f"w{i}" for i in range(400))
    check(spark, [(i, base + f" tail{i}") for i in range(12)] + [(100 + i, f"quite other {i} text {i * i}") for i in range(12)])


def test_empty_table(spark):
    assert simhash.dedupe(docs(spark, [])).count() == 0
    assert simhash.near_groups(docs(spark, []), "doc_id").count() == 0


def test_cells_and_tiles_lose_no_link(spark):
    import random

    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    near = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(6)}
    prints = sorted({x - (1 << 64) if x >> 63 else x for x in [*seeds, *near]})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "id long, fp long")
    from ledgerleaf.llm.graph import components

    for rows in (20_000, 2):
        links = components(simhash.near_links(df, cell_rows=rows))
        got = {r.id: r.component_id for r in links.collect()}
        label = list(range(len(prints)))
        for _ in range(8):
            for i, a in enumerate(prints):
                for j, b in enumerate(prints):
                    if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                        label[i] = label[j] = min(label[i], label[j])
        assert all(got.get(i, i) == label[i] for i in range(len(prints)))


def test_wide_groups_join_edits_not_strangers(spark):
    base = [f"w{i}" for i in range(300)]
    edited = base[:150] + ["changed"] + base[151:]
    half = base[:150] + [f"v{i}" for i in range(150)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(half)), (4, " ".join(base))]
    got = {r.id: r.component_id for r in simhash.near_groups(docs(spark, rows), "doc_id", tile_rows=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_wide_groups_are_those_of_exact_similarity(spark, monkeypatch):
    import random

    rng = random.Random(8)
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(240)]
        rows.append((len(rows), " ".join(base)))
        for changes in (1, 3, 4, 5, 6, 7, 8, 9, 10, 12):
            w = list(base)
            for k in rng.sample(range(5, 235), changes):
                w[k] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    rows.append((len(rows), " ".join([f"g0w{i}" for i in range(240)] + [f"g0w{i % 6}" for i in range(400)])))  # repeats count once
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: i for i in sets}
    for _ in range(6):
        for i, a in sets.items():
            for j in range(i // 11 * 11, i):
                if want[i] != want[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
        last = len(rows) - 1
        for j in range(11):
            if want[last] != want[j] and len(sets[last] & sets[j]) >= 0.8 * len(sets[last] | sets[j]):
                want[last] = want[j] = min(want[last], want[j])
    for size in (1024, 3):
        monkeypatch.setattr(simhash, "verified", lambda *a, size=size: verified.verified(*a, tile_rows=size))
        got = {r.id: r.component_id for r in simhash.near_groups(docs(spark, rows), "doc_id").collect()}
        assert got == want
    assert len(set(want.values())) > 60 and want[len(rows) - 1] == 0
