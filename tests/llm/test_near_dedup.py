"""Near-duplicates against the full comparison; signatures against the similarity they estimate."""

import random

import numpy as np

from obsexp.llm import near_dedup, shingles

SCHEMA = "doc_id long, text string, key string, row int, class_id string"


def plain_similarity(a, b):
    """The definition, term by term."""
    x, y = dict(zip(a[0].tolist(), a[1])), dict(zip(b[0].tolist(), b[1]))
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


def sets_of(text):
    return shingles.shingle_counts(shingles.words_of(text), shingles.WordHashes())


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]


def edited(rng, base, share):
    return [w if rng.random() > share else "".join(rng.choices("xyz", k=5)) for w in base]


def test_similarity_is_the_defined_one():
    rng = random.Random(1)
    for _ in range(40):
        base = words(rng, rng.randint(5, 40)) * rng.randint(1, 3)
        a, b = sets_of(" ".join(base)), sets_of(" ".join(edited(rng, base, 0.05) + base[:7]))
        assert abs(shingles.probability_jaccard(a, b) - plain_similarity(a, b)) < 1e-12


def test_registers_agree_as_often_as_the_similarity_says():
    rng = random.Random(2)
    base = words(rng, 120)
    sets = [sets_of(" ".join(base + base[:40])), sets_of(" ".join(edited(rng, base, 0.03)))]
    sig = shingles.signatures(sets, 4096)
    assert abs((sig[0] == sig[1]).mean() - shingles.probability_jaccard(*sets)) < 0.03
    assert (sig[0] != 0).all() and set(np.unique(sig[0])) <= set(sets[0][0])


def corpus():
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randint(30, 150))
        texts += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))) for _ in range(rng.randint(1, 8))]
    chain = words(rng, 100)  # a chain of copies whose ends are far apart
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[3:] + words(rng, 3)
    return texts + ["a b", "A  b", "a b c", "", "   ", None, "one two three four five six"]


def brute(texts, threshold=0.8):
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and shingles.probability_jaccard(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_classes_match_the_full_comparison(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df.repartition(4)).collect()}
    want = brute(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_a_large_group_around_the_threshold_in_small_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base = words(rng, 120)
    texts = [" ".join(edited(rng, base, rng.choice([0.012, 0.02, 0.025]))) for _ in range(70)]
    texts += [" ".join(words(rng, 40)) for _ in range(10)]
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    want = brute(texts)
    assert len(set(want)) > 12 and [got[i] for i in range(len(texts))] == want


def test_blocks_return_forests_of_all_links():
    rng = random.Random(7)
    base = words(rng, 100)
    texts = [" ".join(edited(rng, base, 0.02) + base[:9] * (i % 3)) for i in range(60)]
    sets, rid = [sets_of(t) for t in texts], np.arange(60) + 100
    part = np.array([i if i % 4 else 0 for i in range(60)])  # some are joined already
    for side in (np.zeros(60, bool), rid % 2 == 0):
        edges = near_dedup.compare(rid, part, side, sets, 0.8)
        assert len(edges) < len(set(part))

        def grouped(pairs):
            root = {int(p): int(p) for p in part}
            for i, j in pairs:
                a, b = root[int(part[i])], root[int(part[j])]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
            return root

        every = [(i, j) for i in range(60) for j in range(i) if (not side.any() or side[i] != side[j])
                 and shingles.probability_jaccard(sets[i], sets[j]) >= 0.8]
        assert grouped(every) == grouped([(u - 100, v - 100) for u, v in edges])


def test_bitmaps_pick_the_numbered_rows(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, (5 << 33), (5 << 33) + 70000]
    rows = spark.createDataFrame([(n + d,) for n in numbers for d in (0, 1, 9)], "rid long").distinct()
    got = near_dedup._among(rows, spark.createDataFrame([(n,) for n in numbers], "_r long"), "bits").collect()
    assert sorted(r.rid for r in got) == sorted(numbers)


def test_repeats_null_ids_long_texts_and_no_rows(spark):
    rng = random.Random(4)
    long = " ".join(words(rng, 30000))
    rows = [(7, long, "x", 1, "c"), (5, long + " end", "x", 1, "c"), (7, long, "x", 1, "c"), (None, long, None, None, None),
            (None, "p q r s t u", None, None, None), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 5, False), (3, 3, True), (5, 5, True), (7, 5, False), (7, 5, False)]
    kept = near_dedup.distinct_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 5]
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_registered_query(spark, small, registered):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted((r.doc_id, r.class_id) for r in registered.queries()["op9_minhash_dedup"](spark, small).collect())
    assert got == list(enumerate(brute(texts)))
