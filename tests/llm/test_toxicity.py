"""Toxicity: neighbours against a full comparison, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np

from obsexp.llm import toxicity
from obsexp.llm.toxicity import Index, Scorer

DOCS = "doc_id long, text string, score double, label int, row string"
LABELS = "doc_id long, quality int, toxic int"


def vectors(rng, n, n_terms, groups=1):
    """Term counts of texts; each of ``groups`` has terms of its own, and some terms are common to all."""
    out = []
    for i in range(n):
        own, low = n_terms // groups, i % groups * (n_terms // groups)
        out.append({(low + rng.randrange(own)) if rng.random() < 0.8 else rng.randrange(n_terms): rng.randint(1, 4)
                    for _ in range(rng.randint(1, 12))})
    return out


def built(texts, idf, labels=None, block=toxicity.BLOCK):
    t = np.array([t for c in texts for t in c], np.int64)
    n = np.array([n for c in texts for n in c.values()], float)
    terms = [f"t{i:03d}".encode() for i in range(len(idf))]
    ids = np.arange(len(texts)) * 3
    index = Index.of(terms, idf, ids, np.array(labels or [0] * len(texts), float), np.array([len(c) for c in texts]), t, n, block=block)
    return Scorer(index)


def unit(counts, idf):
    raw = {t: n * idf[t] for t, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
    return {t: w / norm for t, w in raw.items()}


def test_nearest_equals_comparing_everything():
    rng = random.Random(1)
    for groups in (1, 6):
        idf = np.array([rng.choice([0.0, 1 + rng.random() * 4, 1 + rng.random() * 4]) for _ in range(120)])
        texts = vectors(rng, 700, 120, groups) + [{3: 1}] * 90 + [{}]
        scorer = built(texts, idf, block=16)
        units = [unit(c, idf) for c in texts]
        for query in vectors(rng, 60, 120, groups) + [{3: 2}, {}, texts[5]]:
            q = unit(query, idf)
            want = sorted((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 9), 3 * i) for i, v in enumerate(units))
            want = [(i, -s) for s, i in want if s < 0][:25]
            t = np.array([t for t in q if q[t] > 0], np.int64)
            (cosine, near), = scorer.nearest([(t, np.array([q[x] for x in t]))], 25)
            assert [int(scorer.index.ids[p]) for p in near] == [i for i, _ in want]
            assert all(math.isclose(c, s, abs_tol=1e-8) for c, (_, s) in zip(cosine, want))


def test_bounds_leave_blocks_unopened():
    rng = random.Random(2)
    idf = np.array([1 + rng.random() * 4 for _ in range(240)])
    scorer = built(vectors(rng, 3000, 240, 6), idf, block=32)
    for query in vectors(rng, 100, 240, 6):
        q = unit(query, idf)
        list(scorer.nearest([(np.array(list(q), np.int64), np.array(list(q.values())))], 25))
    assert scorer.opened < 0.5 * scorer.met


def test_the_main_direction_puts_groups_together():
    rng = random.Random(5)
    texts = vectors(rng, 640, 240, 2)
    sizes = np.array([len(c) for c in texts])
    t, n = np.array([t for c in texts for t in c]), np.array([1.0 for c in texts for _ in c])
    order = toxicity.arrange(sizes, t, n, 240, 32)
    assert sorted(order) == list(range(640))
    parts = [int(sum(i % 2 for i in order[b:b + 32])) for b in range(0, 640, 32)]
    assert sum(p <= 4 or p >= 28 for p in parts) >= 16


def test_isotonic_steps():
    raw, label = np.array([0.1, 0.2, 0.2, 0.5, 0.6, 0.9]), np.array([0.0, 1.0, 0.0, 0.0, 1.0, 1.0])
    knots, levels = toxicity.isotonic(raw, label, np.full(6, 1e9), 0.5)
    assert knots.tolist() == [0.1, 0.2, 0.6] and np.allclose(levels, [0, 1 / 3, 1])
    assert len(toxicity.isotonic(raw[:0], label[:0], raw[:0], 0.0)[0]) == 0


def tables(spark, n=1600):
    rng = random.Random(7)
    stems = ["vilea", "grotz"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("aeiklmnrst", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(stems) + "".join(rng.choices("bcd", k=2))
        docs.append((i, " ".join(words), 0.5, 9, "x"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {i: y for i, _, y in labels}


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = tables(spark)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    caught = [r for r in held if truth[r.doc_id] and r.predicted]
    wrong = [r for r in held if not truth[r.doc_id] and r.predicted]
    assert len(caught) >= 0.9 * sum(truth[r.doc_id] for r in held) and len(wrong) <= 0.02 * len(held)
    assert all(not r.held_out or r.doc_id not in r.neighbours for r in rows)
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_rare_toxic_words_count_and_clean_texts_have_neighbours(spark):
    rng = random.Random(3)
    plain, rude = [f"{a}{b}o" for a in "bdfgk" for b in "lmnrst"], [f"{a}xz{b}" for a in "qwy" for b in "abcdefgh"]
    docs, labels, truth = [], [], {}
    for i in range(640):
        words = rng.choices(plain, k=30)
        truth[i] = int(i % 8 == 0)
        if truth[i]:
            words[3:6] = rng.sample(rude, 3)  # each in about six of 480 examples
        docs.append((i, " ".join(words), 0.5, 9, "x"))
        labels.append((i, 1, truth[i]))
    rows = toxicity.score_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert all(len(r.neighbours) == toxicity.NEIGHBOURS for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted for r in held if truth[r.doc_id]) >= 0.9 * sum(truth[r.doc_id] for r in held)
    assert sum(r.predicted for r in held if not truth[r.doc_id]) <= 0.02 * len(held)


def test_labels_keep_their_true_shares_in_a_bounded_sample(spark):
    rng = random.Random(4)
    words = [f"{a}{b}o" for a in "bdfgk" for b in "lmnrst"]
    docs = [(i, " ".join(rng.choices(words, k=30)) if i else "", 0.5, 9, "x") for i in range(800)]
    labels = [(i, 1, int(i % 10 == 0)) for i in range(800)]
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = toxicity.score_documents(docs, labels, per_label=40).collect()
    held = [r.score for r in rows if r.held_out]
    assert abs(sum(held) / len(held) - 0.1) < 0.04
    empty, = (r.score for r in rows if r.doc_id == 0)
    assert empty < 0.3


def test_scores_are_calibrated(spark):
    rng = random.Random(8)
    words = [f"{a}{b}o" for a in "bdfgk" for b in "lmnrst"]
    docs, labels = [], []
    for i in range(3000):
        rate = (0.05, 0.5, 0.9)[i % 3]  # a word tells the rate, nothing tells the label
        docs.append((i, " ".join(rng.choices(words, k=20) + [("axxa", "ezze", "ivvi")[i % 3]] * 4), 0.5, 9, "x"))
        labels.append((i, 1, int(rng.random() < rate)))
    rows = toxicity.score_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: y for i, _, y in labels}
    for low, high in ((0, 0.25), (0.25, 0.7), (0.7, 1.01)):
        held = [r for r in rows if r.held_out and low <= r.score < high]
        assert len(held) > 100
        assert abs(sum(r.score for r in held) / len(held) - sum(truth[r.doc_id] for r in held) / len(held)) < 0.08


def test_nulls_empty_texts_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", 0.1, 1, "x"), (1, "", 0.1, 1, "x"), (2, "w " * 90000, 0.1, 1, "x")], DOCS)
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (99, 0, 7)], LABELS)
    for labels in (none, odd):
        rows = toxicity.score_documents(docs, labels).collect()
        assert len(rows) == 4 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.score_documents(docs.limit(0), none).collect() == []
    assert toxicity.clean_documents(docs, none).count() == 4


def test_registered_query(spark, small, registered):
    """Every row again, from the same index by comparing with all examples."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    scorer = Scorer(index)
    dense = np.zeros((len(index.ids), len(index.idf)))
    dense[index.inside, np.repeat(np.arange(len(index.idf)), index.starts[:, -1] - index.starts[:, 0])] = index.values
    got = {}
    for r in registered.queries()["op8_toxicity"](spark, small).collect():
        got.setdefault(r.doc_id, r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        t, w = scorer.query(text)
        cosine = np.round(dense[:, t] @ w, 12)
        near = [p for p in np.lexsort((index.ids, -cosine))[:25] if cosine[p] > 0]
        assert got[i].neighbours == index.ids[near].tolist()
        if near:
            vote = cosine[near] ** 2 * index.votes[near]
            total, share = (cosine[near] ** 2).sum(), vote @ index.labels[near] / vote.sum()
            raw = (total * share + 0.2 * index.background) / (total + 0.2)
            level = index.levels[max(0, np.searchsorted(index.knots, raw + 1e-12, side="right") - 1)]
            assert math.isclose(got[i].score, min(1, max(0, level)), abs_tol=1e-9)
        else:
            assert got[i].score == index.background
