"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np

from obsexp.llm import lexical_search as L

DOCS = "doc_id long, text string, item_id string, score int, rank string"
ITEMS = "item_id long, text string, doc_id int, term string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """(item, rank, doc, score) with Python integers; rows of one item id are one item."""
    bags = [(i, terms_of(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total = sum(len(b) for _, b in bags)
    holders, wanted = {}, {}
    for _, b in bags:
        for t in set(b):
            holders[t] = holders.get(t, 0) + 1
    for i, text in items:
        wanted.setdefault(i, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, b in bags:
            m = 100 - 50 + 50 * len(b) * len(bags) // total
            score = 0
            for t in terms & set(b):
                w = math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * holders[t] + 1)))
                tf = b.count(t)
                score += w * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(*r, 1, "z") for r in items], ITEMS)
    return sorted((tuple(r) for r in L.search(d, q, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def planted(n=700, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Éa", "中文", "x1", "A"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=int(rng.paretovariate(1.1) * 4) % 400 + 1))) for i in range(n)]
    # Copies: many documents of equal score, cut off inside the tie; ids in mixed order, some null.
    docs += [(5000 - i, "w7 w9, W7-copy!") for i in range(120)] + [(None, "w7 w9, w7-copy!")] * 3
    docs += [(9001, None), (9002, ""), (9003, " ,.\n"), (9004, "long " * 30000 + "w250"), (9005, "tail"), (9005, "tail")]
    items = [(i, " ".join(rng.choices(words, k=12)) + (" " + docs[i][1] if i % 3 else "")) for i in range(25)]
    return docs, items + [(100, "copy"), (101, None), (102, "nowhere"), (103, "tail TAIL"), (103, "w1"), (None, "w2 w3"), (104, "")]


def test_ranks_are_those_of_the_full_comparison(spark):
    docs, items = planted()
    want = brute(docs, items)
    assert searched(spark, docs, items) == want
    # Several passes, small k.
    assert searched(spark, docs, items, k=3, pass_bytes=2000) == brute(docs, items, 3)


def test_thresholds_from_the_longest_leave_results_alone(spark, monkeypatch):
    docs, items = planted(400, 5)
    monkeypatch.setattr(L, "FIRST_ROWS", 20)
    assert searched(spark, docs, items, k=5) == brute(docs, items, 5)


def test_bounds_skip_buckets_and_documents():
    rng = np.random.default_rng(1)
    rows, vocabulary = 4000, 200
    sizes = np.minimum(rng.geometric(0.05, rows), 100)
    terms = np.concatenate([rng.choice(vocabulary, s, replace=False) for s in sizes])
    impacts = (rng.pareto(1.5, len(terms)) * 1000).astype(np.int64) % 900_000 + 1
    weights = rng.integers(100, 9000, vocabulary)
    row = np.repeat(np.arange(rows), sizes)
    length = np.sqrt(np.bincount(row, weights[terms] * impacts.astype(float) ** 2, rows))
    sets = [np.unique(rng.choice(vocabulary, 15)) for _ in range(30)]
    sets = [t[np.argsort(-weights[t], kind="stable")] for t in sets]
    items = L.Items(list(range(30)), np.cumsum([0, *map(len, sets)]), np.concatenate(sets), weights[np.concatenate(sets)])
    search = L.Search(items, 10)
    order = np.argsort(-length, kind="stable")
    for i in range(0, rows, 250):
        some = order[i:i + 250]
        inside = [np.flatnonzero(row == r) for r in some]
        flat = np.concatenate(inside)
        search.add(L.Bucket.of(some, some, np.zeros(250, bool), length[some], np.array([len(x) for x in inside]), terms[flat], impacts[flat]))
    got = search.results()
    dense = np.zeros((rows, vocabulary), np.int64)
    dense[row, terms] = impacts
    want = []
    for i, t in enumerate(sets):
        score = dense[:, t] @ weights[t]
        want += [(i, int(d), int(score[d])) for d in np.lexsort((np.arange(rows), -score))[:10]]
    assert list(zip(*(got.column(c).to_pylist() for c in ("item_id", "doc_id", "score")))) == want
    assert search.met["buckets compared"] < 0.7 * search.met["buckets"]
    assert search.met["documents scored"] < 0.2 * search.met["documents"]


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


def test_registered_query(spark, small, registered):
    got = sorted(map(tuple, registered.queries()["op12_lexical_search"](spark, small).collect()))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert got == sorted(brute(docs, items))
