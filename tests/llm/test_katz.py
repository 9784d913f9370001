"""Katz backoff against dictionaries in plain Python; its distributions sum to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from obsexp.llm import katz

SCHEMA = "doc_id long, text string, score double, chunk long, held string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, START, K = ("end",), ("start",), katz.CUTOFF


def tokens(text):
    return [*WORD.findall((text or "").translate(A_Z)), END]


class Plain:
    """The model, term by term."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for t in texts:
            words = tokens(t)
            self.uni.update(words)
            for v, w in zip([START, *words], words):
                self.bi[v][w] += 1
        self.total = sum(self.uni.values())
        self.d1 = self.discount(Counter(self.uni.values()))
        self.d2 = self.discount(Counter(c for ws in self.bi.values() for c in ws.values()))
        left = sum(c * (1 - self.d1.get(c, 1)) for c in self.uni.values())
        self.size = self.total if left > 0 else self.total + 1
        self.unknown = (left if left > 0 else 1) / self.size

    @staticmethod
    def discount(n):
        out = {}
        q = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - q) / (1 - q) if n[r] and q != 1 else 0.0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def p1(self, w):
        c = self.uni.get(w, 0)
        return c * self.d1.get(c, 1) / self.size if c else self.unknown

    def p2(self, v, w):
        after = self.bi.get(v)
        if not after:
            return self.p1(w)
        left = sum(c * (1 - self.d2.get(c, 1)) for c in after.values())
        size = sum(after.values()) + (0 if left > 0 else 1)
        if w in after:
            return after[w] * self.d2.get(after[w], 1) / size
        return (left if left > 0 else 1) / size / (1 - sum(self.p1(x) for x in after)) * self.p1(w)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(rows, docs):
    model = Plain([t for i, t in docs if not held(i)])
    want = defaultdict(list)
    for i, t in docs:
        words = tokens(t)
        base = sum(math.log10((model.uni.get(w, 0) + 1) / (model.total + len(model.uni) + 1)) for w in words)
        score = sum(math.log10(model.p2(v, w)) for v, w in zip([START, *words], words))
        want[i].append((held(i), len(words), sum(w in model.uni for w in words), model.total, base, score))
    assert len(rows) == len(docs)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    for i in want:
        for g, w in zip(sorted(got[i]), sorted(want[i])):
            assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)
    return model


def corpus(n=300):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeXYZé", k=rng.randint(1, 3))) for _ in range(150)]
    texts = [" ".join(words[min(149, int(rng.expovariate(0.05)))] for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return list(enumerate(texts)) + [(9000, "new\u00a0word  K\u212a\x0bx"), (9001, None), (9001, None), (None, "a A a")]


def test_scores_match_and_every_context_sums_to_one(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 0.0, 1, "x") for i, t in docs], SCHEMA)
    model = check(katz.score_documents(df.repartition(3)).collect(), docs)
    for v in [START, *list(model.bi)[:40]]:
        assert sum(model.p2(v, w) for w in model.uni) + model.p2(v, ("unknown",)) == pytest.approx(1.0, abs=1e-12)


def test_frequent_contexts_and_many_partitions_change_nothing(spark):
    docs = corpus(200)
    df = spark.createDataFrame([(i, t, 0.0, 1, "x") for i, t in docs], SCHEMA)
    check(katz.score_documents(df.repartition(3), hot=20, tokens_per_partition=300).collect(), docs)


def test_no_training_rows_and_no_rows(spark):
    out = [i for i in range(40) if held(i)][:2]
    df = spark.createDataFrame([(i, "a b", None, None, None) for i in out], SCHEMA)
    rows = katz.score_documents(df).collect()
    assert [(r.n_known, r.train_tokens, r.score, r.base_score) for r in rows] == [(0, 0, 0.0, 0.0)] * 2
    assert katz.score_documents(df.limit(0)).collect() == []


def test_held_out_texts_are_likelier_than_by_the_base(spark, small, registered):
    rows = registered.queries()["op7_katz_scores"](spark, small).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(rows, docs)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
