"""Mixing: targets against a loop in plain Python, sampling against its defining properties."""

import math
import re
from collections import defaultdict

import pytest

from obsexp.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string, key int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in names}
        capped |= over


def docs_of(spark, per_source):
    rows, i = [], 0
    for s, lengths in per_source.items():
        for n in lengths:
            rows.append((i, " ".join(f"w{j}" for j in range(n)), s, "x", 0))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def check(rows, tolerance):
    taken, size, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for r in rows:
        assert r.source_size == size[r.source]
    want = plain_targets(dict(size))
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= tolerance * largest[s] + 1e-6


def test_targets_and_taken_words(spark):
    lengths = {"é": [5, 50, 500], "a": [7] * 400, "Z": [1 + i % 90 for i in range(9000)], None: [3, 4], "b": [2]}
    df = docs_of(spark, lengths)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    check(rows, 0.5)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_importance_changes_odds_not_totals(spark):
    df = docs_of(spark, {"a": [10] * 3000, "b": [10] * 300}).selectExpr("*", "if(doc_id % 2 = 0, 4.0, 1.0) as imp")
    rows = mixing.mix(df, importance="imp").where("source = 'a'").collect()
    check(mixing.mix(df, importance="imp").collect(), 1.5)
    even = sum(r.copies for r in rows if r.doc_id % 2 == 0)
    assert even > 1.5 * sum(r.copies for r in rows if r.doc_id % 2)


def test_nulls_ties_and_no_rows(spark):
    rows = [(None, None, None, None, None)] * 2 + [(1, "", "s", "x", 1), (2, "a b c", "s", "x", 1), (2, "a b c", "s", "x", 1)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5 and sum(r.taken for r in out) == 6 and all(r.taken == 0 for r in out if r.size == 0)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "s", "x", 1)], SCHEMA)
    assert [r.taken for r in mixing.mix(blank).collect()] == [0]


def test_documents_repeat_as_decided(spark):
    df = docs_of(spark, {"a": [4] * 50, "b": [9] * 500, "c": [3] * 10})
    df = df.union(df.limit(30))
    want = defaultdict(int)
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.copies
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
        assert r.key == 0
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_registered_query(spark, small, registered):
    rows = registered.queries()["op2_source_mixing"](spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    by_id = {d.doc_id: d for d in docs}
    assert len(rows) == len(docs)
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += len(WORD.findall(d.text or ""))
    want = plain_targets(dict(sizes))
    for r in rows:
        d = by_id[r.doc_id]
        assert r.size == len(WORD.findall(d.text or "")) and r.target == pytest.approx(want[d.source])
        assert r.source_size == sizes[d.source]


def plain_sample(rows):
    """Residual copies of one source, from what ``mix`` says of size, draw and target."""
    words = sum(r.size for r in rows)
    target = rows[0].target
    whole = min(int(target // words), 3)
    rest = target - whole * words
    weight = {r.doc_id: math.isqrt(r.size - 1) + 1 for r in rows}
    certain = set()
    while True:
        open_mass = sum(weight[r.doc_id] * r.size for r in rows if r.doc_id not in certain)
        rate = (rest - sum(r.size for r in rows if r.doc_id in certain)) / open_mass
        more = {r.doc_id for r in rows if rate * weight[r.doc_id] >= 1} - certain
        if not more:
            break
        certain |= more

    def rank(r):
        u, p = (r.draw + 0.5) / 2**52, rate * weight[r.doc_id]
        if r.doc_id in certain:
            return 0.0
        return u / (1 - u) * (1 - p) / p if p else math.inf

    taken, seen = {}, 0
    for r in sorted(rows, key=lambda r: (rank(r), r.doc_id)):
        near = seen + r.size <= rest or (seen < rest and seen + r.size - rest < rest - seen)
        taken[r.doc_id], seen = whole + int(near), seen + r.size
    return taken, certain


def test_sample_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(mixing, "INTERVAL_ROWS", 16)
    lengths = {"a": [9] * 50, "b": [1 + (i * i) % 97 for i in range(800)] + [4000, 2500, 900, 60, 60],
               "c": [2 + i % 11 for i in range(1500)], None: [1 + i % 40 for i in range(600)]}
    rows = mixing.mix(docs_of(spark, lengths)).collect()
    check(rows, 0.5)
    sure = 0
    for name in lengths:
        own = [r for r in rows if r.source == name]
        want, certain = plain_sample(own)
        assert {r.doc_id: r.copies for r in own} == want
        sure += len(certain)
    assert sure  # the very long ones are beyond chance


def test_longer_documents_are_likelier(spark):
    df = docs_of(spark, {"a": [4] * 3000 + [100] * 3000, "b": [30] * 4000, "c": [30] * 4000})
    rows = [r for r in mixing.mix(df).collect() if r.source == "a"]
    short = sum(r.copies for r in rows if r.size == 4)
    long = sum(r.copies for r in rows if r.size == 100)
    assert {r.copies for r in rows} == {0, 1} and long / short == pytest.approx(5, rel=0.3)


def test_odd_importance_has_a_place(spark):
    values = "array(null, double('nan'), -3.0D, 0.0D, 1e300D, double('inf'), 0.25D, 1.0D)[cast(doc_id % 8 as int)] as imp"
    df = docs_of(spark, {"a": [10] * 800, "b": [10] * 8000}).selectExpr("*", values)
    rows = mixing.mix(df, importance="imp").collect()
    check(rows, 1.5)
    assert {r.copies for r in rows if r.source == "b" and r.doc_id % 8 in (4, 5)} == {1}
