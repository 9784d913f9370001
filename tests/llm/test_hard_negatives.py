"""Hard negatives against the full comparison."""

import math

import numpy as np
from pyspark.sql import functions as F

from obsexp.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rid string, anchor int"


def brute(rows, step=100, relabel=False):
    ok = []
    for i, v, y in rows:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if relabel and i % 7 == 0:
            y = (y + 1) % 10
        ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v], y))
    out = []
    for n, (i, a, y) in enumerate(ok):
        if i % step:
            continue
        scored = [(-sum(p * q for p, q in zip(a, b)), j, z) for m, (j, b, z) in enumerate(ok) if m != n and len(a) == len(b)]
        for s, p, _ in sorted(r for r in scored if r[2] == y)[:5]:
            found = sorted(r for r in scored if r[2] != y and 30 * -s <= 100 * -r[0] <= 90 * -s)[:10]
            out += [(i, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(found)]
    return sorted(out)


def planted(n=900, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, dim))
    rows = []
    for i in range(n):
        # Coarse components, so that scores tie; a third of the rows share one label.
        v = np.round(base[i % 12] + 0.7 * rng.standard_normal(dim), 1)
        rows.append((i, [float(np.float32(x)) for x in v], 3 if i % 3 == 0 else int(rng.integers(0, 10))))
    rows += [(n, None, 1), (n + 1, [1.0] * (dim - 1) + [float("nan")], 1), (n + 2, [1.0, None], 2), (n + 3, [], 1),
             (n + 4, [1.0, 2.0], 1), (1000, [2.0, 4.0], 1), (n + 6, [2.0, 5.0], 2), (n + 7, [float("inf"), 1.0], 1),
             (n + 8, [0.0] * dim, 4), (1100, [0.0] * dim, 4), (1200, [1.0] * dim, None), (None, [1.0] * dim, 3)]
    return rows


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(7)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % 20 == 0, **options).collect()))


def test_windows_match_the_full_comparison(spark):
    rows = planted()
    want = brute(rows, 20)
    assert len(want) > 1000
    assert mined(spark, rows) == want
    # Several chunks of anchors give the same result.
    assert mined(spark, rows, chunk_components=150) == want


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-H.MOST, H.MOST, (4, 64)).astype(np.int32) for _ in range(2))
    want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
    assert H.products(a, b).tolist() == want
    assert H.products(a % 256, b % 256).tolist() == [[sum(int(p) % 256 * (int(q) % 256) for p, q in zip(x, y)) for y in b] for x in a]


def test_repeated_rows_and_no_rows(spark):
    # Repeated anchors are each other's positive and give one result each.
    rows = [(0, [1.0, 0.0], 1)] * 2 + [(5, [0.5, 0.1], 2)] * 12 + [(7, [0.5, 0.2], 2)]
    got = mined(spark, rows)
    assert got == sorted([(0, 0, k + 1, 5, 65536, 32768) for k in range(10)] * 2)
    assert mined(spark, [(0, [1.0, 0.0], 1), (3, [0.5, 0.0], 2)]) == []  # no positive
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    assert H.mine(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_limits_are_whole_percentages(spark):
    values = [0, 1, 2, 9, 10, 11, 99, 100, 101, 333, 2**62 + 7]
    df = spark.createDataFrame([(v,) for v in values], "score long")
    got = df.select(H._percent(F.col("score"), 90), H._percent(F.col("score"), 30, 99)).collect()
    assert [tuple(r) for r in got] == [(90 * v // 100, -(-30 * v // 100)) for v in values]


def test_registered_query(spark, small, registered):
    got = sorted(map(tuple, registered.queries()["op13_hard_negatives"](spark, small).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert got == brute(rows, relabel=True) and got
