"""Graph search against brute force: recall, exact scores, order, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from obsexp.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute(rows, query, k=10):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in ok.items():
        if query(i):
            far = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in ok.items() if j != i and len(w) == len(v))
            out[i] = far[:k]
    return out


def check(got, want, least=0.9):
    by_query, hits, total = {}, 0, 0
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {q for q, w in want.items() if w}
    for q, rows in by_query.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == len(want[q])
        keys = [(r.score, r.vec_id) for r in rows]
        assert keys == sorted(keys) and q not in [r.vec_id for r in rows]
        hits += len({r.vec_id for r in rows} & {i for _, i in want[q]})
        total += len(rows)
        known = {i: s for s, i in want[q]}
        assert all(abs(known.get(r.vec_id, r.score) - r.score) < 1e-12 for r in rows)
    assert hits >= least * total, hits / total


def test_recall_over_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + rng.standard_normal(24)]) for i in range(2500)]
    df = spark.createDataFrame([(*r, 1, None, "x") for r in rows], SCHEMA)
    got = ann.nearest(df, F.col("vec_id") % 25 == 0, shard_rows=900, queries_per_task=40).collect()
    check(got, brute(rows, lambda i: i % 25 == 0))


def test_copies_odd_vectors_and_few_candidates(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(400 + i, [3.0 + i, 1.0]) for i in range(5)]
    rows += [(500, None), (510, [0.0, 0.0]), (520, [float("nan"), 1.0]), (530, [None, 1.0]), (540, []), (550, [1.0, 2.0, 3.0]),
             (560, [1.0, 2.0, 4.0]), (570, [float("inf"), 0.0]), (None, [1.0, 2.0]), (10, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, None, 3, None) for r in rows], SCHEMA)
    got = ann.nearest(df, F.col("vec_id") % 10 == 0).collect()
    check(got, brute(rows, lambda i: i % 10 == 0), 1.0)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_registered_query(spark, small, registered):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = registered.queries()["op6_nearest_neighbours"](spark, small).collect()
    check(got, brute(rows, lambda i: i % 100 == 0))
