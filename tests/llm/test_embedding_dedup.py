"""Linked vectors against the full comparison."""

import numpy as np

from obsexp.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n int"


def brute(rows, threshold=0.98):
    ok = [(i, np.array(v, float), y) for i, v, y in rows
          if v and y is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, *_ in rows}
    links = {i: 0 for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, x, s), (j, y, t) = ok[a], ok[b]
            if s == t and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in parent if i is not None}


def planted(n=500, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.standard_normal((30, dim))
    for i in range(n):
        v = base[i % 30] + (0.12 * rng.standard_normal(dim) if i % 3 else 0) if i % 2 else rng.standard_normal(dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 30 % 4) if i % 50 else None))
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] + [1.0] * (dim - 1), 1), (n + 3, [1.0, None], 1),
             (n + 4, [], 1), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (n + 7, [float("inf"), 1.0], 1), (n + 8, [1e30, 2e30], 1)]
    return rows


def test_links_and_components_match_the_full_comparison(spark):
    rows = planted()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want = brute(rows)
    # Small blocks, so that buckets are compared in several tasks.
    got = {r.vec_id: r for r in E.near_duplicates(df, block=4).collect()}
    assert len(got) == len(rows)
    for i, (n, c) in want.items():
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, c, i == c), i


def test_copies_are_counted_without_pairs(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(3000)] + [(5000 + i, [1.0, 2.0, 3.0 + i * 1e-4], 1) for i in range(50)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = E.near_duplicates(df, block=8).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(3049, 0)}


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, None, None), (7, [1.0, 0.0], 1, None, None), (7, [1.0, 0.0], 1, None, None)], SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (7, 1, 7, True), (7, 1, 7, True)]
    assert E.near_duplicates(df.limit(0)).collect() == []


def test_registered_query(spark, small, registered):
    out = {r.vec_id: (r.n_links, r.component_id) for r in registered.queries()["op10_embedding_dedup"](spark, small).collect()}
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert out == brute(rows)


def test_tables_miss_a_pair_at_the_threshold_once_in_a_million():
    import numpy as np
    from obsexp.llm.embedding_dedup import PROJECTIONS, TABLES, WIDTH, hash_keys
    rng = np.random.default_rng(5)
    u = rng.standard_normal((4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    near = 0.98 * u + np.sqrt(1 - 0.98 ** 2) * w
    hit = (hash_keys(u, TABLES, PROJECTIONS, WIDTH) == hash_keys(near, TABLES, PROJECTIONS, WIDTH)).mean()
    assert (1 - hit) ** TABLES < 2e-6
