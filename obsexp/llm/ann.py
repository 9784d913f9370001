"""Approximate nearest neighbours in robust-pruned directed graphs (Subramanya et al. 2019), one graph per shard.

A shard's graph is built in rounds: every vector's greedy search proposes neighbours, relaxed distance pruning keeps
those that no kept neighbour is closer to by the factor ``alpha``, and the reverse edges are pruned alike. A query's
beam search walks each shard's graph; what it has met is measured again in double precision on the original vectors.

Equal vectors are one class: they would otherwise be each other's only neighbours. A class keeps its smallest ids, as
many as a result can hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .vectors import slim, usable

SHARD_ROWS = 6000
QUERIES_PER_TASK = 2048
DEGREE, BEAM, ALPHA = 32, 96, 1.2
BUILD_BEAM, BUILD_BATCH = 64, 256
SEED = 6


def _distances(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances less |q|^2 of the rows ``ids`` (queries x m) to each query, in single precision."""
    return norms[ids] - 2.0 * np.einsum("bmd,bd->bm", x[ids], q)


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> np.ndarray:
    """The ``beam`` nearest rows met from ``start``, per query, nearest first; -1 fills up. All queries walk in step.

    A step expands each query's nearest row not yet expanded; a query rests when its beam holds only expanded rows.
    """
    n, rows = len(q), len(x)
    ids = np.full((n, beam), rows, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    met = np.zeros((n, rows + 1), bool)
    met[:, rows] = True
    ids[:, 0], done[:, 0] = start, False
    met[:, start] = True
    dist[:, 0] = _distances(x, norms, np.full((n, 1), start), q)[:, 0]
    active = np.arange(n)
    while len(active):
        pick = np.where(done[active], np.inf, dist[active]).argmin(axis=1)
        open_ = ~done[active, pick]
        active, pick = active[open_], pick[open_]
        if not len(active):
            break
        done[active, pick] = True
        near = graph[ids[active, pick]]
        fresh = ~met[active[:, None], near]
        met[active[:, None], near] = True
        d = np.where(fresh, _distances(x, norms, np.minimum(near, rows - 1), q[active]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[active], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_d, order, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), order, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), order, 1)
    ids[~np.isfinite(dist)] = -1
    return ids


def robust_prune(x: np.ndarray, norms: np.ndarray, p: int, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of ``p``: from near to far, a candidate goes if a kept one is ``alpha`` times closer to it than p is."""
    pool = pool[pool != p]
    d = norms[pool] - 2.0 * (x[pool] @ x[p]) + norms[p]
    order = np.argsort(d, kind="stable")
    pool, d = pool[order], d[order]
    between = norms[pool][:, None] + norms[pool][None, :] - 2.0 * (x[pool] @ x[pool].T)
    covers = alpha * alpha * between <= d[None, :]
    alive, kept = np.ones(len(pool), bool), []
    for i in range(len(pool)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= ~covers[i]
    return pool[kept]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA,
                seed: int = SEED) -> tuple[np.ndarray, int]:
    """Neighbour table (rows x degree, filled with the row count) and the start row."""
    n = len(x)
    norms = (x * x).sum(axis=1)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), n, np.int64)
    if n <= degree + 1:
        for p in range(n):
            others = np.delete(np.arange(n), p)
            graph[p, :len(others)] = others
        return graph, start
    order = rng.permutation(n)
    first = order[:beam]
    for p in first:  # a small complete core, pruned
        edges = robust_prune(x, norms, int(p), first, degree, alpha)
        graph[p, :len(edges)] = edges
    if start not in first:
        edges = robust_prune(x, norms, start, first, degree, alpha)
        graph[start, :len(edges)] = edges
        order = np.concatenate([[start], order[order != start]])
    at = beam
    while at < n:
        batch = order[at:at + min(BUILD_BATCH, at)]  # batches grow with what is there to be searched
        at += len(batch)
        found = beam_search(x, norms, graph, start, x[batch], beam)
        incoming: dict[int, list[int]] = {}
        for p, pool in zip(batch.tolist(), found):
            edges = robust_prune(x, norms, p, np.union1d(pool[pool >= 0], graph[p][graph[p] < n]), degree, alpha)
            graph[p] = n
            graph[p, :len(edges)] = edges
            for e in edges.tolist():
                incoming.setdefault(e, []).append(p)
        for e, sources in incoming.items():
            own = graph[e][graph[e] < n]
            pool = np.union1d(own, sources)
            pool = pool if len(pool) <= degree else robust_prune(x, norms, e, pool, degree, alpha)
            graph[e] = n
            graph[e, :len(pool)] = pool
    return graph, start


def _index_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("class_id")
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    scale = np.abs(x).max()
    graph, start = build_graph((x / scale).astype(np.float32))
    return pd.DataFrame([(key[0], key[1], pdf["class_id"].to_numpy(np.int64).tobytes(), x.tobytes(), float(scale),
                          graph.astype(np.int32).tobytes(), start)],
                        columns=["dim", "shard", "ids", "x", "scale", "graph", "start"])


INDEX_SCHEMA = "dim int, shard int, ids binary, x binary, scale double, graph binary, start int"


def shard_counts(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Stored: how many shards each dimension has, for about ``shard_rows`` rows a shard."""
    return materialise(rows.groupBy(F.col("dim").alias("_d")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("shards")), "shard-counts")


def build_index(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """A stored row per shard: class ids, vectors, graph. ``rows`` is a stored table ``(class_id, v, dim)``.

    Rows are dealt to shards by hash, so that a task's memory is bounded at any size.
    """
    dealt = rows.join(counts, F.col("dim") == F.col("_d")).select(
        "dim", F.pmod(F.xxhash64(F.lit(SEED), F.col("class_id")), F.col("shards")).cast("int").alias("shard"), "class_id", "v")
    return materialise(dealt.groupBy("dim", "shard").applyInPandas(_index_shard, INDEX_SCHEMA), "graph-index")


def _search(k: int, beam: int):
    columns = ["query_id", "class_id", "score"]

    def run(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or queries.empty:
            return pd.DataFrame(columns=columns).astype({"query_id": "int64", "class_id": "int64", "score": "float64"})
        row, dim = shard.iloc[0], int(key[0])
        ids = np.frombuffer(row["ids"], np.int64)
        x = np.frombuffer(row["x"]).reshape(-1, dim)
        graph = np.frombuffer(row["graph"], np.int32).reshape(len(ids), -1).astype(np.int64)
        small = (x / row["scale"]).astype(np.float32)
        norms = (small * small).sum(axis=1)
        out = []
        step = max(1, min(256, 20_000_000 // (len(ids) + 1)))
        for at in range(0, len(queries), step):
            part = queries.iloc[at:at + step]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            near = beam_search(small, norms, graph, int(row["start"]), (q / row["scale"]).astype(np.float32), beam)
            for qid, v, found in zip(part["query_id"], q, near):
                found = found[found >= 0]
                d = np.sqrt(((x[found] - v) ** 2).sum(axis=1))
                # One more class than asked for, as the query's own may hold no other row.
                best = np.lexsort((ids[found], d))[:k + 1]
                out.append(pd.DataFrame({"query_id": qid, "class_id": ids[found[best]], "score": d[best]}))
        return pd.concat(out)

    return run


def nearest(rows: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", beam: int = BEAM,
            shard_rows: int = SHARD_ROWS, queries_per_task: int = QUERIES_PER_TASK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found rows, other than the query's own id.

    ``is_query`` is a condition on ``vec_id``. Distances are Euclidean, in double precision on the given vectors, ties
    to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
    take no part; vectors of unequal length never meet. A repeated row counts once. A query with fewer than ``k``
    candidates gets all. Other columns are not read, so their names don't matter.
    """
    base = slim(rows, vec_id, vector).where(usable() & F.col("vec_id").isNotNull())
    base = materialise(base.distinct(), "ann-vectors")
    named = materialise(base.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "ann-classes")
    sized = named.select("class_id", "v", F.size("v").alias("dim"))
    counts = shard_counts(sized, shard_rows)
    index = build_index(sized, counts)
    asked = base.where(is_query).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"))
    asked = materialise(asked, "ann-queries")
    chunks = asked.count() // queries_per_task + 1
    # A shard meets the queries in chunks; both sides of a task are bounded.
    shards = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    sent = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).join(
        counts, F.col("dim") == F.col("_d")).select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "chunk", "query_id", "v")
    keys = ["dim", "shard", "chunk"]
    found = shards.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(
        _search(k, beam), "query_id long, class_id long, score double")
    top = Window.partitionBy("query_id").orderBy("score", "class_id")
    found = materialise(found.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1).drop("_r"), "ann-found")
    # Classes of several rows stand for their smallest ids; single ones for themselves.
    several = named.where("n > 1").select(F.col("v").alias("_v"), F.col("class_id").alias("_c"))
    members = base.join(several, F.col("v") == F.col("_v")).select("vec_id", F.col("_c"))
    smallest = Window.partitionBy("_c").orderBy("vec_id")
    members = members.withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k + 1).drop("_r")
    out = found.join(members, F.col("class_id") == F.col("_c"), "left").select(
        "query_id", F.coalesce("vec_id", "class_id").alias("vec_id"), "score").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
