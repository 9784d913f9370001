"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

A vector of unit length falls, per table, into the bucket floor((a·v + b) / w) of each of several Gaussian projections
(Datar et al. 2004). Vectors of cosine 0.98 are 0.2 apart and share a bucket of w = 1.6 in nine of ten projections, so
all of the 42 tables miss them with probability 8e-7 (less for closer ones); unrelated ones hardly ever meet.

Equal vectors of one label are one class, so copies never form pairs. A bucket is compared in blocks: two blocks make a
matrix product in one task, which returns counts per vector and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import components
from .vectors import slim, usable

THRESHOLD = 0.98
TABLES, PROJECTIONS, WIDTH = 42, 12, 1.6
# Classes of one bucket that one side of a comparison holds.
BLOCK = 512
BATCH_ROWS = 10_000
SEED = 20


def hash_keys(unit: np.ndarray, tables: int, projections: int, width: float, seed: int = SEED) -> np.ndarray:
    """Bucket numbers, rows x tables. The projections follow from the seed and the dimension alone."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    a = rng.standard_normal((unit.shape[1], tables * projections))
    b = rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, projections)
    out = np.zeros((len(unit), tables), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(projections):
            out = (out ^ cells[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # keeps squares of very large and very small values finite
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def classes(rows: DataFrame) -> DataFrame:
    """``(class_id, label, v, n)``: equal usable vectors of one label, named by their smallest id."""
    return rows.groupBy("label", "v").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n"))


def _keyed(found: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    schema = "class_id long, label string, n long, v array<double>, dim int, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(x) for x in batch.column("v").to_pylist()], np.int64)
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                keys[at] = hash_keys(_unit(_matrix(batch.column("v").take(pa.array(at)), int(d))), tables, projections, width)
            ends = np.arange(0, batch.num_rows * tables + 1, tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id"), batch.column("label"), batch.column("n"), batch.column("v"),
                 pa.array(dims.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                names=["class_id", "label", "n", "v", "dim", "keys"])

    return found.select("class_id", "label", "n", "v").mapInArrow(run, schema)


def _compare(threshold: float):
    """Links inside the comparisons of one batch: counts per class, and a forest over the linked classes.

    A comparison is a block with itself, or two blocks with each other (``side`` 0 and 1). Comparisons of equal size go
    through one product, since most hold two or three vectors.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(["t", "key", "label", "dim", "lo", "hi"], sort=False).ngroup().to_numpy()
        weight: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for dim in pdf["dim"].unique():
            at = np.flatnonzero(pdf["dim"].to_numpy() == dim)
            part, code = pdf.iloc[at], group[at]
            order = np.argsort(code, kind="stable")
            part, code = part.iloc[order], code[order]
            starts = np.flatnonzero(np.append(True, np.diff(code) != 0))
            sizes = np.diff(np.append(starts, len(code)))
            unit, keys = _unit(np.stack(part["v"].to_numpy())), np.stack(part["keys"].to_numpy())
            ids, n, side, t = (part[c].to_numpy() for c in ("class_id", "n", "side", "t"))
            whole = (part["lo"] == part["hi"]).to_numpy()
            for size in np.unique(sizes):
                first = starts[sizes == size]
                step = max(1, 4_000_000 // int(size * size * keys.shape[1]))
                for i in range(0, len(first) if size > 1 else 0, step):
                    rows = first[i:i + step, None] + np.arange(size)
                    _compare_alike(rows, unit, keys, ids, n, side, t, whole, threshold, weight, edges)
        sums = [(u, None, w) for u, w in weight.items()]
        out = pd.DataFrame(sums + [(u, v, 0) for u, v in edges], columns=["u", "v", "links"])
        return out.astype({"u": "int64", "v": "Int64", "links": "int64"})

    return run


def _compare_alike(rows, unit, keys, ids, n, side, t, whole, threshold, weight, edges) -> None:
    """Comparisons of one size, ``rows`` holding a line of row numbers for each."""
    x, k = unit[rows], keys[rows]
    linked = x @ x.transpose(0, 2, 1) >= threshold
    apart = side[rows][:, :, None] != side[rows][:, None, :]
    linked &= np.where(whole[rows[:, 0], None, None], ~np.eye(rows.shape[1], dtype=bool), apart)
    live = np.flatnonzero(linked.any(axis=(1, 2)))
    if not len(live):
        return
    rows, linked, k = rows[live], linked[live], k[live]
    # A pair counts in the first table that joins it.
    before = np.arange(keys.shape[1]) < t[rows[:, 0]][:, None]
    for table in range(keys.shape[1]):
        column = k[:, :, table]
        linked &= ~((column[:, :, None] == column[:, None, :]) & before[:, table, None, None])
    counts = (linked * n[rows][:, None, :]).sum(axis=2)
    for line, links, matrix in zip(rows, counts, linked):
        for r, c in zip(line[links > 0], links[links > 0]):
            weight[int(ids[r])] = weight.get(int(ids[r]), 0) + int(c)
        everyone = np.arange(len(line))
        us, vs = _forest(matrix, everyone, everyone, len(line))
        edges += [(int(ids[line[u]]), int(ids[line[v]])) for u, v in zip(us, vs)]


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    us, vs = [], []
    for i, row in enumerate(linked):
        for j in np.flatnonzero(row):
            a, b = find(int(left[i])), find(int(right[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                us.append(int(left[i]))
                vs.append(int(right[j]))
    return us, vs


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS,
                    width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Linked are different rows of one label with a cosine of at least ``threshold`` in double precision. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing; so do vectors
    of unequal length, and rows without an id (their component is null). A repeated row is linked with its copies. Other
    columns are not read, so their names don't matter.
    """
    base = materialise(slim(rows, vec_id, vector, F.col(label).cast("string").alias("label")), "vectors")
    takes_part = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    live = base.where(takes_part)
    found = materialise(_keyed(materialise(classes(live), "vector-classes"), tables, projections, width), "vector-keys")
    entries = found.select("class_id", "label", "dim", F.posexplode("keys").alias("t", "key"))
    sizes = materialise(entries.groupBy("t", "key", "label", "dim").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(
        F.col("t").alias("_t"), F.col("key").alias("_k"), F.col("label").alias("_l"), F.col("dim").alias("_d"), "size"), "buckets")
    on = (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_k")) & (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d"))
    shared = entries.join(sizes, on).select("class_id", "t", "key", "label", "dim", "size")
    shared = shared.join(found.select(F.col("class_id").alias("_c"), "n", "v", "keys"), F.col("class_id") == F.col("_c"))
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("class_id"), blocks).cast("int")
    # Block i meets every block j: (i, i) once, and (min, max) from both sides.
    shared = shared.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    shared = shared.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"),
                                 "side": (F.col("own") > F.col("other")).cast("int")})
    # Comparisons travel in batches of about BATCH_ROWS rows: most are too small for a call of their own.
    moved = sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / F.lit(block)))).first()[0] or 0
    keys = ["t", "key", "label", "dim", "lo", "hi"]
    batch = F.pmod(F.xxhash64(*keys), F.lit(int(moved // BATCH_ROWS + 1))).alias("batch")
    links = shared.select(batch, *keys, "side", "class_id", "n", "v", "keys").groupBy("batch").applyInPandas(
        _compare(threshold), "u long, v long, links long")
    links = materialise(links, "vector-links")
    counted = links.where("v is null").groupBy("u").agg(F.sum("links").alias("others"))
    parts = components(links.where("v is not null").select("u", "v"))
    known = found.select("class_id", F.col("n").alias("_n")).join(
        counted.select(F.col("u").alias("_u"), "others"), F.col("class_id") == F.col("_u"), "left").join(
        parts.select(F.col("node").alias("_node"), "component"), F.col("class_id") == F.col("_node"), "left")
    known = known.select("class_id", (F.col("_n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "class_id").alias("component_id"))
    member = live.select("vec_id", "label", "v").join(
        found.select(F.col("label").alias("_l"), F.col("v").alias("_v"), "class_id"),
        (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v"))).select("vec_id", F.col("class_id").alias("_c"))
    alive = member.join(known, F.col("_c") == F.col("class_id")).select("vec_id", "n_links", "component_id")
    single = base.where(~takes_part).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return alive.unionByName(single).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
