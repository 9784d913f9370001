"""Hard negatives from score windows below each positive, by slots.

An anchor's positives put an upper limit on their negatives: a share of the positive's score. The limits, in descending
order, cut the scores into disjoint slots, so each candidate row belongs to one slot of an anchor whatever the number of
positives. Tasks keep the best rows of each slot, and so does the merge of their results. The best rows below a limit are
those of its slot, then of the slots below it: one descending pass over an anchor's few rows answers all its overlapping
windows.

Anchors go through the table in chunks of a fixed number, each chunk sent to every task; one task scores its rows against
a chunk in blocks of matrix products and holds only the best rows of each anchor and slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path

SCALE = 256
# Whole components stay below this size, so that inner products of up to 8,192 dimensions are 64-bit integers.
MOST = 1 << 25
POSITIVES, NEGATIVES = 5, 10
LOWER, UPPER = 30, 90  # percent of the positive's score
# Components of one chunk of anchors: 16 MB on the driver and in every task.
CHUNK_COMPONENTS = 1 << 22
# Anchors times rows of one product.
CELLS = 1 << 21
NEVER = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, label: Column, is_anchor: Column) -> DataFrame:
    """``rid, vec_id, label, flag, x``: rows that take part, components scaled and floored to whole numbers."""
    slim = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.coalesce(is_anchor, F.lit(False)).alias("flag"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(MOST / SCALE)))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & finite, F.lit(False))
    scaled = F.transform("v", lambda x: F.floor(x * SCALE).cast("int"))
    return slim.where(takes_part).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "flag", scaled.alias("x"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; doubles are used where they are exact."""
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group: highest score first, then smaller id, then smaller row number."""
    order = np.lexsort((rid, ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])[:len(g)])
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[place < k]


@dataclass
class Chunk:
    """Anchors of one chunk. ``limits``: the slots' upper limits in descending order, and the lowest score of any window."""

    rid: np.ndarray
    label: np.ndarray
    ends: np.ndarray
    components: np.ndarray
    limits: np.ndarray | None = None
    lowest: np.ndarray | None = None

    @property
    def slots(self) -> int:
        return 1 if self.limits is None else self.limits.shape[1]


class Combiner:
    """The best rows of each anchor and slot among those met: of the anchor's label without limits, of others with them."""

    def __init__(self, chunk: Chunk, k: int):
        self.chunk, self.k = chunk, k
        dims = np.diff(chunk.ends)
        self.by_dim = {}
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            self.by_dim[int(d)] = at, chunk.components[chunk.ends[at][:, None] + np.arange(d)]
        self.held = tuple(np.zeros(0, np.int64) for _ in range(5))
        self.bar = np.full(len(chunk.rid) * chunk.slots, NEVER)  # a full slot's lowest score

    def add(self, rid: np.ndarray, ids: np.ndarray, label: np.ndarray, ends: np.ndarray, components: np.ndarray) -> None:
        chunk, found, dims = self.chunk, [self.held], np.diff(ends)
        for d in np.unique(dims):
            anchors, a = self.by_dim.get(int(d), (np.zeros(0, np.int64), None))
            rows = np.flatnonzero(dims == d)
            b = components[ends[rows][:, None] + np.arange(d)]
            step = max(1, CELLS // len(rows))
            for i in range(0, len(anchors), step):
                some = anchors[i:i + step]
                score, same = products(a[i:i + step], b), chunk.label[some][:, None] == label[rows][None, :]
                if chunk.limits is None:
                    fits = same & (chunk.rid[some][:, None] != rid[rows][None, :]) & (score >= self.bar[some][:, None])
                else:
                    fits = ~same & (score <= chunk.limits[some][:, :1]) & (score >= chunk.lowest[some][:, None])
                x, y = np.nonzero(fits)
                value, slot = score[x, y], np.zeros(len(x), np.int64)
                if chunk.limits is not None:
                    slot = (value[:, None] <= chunk.limits[some[x]]).sum(axis=1) - 1
                    high = value >= self.bar[some[x] * chunk.slots + slot]
                    x, y, value, slot = x[high], y[high], value[high], slot[high]
                found.append((some[x], slot, value, ids[rows[y]], rid[rows[y]]))
        anchor, slot, score, ids, rid = (np.concatenate(part) for part in zip(*found))
        group = anchor * chunk.slots + slot
        at = best(group, score, ids, rid, self.k)
        self.held = tuple(part[at] for part in (anchor, slot, score, ids, rid))
        kept, sizes = np.unique(group[at], return_counts=True)
        lasts = score[at][np.cumsum(sizes) - 1] if len(kept) else score[:0]
        self.bar[kept[sizes == self.k]] = lasts[sizes == self.k]


def _combined(rows: DataFrame, chunk: Chunk, k: int) -> DataFrame:
    """``anchor, slot, score, vec_id, rid``: the best rows of each task, then the best of these, per anchor and slot."""
    send = rows.sparkSession.sparkContext.broadcast(
        tuple(getattr(chunk, f.name) for f in fields(Chunk)))  # arrays only: workers need no copy of this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner(Chunk(*send.value), k)
        for batch in batches:
            x = batch.column("x")
            combiner.add(*(batch.column(c).to_numpy() for c in ("rid", "vec_id", "label")),
                         x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py(), x.flatten().to_numpy())
        anchor, *rest = combiner.held
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (combiner.chunk.rid[anchor], *rest)],
                                         names=["anchor", "slot", "score", "vec_id", "rid"])

    found = rows.select("rid", "vec_id", "label", "x").mapInArrow(
        run, "anchor long, slot long, score long, vec_id long, rid long")
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "rid"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _percent(score: Column, share: int, more: int = 0) -> Column:
    """``(score * share + more) div 100`` of a score of at least 0, without leaving 64 bits."""
    hundred = F.lit(100).cast("long")
    return F.call_function("div", score, hundred) * share + F.call_function("div", score % hundred * share + more, hundred)


def mine(rows: DataFrame, is_anchor: Column, label: Column | str = "label", vec_id: str = "vec_id", vector: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER,
         chunk_components: int = CHUNK_COMPONENTS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of components multiplied by 256 and floored. An anchor's positives are the best other rows
    of its label, its negatives for a positive the best rows of other labels whose score lies between ``lower`` and
    ``upper`` percent of the positive's. Equal scores are ordered by id.

    Rows with a null id, label, vector or component, an empty vector, or a component that is not finite or 131,072 or
    more in size take no part. Vectors of unequal length have no score. Repeated rows are rows of their own: each may be
    another's positive, and each anchor row returns its own result. An anchor without positives, a positive of negative
    score and a window without rows return nothing; so does an empty table. Other columns are read only where
    ``is_anchor`` and ``label`` name them.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    table = materialise(whole_vectors(rows, vec_id, vector, label, is_anchor), "whole-vectors")
    anchors = table.where("flag")
    total = anchors.agg(F.sum(F.size("x"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_components))
    path = scratch_path(spark, "hard-negatives")
    for number in range(chunks):
        own = anchors.where(F.pmod(F.xxhash64("rid"), F.lit(chunks)) == number).select("rid", "label", "x", "vec_id")
        part = own.toArrow().combine_chunks()  # about chunk_components numbers
        x = part["x"].combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.int32()))
        chunk = Chunk(part["rid"].to_numpy(), part["label"].to_numpy(), x.offsets.to_numpy().astype(np.int64), x.flatten().to_numpy())
        near = _combined(table, chunk, positives).where("score >= 0").select(
            "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place",
            _percent(F.col("score"), upper).alias("most"), _percent(F.col("score"), lower, 99).alias("least"))
        near = materialise(near, "positives")
        chunk.limits, chunk.lowest = _limits(near, chunk.rid, positives)
        found = _combined(table, chunk, negatives)
        listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id", "rid", "slot")))
        # At most slots x negatives rows an anchor.
        merged = found.groupBy("anchor").agg(listed.alias("rows")).withColumnRenamed("anchor", "_anchor")
        # Slots below a positive's own limit hold lower scores only, so the suffix of the list is in order.
        suffix = F.filter("rows", lambda r: r["slot"] >= F.col("place") - 1)
        inside = F.filter(F.slice(suffix, 1, negatives), lambda r: -r["low"] >= F.col("least"))
        out = near.join(merged, F.col("anchor") == F.col("_anchor")).select(
            "anchor", "positive_id", "positive_score", F.posexplode(inside).alias("place", "row"))
        ids = own.select(F.col("rid").alias("_rid"), F.col("vec_id").alias("anchor_id"))
        out.join(ids, F.col("anchor") == F.col("_rid")).select(
            "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("row.vec_id").alias("negative_id"),
            "positive_score", (-F.col("row.low")).alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def _limits(near: DataFrame, rid: np.ndarray, positives: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper limits per anchor in descending order (places without a positive match nothing), and the lowest bound."""
    got = near.select("anchor", "place", "most", "least").toArrow()  # at most ``positives`` rows an anchor of the chunk
    limits, lowest = np.full((len(rid), positives), NEVER), np.full(len(rid), np.iinfo(np.int64).max)
    order = np.argsort(rid)
    at = order[np.searchsorted(rid[order], got["anchor"].to_numpy())]
    limits[at, got["place"].to_numpy() - 1] = got["most"].to_numpy()
    np.minimum.at(lowest, at, got["least"].to_numpy())
    return limits, lowest


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
