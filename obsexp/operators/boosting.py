"""Boosted trees on binned columns, fitted on counts.

A split can only tell rows apart by the bin of a number or the value of a category, so rows that agree in all of them are one
cell, and a fit needs of a cell its two counts. Cells are counted in one pass; there are as many as bins and values allow,
whatever the number of rows. The trees are those of Spark ML's ``GBTClassifier``: a first regression tree on the outcomes as
-1 and 1, further ones on the pseudo-residuals of the log loss, splits by variance, rows drawn for every tree and columns for
every node. Of a cell the drawn rows are a binomial number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

MAX_BINS = 32
# Cells that one task holds, at about a hundred bytes each; with more of them Spark's own trees are fitted on the rows.
MAX_CELLS = 4_000_000
# Rows that one task of Spark's own tree fit holds at most; the fit keeps some hundred bytes of each.
ROWS_PER_TASK = 300_000
# Stretches of the first count of a column's values, and the share of the rows that one of them may hold uncut.
STRETCHES, HEAVY = 4096, 1 / 1024
_PIECE = 1 << 18
# Bins of columns that are counted together; their own counts are sums of these.
_JOINT = 2048


def number(column: str) -> Column:
    """A double; NaN counts as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


@dataclass
class Bins:
    """How columns become codes: cuts and filling value of a number, values and most frequent value of a text."""

    numeric: list[str]
    cuts: list[list[float]]
    fill: list[float]
    categorical: list[str]
    levels: list[list[str]]
    modes: list[str]

    def sizes(self) -> list[int]:
        """Codes per column; a text has one more, for values that were not seen."""
        return [len(c) + 1 for c in self.cuts] + [len(v) + 1 for v in self.levels]

    def coded(self, df: DataFrame) -> DataFrame:
        """Adds ``features``: the number of cuts below a value, and the place of a text among the values."""
        filled = {f"_x{j}": F.coalesce(number(c), F.lit(fill)) for j, (c, fill) in enumerate(zip(self.numeric, self.fill))}
        codes = [_cut(F.col(f"_x{j}"), cuts, 0) for j, cuts in enumerate(self.cuts)]
        for j, (c, levels, mode) in enumerate(zip(self.categorical, self.levels, self.modes)):
            known = F.array(*[F.lit(v) for v in levels]).cast("array<string>")
            filled[f"_t{j}"] = F.array_position(known, F.coalesce(F.col(c).cast("string"), F.lit(mode)))
            codes.append(F.when(F.col(f"_t{j}") > 0, F.col(f"_t{j}") - 1).otherwise(len(levels)).cast("int"))
        return df.withColumns(filled).withColumn("features", F.array(*codes)).drop(*filled)


def _cut(value: Column, cuts: Sequence[float], below: int) -> Column:
    if not cuts:
        return F.lit(below)
    half = len(cuts) // 2
    return F.when(value <= cuts[half], _cut(value, cuts[:half], below)).otherwise(
        _cut(value, cuts[half + 1:], below + half + 1))


def find_bins(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Bins:
    """Cuts at quantiles, between two neighbouring values each, and all values of the texts, which the driver holds."""
    counts = value_counts(df, numeric)
    empty = [c for c, found in zip(numeric, counts) if not found]
    if empty:
        raise ValueError(f"columns without a value to fill holes with: {empty}")
    levels: list[dict[str, int]] = [{} for _ in categorical]
    if categorical:
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v"))
                                    for i, c in enumerate(categorical)]))
        for r in df.select(pairs.alias("x")).where("x.v is not null").groupBy("x.c", "x.v").agg(
                F.count(F.lit(1)).alias("n")).collect():
            levels[r.c][r.v] = r.n
    return Bins(list(numeric), [quantile_cuts(found) for found in counts], [_middle(found) for found in counts],
                list(categorical), [sorted(v) for v in levels],
                [min(v, key=lambda x: (-v[x], x)) if v else "missing" for v in levels])


def value_counts(df: DataFrame, columns: Sequence[str]) -> list[list[tuple[int, float, float]]]:
    """(rows, lowest, highest value) of stretches of each column's values, in order; NaN counts as missing.

    Stretches of equal width are counted first; one that holds more than ``HEAVY`` of the rows and more than one value is
    cut again, in another pass over the rows. The driver holds some thousand stretches of each column.
    """
    if not columns:
        return []
    names = [f"_x{j}" for j in range(len(columns))]
    rows = df.select(*[number(c).alias(x) for c, x in zip(columns, names)])
    finite = [F.when(F.abs(x) < math.inf, F.col(x)) for x in names]
    ends = rows.agg(*[a.alias(f"{end}{x}") for x, v in zip(names, finite) for end, a in (("lo", F.min(v)), ("hi", F.max(v)))]).first()
    pairs = []
    for j, x in enumerate(names):
        lo, hi = ends[f"lo{x}"] or 0.0, ends[f"hi{x}"] or 0.0
        place = (F.col(x) - lo) * (STRETCHES / (hi - lo) if STRETCHES * (hi - lo) > 0 else 0.0)
        at = F.least(F.greatest(place, F.lit(0.0)), F.lit(float(STRETCHES))).cast("int")
        pairs.append(F.struct(F.lit(j).alias("c"), at.alias("at"), F.col(x).alias("x")))
    counts = rows.select(F.inline(F.array(*pairs))).where("x is not null").groupBy("c", "at").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    found = _in_order(counts, len(columns))
    while True:
        # A stretch ends at its highest value; a heavy one gets further ends.
        edges, finer = [], False
        for stretches in found:
            limit, old = HEAVY * sum(n for n, _, _ in stretches), np.unique([hi for _, _, hi in stretches])
            edges.append(np.unique(np.concatenate([old, *[_between(lo, hi, 64) for n, lo, hi in stretches if n > limit and lo < hi]])))
            finer |= len(edges[-1]) > len(old)
        if not finer:
            return found
        found = _in_order(rows.mapInArrow(partial(_count_stretches, edges=edges), "c int, at int, n long, lo double, hi double").groupBy(
            "c", "at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), len(columns))


def _in_order(counts: DataFrame, columns: int) -> list[list[tuple[int, float, float]]]:
    found: list[list] = [[] for _ in range(columns)]
    for r in sorted(counts.collect(), key=lambda r: (r.c, r.at)):
        found[r.c].append((r.n, r.lo, r.hi))
    return found


def _between(lo: float, hi: float, parts: int) -> np.ndarray:
    """Edges from ``lo`` to ``hi``, both in; a value belongs to the first edge that is not below it."""
    lo, hi = (max(-1.7e308, min(1.7e308, x)) for x in (lo, hi))
    share = np.linspace(0, 1, parts + 1)
    return np.unique(np.concatenate([[lo, hi], lo * (1 - share) + hi * share]))


def _count_stretches(batches: Iterator[pa.RecordBatch], edges: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    totals = [(np.zeros(len(e) + 1, np.int64), np.full(len(e) + 1, np.inf), np.full(len(e) + 1, -np.inf)) for e in edges]

    def add(pieces: Sequence[pa.RecordBatch]) -> None:
        for j, (n, lo, hi) in enumerate(totals):
            x = np.concatenate([b.column(j).to_numpy(zero_copy_only=False) for b in pieces])
            x = np.sort(x[~np.isnan(x)])
            ends = np.concatenate([np.searchsorted(x, edges[j], side="right"), [len(x)]])
            size = np.diff(ends, prepend=0)
            some = size > 0
            n += size
            lo[some] = np.minimum(lo[some], x[(ends - size)[some]])
            hi[some] = np.maximum(hi[some], x[ends[some] - 1])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _PIECE:
            add(held)
            held, rows = [], 0
    if held:
        add(held)
    for j, (n, lo, hi) in enumerate(totals):
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), j, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(lo[at]),
             pa.array(hi[at])], names=["c", "at", "n", "lo", "hi"])


def quantile_cuts(stretches: Sequence[tuple[int, float, float]], bins: int = MAX_BINS) -> list[float]:
    """At most ``bins`` - 1 cuts, each half way between two stretches: all of them, or those closest to equal shares.

    Shares are those of the rows that are left, so a value that many rows hold has a bin of its own and takes no other.
    """
    halves = [(a + b) / 2 if math.isfinite((a + b) / 2) else a for (_, _, a), (_, b, _) in zip(stretches, stretches[1:])]
    if len(halves) < bins:
        return halves
    rows = sum(n for n, _, _ in stretches)
    cuts, reached, target = [], stretches[0][0], rows / bins
    for (n, _, _), half in zip(stretches[1:], halves):
        before, reached = reached, reached + n
        if abs(before - target) < abs(reached - target):
            cuts.append(half)
            if len(cuts) == bins - 1:
                break
            target = before + (rows - before) / (bins - len(cuts))
    return cuts


def _middle(stretches: Sequence[tuple[int, float, float]]) -> float:
    """The value in the middle, as close as the stretches tell."""
    reached, rows = 0, sum(n for n, _, _ in stretches)
    for n, _, hi in stretches:
        reached += n
        if 2 * reached >= rows:
            return hi
    raise ValueError("no values")


@dataclass(frozen=True)
class Settings:
    max_iter: int
    step_size: float
    seed: int
    depth: int = 5
    rows: float = 0.8
    columns: float = 0.8
    min_rows: int = 5


class BoostedTrees(Estimator):
    """Fits on ``label`` and ``features``, an array of codes; ``numbers`` of them are bins, the others values of texts."""

    def __init__(self, sizes: Sequence[int], numbers: int, settings: Settings):
        super().__init__()
        self.sizes, self.numbers, self.settings = list(sizes), numbers, settings

    def _fit(self, dataset: DataFrame) -> Model:
        label = F.col("label")
        counts = materialise(dataset.groupBy("features").agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive"),
            F.bool_or(~F.coalesce(label.isin(0.0, 1.0), F.lit(False))).alias("odd")), "cells")
        seen = counts.agg(F.count(F.lit(1)).alias("cells"), F.bool_or("odd").alias("odd")).first()
        if not seen.cells or seen.odd:
            raise ValueError("labels must be 0 or 1" if seen.odd else "no rows to learn from")
        s = self.settings
        if seen.cells > MAX_CELLS:
            classifier = GBTClassifier(
                maxIter=s.max_iter, maxDepth=s.depth, stepSize=s.step_size, subsamplingRate=s.rows, maxBins=MAX_BINS,
                featureSubsetStrategy=str(s.columns), minInstancesPerNode=s.min_rows, seed=s.seed)
            rows = dataset.select("label", self._vector().alias("features"))
            return RowTrees(classifier.fit(spread(rows, ROWS_PER_TASK)), self._vector())
        trees = counts.select("features", "n", "positive").repartition(1).mapInArrow(
            partial(_grow_all, sizes=self.sizes, numbers=self.numbers, settings=s),
            "tree int, column array<int>, cut array<int>, value array<double>").orderBy("tree").collect()
        return CellTrees([np.array([t[name] for t in trees]) for name in ("column", "cut", "value")], self.numbers)

    def _vector(self) -> Column:
        code = F.col("features")
        hot = [(code[j] == v).cast("double") for j in range(self.numbers, len(self.sizes)) for v in range(self.sizes[j])]
        return array_to_vector(F.array(*[code[j].cast("double") for j in range(self.numbers)], *hot))


def spread(df: DataFrame, most: int) -> DataFrame:
    """Rows dealt over as many tasks as their number needs if one task holds more than ``most`` of them."""
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (sizes[0] or 0) <= most:
        return df
    return df.repartition(max(math.ceil(sizes[1] / most), df.sparkSession.sparkContext.defaultParallelism))


class RowTrees(Model):
    """Spark's own trees, on codes as numbers."""

    def __init__(self, trees: Model, vector: Column):
        super().__init__()
        self.trees, self.vector = trees, vector

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.trees.transform(dataset.withColumn("_codes", F.col("features")).withColumn("features", self.vector))
        return scored.select(*[F.col("_codes").alias(c) if c == "features" else c for c in dataset.columns],
                             vector_to_array("probability")[1].alias("probability"))


class CellTrees(Model):
    """Whole trees of one depth as arrays: column and cut of the inner nodes, value of the last ones."""

    def __init__(self, trees: Sequence[np.ndarray], numbers: int):
        super().__init__()
        self.trees, self.numbers = trees, numbers

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Distinct cells are scored once and stored; rows meet them in a join, which the planner broadcasts while they are few."""
        cells = dataset.select(F.col("features").alias("_cell")).distinct()
        scores = materialise(cells.mapInArrow(
            partial(_score_cells, trees=self.trees, numbers=self.numbers), "_cell array<int>, probability double"), "cell-scores")
        return dataset.join(scores, F.col("features") == F.col("_cell")).select(*dataset.columns, "probability")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _score_cells(batches: Iterator[pa.RecordBatch], trees: Sequence[np.ndarray], numbers: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.ascontiguousarray(_matrix(batch).T)
        total = np.zeros(batch.num_rows)
        for column, cut, value in zip(*trees):
            total += value[_last_nodes(columns, column, cut, numbers)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_probability(total))], names=["_cell", "probability"])


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(margin, -350, 350)))


def _last_nodes(columns: np.ndarray, column: np.ndarray, cut: np.ndarray, numbers: int) -> np.ndarray:
    """Where each cell comes out of a tree, counted from the left."""
    flat, width = columns.ravel(), columns.shape[1]
    node, rows = np.ones(width, np.int64), np.arange(width)
    for _ in range(int(math.log2(len(column) + 1))):
        own = column[node - 1]
        code, limit = flat[own * width + rows], cut[node - 1]
        node = 2 * node + np.where(own < numbers, code > limit, code == limit)
    return node - len(column) - 1


def _grow_all(batches: Iterator[pa.RecordBatch], sizes: Sequence[int], numbers: int, settings: Settings) -> Iterator[pa.RecordBatch]:
    """All trees of a fit, from its cells in the order of their codes, so that no result depends on how they arrive."""
    held = [(_matrix(b), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
            for b in batches if b.num_rows]
    if not held:
        return
    codes, n, positive = (np.concatenate(part) for part in zip(*held))
    del held
    order = np.lexsort(codes.T[::-1])
    columns = np.ascontiguousarray(codes[order].T)
    n, positive = n[order].astype(np.int64), positive[order].astype(np.int64)
    groups = _joint(columns, sizes)
    margin, out = np.zeros(len(n)), []
    for m in range(settings.max_iter):
        rng = np.random.default_rng([settings.seed, m])
        won, lost = rng.binomial(positive, settings.rows), rng.binomial(n - positive, settings.rows)
        # Minus the gradient of 2 log(1 + exp(-2 y F)) for y of 1 and of -1; the first tree learns y itself.
        p = _probability(margin)
        up, down = (4 * (1 - p), -4 * p) if m else (1.0, -1.0)
        column, cut, value, last = _grow(
            columns, groups, sizes, numbers, (won + lost).astype(np.float64), won * up + lost * down, rng, settings)
        value = value * (settings.step_size if m else 1.0)
        margin += value[last]
        out.append((m, column.tolist(), cut.tolist(), value.tolist()))
    yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in out], pa.int32())] + [
        pa.array([t[i] for t in out], pa.list_(kind)) for i, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.float64()))],
        names=["tree", "column", "cut", "value"])


def _joint(columns: np.ndarray, sizes: Sequence[int]) -> list[tuple[list[int], list[int], np.ndarray]]:
    """Columns in groups, the sizes of a group, and the code that tells all its bins apart."""
    groups: list = []
    for j, size in enumerate(sizes):
        if groups and math.prod(groups[-1][1]) * size <= _JOINT:
            members, shape, code = groups[-1]
            groups[-1] = ([*members, j], [*shape, size], code * size + columns[j])
        else:
            groups.append(([j], [size], columns[j].astype(np.int64)))
    return groups


def _grow(columns: np.ndarray, groups: Sequence[tuple], sizes: Sequence[int], numbers: int, weight: np.ndarray, total: np.ndarray,
          rng: np.random.Generator, settings: Settings):
    """One regression tree, level by level: (column, cut, values of the last level, the last node of every cell).

    A node that is not split passes all its cells to the left, down to the last level.
    """
    inner = 2 ** settings.depth - 1
    column, cut = np.zeros(inner, np.int64), np.full(inner, np.iinfo(np.int32).max, np.int64)
    # Every bin and every value of a text counts as a feature when features are drawn, as after one-hot encoding.
    starts = np.concatenate([np.arange(numbers), numbers + np.cumsum([0, *sizes[numbers:]])]).astype(int)
    features = int(starts[-1])
    wanted = math.ceil(settings.columns * features)
    node, mean = np.zeros(columns.shape[1], np.int64), np.zeros(1)
    mean[0] = total.sum() / weight.sum() if weight.sum() else 0.0
    live = np.ones(1, bool)
    for depth in range(settings.depth):
        nodes = 2 ** depth
        drawn = np.argsort(rng.random((nodes, features)), axis=1).argsort(axis=1) < wanted
        best = np.zeros(nodes)
        where = np.full((nodes, 2), -1)
        sides = np.zeros((nodes, 4))
        whole_w, whole_s = np.bincount(node, weight, nodes), np.bincount(node, total, nodes)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = whole_s ** 2 / whole_w
            counts = {}
            for members, shape, code in groups:
                key = node * math.prod(shape) + code
                both = [np.bincount(key, x, nodes * math.prod(shape)).reshape(nodes, *shape) for x in (weight, total)]
                for at, j in enumerate(members):
                    counts[j] = [x.sum(axis=tuple(i + 1 for i in range(len(shape)) if i != at)) for x in both]
            for j, size in enumerate(sizes):
                if size < 2:
                    continue
                w, s = counts[j]
                if j < numbers:
                    left_w, left_s = np.cumsum(w, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
                    allowed = drawn[:, [j]]
                else:
                    left_w, left_s = whole_w[:, None] - w, whole_s[:, None] - s
                    allowed = drawn[:, starts[j]:starts[j] + size]
                right_w, right_s = whole_w[:, None] - left_w, whole_s[:, None] - left_s
                gain = left_s ** 2 / left_w + right_s ** 2 / right_w - own[:, None]
                gain = np.where(allowed & (left_w >= settings.min_rows) & (right_w >= settings.min_rows), gain, 0.0)
                at = gain.argmax(axis=1)
                rows = np.arange(nodes)
                better = live & (gain[rows, at] > best)
                best[better] = gain[rows, at][better]
                where[better] = np.column_stack([np.full(nodes, j), at])[better]
                sides[better] = np.column_stack([x[rows, at] for x in (left_w, left_s, right_w, right_s)])[better]
        split = where[:, 0] >= 0
        first = nodes - 1
        column[first:first + nodes] = np.where(split, where[:, 0], 0)
        cut[first:first + nodes] = np.where(split, where[:, 1], np.iinfo(np.int32).max)
        own_column, own_cut = column[first:first + nodes][node], cut[first:first + nodes][node]
        code = columns.ravel()[own_column * columns.shape[1] + np.arange(columns.shape[1])]
        node = 2 * node + np.where(own_column < numbers, code > own_cut, code == own_cut)
        with np.errstate(divide="ignore", invalid="ignore"):
            children = np.column_stack([np.where(split, sides[:, 1] / sides[:, 0], mean), np.where(split, sides[:, 3] / sides[:, 2], mean)])
        mean, live = children.ravel(), np.column_stack([split, split]).ravel()
    return column, cut, mean, node
