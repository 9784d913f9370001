"""Logistic expectations of all folds at once.

What a fit needs from its rows besides the optimiser (counts, moments, medians, category counts) is gathered per fold in
one pass each and merged: all folds less the one left out. The fits of all folds share the passes over the rows, a handful
of Newton steps, and one pass scores every row with the coefficients of its fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .models import FeaturePipeline
from .ordered import Scan, running, value_bucket

# Up to so many coefficients a fit takes Newton steps, whose matrix grows with their square; beyond, Spark's optimiser.
MAX_NEWTON = 48


@dataclass
class Preparation:
    """What the rows outside one fold say: their number, and per column the filling value, mean and spread."""

    n: int
    fill: list[float]
    mean: list[float]
    spread: list[float]
    modes: list[str]


def cross_fit_logistic(
    df: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str], fold: str = "fold", k: int = 5,
    out: str = "expected", max_iter: int = 1000, parallel: int = 5,
) -> DataFrame:
    """Score every row with an L2 logistic regression fitted on the other folds; the penalty is a unit-strength ridge.

    Numeric columns are filled with the exact median of the training rows and scaled, text columns filled with the most
    frequent value (the smallest on ties) and one-hot encoded; a value that no training row has adds nothing. A column
    without any training value is filled with 0. Rows without an outcome are scored and not learned from, and where no
    training row is left the score is null. A row without a fold number from 0 to k-1 is an error. The categories of a
    column are held by the driver.
    """
    FeaturePipeline(numeric, categorical, scale=True)  # refuses columns that describe the outcome
    stored = materialise(df, "cross-fit", [fold])
    values = [_number(c) for c in numeric]
    texts = [F.col(c).cast("string") for c in categorical]
    train = stored.where(F.col(outcome).isNotNull())
    if stored.where(F.col(fold).isNull() | ~F.col(fold).between(0, k - 1)).limit(1).count():
        raise ValueError("every row must be scored out of fold")
    names, plans, fitted = fit_folds(train, outcome, numeric, categorical, fold, k, max_iter, parallel)
    return stored.withColumn(out, _score(F.col(fold), values, texts, names, plans, fitted)).select(*df.columns, out)


def fit_folds(train: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str], fold: str, k: int,
              max_iter: int, parallel: int = 5):
    """(values per text column, preparations, coefficients) of the k fits, each on the rows outside its fold."""
    counts = category_counts(train, categorical, fold)
    names = [sorted({value for column, value, _ in counts if column == i}) for i in range(len(categorical))]
    plans = preparations(train, numeric, categorical, fold, k, counts)
    if 1 + len(numeric) + sum(map(len, names)) <= MAX_NEWTON:
        return names, plans, _newton(train, outcome, numeric, categorical, fold, names, plans, max_iter)
    values = [_number(c) for c in numeric]
    texts = [F.col(c).cast("string") for c in categorical]

    def fit(i: int):
        plan = plans[i]
        if plan.n == 0:
            return None
        numbers = [(F.coalesce(v, F.lit(plan.fill[j])) - plan.mean[j]) / plan.spread[j] if plan.spread[j] else F.lit(0.0)
                   for j, v in enumerate(values)]
        hot = [_one_hot(F.coalesce(t, F.lit(plan.modes[c])), names[c]) for c, t in enumerate(texts) if names[c]]
        vector = array_to_vector(F.concat(F.array(*numbers).cast("array<double>"), *hot))
        rows = train.where(F.col(fold) != i).select(vector.alias("features"), F.col(outcome).cast("double").alias("label"))
        model = LogisticRegression(maxIter=max_iter, regParam=1.0 / plan.n, elasticNetParam=0.0, standardization=False).fit(rows)
        return model.intercept, [float(c) for c in model.coefficients]

    with ThreadPool(min(parallel, k)) as pool:
        return names, plans, pool.map(inheritable_thread_target(train.sparkSession)(fit), range(k))


def _newton(train: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str], fold: str,
            names: Sequence[Sequence[str]], plans: Sequence[Preparation], max_iter: int):
    """Newton steps on the ridge-penalised loss of all folds. A pass returns one sum per fold and matrix entry.

    A step that raises a loss is halved. Where all outcomes are equal, the intercept is infinite.
    """
    codes = [F.array_position(F.array(*[F.lit(v) for v in names[c]]).cast("array<string>"), F.col(t).cast("string")).cast("double")
             for c, t in enumerate(categorical)]
    rows = train.select(F.col(fold).cast("int").alias("_fold"), F.col(outcome).cast("double").alias("_y"),
                        *[_number(c).alias(f"_x{j}") for j, c in enumerate(numeric)],
                        *[F.coalesce(code, F.lit(0.0)).alias(f"_c{c}") for c, code in enumerate(codes)])
    width = 1 + len(numeric) + sum(map(len, names))
    ridge = np.diag([0.0] + [1.0] * (width - 1))
    at = {i: np.zeros(width) for i, plan in enumerate(plans) if plan.n}
    kept: dict[int, tuple[np.ndarray, float]] = {}
    fitted: list = [None] * len(plans)
    for turn in range(max(1, max_iter)):
        if not at:
            break
        found = _sums(rows, at, len(numeric), names, plans)
        for i, w in list(at.items()):
            positive, loss = found[i][:2]
            gradient, matrix = found[i][2:2 + width], found[i][2 + width:].reshape(width, width)
            loss += w[1:] @ w[1:] / 2
            if positive in (0, plans[i].n):
                fitted[i] = (math.inf if positive else -math.inf, [0.0] * (width - 1))
                del at[i]
                continue
            if i in kept and loss > kept[i][1] * (1 + 1e-12):
                at[i] = (kept[i][0] + w) / 2
                continue
            step = np.linalg.solve(matrix + ridge, gradient - ridge @ w)
            kept[i], at[i] = (w, loss), w + step
            fitted[i] = (float(at[i][0]), at[i][1:].tolist())
            if np.abs(step).max() < 1e-6:  # the next one would be about the square of it
                del at[i]
    return fitted


def _sums(rows: DataFrame, at: dict[int, np.ndarray], numbers: int, names: Sequence[Sequence[str]],
          plans: Sequence[Preparation]) -> dict[int, np.ndarray]:
    """Per fold over the rows outside it: positive outcomes, loss, gradient and matrix of second derivatives at ``at``."""
    sizes = [len(v) for v in names]
    modes = [[values.index(p.modes[c]) + 1 if p.modes[c] in values else 0 for c, values in enumerate(names)] for p in plans]
    fills = [(np.array(p.fill), np.array(p.mean), np.array([1 / s if s else 0.0 for s in p.spread])) for p in plans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros(2 + len(w) + len(w) ** 2) for i, w in at.items()}
        for batch in batches:
            fold, y, *columns = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(batch.num_columns)]
            if not len(y):
                continue
            raw = np.column_stack(columns[:numbers]) if numbers else np.empty((len(y), 0))
            holes = np.isnan(raw)
            for i, w in at.items():
                fill, mean, scale = fills[i]
                parts = [np.ones((len(y), 1)), (np.where(holes, fill, raw) - mean) * scale]
                for c, size in enumerate(sizes):
                    code = np.where(columns[numbers + c] == 0, modes[i][c], columns[numbers + c])
                    parts.append((code[:, None] == np.arange(1, size + 1)).astype(np.float64))
                x, own = np.hstack(parts)[fold != i], y[fold != i]
                z = x @ w
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                total = sums[i]
                total[0] += own.sum()
                total[1] += (np.logaddexp(0, z) - own * z).sum()
                total[2:2 + len(w)] += x.T @ (own - p)
                total[2 + len(w):] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()])],
                                         names=["fold", "sums"])

    parts = rows.mapInArrow(run, "fold int, sums array<double>").select("fold", F.posexplode("sums").alias("place", "part"))
    out = {i: np.zeros(2 + len(w) + len(w) ** 2) for i, w in at.items()}
    for r in parts.groupBy("fold", "place").agg(F.sum("part").alias("total")).collect():
        out[r.fold][r.place] = r.total
    return out


class LogisticModel:
    """One fit on all rows of a table; ``score`` adds the expected probability."""

    def __init__(self, train: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str], max_iter: int):
        FeaturePipeline(numeric, categorical, scale=True)  # refuses columns that describe the outcome
        self.numeric, self.categorical = list(numeric), list(categorical)
        known = train.where(F.col(outcome).isNotNull()).withColumn("_left_out", F.lit(-1))
        self.names, self.plans, self.fitted = fit_folds(known, outcome, numeric, categorical, "_left_out", 1, max_iter)

    def score(self, df: DataFrame, out: str = "expected") -> DataFrame:
        values = [_number(c) for c in self.numeric]
        texts = [F.col(c).cast("string") for c in self.categorical]
        return df.select(*df.columns, _score(F.lit(0), values, texts, self.names, self.plans, self.fitted).alias(out))


def _number(column: str) -> Column:
    """A double; NaN counts as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _one_hot(text: Column, values: Sequence[str]) -> Column:
    return F.transform(F.array(*[F.lit(v) for v in values]), lambda v: (v == text).cast("double"))


def _score(fold: Column, values, texts, names, plans: Sequence[Preparation], fitted) -> Column:
    """The probability by the model of the row's fold; scaling is folded into the coefficients."""
    def of_fold(numbers) -> Column:
        return F.get(F.array(*[F.lit(n) for n in numbers]), fold)

    weights = [[0.0 if m is None or not p.spread[j] else m[1][j] / p.spread[j] for m, p in zip(fitted, plans)]
               for j in range(len(values))]
    starts = [None if m is None else m[0] - math.fsum(weights[j][i] * p.mean[j] for j in range(len(values)))
              for i, (m, p) in enumerate(zip(fitted, plans))]
    total = F.get(F.array(*[F.lit(s).cast("double") for s in starts]), fold)
    for j, value in enumerate(values):
        total = total + of_fold(weights[j]) * F.coalesce(value, of_fold([p.fill[j] for p in plans]))
    at = len(values)
    for c, text in enumerate(texts):
        if names[c]:
            per_value = F.create_map(*[x for v, name in enumerate(names[c]) for x in (F.lit(name), F.array(
                *[F.lit(0.0 if m is None else m[1][at + v]) for m in fitted]))])
            filled = F.coalesce(text, of_fold([p.modes[c] for p in plans]))
            total = total + F.coalesce(F.get(F.try_element_at(per_value, filled), fold), F.lit(0.0))
        at += len(names[c])
    return 1 / (1 + F.exp(-total))


def category_counts(df: DataFrame, categorical: Sequence[str], fold: str) -> dict[tuple[int, str, int], int]:
    """Rows per (column number, value, fold), from one aggregate."""
    if not categorical:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v"))
                                for i, c in enumerate(categorical)]))
    counts = df.select(F.col(fold).alias("_fold"), pairs.alias("x")).where("x.v is not null").groupBy(
        "x.c", "x.v", "_fold").agg(F.count(F.lit(1)).alias("n"))
    return {(r.c, r.v, r._fold): r.n for r in counts.collect()}


def preparations(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold: str, k: int,
                 counts: dict[tuple[int, str, int], int]) -> list[Preparation]:
    """The preparation of each fold's model, from moments per fold (one row each) and the category counts."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for j, c in enumerate(numeric):
        v = _number(c)
        aggs += [F.count(v).alias(f"n{j}"), F.avg(v).alias(f"mean{j}"), (F.var_pop(v) * F.count(v)).alias(f"square{j}")]
    parts = {r[fold]: r for r in df.groupBy(fold).agg(*aggs).collect()}
    holes = [j for j in range(len(numeric)) if any(r[f"n{j}"] < r.n for r in parts.values())]
    known = [[sum(r[f"n{j}"] for f, r in parts.items() if f != i) for j in range(len(numeric))] for i in range(k)]
    medians = _medians(df, [numeric[j] for j in holes], fold, [[known[i][j] for j in holes] for i in range(k)])
    out = []
    for i in range(k):
        others = [r for f, r in parts.items() if f != i]
        n = sum(r.n for r in others)
        fill = [0.0] * len(numeric)
        for at, j in enumerate(holes):
            fill[j] = medians[i][at]
        mean, spread = [], []
        for j in range(len(numeric)):
            groups = [(r[f"n{j}"], r[f"mean{j}"], r[f"square{j}"]) for r in others if r[f"n{j}"]]
            groups.append((n - known[i][j], fill[j], 0.0))
            centre = math.fsum(c * m for c, m, _ in groups) / n if n else 0.0
            square = math.fsum(s + c * (m - centre) ** 2 for c, m, s in groups)
            mean.append(centre)
            spread.append(math.sqrt(square / (n - 1)) if n > 1 else 0.0)
        modes = []
        for c in range(len(categorical)):
            sums: dict[str, int] = {}
            for (column, value, f), rows in counts.items():
                if column == c and f != i:
                    sums[value] = sums.get(value, 0) + rows
            modes.append(min(sums, key=lambda v: (-sums[v], v)) if sums else "missing")
        out.append(Preparation(n, fill, mean, spread, modes))
    return out


def _medians(df: DataFrame, numeric: Sequence[str], fold: str, known: Sequence[Sequence[int]]) -> list[list[float]]:
    """Exact medians of each column outside each fold; ``known`` holds the numbers of values there.

    Values are counted per (column, value, fold) before they are ordered, and all folds share one ordered scan.
    """
    if not numeric:
        return [[] for _ in known]
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("_col"), _number(c).alias("_value")) for j, c in enumerate(numeric)]))
    own = [F.count_if(F.col("_fold") != i).alias(f"_n{i}") for i in range(len(known))]
    counts = materialise(df.select(F.col(fold).alias("_fold"), pairs.alias("_x")).select("_fold", "_x.*").where(
        "_value is not null").groupBy("_col", "_value").agg(*own), "value-counts")
    ranked = running(value_bucket(counts, "_value", "_bucket"), ["_col"], "_bucket", ["_value"], {
        f"_b{i}": Scan("sum", F.col(f"_n{i}"), inclusive=False) for i in range(len(known))})
    picks = []
    for i, sizes in enumerate(known):
        reach = F.col(f"_b{i}") + F.col(f"_n{i}")
        for side, rounded in (("lo", math.floor), ("hi", math.ceil)):
            place = F.get(F.array(*[F.lit(rounded((n - 1) / 2)) for n in sizes]), F.col("_col"))
            picks.append(F.min(F.when((reach > place) & (F.col(f"_n{i}") > 0), F.col("_value"))).alias(f"{side}{i}"))
    rows = {r._col: r for r in ranked.groupBy("_col").agg(*picks).collect()}
    return [[(rows[j][f"lo{i}"] + rows[j][f"hi{i}"]) / 2 if sizes[j] else 0.0 for j in range(len(numeric))]
            for i, sizes in enumerate(known)]
