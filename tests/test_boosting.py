"""Trees on counted cells: bins, growth against a plain loop, and what a fit reads."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsexp.operators import boosting as bo
from obsexp.operators import models as md
from obsexp.plans.registry import QUERIES


def table(spark, n=6000):
    """Half of the rows come three times; holes and values of both kinds that are not there in every row."""
    rng = np.random.default_rng(4)
    x, z, c = rng.normal(size=n).round(2), rng.integers(0, 9, n), rng.choice(["a", "b", "c"], n)
    made = rng.random(n) < 1 / (1 + np.exp(-(2 * x - 0.3 * z + (c == "c"))))
    rows = [(i, float(x[i]) if i % 17 else None, float(z[i]) if i % 13 else math.nan, str(c[i]) if i % 11 else None, int(made[i]))
            for i in range(n)]
    rows += 2 * rows[: n // 2]
    return spark.createDataFrame(rows, "i int, x double, z double, c string, made int")


def test_stretches_are_cut_until_none_is_heavy(spark):
    """Values crowd far from the others, at both ends without limit; each count and end is that of the rows."""
    values = [1e9 + i / 8 for i in range(4000)] + [-1e300, 1e300, math.inf, -math.inf, None, math.nan] + [7.0] * 3000
    df = spark.createDataFrame([(v, 5.0) for v in values], "x double, flat double")
    found, flat = bo.value_counts(df, ["x", "flat"])
    known = sorted(v for v in values if v is not None and v == v)
    assert sum(n for n, _, _ in found) == len(known) and flat == [(len(values), 5.0, 5.0)]
    assert all(n <= bo.HEAVY * len(known) or lo == hi for n, lo, hi in found)
    at = 0
    for n, lo, hi in found:
        assert (known[at], known[at + n - 1]) == (lo, hi)
        at += n
    cuts = bo.quantile_cuts(found)
    assert len(cuts) == 31 and cuts == sorted(set(cuts)) and bo._middle(flat) == 5.0
    sizes = np.diff(np.searchsorted(known, [*cuts, math.inf], side="right"), prepend=0)
    assert sorted(sizes)[-1] == 3000 and sorted(sizes)[-2] < 170  # the value that many rows hold takes no cut from the others
    assert bo.quantile_cuts([(1, float(v), float(v)) for v in range(32)]) == [v + 0.5 for v in range(31)]


def test_every_distinct_row_is_counted_and_codes_fit_their_bins(spark):
    df = table(spark)
    bins = bo.find_bins(df, ["x", "z"], ["c"])
    assert bins.levels == [["a", "b", "c"]] and bins.sizes() == [32, 9, 4] and bins.cuts[1] == [v + 0.5 for v in range(8)]
    odd = spark.createDataFrame([(None, -9.0, "zz"), (99.0, math.nan, None)], "x double, z double, c string")
    fill = [int(np.searchsorted(cuts, v)) for cuts, v in zip(bins.cuts, bins.fill)]
    assert [r.features for r in bins.coded(odd).collect()] == [[fill[0], 0, 3], [31, fill[1], "abc".index(bins.modes[0])]]


def plain_tree(rows, y, columns, numbers, depth, least):
    """The same tree as a recursion over rows: the split with the largest drop of the squared error."""
    def error(part):
        return ((y[part] - y[part].mean()) ** 2).sum() if len(part) else 0.0

    def grow(part, left):
        best = (1e-9, None)
        for j in range(rows.shape[1]):
            for cut in sorted(set(columns[j])):
                right = rows[part, j] > cut if j < numbers else rows[part, j] == cut
                a, b = part[~right], part[right]
                if min(len(a), len(b)) >= least and error(part) - error(a) - error(b) > best[0] + 1e-9:
                    best = (error(part) - error(a) - error(b), (a, b))
        if not left or best[1] is None:
            return [(part, y[part].mean())]
        return grow(best[1][0], left - 1) + grow(best[1][1], left - 1)

    return grow(np.arange(len(rows)), depth)


def test_a_tree_on_cells_equals_one_on_rows():
    rng = np.random.default_rng(7)
    rows = np.column_stack([rng.integers(0, 5, 900), rng.integers(0, 4, 900), rng.integers(0, 3, 900)])
    y = (rng.random(900) < 0.2 + 0.1 * rows[:, 0] + 0.2 * (rows[:, 2] == 1) * (rows[:, 1] > 1)) * 2.0 - 1
    cells, of, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    settings = bo.Settings(1, 1.0, 0, depth=3, columns=1.0)
    total = np.bincount(of.ravel(), y)
    columns, sizes = np.ascontiguousarray(cells.T), [5, 4, 4]
    *_, value, last = bo._grow(columns, bo._joint(columns, sizes), sizes, 2, n.astype(float), total, np.random.default_rng(0), settings)
    want = np.zeros(900)
    for part, mean in plain_tree(rows, y, [range(5), range(4), range(4)], 2, 3, 5):
        want[part] = mean
    np.testing.assert_allclose(value[last][of.ravel()], want, atol=1e-9)


def test_fit_depends_on_no_layout_and_matches_sparks_trees(spark, monkeypatch):
    """Rows in any order and number of parts give the same scores; beyond the cells of one task Spark's trees do as well."""
    df = table(spark)

    def scores(rows):
        model = md.fit_boosted(rows, "made", ["x", "z"], ["c"], max_iter=20, step_size=0.2)
        return {r.i: r.expected for r in model.score(df.limit(6000)).collect()}

    one, other = scores(df.coalesce(1)), scores(df.repartition(7, "made").orderBy(F.desc("i")))
    assert one == other and len(one) == 6000
    made = {r.i: r.made for r in df.collect()}

    def loss(found):
        return -sum(math.log(p if made[i] else 1 - p) for i, p in found.items()) / len(found)

    monkeypatch.setattr(bo, "MAX_CELLS", 10)
    fitted = []
    whole = bo.GBTClassifier
    monkeypatch.setattr(bo, "GBTClassifier", lambda **named: (fitted.append(named), whole(**named))[1])
    rows = scores(df)
    assert len(fitted) == 1 and fitted[0]["maxIter"] == 20 and fitted[0]["subsamplingRate"] == 0.8
    base = sum(made.values()) / len(made)
    assert loss(one) < 0.8 * loss(dict.fromkeys(made, base)) and abs(loss(one) - loss(rows)) < 0.02


def test_more_rows_of_the_same_cells_take_no_more_from_the_trees(spark, monkeypatch):
    """Trees see the cells, with their counts, and not the rows: forty times the rows make no more of them."""
    sizes, kept = [], bo.materialise
    monkeypatch.setattr(bo, "materialise", lambda df, label: (sizes.append((label, t := kept(df, label), t.count())), t)[1])
    for times in (1, 40):
        rows = table(spark, 2000).crossJoin(spark.range(times))
        md.fit_boosted(rows, "made", ["x", "z"], ["c"], max_iter=2, step_size=0.2)
    (_, small, a), (_, large, b) = sizes
    assert a == b and 40 * small.agg(F.sum("n")).first()[0] == large.agg(F.sum("n")).first()[0] == 40 * 4000


def test_odd_training_rows(spark):
    df = table(spark, 200)
    with pytest.raises(ValueError, match="0 or 1"):
        md.fit_boosted(df.withColumn("made", F.lit(2)), "made", ["z"], ["c"], max_iter=1)
    with pytest.raises(ValueError, match="without a value"):
        md.fit_boosted(df.withColumn("x", F.lit(None).cast("double")), "made", ["x"], [], max_iter=1)
    with pytest.raises(ValueError, match="outcome"):
        md.fit_boosted(df, "made", [md.OUTCOME_COLUMNS[0]], [], max_iter=1)
    same = md.fit_boosted(df.withColumn("made", F.lit(1)), "made", ["z"], [], max_iter=3)
    assert all(r.expected > 0.85 for r in same.score(df).collect())
    unknown = df.withColumn("made", F.when(F.col("i") % 2 == 0, F.col("made")))  # rows without an outcome are not learned from
    model = md.fit_boosted(unknown, "made", ["x", "z"], ["c"], max_iter=3)
    alone = md.fit_boosted(df.where("i % 2 = 0"), "made", ["x", "z"], ["c"], max_iter=3)
    one, other = (sorted((r.i, r.expected) for r in m.score(df).collect()) for m in (model, alone))
    assert one == other and len(one) == 400


def test_fits_of_folds_run_side_by_side(spark):
    """Every fit waits for the others."""
    import threading
    meet = threading.Barrier(3, timeout=60)

    class Constant:
        def score(self, df, out):
            return df.withColumn(out, F.lit(0.5))

    def fit(train):
        meet.wait()
        return Constant()

    folded = spark.range(30).withColumn("fold", (F.col("id") % 3).cast("int"))
    assert md.cross_fit(folded, fit, k=3).where("expected = 0.5").count() == 30


def test_registered_boosted_models_grow_all_their_trees(spark, small, monkeypatch):
    """300 rounds with steps of 0.05, as the functions' defaults and the README say, and all rows of the other side."""
    grown, settings = [], []

    class Seen(bo.CellTrees):
        def __init__(self, trees, numbers):
            super().__init__(trees, numbers)
            grown.append([len(part) for part in trees])

    class Asked(bo.BoostedTrees):
        def __init__(self, sizes, numbers, asked):
            super().__init__(sizes, numbers, asked)
            settings.append((asked.max_iter, asked.step_size, asked.depth))

    monkeypatch.setattr(bo, "CellTrees", Seen)
    monkeypatch.setattr(md, "BoostedTrees", Asked)
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    for name, fits in (("holdout_metrics", 1), ("cross_fit_boosted", 3)):
        rows = {r.model: r for r in QUERIES[name](spark, small).collect()}
        assert grown == [[300] * 3] * fits and settings == [(300, 0.05, 5)] * fits
        assert (rows["boosted"].n_test + rows["boosted"].n_train if name == "holdout_metrics" else rows["expected"].n) == lines
        grown.clear()
        settings.clear()
