"""Exact resampling: counts, independence of chunks, and the closed form of the standard error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsexp.operators import multinomial as M


def rows_of(n, seed=3):
    rng = np.random.default_rng(seed)
    return rng.standard_normal(n), np.sort(rng.integers(0, 1 << M.ROW_BITS, n))


def test_every_replicate_draws_as_many_rows_as_there_are():
    for n in (1, 2, 150, 1024, 1025, 5000):
        _, row = rows_of(n)
        assert (M.chunk_sums(np.ones(n), row, n, 99, 40, 0, 0, []) == n).all()


def test_counts_of_rows_are_multinomial():
    # Each row's count over many replicates has mean 1 and variance 1 - 1/n, across a leaf border too.
    n = 1500
    _, row = rows_of(n)
    totals = []
    for i in (0, 700, 1499):
        x = np.zeros(n)
        x[i] = 1.0
        counts = M.chunk_sums(x, row, n, 7, 20000, 0, 0, [])
        assert abs(counts.mean() - 1) < 0.03 and abs(counts.var() - 1) < 0.06
        totals.append(counts)
    assert abs(np.corrcoef(totals)[0, 1:]).max() < 0.03
    half = M.chunk_sums((np.arange(n) < 600).astype(float), row, n, 7, 20000, 0, 0, [])
    assert abs(half.mean() - 600) < 1 and abs(half.var() / (n * 0.4 * 0.6) - 1) < 0.04


def test_chunks_add_up_to_the_whole():
    n, bits = 9000, 3
    x, row = rows_of(n)
    whole = M.chunk_sums(x, row, n, 11, 50, 0, 0, [])
    total = np.zeros(50)
    for chunk in range(1 << bits):
        path = []
        for level in range(bits):
            node, width = chunk >> (bits - level), M.ROW_BITS - level
            inside, left = (row >> width) == node, (row >> (width - 1)) == 2 * node
            path.append((int(left.sum()), int(inside.sum())))
        own = (row >> (M.ROW_BITS - bits)) == chunk
        total += M.chunk_sums(x[own], row[own], n, 11, 50, bits, chunk, path)
    assert np.allclose(whole, total)


@pytest.fixture(scope="module")
def events(spark):
    # Entity 1 holds most rows; entity 3 is below the floor; a null key and null values.
    base = spark.range(30000).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 < 9, 2).when(F.col("id") % 1000 == 9, 3).alias("k"),
        (F.sin(F.col("id") * 12.9898) * 3 + F.col("id") % 5).alias("x"))
    return base.withColumn("x", F.when(F.col("id") % 997 != 0, F.col("x")))


def test_results_do_not_depend_on_chunks_or_order(spark, events):
    runs = []
    for chunk, df in ((1 << 17, events), (1024, events.repartition(5, "x")), (4096, events.orderBy(F.desc("id")))):
        runs.append({r.k: r for r in M.resample(df, ["k"], "x", ["id"], 100, rows_per_chunk=chunk).collect()})
    assert set(runs[0]) == {1, 2}
    for other in runs[1:]:
        for k, r in runs[0].items():
            assert np.allclose([r.total_lo, r.total_hi, r.oe_se], [other[k].total_lo, other[k].total_hi, other[k].oe_se])
    with pytest.raises(ValueError):
        M.resample(events, ["k"], "x", ["id"], rows_per_chunk=10)


def test_standard_error_is_that_of_the_closed_form(events):
    got = {r.k: r for r in M.resample(events.dropna(), ["k"], "x", ["id"], 8000, rows_per_chunk=2048).collect()}
    want = {r.k: r for r in events.dropna().groupBy("k").agg(
        F.stddev_pop("x").alias("sd"), F.count("x").alias("n"), F.sum("x").alias("total")).collect()}
    for k, r in got.items():
        exact = want[k].sd / want[k].n ** 0.5
        assert abs(r.oe_se / exact - 1) < 0.025 and r.n == want[k].n
        assert abs((r.total_hi + r.total_lo) / 2 - want[k].total) < 0.3 * exact * r.n


def test_no_rows(events):
    assert M.resample(events.limit(0), ["k"], "x", ["id"], 10).collect() == []
