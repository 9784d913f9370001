"""Chunked scans against plain pandas, with one key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsexp.operators import ordered as od


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"key": key, "t": rng.permutation(n), "v": rng.integers(0, 50, n).astype(float)})
    pdf.loc[rng.random(n) < 0.2, "v"] = np.nan
    pdf["opt"] = pdf["v"].where(pdf["v"] > 35)
    df = spark.createDataFrame(pdf).withColumns({"v": F.nanvl("v", F.lit(None).cast("double")),
                                                 "opt": F.nanvl("opt", F.lit(None).cast("double")),
                                                 "chunk": F.floor(F.col("t") / 37)})
    return pdf.sort_values(["key", "t"]).reset_index(drop=True), df


def by_row(df, *cols):
    return df.select("key", "t", *cols).toPandas().sort_values(["key", "t"]).reset_index(drop=True)


def test_running_aggregates(skewed):
    pdf, df = skewed
    out = by_row(od.running(df, ["key"], "chunk", ["t"], {
        "total": od.Scan("sum", F.col("v")), "before": od.Scan("count", F.lit(1), inclusive=False),
        "lowest": od.Scan("min", F.col("v")), "latest": od.Scan("last", F.col("opt")),
        "next": od.Scan("last", F.col("opt"), reverse=True, inclusive=False),
        "highest_after": od.Scan("max", F.col("v"), reverse=True),
    }), "total", "before", "lowest", "latest", "next", "highest_after")
    g = pdf.groupby("key")
    np.testing.assert_allclose(out["total"].fillna(0), pdf["v"].fillna(0).groupby(pdf["key"]).cumsum())
    np.testing.assert_array_equal(out["before"], g.cumcount())
    np.testing.assert_allclose(out["lowest"], g["v"].cummin().groupby(pdf["key"]).ffill())
    np.testing.assert_allclose(out["latest"], g["opt"].ffill())
    np.testing.assert_allclose(out["next"], g["opt"].bfill().groupby(pdf["key"]).shift(-1))
    back = pdf.iloc[::-1]
    np.testing.assert_allclose(out["highest_after"], back.groupby("key")["v"].cummax().groupby(back["key"]).ffill().iloc[::-1])


def test_neighbours_cross_chunks_and_keep_missing_values(skewed):
    pdf, df = skewed
    out = by_row(od.neighbours(df, ["key"], "chunk", ["t"], {"p": F.col("v")}, {"n": F.col("v")}), "p", "n")
    g = pdf.groupby("key")["v"]
    np.testing.assert_allclose(out["p"], g.shift(1))
    np.testing.assert_allclose(out["n"], g.shift(-1))


def test_ranks_match_pandas(skewed):
    pdf, df = skewed
    out = by_row(od.with_ranks(df, {"lo": ("v", "min", True), "avg": ("v", "average", False), "pct": ("v", "percent", False)}),
                 "lo", "avg", "pct")
    np.testing.assert_allclose(out["lo"], pdf["v"].rank(ascending=False, method="min"))
    np.testing.assert_allclose(out["avg"], pdf["v"].rank())
    np.testing.assert_allclose(out["pct"], pdf["v"].rank(pct=True))


def test_ranks_inside_labels(skewed):
    pdf, df = skewed
    out = by_row(od.with_ranks(df.withColumn("label", F.col("key") % 3), {"r": ("v", "average", False)}, ["label"]), "r")
    np.testing.assert_allclose(out["r"], pdf["v"].groupby(pdf["key"] % 3).rank())


def test_percentile_of_a_tie_is_neither_percent_rank_nor_cume_dist(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    out = od.with_ranks(df, {"p": ("v", "percent", False)}).orderBy("v").collect()
    assert [r.p for r in out] == [0.25, 0.625, 0.625, 1.0]


def test_quantiles_interpolate(skewed):
    pdf, df = skewed
    levels = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    found = od.exact_quantiles(df, "v", levels).first()[0]
    np.testing.assert_allclose(found, pdf["v"].quantile(levels))


def test_global_position_is_a_permutation_in_order(skewed):
    pdf, df = skewed
    known = df.where("v is not null").withColumn("tie", F.md5(F.col("t").cast("string")))
    out = od.global_position(known, "v", "tie").select("v", "tie", "position").toPandas()
    expected = out.sort_values(["v", "tie"]).reset_index(drop=True)
    np.testing.assert_array_equal(expected["position"], np.arange(1, len(out) + 1))


def test_first_per_key_limits_rows_before_the_shuffle(skewed):
    _, df = skewed
    plan = od.first_per_key(df, ["key"], [F.desc("t")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_window_sees_a_whole_key(skewed):
    """Event rows are only ever sorted within (key, chunk)."""
    _, df = skewed
    plan = od.row_numbers(df, ["key"], "chunk", ["t"])._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window [" in line and line.rstrip().endswith("]")]
    assert whole and all("chunk" in line for line in whole)


def test_crowded_key_is_cut_into_small_chunks(spark):
    # One key holds half of all rows, all inside one minute of a month.
    rows = spark.range(40000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(1 + F.col("id") % 97).alias("k"),
        F.when(F.col("id") % 2 == 0, 1_000_000 + F.col("id") * 0.0015).otherwise(F.col("id") * 64.0).alias("t"), "id")
    for limit in (500, 2):
        cut = od.value_bucket(rows, "t", "chunk", rows_per_chunk=limit)
        largest = cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        assert largest <= 3 * limit + 4, (limit, largest)
    cut = od.value_bucket(rows, "t", "chunk", rows_per_chunk=500)
    wrong = od.row_numbers(cut, ["k"], "chunk", ["t", "id"]).where("k = 0 AND row_number <> id / 2 + 1")
    assert wrong.count() == 0
