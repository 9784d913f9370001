"""Joins, matching and the pair search against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsexp.operators import joins as jn
from obsexp.operators import timejoin as tj


def test_enrich_keeps_rows_and_matches_null_keys(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (9, "d")], "k int, v string")
    dim = spark.createDataFrame([(1, "one"), (1, "one"), (2, "two"), (None, "none")], "id int, name string")
    out = jn.enrich(fact, [jn.Dimension(dim, [("k", "id")], ["name"])])
    assert out.columns == ["k", "v", "name"]
    assert {r.v: r.name for r in out.collect()} == {"a": "one", "b": "two", "c": "none", "d": None}


def test_checked_join_raises(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="same_rows"):
        jn.checked_join(left, spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"])
    with pytest.raises(ValueError, match="covered"):
        jn.checked_join(left, spark.createDataFrame([(1,)], "k int"), ["k"], ["covered"])
    assert jn.checked_join(left, left, ["k"], ["same_rows", "unique_left", "unique_right"]).count() == 2


def test_match_on_key_reports_unmatched_and_refuses_repeats(spark):
    ours = spark.createDataFrame([("Ömer Aşık", 1), ("C.J. McCollum", 2)], "player string, n int")
    theirs = spark.createDataFrame([("omer asik", 5)], "player string, mp int")
    matched, unmatched = jn.match_on_key(ours, theirs, "player", "player")
    assert [(r.key, r.n, r.mp) for r in matched.collect()] == [("omer asik", 1, 5)]
    assert [r.key for r in unmatched.collect()] == ["cj mccollum"]
    with pytest.raises(ValueError, match="unique"):
        jn.match_on_key(ours.union(ours), theirs, "player", "player")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_pair_equals_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    n = 120
    pdf = pd.DataFrame({"id": np.arange(n), "rate": np.round(rng.normal(0.45, 0.02, n), 5), "score": rng.normal(0, 0.02, n),
                        "n": rng.integers(400, 700, n)})
    pdf.loc[:40, "rate"] = 0.4412
    best = jn.best_pair(spark.createDataFrame(pdf), "id", "rate", "score", 0.004, F.col("n") >= 500).first()
    big = pdf[pdf["n"] >= 500]
    gaps = [(a.score - b.score, a.id, b.id) for a in big.itertuples() for b in big.itertuples()
            if a.id != b.id and a.rate - 0.004 <= b.rate <= a.rate + 0.004]
    assert (best.gap, best.entity_high, best.entity_low) == pytest.approx(max(gaps, key=lambda g: (g[0], -g[1], -g[2])))


def times(seed, n, users=4, span=400):
    rng = np.random.default_rng(seed)
    user = np.where(rng.random(n) < 0.4, 0, rng.integers(0, users, n))
    return pd.DataFrame({"user": user, "id": np.arange(n), "t": rng.integers(0, span, n).astype(float)})


def test_band_join_equals_filter(spark):
    a, b = times(1, 80), times(2, 150).rename(columns={"id": "fid", "t": "ft"})
    out = tj.band_join(spark.createDataFrame(a), spark.createDataFrame(b), ["user"], "t", "ft", 7.0).toPandas()
    expected = a.merge(b, on="user").query("abs(ft - t) <= 7.0")
    assert set(zip(out["id"], out["fid"])) == set(zip(expected["id"], expected["fid"])) and len(out) == len(expected)


def test_nearest_equals_brute_force(spark):
    a, b = times(3, 80), times(4, 60)
    out = tj.nearest(spark.createDataFrame(a), spark.createDataFrame(b), ["user"], "t", "t", "id", "id", 5.0, 20.0).toPandas()
    assert len(out) == len(a)
    for row in a.itertuples():
        near = b[b["user"] == row.user].assign(gap=lambda f: (f["t"] - row.t).abs()).query("gap <= 5.0")
        got = out[out["id"] == row.id].iloc[0]
        if near.empty:
            assert pd.isna(got["match_id"])
        else:
            best = near.sort_values(["gap", "t", "id"]).iloc[0]
            assert (got["match_id"], got["gap"]) == (best["id"], best["gap"])


@pytest.mark.parametrize("seed", [5, 6])
def test_nearest_unused_equals_sequential_matching(spark, seed):
    a, b = times(seed, 90), times(seed + 50, 70)
    out = tj.nearest_unused(spark.createDataFrame(a), spark.createDataFrame(b), ["user"], "t", "t", "id", "id", 5.0, 20.0)
    got = {(r.left_id, r.right_id, r.gap) for r in out.collect()}
    used, expected = set(), set()
    for row in a.sort_values(["user", "t", "id"]).itertuples():
        near = b[(b["user"] == row.user) & ~b["id"].isin(used)].assign(gap=lambda f: (f["t"] - row.t).abs()).query("gap <= 5.0")
        if len(near):
            best = near.sort_values(["gap", "t", "id"]).iloc[0]
            used.add(best["id"])
            expected.add((row.id, int(best["id"]), float(best["gap"])))
    assert got == expected


def test_pick_release_prefers_held_and_high_then_close(spark):
    rows = [(1, 1, 1.0, 8.0), (1, 2, 2.0, 9.0), (1, 3, 2.5, 9.0), (1, 4, 3.0, 11.0), (2, 7, 4.0, 9.0), (2, 8, 3.0, 2.0), (2, 9, 3.0, 4.0)]
    cands = spark.createDataFrame(rows, "ev int, pos int, d double, h double")
    out = {r.ev: (r.pos, r.release_confidence) for r in tj.pick_release(cands, ["ev"], "d", "h", "pos", 2.5).collect()}
    assert out == {1: (2, "high"), 2: (8, "low")}


def test_left_band_join_keeps_every_event_once(spark):
    events = spark.createDataFrame([(1, 10.0, "a"), (1, 20.0, None), (2, 10.0, "b"), (None, 5.0, "c"), (1, 10.0, "a")],
                                   "user int, t double, tag string")
    frames = spark.createDataFrame([(1, 11.0, 7), (1, 9.5, 8)], "user int, ft double, frame int")
    out = tj.band_join(events, frames, ["user"], "t", "ft", 2.0, how="left")
    got = sorted((r.user or 0, r.t, r.tag or "", r.frame or 0) for r in out.collect())
    assert got == [(0, 5.0, "c", 0), (1, 10.0, "a", 7), (1, 10.0, "a", 7), (1, 10.0, "a", 8), (1, 10.0, "a", 8),
                   (1, 20.0, "", 0), (2, 10.0, "b", 0)]


def test_best_pair_of_equals(spark):
    rows = [(1, 0.5, 2.0, 600), (2, 0.5, 2.0, 600), (3, 0.501, 2.0, 600)]
    best = jn.best_pair(spark.createDataFrame(rows[:2], "id int, rate double, score double, n int"), "id", "rate", "score", 0.004,
                        F.col("n") >= 500).first()
    assert (best.entity_high, best.entity_low, best.gap) == (1, 2, 0.0)
    best = jn.best_pair(spark.createDataFrame(rows[1:], "id int, rate double, score double, n int"), "id", "rate", "score", 0.004,
                        F.col("n") >= 500).first()
    assert (best.entity_high, best.entity_low) == (2, 3)
