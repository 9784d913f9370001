"""Models on a table with signal, and the validation chain end to end."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsexp.operators import crossfit as cf
from obsexp.operators import folds as fo
from obsexp.operators import models as md
from obsexp.operators import ordered
from obsexp.operators import profiles as pr
from obsexp.operators import scores as sc
from obsexp.operators import shrinkage as sh
from obsexp.plans import board as bd
from obsexp.session import materialise
from signal_data import SKILL_SD, signal

NUM, CAT = ["x1", "x2"], ["cat"]


def logistic(train):
    return md.fit_logistic(train, "made", NUM, CAT, max_iter=30)


def boosted(train):
    return md.fit_boosted(train, "made", NUM, CAT, max_iter=12, step_size=0.3)


@pytest.fixture(scope="module")
def events(spark):
    return materialise(signal(spark, 24000), "signal")


def test_models_beat_the_base_rate_on_held_out_groups(events):
    out = {r.model: r for r in md.holdout_metrics(events, "grp", "made", {"logistic": logistic, "boosted": boosted}).collect()}
    assert out["base_rate"].auc == 0.5
    for name in ("logistic", "boosted"):
        assert out[name].auc > 0.68 and out[name].log_loss < out["base_rate"].log_loss and out[name].brier < out["base_rate"].brier
    assert out["logistic"].n_train + out["logistic"].n_test == 24000


def test_missing_and_unseen_values(spark, events):
    model = logistic(events.withColumn("x1", F.when(F.pmod("event_id", F.lit(10)) > 0, F.col("x1"))))
    odd = spark.createDataFrame([(1, None, 0.0, "zzz"), (2, 0.0, None, None)], "event_id int, x1 double, x2 double, cat string")
    assert all(0 < r.expected < 1 for r in model.score(odd).collect())
    assert md.most_frequent(events, ["cat"]) == {"cat": "a"}


def test_cross_fit_scores_every_row_and_stays_calibrated(events):
    scored = materialise(bd.score_by_model(events, "grp", "made", logistic, 5, method="balanced"), "scored")
    row = scored.agg(F.count(F.lit(1)).alias("n"), F.count("expected").alias("known"), F.count_distinct("event_id").alias("ids"),
                     F.avg("residual").alias("gap")).first()
    assert row.n == row.known == row.ids == 24000 and abs(row.gap) < 0.01


def test_cross_fit_refuses_rows_without_a_fold(events):
    with pytest.raises(ValueError, match="out of fold"):
        md.cross_fit(events.withColumn("fold", F.when(F.col("event_id") > 5, F.pmod("event_id", F.lit(2)).cast("int"))), logistic, k=2)


def plain_logistic(x, y):
    """Newton steps on the ridge-penalised loss; the first column is the intercept, without penalty."""
    ridge = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
    return beta


def test_all_folds_at_once_against_plain_fits(spark, monkeypatch):
    monkeypatch.setattr(cf, "value_bucket", lambda d, v, o: ordered.value_bucket(d, v, o, 50))
    rng = np.random.default_rng(2)
    n = 1500
    x1, x2 = rng.normal(3, 2, n).round(2), rng.normal(size=n)
    cat = rng.choice(["a", "b", "b", "c"], n).astype(object)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.6 * (x1 - 3) - x2 + (cat == "c"))))).astype(float)
    fold = np.arange(n) % 3
    cat[(fold == 1) & (rng.random(n) < 0.05)] = "only in one fold"
    lost, gap = rng.random(n) < 0.15, rng.random(n) < 0.1
    pdf = pd.DataFrame({"i": np.arange(n), "x1": x1, "x2": x2, "flat": 4.0, "cat": cat, "made": y, "fold": fold})
    rows = [(int(r.i), (None if r.i % 2 else float("nan")) if lost[r.i] else r.x1, r.x2, r.flat, None if gap[r.i] else r.cat,
             None if r.i < 20 else r.made, int(r.fold)) for r in pdf.itertuples()]
    df = spark.createDataFrame(rows, "i int, x1 double, x2 double, flat double, cat string, made double, fold int")
    got = {r.i: r for r in cf.cross_fit_logistic(df, "made", ["x1", "x2", "flat"], ["cat"], k=3).collect()}
    assert len(got) == n and got[5].made is None and got[5].x2 == pytest.approx(x2[5])
    pdf.loc[lost, "x1"], pdf.loc[gap, "cat"] = np.nan, None
    for i in range(3):
        train = pdf[(pdf["fold"] != i) & (pdf["i"] >= 20)]
        mode = train["cat"].value_counts().index[0]
        levels = sorted(set(train["cat"].dropna()))

        def design(part):
            numbers = [part["x1"].fillna(train["x1"].median()), part["x2"]]
            base = [train["x1"].fillna(train["x1"].median()), train["x2"]]
            scaled = [(a - b.mean()) / b.std() for a, b in zip(numbers, base)]
            text = part["cat"].where(part["cat"].notna(), mode)
            return np.column_stack([np.ones(len(part)), *scaled, *[(text == v).astype(float) for v in levels]]).astype(float)

        test = pdf[pdf["fold"] == i]
        want = 1 / (1 + np.exp(-design(test) @ plain_logistic(design(train), train["made"].to_numpy())))
        assert [got[j].expected for j in test["i"]] == pytest.approx(list(want), abs=2e-4)


def test_all_folds_at_once_on_odd_tables(spark, events):
    with pytest.raises(ValueError, match="out of fold"):
        cf.cross_fit_logistic(events.withColumn("fold", F.when(F.col("event_id") > 5, F.lit(0))), "made", NUM, CAT, k=2)
    with pytest.raises(ValueError, match="outcome"):
        cf.cross_fit_logistic(events.withColumn("fold", F.lit(0)), "made", [md.OUTCOME_COLUMNS[0]], [], k=2)
    one = events.limit(50).withColumn("fold", F.lit(1))  # nothing to learn from outside the fold
    assert {r.expected for r in cf.cross_fit_logistic(one, "made", NUM, CAT, k=2).collect()} == {None}
    void = spark.createDataFrame([(float(i % 2), None, None, i % 2) for i in range(8)], "made double, x1 double, cat string, fold int")
    assert all(r.expected == pytest.approx(float(1 - r.fold)) for r in cf.cross_fit_logistic(void, "made", ["x1"], ["cat"], k=2).collect())
    assert cf.cross_fit_logistic(void.limit(0), "made", ["x1"], ["cat"], k=2).collect() == []


def test_all_folds_at_once_agrees_with_one_by_one(events):
    folded = materialise(fo.group_folds(events, "grp", 3), "folded")
    single = md.cross_fit(folded, lambda t: md.fit_logistic(t, "made", NUM, CAT), k=3).select("event_id", F.col("expected").alias("e"))
    both = cf.cross_fit_logistic(folded, "made", NUM, CAT, k=3).join(single, "event_id")
    assert both.agg(F.max(F.abs(F.col("e") - F.col("expected")))).first()[0] < 1e-3


def test_validation_chain_recovers_skill(spark, events):
    scored = materialise(events.withColumns({
        "expected": 1 / (1 + F.exp(-(F.log(F.col("p_true") / (1 - F.col("p_true"))) - F.col("skill"))))}).withColumn(
        "residual", F.col("made") - F.col("expected")), "chain")
    board = materialise(bd.scored_board(scored, ["entity"], ["event_id"], 400), "board")
    moments = sh.dersimonian_laird(board).first()
    planted = (SKILL_SD * 0.21) ** 2       # skill on the probability scale at the mean slope
    assert 0.3 * planted < moments.tau2 < 2.5 * planted
    assert board.count() == 60 and board.where("separable").count() > 10
    halves = {r.design: r for r in bd.reliability_report(scored, ["entity"], "ts", ["event_id"]).collect()}
    assert halves["alternate"].half_r > 0.3 and halves["date"].half_r > 0.3
    first, second = scored.where("event_id < 12000"), scored.where("event_id >= 12000")
    panel, correlations, sweep = bd.stability_report(first, second, "entity", "made", F.col("made") * 2, 100, (50, 100))
    r = {row.metric: row for row in correlations.collect()}
    assert panel.count() == 60 and r["oe_rate"].r > 0.3 and r["oe_rate"].p < 0.05 and sweep.count() == 6
    tagged = board.withColumn("profile", F.when(F.col("entity") % 2 == 0, "even").otherwise("odd"))
    means, omnibus = bd.fairness_report(tagged)
    assert means.count() == 2 and 0 <= omnibus.first().p <= 1


def test_score_with_reports_the_gap_of_a_shifted_period(spark, events):
    model = logistic(events)
    later = signal(spark, 12000, seed=50, drift=0.5).withColumn("period", F.lit("late"))
    both = events.withColumn("period", F.lit("early")).unionByName(later)
    gaps = {r.period: r.gap for r in sc.calibration_gap(md.score_with(model, both), ["period"], "made", "expected").collect()}
    assert abs(gaps["early"]) < 0.01 and gaps["late"] < -0.05


def test_profiles_are_found_and_named(spark):
    centres = {"Interior Finishers": (4, 3, 1.5, 0.5, 0.0), "On-Ball Creators": (14, 4, 5, 5, 0.3),
               "Catch-and-Shoot": (20, 6, 1.5, 0.7, 0.7), "Mid-Range Scorers": (15, 4.5, 2, 1, 0.1)}
    rows = [(f"{name}-{i}", *[c + 0.02 * ((i * 7 + j) % 5) for j, c in enumerate(centre)]) for name, centre in centres.items() for i in range(15)]
    df = spark.createDataFrame(rows, "entity string, " + ", ".join(f"{f} double" for f in pr.STYLE_FEATURES))
    clustered = pr.cluster_profiles(df, pr.STYLE_FEATURES, starts=5)
    named = clustered.join(pr.style_names(pr.centroids(clustered, pr.STYLE_FEATURES)), "cluster")
    assert named.count() == 60 and named.where(~F.col("entity").startswith(F.col("profile"))).count() == 0
