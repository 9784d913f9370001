"""Registered queries: fitted expectation models and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import models as md
from ..operators import profiles as pr
from ..operators import scores as sc
from .board import score_by_logistic, score_by_model
from .registry import LINE_ID, banded, load, query, r6

NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CATEGORICAL = ("l_linestatus", "q_band")


def lines(spark, folder):
    return banded(load(spark, folder, "lineitem")).select(*LINE_ID, *NUMERIC, "q_band", "made", "l_shipdate")


def learnable(spark, folder):
    """The columns that models of the outcome and their folds need."""
    return lines(spark, folder).select("l_orderkey", *NUMERIC, *CATEGORICAL, "made")


def logistic(train):
    return md.fit_logistic(train, "made", NUMERIC, CATEGORICAL)


def boosted(train):
    return md.fit_boosted(train, "made", NUMERIC, CATEGORICAL)


@query("model_features")
def model_features(spark, folder):
    """Feature vectors of the training rows, summarised per category."""
    train = lines(spark, folder)
    features = md.FeaturePipeline(NUMERIC, CATEGORICAL, scale=True)
    model = md.fit_model(train, "made", features, md.LogisticRegression(maxIter=1000, regParam=0.01))
    vectors = model.fitted.transform(features.prepare(train, model.modes))
    return vectors.withColumn("v", md.vector_to_array("features")).groupBy("l_linestatus", "q_band").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("v")[0])).alias("mean_scaled_quantity"), F.max(F.size("v")).alias("width"))


@query("holdout_metrics")
def holdout_metrics(spark, folder):
    return md.holdout_metrics(learnable(spark, folder), "l_orderkey", "made", {"logistic": logistic, "boosted": boosted})


@query("cross_fit_logistic")
def cross_fit_logistic(spark, folder):
    scored = score_by_logistic(lines(spark, folder), "l_orderkey", "made", NUMERIC, CATEGORICAL)
    return ag.oe_table(scored, ["l_suppkey"], floor=150)


@query("cross_fit_boosted")
def cross_fit_boosted(spark, folder):
    scored = score_by_model(learnable(spark, folder), "l_orderkey", "made", boosted, k=3)
    return sc.scorecard(scored, "made", ["expected"])


@query("score_with")
def score_with(spark, folder):
    """A model of the early years applied to both periods, with the calibration gap of each."""
    early = F.year("l_shipdate") <= 1998
    all_lines = lines(spark, folder).withColumn("period", F.when(early, "early").otherwise("late"))
    model = logistic(all_lines.where(early))
    return sc.calibration_gap(md.score_with(model, all_lines), ["period"], "made", "expected")


FEATURES = ("avg_shot_dist", "avg_def_dist", "avg_touch_time", "avg_dribbles", "three_rate")


def style(spark, folder):
    return ag.entity_profile(
        load(spark, folder, "lineitem"), ["l_suppkey"],
        {"avg_shot_dist": "l_quantity", "avg_def_dist": "l_discount", "avg_touch_time": "l_tax", "avg_dribbles": "l_extendedprice"},
        {"three_rate": F.col("l_linenumber") == 3}, 150)


@query("cluster_profiles")
def cluster_profiles(spark, folder):
    clustered = pr.cluster_profiles(style(spark, folder), FEATURES, k=4, starts=10)
    names = pr.style_names(pr.centroids(clustered, FEATURES))
    return clustered.join(names, "cluster").groupBy("profile").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(f).alias(f) for f in FEATURES])


@query("name_clusters", """
WITH c AS (SELECT l_linenumber AS cluster, avg(l_quantity) AS avg_shot_dist, avg(l_extendedprice) AS avg_dribbles, avg(l_discount) AS three_rate FROM lineitem GROUP BY 1),
a AS (SELECT *, row_number() OVER (ORDER BY avg_shot_dist, cluster) AS ra FROM c),
b AS (SELECT *, CASE WHEN ra > 1 THEN row_number() OVER (PARTITION BY ra > 1 ORDER BY avg_dribbles DESC, cluster) END AS rb FROM a),
d AS (SELECT *, CASE WHEN rb > 1 THEN row_number() OVER (PARTITION BY coalesce(rb > 1, false) ORDER BY three_rate DESC, cluster) END AS rd FROM b)
SELECT cluster, CASE WHEN ra = 1 THEN 'Interior Finishers' WHEN rb = 1 THEN 'On-Ball Creators' WHEN rd = 1 THEN 'Catch-and-Shoot' ELSE 'Mid-Range Scorers' END AS profile FROM d""")
def name_clusters(spark, folder):
    groups = load(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("cluster")).agg(
        F.avg("l_quantity").alias("avg_shot_dist"), F.avg("l_extendedprice").alias("avg_dribbles"),
        F.avg("l_discount").alias("three_rate"))
    return pr.style_names(groups)
