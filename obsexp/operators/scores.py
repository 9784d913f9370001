"""Classifier scores computed from distinct predictions.

Every score here depends on events only through how many share a prediction and how many of those succeeded. Events are
counted by prediction once, the counts are stored, and all scores are read from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import Scan, running, value_bucket

LOG_LOSS_EPS = 2.220446049250313e-16


def prediction_counts(df: DataFrame, outcome: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Successes and failures per distinct prediction ``p``."""
    counts = df.where(F.col(predicted).isNotNull()).groupBy(*by, F.col(predicted).alias("p")).agg(
        F.sum(outcome).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    return materialise(counts.withColumn("neg", F.col("n") - F.col("pos")), "prediction-counts")


def auc_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve: for each success, the failures predicted lower plus half of those predicted equal."""
    ordered = running(value_bucket(counts, "p", "_bucket"), by, "_bucket", ["p"],
                      {"_below": Scan("sum", F.col("neg"), inclusive=False)})
    won = F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2))
    return ordered.groupBy(*by).agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def auc(df: DataFrame, outcome: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return auc_of(prediction_counts(df, outcome, predicted, by), by)


def _with_auc(table: DataFrame, counts: DataFrame, by: Sequence[str]) -> DataFrame:
    areas = auc_of(counts, by).withColumnsRenamed({k: f"_k_{k}" for k in by})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]
    return table.join(areas, on, "left").drop(*[f"_k_{k}" for k in by])


def scorecard(df: DataFrame, outcome: str, predicted: Sequence[str]) -> DataFrame:
    """Accuracy, AUC, log loss and Brier score of several prediction columns, one row each."""
    models = F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).alias("p")) for p in predicted])
    long = df.select(F.col(outcome).alias("y"), F.explode(models).alias("m")).select("y", "m.model", "m.p")
    counts = prediction_counts(long, "y", "p", ["model"])
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    clipped = F.greatest(F.least(p, F.lit(1 - LOG_LOSS_EPS)), F.lit(LOG_LOSS_EPS))
    losses = counts.groupBy("model").agg(
        (F.sum(F.when(p > 0.5, pos).otherwise(neg)) / F.sum("n")).alias("accuracy"),
        (-F.sum(pos * F.log(clipped) + neg * F.log1p(-clipped)) / F.sum("n")).alias("log_loss"),
        (F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / F.sum("n")).alias("brier"),
        F.sum("n").cast("long").alias("n"),
    )
    return _with_auc(losses, counts, ["model"])


def calibration_gap(df: DataFrame, by: Sequence[str], outcome: str, expected: str) -> DataFrame:
    """Mean expected, mean actual, their gap and the AUC, per design and period."""
    by = list(by)
    counts = prediction_counts(df, outcome, expected, by)
    means = counts.groupBy(*by).agg(
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_expected"), (F.sum("pos") / F.sum("n")).alias("mean_actual"))
    return _with_auc(means, counts, by).select(
        *by, "mean_expected", "mean_actual", (F.col("mean_expected") - F.col("mean_actual")).alias("gap"), "auc")
