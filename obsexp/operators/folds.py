"""Folds and hold-outs that never split a group, and expectations computed from cell means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import bucket_of, fast_uniform, md5_hex, md5_uniform
from ..session import materialise
from .ordered import global_position


def group_folds(
    df: DataFrame, group: str, k: int = 5, seed: int = 42, outcome: str | None = None, method: str = "hash",
    hash_method: str = "xxhash64", out: str = "fold",
) -> DataFrame:
    """Add a fold number; every group falls into exactly one fold.

    ``hash`` reads the fold off the group's hash: no shuffle at all, and even folds once there are many groups.
    ``balanced`` sorts groups by outcome rate and deals them out back and forth, for small tables where chance would
    leave folds with different rates.
    """
    if method == "hash":
        return df.withColumn(out, bucket_of(k, seed, group, hash_method))
    if method != "balanced" or outcome is None:
        raise ValueError("method must be 'hash', or 'balanced' with an outcome column")
    groups = df.groupBy(group).agg(F.avg(outcome).alias("_rate")).withColumn("_tie", md5_hex(group, F.lit(seed)))
    placed = global_position(materialise(groups, "groups"), "_rate", "_tie", "_pos")
    turn, seat = F.floor((F.col("_pos") - 1) / k), (F.col("_pos") - 1) % k
    dealt = placed.select(F.col(group).alias("_g"),
                          F.when(turn % 2 == 0, seat).otherwise(k - 1 - seat).cast("int").alias(out))
    return df.join(dealt, F.col(group) == F.col("_g")).drop("_g")


def group_holdout(df: DataFrame, group: str, share: float = 0.2, seed: int = 42, hash_method: str = "xxhash64",
                  out: str = "is_test") -> DataFrame:
    """Flag the rows of about ``share`` of all groups, chosen by hash."""
    u = md5_uniform(group, F.lit(seed)) if hash_method == "md5" else fast_uniform(seed, group)
    return df.withColumn(out, u < share)


def base_rate(df: DataFrame, outcome: str, train: Column, out: str = "base_rate") -> DataFrame:
    """Constant expectation: the mean outcome of the training rows."""
    return df.withColumn(out, df.where(train).agg(F.avg(outcome)).scalar())


def cell_mean(
    df: DataFrame, cells: Sequence[str], outcome: str, fold: str = "fold", smoothing: float = 20.0, out: str = "expected",
) -> DataFrame:
    """Cross-fitted expectation: the mean outcome of the row's difficulty cell over the other folds.

    Cell means are pulled towards the other folds' overall mean as if by ``smoothing`` events. The sums per cell and fold
    are stored, so the planner knows their size and broadcasts them only if they are small.
    """
    cells = list(cells)
    sums = materialise(df.groupBy(*cells, fold).agg(F.count(F.lit(1)).alias("_n"), F.sum(outcome).alias("_s")), "cell-sums")
    per_cell, whole = Window.partitionBy(*cells), Window.partitionBy()
    folds = sums.groupBy(F.col(fold).alias("_fold")).agg(F.sum("_n").alias("_fn"), F.sum("_s").alias("_fs"))  # a row per fold
    prior = F.try_divide((F.sum("_fs").over(whole) - F.col("_fs")).cast("double"), F.sum("_fn").over(whole) - F.col("_fn"))
    folds = folds.select("_fold", prior.alias("_prior"))
    other_n = F.sum("_n").over(per_cell) - F.col("_n")
    other_s = F.sum("_s").over(per_cell) - F.col("_s")
    scored = sums.withColumns({"_on": other_n, "_os": other_s}).join(folds, F.col(fold).eqNullSafe(F.col("_fold"))).select(
        *[F.col(c).alias(f"_c_{c}") for c in [*cells, fold]],
        ((F.col("_os") + smoothing * F.col("_prior")) / (F.col("_on") + smoothing)).alias(out))
    on = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in [*cells, fold]]
    return df.join(scored, on, "left").drop(*[f"_c_{c}" for c in [*cells, fold]])
