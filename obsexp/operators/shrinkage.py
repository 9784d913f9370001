"""Random-effects moments, shrinkage and split-half reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import parity


def dersimonian_laird(entities: DataFrame, x: str = "oe_rate", se: str = "oe_se", store: bool = True) -> DataFrame:
    """One row (k, mu, tau2): inverse-variance moments of a random-effects model.

    The entity table is read three times, so it is stored first unless it is stored already.
    """
    entities = materialise(entities, "entities") if store else entities
    w = 1 / (F.col(se) * F.col(se))
    fixed = entities.agg((F.sum(w * F.col(x)) / F.sum(w)).alias("m")).scalar()
    centred = entities.withColumn("_m", fixed)
    gap = F.col(x) - F.col("_m")
    moments = centred.agg(
        F.count(F.lit(1)).alias("k"), F.sum(w * gap * gap).alias("q"),
        (F.sum(w) - F.sum(w * w) / F.sum(w)).alias("c"),
    ).select("k", F.greatest(F.lit(0.0), F.try_divide(F.col("q") - (F.col("k") - 1), F.col("c"))).alias("tau2"))
    spread = entities.withColumn("_tau2", moments.select("tau2").scalar())
    star = 1 / (F.col(se) * F.col(se) + F.col("_tau2"))
    mu = spread.agg((F.sum(star * F.col(x)) / F.sum(star)).alias("mu")).scalar()
    return moments.select("k", mu.alias("mu"), "tau2")


def shrink(entities: DataFrame, x: str = "oe_rate", se: str = "oe_se", n: str = "n", store: bool = True) -> DataFrame:
    """Pull each rate towards the overall mean by how little of it is repeatable; add the shrunk total."""
    entities = materialise(entities, "entities") if store else entities
    moments = dersimonian_laird(entities, x, se, store=False).select(F.struct("mu", "tau2").alias("m")).scalar()
    weight = F.col("_m.tau2") / (F.col("_m.tau2") + F.col(se) * F.col(se))
    return (
        entities.withColumn("_m", moments)
        .withColumn("reliability", weight)
        .withColumn("rate_shrunk", F.col("_m.mu") + F.col("reliability") * (F.col(x) - F.col("_m.mu")))
        .withColumn("total_shrunk", F.col("rate_shrunk") * F.col(n))
        .drop("_m")
    )


def _by_entity(df: DataFrame, keys, value: str, half: str, floor: int) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.try_divide(F.sum(F.when(F.col(half) == 0, F.col(value))), F.sum(F.when(F.col(half) == 0, F.col("_n")))).alias("half_a"),
        F.try_divide(F.sum(F.when(F.col(half) == 1, F.col(value))), F.sum(F.when(F.col(half) == 1, F.col("_n")))).alias("half_b"),
    ).where(F.col("n") >= floor)


def split_half(
    df: DataFrame, keys: Sequence[str], value: str, date: str, sequence: Sequence[str] = (), design: str = "alternate",
    floor: int = 150,
) -> DataFrame:
    """Mean residual of each half of an entity's events: every other event in time order, or before and after its median date.

    The alternating design numbers events date by date. The date design first reduces events to one row per entity and
    date, and takes the median from those rows.
    """
    keys, known = list(keys), df.dropna(subset=list(keys))
    if design == "alternate":
        halved = parity(known.withColumn("_day", F.to_date(date)), keys, "_day", [date, *sequence], "_half")
        return _by_entity(halved.withColumn("_n", F.lit(1)), keys, value, "_half", floor)
    if design != "date":
        raise ValueError("design must be 'alternate' or 'date'")
    days = known.groupBy(*keys, F.unix_date(F.to_date(date)).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    middle = days.groupBy(*[F.col(k).alias(f"_m_{k}") for k in keys]).agg(
        F.percentile("_day", 0.5, F.col("_n")).alias("_mid"))
    halved = days.join(middle, [F.col(k) == F.col(f"_m_{k}") for k in keys]).withColumn(
        "_half", (F.col("_day") > F.col("_mid")).cast("int"))
    return _by_entity(halved, keys, "_v", "_half", floor)


def spearman_brown(r: Column) -> Column:
    """Reliability of the full length from the correlation of its halves."""
    return 2 * r / (1 + r)


def half_correlation(halves: DataFrame, design: str) -> DataFrame:
    """One row: entities, correlation between halves and its full-length correction."""
    both = halves.where(F.col("half_a").isNotNull() & F.col("half_b").isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("half_a", "half_b").alias("half_r")).select(
        F.lit(design).alias("design"), "n", "half_r", spearman_brown(F.col("half_r")).alias("corrected"))
