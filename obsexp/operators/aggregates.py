"""Observed-versus-expected tables and descriptive aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialise
from .ordered import exact_quantiles, quantiles_of, value_ranks, with_ranks


def _drop_null_keys(df: DataFrame, keys: Sequence[str], keep: bool) -> DataFrame:
    return df if keep else df.dropna(subset=list(keys))


def oe_table(
    df: DataFrame, keys: Sequence[str], outcome: str = "made", expected: str = "expected", floor: int = 0,
    keep_null_keys: bool = True,
) -> DataFrame:
    """Actual against expected successes per key, for keys with at least ``floor`` events."""
    totals = _drop_null_keys(df, keys, keep_null_keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(outcome).alias("actual"),
        F.sum(expected).alias("expected_total"),
        F.avg(outcome).alias("actual_rate"),
        F.avg(expected).alias("expected_rate"),
    )
    return totals.where(F.col("n") >= floor).withColumns({
        "oe_total": F.col("actual") - F.col("expected_total"),
        "oe_rate": F.col("actual_rate") - F.col("expected_rate"),
    })


def rank_table(
    df: DataFrame, keys: Sequence[str], outcome: str, points: str, expected: str = "expected", floor: int = 150,
) -> DataFrame:
    """Rank entities by raw rate, by effective rate and by residual rate, with the shifts between them."""
    totals = (
        df.dropna(subset=list(keys)).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("made"), F.sum(points).alias("points"),
             F.sum(expected).alias("expected_total"))
        .where(F.col("n") >= floor)
        .withColumns({"pct": F.col("made") / F.col("n"), "efg": C.effective_rate("points", "n"),
                      "expected_pct": F.col("expected_total") / F.col("n")})
        .withColumn("oe_rate", F.col("pct") - F.col("expected_pct"))
    )
    ranked = with_ranks(totals, {"pct_rank": ("pct", "min", True), "efg_rank": ("efg", "min", True),
                                 "oe_rank": ("oe_rate", "min", True)})
    return ranked.withColumns({"shift_vs_pct": F.col("pct_rank") - F.col("oe_rank"),
                               "shift_vs_efg": F.col("efg_rank") - F.col("oe_rank")})


def entity_scores(
    df: DataFrame, key: str, outcome: str, points: str | Column, expected: str = "expected", floor: int = 100,
    label: str | None = None,
) -> DataFrame:
    """Scores of one period: rate, expected rate, residual rate and effective rate per entity."""
    points = F.col(points) if isinstance(points, str) else points
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("pct"), F.avg(expected).alias("expected_pct"),
            F.sum(points).alias("points")]
    if label:
        aggs.append(F.min(label).alias(label))
    return (
        df.dropna(subset=[key]).groupBy(key).agg(*aggs).where(F.col("n") >= floor)
        .withColumns({"efg": C.effective_rate("points", "n"), "oe_rate": F.col("pct") - F.col("expected_pct")})
    )


def entity_profile(
    df: DataFrame, keys: Sequence[str], means: Mapping[str, str], rates: Mapping[str, Column], floor: int = 0,
) -> DataFrame:
    """Mean features per entity; a rate counts a missing condition as false."""
    return (
        df.dropna(subset=list(keys)).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for n, c in means.items()],
             *[F.avg(F.coalesce(cond, F.lit(False)).cast("int")).alias(n) for n, cond in rates.items()])
        .where(F.col("n") >= floor)
    )


def group_mean_back(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Attach the key's mean to every row. The mean is aggregated first, so a hot key stays spread out."""
    means = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.avg(value).alias(out))
    return df.join(means, F.col(key) == F.col("_k"), "left").drop("_k")


def context_exposure(
    df: DataFrame, entity: str, opponent: str, outcome: str, home: Column, floor: int = 150,
) -> DataFrame:
    """Per entity: mean success rate its opponents allow, and share of home events."""
    allowed = df.where(F.col(opponent).isNotNull()).groupBy(F.col(opponent).alias("_k")).agg(F.avg(outcome).alias("_a"))
    pairs = df.dropna(subset=[entity]).groupBy(entity, opponent).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(home, F.lit(False)).cast("int")).alias("_home"))
    faced = pairs.join(allowed, F.col(opponent) == F.col("_k"), "left")
    known = F.sum(F.when(F.col("_a").isNotNull(), F.col("_n")))
    return faced.groupBy(entity).agg(
        F.sum("_n").alias("n"), (F.sum(F.col("_a") * F.col("_n")) / known).alias("opponent_allowed"),
        (F.sum("_home") / F.sum("_n")).alias("home_share"),
    ).where(F.col("n") >= floor)


def calibration(df: DataFrame, predicted: str, outcome: str, q: int = 10) -> DataFrame:
    """Mean prediction and mean outcome by quantile bin; edges interpolate, bins close on the right, equal edges merge."""
    by_value = value_ranks(df, predicted, {"_successes": F.col(outcome)})
    edges = quantiles_of(by_value, predicted, [i / q for i in range(1, q)]).scalar()
    inner = F.array_distinct(F.col("_edges"))
    tagged = by_value.withColumn("_edges", edges).withColumn(
        "bin", F.size(F.filter(inner, lambda e: e < F.col(predicted))))
    return tagged.groupBy("bin").agg(
        (F.sum(F.col(predicted) * F.col("n_equal")) / F.sum("n_equal")).alias("mean_predicted"),
        (F.sum("_successes") / F.sum("n_equal")).alias("mean_actual"),
        F.sum("n_equal").alias("n"),
    )


def pivot_mean(df: DataFrame, rows: str, cols: str, labels: Sequence[str], value: str, scale: float = 100.0) -> DataFrame:
    """Two-way table of means; the column labels are given, so no extra pass finds them."""
    cells = df.dropna(subset=[rows, cols]).groupBy(rows).pivot(cols, list(labels)).agg(F.avg(value))
    return cells.select(rows, *[(F.col(f"`{c}`") * scale).alias(c) for c in labels])


def stratum_profile(df: DataFrame, stratum: str, outcome: str, covariate: str, cut: float) -> DataFrame:
    """Outcome rate, mean covariate and share at or above the cut, per stratum."""
    return df.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(outcome) * 100).alias("outcome_pct"),
        F.avg(covariate).alias("mean_covariate"),
        (F.avg(F.coalesce(F.col(covariate) >= cut, F.lit(False)).cast("int")) * 100).alias("share_above_pct"),
    )


def bucket_share(df: DataFrame, bucket: str, outcome: str) -> DataFrame:
    """Count, successes, rate and share of all bucketed events."""
    counts = df.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(
        F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("made"))
    total = df.where(F.col(bucket).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return counts.withColumns({"rate_pct": F.col("made") / F.col("n") * 100, "share_pct": F.col("n") / total * 100})


def profile(
    df: DataFrame, distinct: Mapping[str, str], date: str | None = None, shares: Mapping[str, Column] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """One row: number of events, distinct counts, date range and shares."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [count(F.col(c)).alias(n) for n, c in distinct.items()]
    if date:
        aggs += [F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    aggs += [F.avg(F.coalesce(cond, F.lit(False)).cast("int")).alias(n) for n, cond in (shares or {}).items()]
    return df.agg(*aggs)


def board_summary(entities: DataFrame) -> DataFrame:
    """One row describing a scored board: size, separable entities, events, interval width, reliability."""
    entities = materialise(entities, "board")
    half = (F.col("total_hi") - F.col("total_lo")) / 2
    events_median = exact_quantiles(entities, "n", [0.5], store=False).scalar()
    weight_median = exact_quantiles(entities, "reliability", [0.5], store=False).scalar()
    return entities.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if("separable").alias("n_separable"),
        F.avg("n").alias("mean_events"),
        F.avg(half).alias("mean_half_width"),
        F.avg("oe_rate").alias("mean_rate"),
        F.min("reliability").alias("reliability_min"),
        F.max("reliability").alias("reliability_max"),
    ).withColumns({"median_events": events_median[0], "reliability_median": weight_median[0]})


def error_metrics(
    df: DataFrame, a: str, b: str, within: float, confident: Column, agree: Column | None = None,
) -> DataFrame:
    """Absolute error, share within a tolerance, correlation and agreement: over all rows and the confident ones."""
    err = F.abs(F.col(a) - F.col(b))
    agree = F.lit(None).cast("boolean") if agree is None else agree
    tagged = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn(
        "subset", F.explode(F.when(confident, F.array(F.lit("all"), F.lit("confident"))).otherwise(F.array(F.lit("all")))))
    return tagged.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"),
        F.avg((err <= within).cast("int")).alias("share_within"),
        F.corr(a, b).alias("pearson"), F.avg(agree.cast("int")).alias("agreement"),
    )
