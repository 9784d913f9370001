"""Events to a scored board, and the board to its validation tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import aggregates as ag
from ..operators import association as st
from ..operators import panel as pn
from ..operators import shrinkage as sh
from ..operators.folds import cell_mean, group_folds
from ..operators.crossfit import cross_fit_logistic
from ..operators.models import ExpectationModel, cross_fit
from ..operators.resampling import bootstrap


def score_by_cells(
    df: DataFrame, group: str, outcome: str, cells: Sequence[str], k: int = 5, seed: int = 42,
    hash_method: str = "xxhash64",
) -> DataFrame:
    """Hash folds and cell-mean expectations; adds fold, expected and residual."""
    folded = group_folds(df, group, k, seed, hash_method=hash_method)
    scored = cell_mean(folded, cells, outcome, "fold")
    return scored.withColumn("residual", F.col(outcome) - F.col("expected"))


def score_by_model(
    df: DataFrame, group: str, outcome: str, fit: Callable[[DataFrame], ExpectationModel], k: int = 5, seed: int = 42,
    method: str = "hash",
) -> DataFrame:
    """Folds and a cross-fitted model; adds fold, expected and residual."""
    folded = group_folds(df, group, k, seed, outcome, method)
    scored = cross_fit(folded, fit, "fold", k)
    return scored.withColumn("residual", F.col(outcome) - F.col("expected"))


def score_by_logistic(
    df: DataFrame, group: str, outcome: str, numeric: Sequence[str], categorical: Sequence[str], k: int = 5, seed: int = 42,
    method: str = "hash",
) -> DataFrame:
    """The same with logistic regressions, all folds at once."""
    folded = group_folds(df, group, k, seed, outcome, method)
    scored = cross_fit_logistic(folded, outcome, numeric, categorical, "fold", k)
    return scored.withColumn("residual", F.col(outcome) - F.col("expected"))


def write_scored(scored: DataFrame, path: str, period: str) -> None:
    """Store scored events once, a folder per period, for the board and every report to read."""
    scored.write.partitionBy(period).parquet(path)


def read_scored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Scored events as stored; a filter on the period reads its folders only. A table without rows needs its schema."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def scored_board(
    scored: DataFrame, keys: Sequence[str], row_id: Sequence[Column | str], replicates: int = 2000, floor: int = 150,
) -> DataFrame:
    """Entities with interval, standard error, reliability and shrunk values."""
    return sh.shrink(bootstrap(scored, keys, "residual", row_id, replicates, floor=floor))


def reliability_report(scored: DataFrame, keys: Sequence[str], date: str, sequence: Sequence[str], floor: int = 150) -> DataFrame:
    """Both split-half designs, one row each."""
    rows = [sh.half_correlation(sh.split_half(scored, keys, "residual", date, sequence, design, floor), design)
            for design in ("alternate", "date")]
    return rows[0].unionByName(rows[1])


def stability_report(
    first: DataFrame, second: DataFrame, key: str, outcome: str, points: Column | str, floor: int = 100,
    floors: Sequence[int] = (50, 100, 150, 200, 250),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel, correlations at the floor, sweep over floors) of two scored periods."""
    lowest = min([floor, *floors])
    a, b = (ag.entity_scores(p, key, outcome, points, floor=lowest) for p in (first, second))
    joined = pn.panel(a, b, key, floor)
    metrics = ["oe_rate", "pct", "efg"]
    return joined, pn.panel_correlations(joined, metrics), pn.threshold_sweep(a, b, key, metrics, floors)


def fairness_report(board: DataFrame, profile: str = "profile", covariate: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(means per profile, omnibus test): weighted raw means beside shrunk means with their intervals."""
    raw = st.weighted_mean_test(board, [profile]).withColumnsRenamed({"n": "_n", "p": "p_weighted"})
    means = st.group_mean_ci(board, [profile], "rate_shrunk", "separable", covariate)
    return means.join(raw.drop("_n"), profile), st.kruskal(board, profile, "rate_shrunk")
