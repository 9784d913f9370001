"""Expectation models on Spark ML, fitted so that no event is scored by a model that saw its group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression  # noqa: F401
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .boosting import Bins, BoostedTrees, Settings, find_bins, spread
from .cleaning import OUTCOME_COLUMNS
from .folds import base_rate, group_holdout
from .scores import scorecard

SEED = 42
# Training rows that one task of a tree fit counts at most.
ROWS_PER_TASK = 10_000_000


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """The most frequent value of each column (the smallest on ties): one row per column, from one aggregate."""
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    counts = df.select(pairs.alias("x")).where("x.v is not null").groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    return {**dict.fromkeys(cols, "missing"), **{row.c: row.v for row in modes.collect()}}


class FeaturePipeline:
    """Imputation, optional scaling and one-hot encoding; refuses columns that describe the outcome."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], scale: bool = False,
                 forbidden: Iterable[str] = OUTCOME_COLUMNS):
        leaked = sorted(set(forbidden) & {*numeric, *categorical})
        if leaked:
            raise ValueError(f"outcome columns cannot be features: {leaked}")
        self.numeric, self.categorical, self.scale = list(numeric), list(categorical), scale

    def prepare(self, df: DataFrame, modes: dict[str, str]) -> DataFrame:
        """Doubles for numeric columns, filled text for categorical ones."""
        out = df.withColumns({f"_num_{c}": F.col(c).cast("double") for c in self.numeric})
        return out.withColumns({f"_cat_{c}": F.coalesce(F.col(c).cast("string"), F.lit(modes[c]))
                                for c in self.categorical}) if self.categorical else out

    def stages(self) -> list[Estimator | Transformer]:
        numbers = [f"_num_{c}" for c in self.numeric]
        filled = [f"_imp_{c}" for c in self.numeric]
        stages: list = [Imputer(strategy="median", inputCols=numbers, outputCols=filled),
                        VectorAssembler(inputCols=filled, outputCol="_numbers")]
        parts = ["_numbers"]
        if self.scale:
            stages.append(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True))
            parts = ["_scaled"]
        if self.categorical:
            codes = [f"_code_{c}" for c in self.categorical]
            hot = [f"_hot_{c}" for c in self.categorical]
            stages += [StringIndexer(inputCols=[f"_cat_{c}" for c in self.categorical], outputCols=codes,
                                     handleInvalid="keep"),
                       OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep")]
            parts += hot
        return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


class ExpectationModel:
    """A fitted feature pipeline and classifier; ``score`` adds the expected probability."""

    def __init__(self, features: FeaturePipeline, modes: dict[str, str], fitted: PipelineModel):
        self.features, self.modes, self.fitted = features, modes, fitted

    def score(self, df: DataFrame, out: str = "expected") -> DataFrame:
        scored = self.fitted.transform(self.features.prepare(df, self.modes))
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def fit_model(train: DataFrame, outcome: str, features: FeaturePipeline, classifier: Estimator) -> ExpectationModel:
    modes = most_frequent(train, features.categorical)
    prepared = features.prepare(train, modes).withColumn("label", F.col(outcome).cast("double"))
    fitted = []
    for stage in features.stages():
        fitted.append(stage.fit(prepared) if isinstance(stage, Estimator) else stage)
        prepared = fitted[-1].transform(prepared)
    last = Pipeline(stages=[classifier]).fit(prepared.select("label", "features"))
    return ExpectationModel(features, modes, PipelineModel([*fitted, last]))


class BoostedModel:
    """Fitted trees and the bins they split; ``score`` adds the expected probability."""

    def __init__(self, bins: Bins, fitted: PipelineModel):
        self.bins, self.fitted = bins, fitted

    def score(self, df: DataFrame, out: str = "expected") -> DataFrame:
        return self.fitted.transform(self.bins.coded(df)).select(*df.columns, F.col("probability").alias(out))


def fit_logistic(train: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str], max_iter: int = 1000):
    """L2 logistic regression on scaled inputs; the penalty is that of a unit-strength ridge on the summed loss.

    Fitted as one fold of ``cross_fit_logistic``: numbers are filled with exact medians, and rows without an outcome are
    not learned from.
    """
    from .crossfit import LogisticModel

    return LogisticModel(train, outcome, numeric, categorical, max_iter)


def fit_boosted(train: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str],
                max_iter: int = 300, step_size: float = 0.05, seed: int = SEED) -> BoostedModel:
    """Boosted trees of depth 5 with row and column sampling. Fewer rounds need a larger step.

    Rows become codes of bins, which are counted in one pass; the trees grow on the counts. Numbers are filled with the
    median, texts with the most frequent value; rows without an outcome are not learned from.
    """
    FeaturePipeline(numeric, categorical)  # refuses columns that describe the outcome
    known = train.where(F.col(outcome).isNotNull()).select(*dict.fromkeys([*numeric, *categorical, outcome]))
    bins = find_bins(known, numeric, categorical)
    rows = bins.coded(known).select(F.col(outcome).cast("double").alias("label"), "features")
    trees = BoostedTrees(bins.sizes(), len(bins.numeric), Settings(max_iter, step_size, seed))
    return BoostedModel(bins, Pipeline(stages=[trees]).fit(spread(rows, ROWS_PER_TASK)))


def cross_fit(
    df: DataFrame, fit: Callable[[DataFrame], ExpectationModel], fold: str = "fold", k: int = 5, out: str = "expected",
    check: bool = True, parallel: int = 5,
) -> DataFrame:
    """Score every row with a model fitted on the other folds.

    The features are written to the shared folder once, one directory per fold: the k fits read them instead of
    recomputing them, and a fit skips the files of the fold it leaves out. The fits run side by side, up to ``parallel``.
    """
    stored = materialise(df, "cross-fit", [fold])

    def scored_by_others(i: int) -> DataFrame:
        return fit(stored.where(F.col(fold) != i)).score(stored.where(F.col(fold) == i), out)

    with ThreadPool(min(parallel, k)) as pool:
        scored, *others = pool.map(inheritable_thread_target(df.sparkSession)(scored_by_others), range(k))
    for part in others:
        scored = scored.unionByName(part)
    if check:
        left_out = stored.where(F.col(fold).isNull() | ~F.col(fold).between(0, k - 1)).limit(1).count()
        if left_out:
            raise ValueError("every row must be scored out of fold")
    return scored


def score_with(model: ExpectationModel, df: DataFrame, out: str = "expected") -> DataFrame:
    """Apply a model fitted on one period to another."""
    return model.score(df, out)


def holdout_metrics(
    df: DataFrame, group: str, outcome: str, models: dict[str, Callable[[DataFrame], ExpectationModel]],
    share: float = 0.2, seed: int = SEED,
) -> DataFrame:
    """Scorecard of each model and of the base rate on held-out groups."""
    flagged = materialise(group_holdout(df, group, share, seed), "hold-out")
    test = base_rate(flagged, outcome, ~F.col("is_test")).where("is_test")
    names = ["base_rate"]
    for name, fit in models.items():
        test = fit(flagged.where(~F.col("is_test"))).score(test, name)
        names.append(name)
    n_train = flagged.where(~F.col("is_test")).agg(F.count(F.lit(1))).scalar()
    return scorecard(test, outcome, names).withColumnRenamed("n", "n_test").withColumn("n_train", n_train)
