"""Clusters of entity profiles, named by rule."""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Cluster names in board order, and the features that decide them.
NAMES = ("On-Ball Creators", "Catch-and-Shoot", "Mid-Range Scorers", "Interior Finishers")
# Profiles that one task of a pass holds at most.
ROWS_PER_TASK = 25_000
STYLE_FEATURES = ("avg_shot_dist", "avg_def_dist", "avg_touch_time", "avg_dribbles", "three_rate")


def name_clusters(centroids: DataFrame, lowest: tuple[str, str], highest: Sequence[tuple[str, str]], rest: str,
                  cluster: str = "cluster") -> DataFrame:
    """Name clusters by rank of their centroids: the lowest of one feature, then the highest of others among those left."""
    first = centroids.agg(F.min_by(cluster, F.struct(F.col(lowest[0]), F.col(cluster)))).scalar()
    taken = [(first, lowest[1])]
    for feature, name in highest:
        left = centroids
        for found, _ in taken:
            left = left.where(F.col(cluster) != found)
        taken.append((left.agg(F.min_by(cluster, F.struct(-F.col(feature), F.col(cluster)))).scalar(), name))
    label = F.lit(rest)
    for found, name in reversed(taken):
        label = F.when(F.col(cluster) == found, F.lit(name)).otherwise(label)
    return centroids.select(cluster, label.alias("profile"))


def style_names(centroids: DataFrame) -> DataFrame:
    """The rule for style profiles: nearest shots, then most dribbles, then most threes, then the remaining cluster."""
    return name_clusters(centroids, ("avg_shot_dist", NAMES[3]),
                         [("avg_dribbles", NAMES[0]), ("three_rate", NAMES[1])], NAMES[2])


def cluster_profiles(
    profiles: DataFrame, features: Sequence[str], k: int = 4, starts: int = 10, seed: int = 42, out: str = "cluster",
) -> DataFrame:
    """K-means on standardised features, the best of several starts.

    The scaler's sample deviation differs from the population one by the same factor in every feature, which leaves the
    clusters as they are. The starts run side by side: a pass over the profiles is short, and a start makes hundreds. The
    files that hold the profiles follow from the events, so the passes go over profiles dealt by their number.
    """
    stored = materialise(profiles.dropna(subset=list(features)), "profiles")
    assembled = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(stored)
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(assembled).transform(assembled)
    dealt = scaled.select("features").repartition(max(1, math.ceil(stored.count() / ROWS_PER_TASK)))

    def fit(start: int):
        return KMeans(k=k, seed=seed + start, maxIter=300, tol=1e-4).fit(dealt)

    with ThreadPool(starts) as pool:
        models = pool.map(inheritable_thread_target(profiles.sparkSession)(fit), range(starts))
    best = min(models, key=lambda model: model.summary.trainingCost)
    return best.setPredictionCol(out).transform(scaled).select(*profiles.columns, out)


def centroids(clustered: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    return clustered.groupBy(cluster).agg(*[F.avg(f).alias(f) for f in features])
