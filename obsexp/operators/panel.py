"""Two-period panels and the floor sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .association import pearson, spearman


def panel(a: DataFrame, b: DataFrame, key: str, floor: int = 0, n: str = "n", suffixes: tuple[str, str] = ("_a", "_b"),
          shared: Sequence[str] = ()) -> DataFrame:
    """Entities that clear the floor in both periods, one row each. ``shared`` columns come from the first period only."""
    def side(df: DataFrame, suffix: str, keep: Sequence[str]) -> DataFrame:
        drop = [c for c in shared if c not in keep and c in df.columns]
        return df.where(F.col(n) >= floor).drop(*drop).withColumnsRenamed(
            {c: c + suffix for c in df.columns if c != key and c not in shared})
    return side(a, suffixes[0], shared).join(side(b, suffixes[1], ()), key, "inner")


def panel_correlations(
    joined: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), suffixes: tuple[str, str] = ("_a", "_b"),
    p_value: bool = True,
) -> DataFrame:
    """Period-to-period correlation of each metric: n, Pearson r (and p), Spearman rho."""
    joined = materialise(joined, "panel")
    pairs = [(m + suffixes[0], m + suffixes[1]) for m in metrics]
    names = F.create_map(*[F.lit(x) for m, (a, _) in zip(metrics, pairs) for x in (a, m)])
    r = pearson(joined, pairs, by, p_value).withColumn("metric", names[F.col("a")]).drop("a", "b")
    rho = spearman(joined, pairs, by, p_value=False).select(*by, names[F.col("a")].alias("metric"), "rho")
    return r.join(rho, [*by, "metric"], "left")


def threshold_sweep(
    a: DataFrame, b: DataFrame, key: str, metrics: Sequence[str], floors: Sequence[int] = (50, 100, 150, 200, 250),
    n: str = "n", p_value: bool = True,
) -> DataFrame:
    """Period-to-period correlations at every floor, from one join: an entity counts at each floor it clears twice."""
    joined = panel(a, b, key, min(floors), n)
    cleared = F.filter(F.array(*[F.lit(f) for f in floors]), lambda f: F.least(f"{n}_a", f"{n}_b") >= f)
    return panel_correlations(joined.withColumn("floor", F.explode(cleared)), metrics, ["floor"], p_value=p_value)
