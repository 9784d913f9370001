"""Correlation, regression and group tests. Tables are reduced in Spark; tails are looked up on the result rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi2_p, normal_p, student_p, student_t95, student_two_sided
from ..session import materialise
from .ordered import Scan, running, value_bucket, value_ranks, with_ranks

Pairs = Sequence[tuple[str, str]]


# A column of which earlier ones leave less than this share of its variance is a combination of them.
COLLINEAR = 1e-9


def pearson(df: DataFrame, pairs: Pairs, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Correlation of each pair of columns over the rows that hold both, all pairs in one pass."""
    by = list(by)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(a, b).alias(f"_r{i}"), F.count_if(both).alias(f"_n{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_r{i}").alias("r"),
                                        F.col(f"_n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("x")
    wide = df.groupBy(*by).agg(*aggs)
    out = wide.select(*by, rows).select(*by, "x.a", "x.b", "x.r", "x.n")
    if not p_value:
        return out
    return out.withColumn("p", _correlation_p("r"))


def spearman(df: DataFrame, pairs: Pairs, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Rank correlation of each pair of numeric columns (ties share their average rank), over the rows that hold both.

    All pairs go through one contingency table: rows are counted by (pair, a, b) before anything is ordered, the distinct
    values of a side are ranked once, and the correlation weighs each cell by its count. Null and NaN are missing values.
    A pair (or label of ``by``) without a complete row has n 0 and no rho; one side without variation has no rho either.
    A table without rows gives none.
    """
    by = list(by)
    options = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        options.append(F.struct(F.lit(i).alias("_pair"), F.when(both, x).alias("_a"), F.when(both, y).alias("_b")))
    cells = df.select(*by, F.explode(F.array(*options)).alias("_x")).select(*by, "_x.*")
    cells = materialise(cells.groupBy(*by, "_pair", "_a", "_b").agg(F.count("_a").alias("_n")), "pair-cells")
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("_side"), F.col(c).alias("_value"))
                                for side, c in enumerate(("_a", "_b"))]))
    keys = [*by, "_pair", "_side"]
    values = cells.where("_n > 0").select(*by, "_pair", "_n", sides.alias("_x")).select(*by, "_pair", "_x.*", "_n")
    values = materialise(values.groupBy(*keys, "_value").agg(F.sum("_n").alias("_n")), "pair-values")
    ranks = running(value_bucket(values, "_value", "_bucket"), keys, "_bucket", ["_value"],
                    {"_below": Scan("sum", F.col("_n"), inclusive=False)})
    ranks = materialise(ranks.withColumn("_rank", F.col("_below") + (F.col("_n") + 1) / 2.0), "pair-ranks")
    placed = cells
    for side, value in enumerate(("_a", "_b")):
        names = {c: f"_k{side}_{i}" for i, c in enumerate([*by, "_pair", "_value"])}
        one = ranks.where(F.col("_side") == side).select(
            *[F.col(c).alias(k) for c, k in names.items()], F.col("_rank").alias(f"_r{side}"))
        on = [F.col(b).eqNullSafe(F.col(names[b])) for b in by]
        on += [F.col("_pair") == F.col(names["_pair"]), F.col(value) == F.col(names["_value"])]
        placed = placed.join(one, on, "left").drop(*names.values())
    n, x, y = F.col("_n").cast("double"), F.col("_r0"), F.col("_r1")
    sums = placed.groupBy(*by, "_pair").agg(
        F.sum("_n").alias("n"), F.sum(n * x * y).alias("_xy"), F.sum(n * x * x).alias("_xx"), F.sum(n * y * y).alias("_yy"),
        ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("_varied"))
    # The mean rank of either side is (n + 1) / 2.
    mid = F.col("n") * ((F.col("n") + 1) / 2.0) * ((F.col("n") + 1) / 2.0)
    rho = (F.col("_xy") - mid) / F.sqrt((F.col("_xx") - mid) * (F.col("_yy") - mid))
    named = [F.array(*[F.lit(pair[side]) for pair in pairs])[F.col("_pair")].alias(c) for side, c in enumerate("ab")]
    out = sums.select(*by, *named, F.when(F.col("_varied"), F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0))).alias("rho"), "n")
    return out.withColumn("p", _correlation_p("rho")) if p_value else out


def _correlation_p(r: str) -> Column:
    """Two-sided p-value of a correlation over n rows, by the t distribution."""
    dof = F.col("n") - 2
    return student_p(F.col(r) * F.sqrt(F.try_divide(dof, 1 - F.col(r) * F.col(r))), dof)


def weighted_mean_test(df: DataFrame, by: Sequence[str], rate: str = "oe_rate", se: str = "oe_se") -> DataFrame:
    """Inverse-variance mean per group, its standard error and a two-sided normal p-value against zero."""
    w = 1 / (F.col(se) * F.col(se))
    means = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(w * F.col(rate)) / F.sum(w)).alias("weighted_mean"),
        F.sqrt(1 / F.sum(w)).alias("weighted_se"))
    return means.withColumn("p", normal_p(F.col("weighted_mean") / F.col("weighted_se")))


def group_mean_ci(
    df: DataFrame, by: Sequence[str], value: str, separable: str | None = None, covariate: str | None = None,
) -> DataFrame:
    """Mean per group with a 95 % t interval and a one-sample p-value; groups of one are left out."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
            (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se")]
    if separable:
        aggs.append(F.avg(F.col(separable).cast("int")).alias("separable_share"))
    if covariate:
        aggs.append(F.avg(covariate).alias("mean_covariate"))
    means = df.groupBy(*by).agg(*aggs).where("n >= 2")
    dof = F.col("n") - 1
    half = student_t95(dof) * F.col("se")
    return means.withColumns({"ci_lo": F.col("mean") - half, "ci_hi": F.col("mean") + half,
                              "p": student_p(F.try_divide("mean", "se"), dof)})


def kruskal(df: DataFrame, by: str, value: str) -> DataFrame:
    """One row: tie-corrected rank statistic across groups, its degrees of freedom and p-value; null if all values are equal."""
    known = df.dropna(subset=[by, value])
    ranks = value_ranks(known, value).select(
        F.col(value).alias("_v"), (F.col("n_below") + (F.col("n_equal") + 1) / 2).alias("_rank"), "n_equal", "n_total")
    cells = known.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    groups = cells.join(ranks, F.col(value) == F.col("_v")).groupBy(by).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_rank")).alias("r"))
    spread = groups.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k"))
    t = F.col("n_equal").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("ties"), F.max("n_total").cast("double").alias("n"))
    row = spread.withColumn("_t", ties.select(F.struct("ties", "n")).scalar())
    n = F.col("_t.n")
    untied = 1 - F.try_divide(F.col("_t.ties"), n * n * n - n)
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), untied)
    return row.select(h.alias("h"), (F.col("k") - 1).alias("dof"), n.cast("long").alias("n")).withColumn(
        "p", chi2_p("h", "dof"))


def _moments(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """One row: count, means and the upper triangle of the covariance matrix of (xs, y)."""
    names = [*xs, y]
    known = df.dropna(subset=names)
    means = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)]
    cov = [F.covar_samp(names[i], names[j]).alias(f"_c{i}_{j}")
           for i in range(len(names)) for j in range(i, len(names))]
    size = len(names)
    flat = [F.col(f"_c{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)]
    return known.agg(F.count(F.lit(1)).alias("n"), *means, *cov).select(
        "n", F.array(*[F.col(f"_m{i}") for i in range(size)]).alias("means"), F.array(*flat).alias("cov"))


def _independent(cov: np.ndarray) -> list[int]:
    """Columns that are no linear combination of those before them, by elimination on the correlations."""
    scale = np.sqrt(np.diag(cov))
    left = np.divide(cov, np.outer(scale, scale), out=np.zeros_like(cov), where=np.outer(scale, scale) > 0)
    kept = []
    for i in range(len(cov)):
        if left[i, i] > COLLINEAR:
            left = left - np.outer(left[:, i], left[i]) / left[i, i]
            kept.append(i)
    return kept


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares with intercept: one row per term with coefficient, standard error, t, p, and the fit's R².

    Rows are reduced to means and covariances in one pass; only that one row is solved. A constant column, or one that
    earlier columns explain, is left out of the fit: its ``beta``, ``se``, ``t`` and ``p`` are null. Without a degree of
    freedom left, ``se``, ``t``, ``p`` and ``adj_r2`` are null; without two complete rows everything but ``n`` is.
    """
    xs = list(xs)
    k = len(xs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                n = int(row.n)
                beta, se, r2, adjusted, dof = np.full(k + 1, np.nan), np.full(k + 1, np.nan), np.nan, np.nan, 0
                if n > 1:
                    mean, cov = np.asarray(row.means, float), np.asarray(row.cov, float).reshape(k + 1, k + 1) * (n - 1)
                    kept = _independent(cov[:k, :k])
                    inverse = np.linalg.inv(cov[np.ix_(kept, kept)])
                    slope = inverse @ cov[kept, k]
                    at = [0, *[i + 1 for i in kept]]
                    beta[at] = np.r_[mean[k] - mean[kept] @ slope, slope]
                    dof = n - len(kept) - 1
                    unexplained = cov[k, k] - slope @ cov[kept, k]
                    r2 = 1 - unexplained / cov[k, k] if cov[k, k] > 0 else np.nan
                    if dof > 0:
                        s2 = max(unexplained, 0.0) / dof
                        se[at] = np.sqrt(s2 * np.r_[1 / n + mean[kept] @ inverse @ mean[kept], np.diag(inverse)])
                        adjusted = 1 - (1 - r2) * (n - 1) / dof
                t = np.divide(beta, se, out=np.full(k + 1, np.nan), where=se > 0)
                out = pd.DataFrame({
                    "term": ["intercept", *xs], "beta": beta, "se": se, "t": t,
                    "p": [student_two_sided(x, dof) if np.isfinite(x) else np.nan for x in t], "r2": r2, "adj_r2": adjusted, "n": n})
                yield out.astype(object).where(out.notna(), None)

    return _moments(df, y, xs).mapInPandas(
        solve, "term string, beta double, se double, t double, p double, r2 double, adj_r2 double, n long")


def residualise(
    df: DataFrame, y: str, xs: Sequence[str], n: str = "n", total: str | None = None,
) -> DataFrame:
    """Remove the linear effect of the covariates from ``y``, keep its mean, and rank totals before and after."""
    df = materialise(df, "entities")
    fit = ols(df, y, xs)
    coefficients = fit.agg(F.map_from_entries(F.collect_list(F.struct("term", "beta"))).alias("b")).scalar()
    means = df.dropna(subset=[y, *xs]).agg(F.avg(y)).scalar()
    fitted = F.col("_b")["intercept"]
    for x in xs:
        fitted = fitted + F.coalesce(F.col("_b")[x], F.lit(0.0)) * F.col(x)
    out = df.withColumns({"_b": coefficients, "_mean": means})
    out = out.withColumn("adjusted", F.col(y) - fitted + F.col("_mean")).drop("_b", "_mean")
    out = out.withColumn("total_before", F.col(total) if total else F.col(y) * F.col(n))
    out = out.withColumn("total_after", F.col("adjusted") * F.col(n))
    ranked = with_ranks(out, {"rank_before": ("total_before", "min", True), "rank_after": ("total_after", "min", True)},
                        store=False)
    return ranked.withColumn("shift", F.col("rank_before") - F.col("rank_after"))


def shift_summary(adjusted: DataFrame, top: int = 20) -> DataFrame:
    """One row: how far an adjustment moves the board overall and among its first places."""
    adjusted = materialise(adjusted, "adjusted")
    first = F.when(F.col("rank_before") <= top, F.abs("shift"))
    moved = adjusted.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("shift")).alias("mean_abs_shift"),
        F.avg(first).alias("top_mean_abs_shift"), F.max(first).alias("top_max_abs_shift"))
    rho = spearman(adjusted, [("total_before", "total_after")], p_value=False).select("rho").scalar()
    return moved.withColumn("spearman", rho)


def incremental_r2(df: DataFrame, y: str, base: Sequence[str], extra: str) -> DataFrame:
    """One row: adjusted R² without and with the extra predictor, its coefficient, and each predictor's own correlation."""
    known = df.dropna(subset=[y, *base, extra])
    small = ols(known, y, base).where("term = 'intercept'").select("adj_r2").scalar()
    full = ols(known, y, [*base, extra]).where(F.col("term") == extra)
    alone = pearson(known, [(extra, y), (base[0], y)], p_value=False)
    return full.select(
        "n", small.alias("adj_r2_base"), F.col("adj_r2").alias("adj_r2_full"),
        (F.col("adj_r2") - small).alias("gain"), F.col("beta").alias("extra_beta"), F.col("p").alias("extra_p"),
        alone.where(F.col("a") == extra).select("r").scalar().alias("r_extra"),
        alone.where(F.col("a") == base[0]).select("r").scalar().alias("r_base"))


def variance_share(entities: DataFrame, moments: DataFrame, residual_variance: Column | None = None) -> DataFrame:
    """One row: share of rate variance explained by expectation, share of residual-rate variance that is repeatable, and,
    if given, the residual variance of single events that both stand against."""
    r = F.corr("actual_rate", "expected_rate")
    return entities.agg(
        (r * r).alias("r2_expected"), F.corr("expected_rate", "oe_rate").alias("corr_expected_oe"),
        F.var_samp("oe_rate").alias("var_oe_rate"),
    ).withColumn("tau2", moments.select("tau2").scalar()).withColumns({
        "repeatable_share": F.try_divide("tau2", "var_oe_rate"),
        "residual_variance": F.lit(None).cast("double") if residual_variance is None else residual_variance})


def n_for_reliability(
    entities: DataFrame, residual_variance: Column, tau2: Column, levels: Sequence[float] = (0.5, 0.6, 0.7, 0.8),
    n: str = "n",
) -> DataFrame:
    """Events needed to reach each reliability, and the share of entities that have them."""
    sized = entities.select(F.col(n).alias("_n"), residual_variance.alias("_s2"), tau2.alias("_t2"))
    rows = sized.select("_n", "_s2", "_t2", F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("reliability"))
    r = F.col("reliability")
    need = F.round(F.try_divide(F.col("_s2") * r, (1 - r) * F.col("_t2"))).cast("long")
    return rows.withColumn("events_needed", need).groupBy("reliability", "events_needed").agg(
        F.avg((F.col("_n") >= F.col("events_needed")).cast("int")).alias("share_reaching"))
