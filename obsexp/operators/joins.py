"""Joins on equality, with coverage checks, and the constrained pair search.

No side is broadcast by hint: the planner broadcasts a side whose size it knows or has measured to be small, and splits
skewed partitions of the sort-merge join otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise_key
from ..session import materialise
from .ordered import Scan, running

@dataclass(frozen=True)
class Dimension:
    """A lookup table: its (fact key, own key) pairs and the columns it adds."""

    table: DataFrame
    keys: Sequence[tuple[str, str]]
    columns: Sequence[str]


def enrich(fact: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Left-join each dimension, dropping its own keys. Duplicate dimension rows are removed first; null keys match."""
    out = fact
    for dim in dims:
        own = {k: f"_dim_{k}" for _, k in dim.keys}
        table = dim.table.select(*[F.col(k).alias(a) for k, a in own.items()], *dim.columns).distinct()
        on = [F.col(fk).eqNullSafe(F.col(own[dk])) for fk, dk in dim.keys]
        out = out.join(table, on, "left").drop(*own.values())
    return out


def join_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row of counts that decide whether a join keeps its promises."""
    on = list(on)
    lk = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l"))
    rk = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_r"))
    both = lk.join(rk, on, "full_outer")
    return both.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0)).alias("joined_rows"),
        F.coalesce(F.sum(F.when(F.col("_r").isNull(), F.col("_l"))), F.lit(0)).alias("left_unmatched"),
        F.count_if(F.col("_l") > 1).alias("left_repeated_keys"),
        F.count_if(F.col("_r") > 1).alias("right_repeated_keys"),
    )


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], expect: Sequence[str] = ("same_rows",)) -> DataFrame:
    """Inner join that first proves its expectations in one counting job.

    ``same_rows``: every left row meets exactly one right row; ``unique_left``, ``unique_right``: keys do not repeat;
    ``covered``: every left key is found.
    """
    report = join_report(left, right, on).first()
    broken = {
        "same_rows": report.joined_rows != report.left_rows or report.left_unmatched > 0,
        "unique_left": report.left_repeated_keys > 0,
        "unique_right": report.right_repeated_keys > 0,
        "covered": report.left_unmatched > 0,
    }
    failed = [name for name in expect if broken[name]]
    if failed:
        raise ValueError(f"join on {list(on)} breaks {failed}: {report.asDict()}")
    return left.join(right, list(on), "inner")


def match_on_key(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str, fixes: Mapping[str, str] | None = None,
    verify: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): inner join on normalised names, and the left keys the right side lacks."""
    lk = left.withColumn("key", normalise_key(left_name, fixes))
    rk = right.withColumn("key", normalise_key(right_name, fixes))
    if verify:
        report = join_report(lk, rk, ["key"]).first()
        if report.left_repeated_keys or report.right_repeated_keys:
            raise ValueError(f"match keys must be unique on both sides: {report.asDict()}")
    clash = [c for c in right.columns if c in left.columns]
    renamed = rk.withColumnsRenamed({c: f"{c}_right" for c in clash})
    return lk.join(renamed, "key", "inner"), lk.select("key").distinct().join(rk.select("key"), "key", "left_anti")


def compare_buckets(a: DataFrame, b: DataFrame, bucket: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Full outer join of two bucket tables; value columns take the suffixes."""
    def tag(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnsRenamed({c: c + suffix for c in df.columns if c != bucket})
    return tag(a, suffixes[0]).join(tag(b, suffixes[1]), bucket, "full_outer")


def mean_gap(compared: DataFrame, a: str, b: str) -> DataFrame:
    """Mean absolute difference of two columns over the buckets both sides hold."""
    return compared.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_gap"))


def map_label(df: DataFrame, col: str, mapping: Mapping, out: str, default: str | None = None) -> DataFrame:
    """Replace codes by names from a small mapping; codes without a name take the default."""
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(col)), F.lit(default)))


def best_pair(
    df: DataFrame, entity: str, rate: str, score: str, tolerance: float, eligible: Column,
) -> DataFrame:
    """The two eligible entities whose rates differ by at most the tolerance and whose scores differ most.

    No pairs are formed. Rates are cut into blocks one tolerance wide; the entities within reach of a rate are then
    its own block, the end of the block below and the start of the block above, each a running minimum.
    """
    chosen = materialise(df.where(eligible).select(entity, rate, score).dropna(subset=[rate, score]), "eligible")
    item = F.struct(F.col(score).alias("score"), F.col(entity).alias("entity"), F.col(rate).alias("rate"))
    mirrored = F.struct((-F.col(score)).alias("neg"), F.col(entity).alias("entity"), F.col(rate).alias("rate"))
    points = chosen.groupBy(F.col(rate).alias("at")).agg(F.min(item).alias("low"), F.min(mirrored).alias("high"))
    tol = F.lit(float(tolerance))
    points = points.withColumn("block", F.floor(F.col("at") / tol))
    blocks = materialise(points.groupBy("block").agg(F.min("low").alias("own_low")), "rate-blocks")
    # An entity that is the lowest of its own block is paired with the next one there.
    rest = chosen.withColumn("block", F.floor(F.col(rate) / tol)).join(blocks, "block").where(
        F.col(entity) != F.col("own_low.entity")).groupBy("block").agg(F.min(item).alias("own_second"))
    blocks = blocks.join(rest, "block", "left")

    def reach(step: int) -> DataFrame:
        """Lowest score in the neighbouring block on one side, up to the tolerance."""
        asked = points.select((F.col("block") + step).alias("block"), (F.col("at") + step * tol).alias("pos"),
                              F.lit(step).alias("side"), F.lit(None).cast(points.schema["low"].dataType).alias("low"),
                              F.col("at").alias("asker"))
        held = points.select("block", F.col("at").alias("pos"), F.lit(0).alias("side"), "low",
                             F.lit(None).cast("double").alias("asker"))
        both = asked.unionByName(held).withColumn("chunk", F.floor(F.col("pos") / tol * 64))
        scanned = running(both, ["block"], "chunk", ["pos", "side", "asker"],
                          {"seen": Scan("min", F.col("low"), reverse=step < 0)})
        return scanned.where(F.col("asker").isNotNull()).select("asker", F.col("seen").alias(f"low_{step + 1}"))

    found = points.join(blocks, "block")
    for step in (-1, 1):
        side = reach(step)
        found = found.join(side, found["at"] == side["asker"], "left").drop("asker")
    own = F.when(F.col("own_low.entity") != F.col("high.entity"), F.col("own_low")).otherwise(F.col("own_second"))
    best = found.select(F.col("high").alias("h"), F.least(own, "low_0", "low_2").alias("l")).select(
        F.col("h.entity").alias("entity_high"), F.col("l.entity").alias("entity_low"),
        (-F.col("h.neg")).alias("score_high"), F.col("l.score").alias("score_low"),
        F.col("h.rate").alias("rate_high"), F.col("l.rate").alias("rate_low"),
        (-F.col("h.neg") - F.col("l.score")).alias("gap"),
    )
    return best.where("entity_high <> entity_low").orderBy(F.desc("gap"), "entity_high", "entity_low").limit(1)
