"""Ordered computations that never put one key, or the whole table, into one task.

A window partitioned by an entity sends all of that entity's rows to one task, and a window without keys sends
everything there. The functions below cut each key into chunks along the order (days, hours, value buckets), scan
inside a chunk, reduce every chunk to one summary row, scan the summaries, and add the carried part back. Rows move
once, hashed by (key, chunk); only summaries meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

# Rows that one chunk of an ordered scan should hold at most, ties aside.
CHUNK_ROWS = 50_000
# Edges of one cut; beyond that many chunks every chunk is cut again.
MAX_EDGES = 4096


def _cols(items: Sequence[Column | str]) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


@dataclass(frozen=True)
class Scan:
    """One running aggregate: sum, count, min, max or last (the latest non-null value).

    ``reverse`` runs from the end, ``inclusive=False`` leaves the current row out, and ``order`` replaces the order of
    the call for this scan.
    """

    agg: str
    expr: Column
    reverse: bool = False
    inclusive: bool = True
    order: Sequence[str] | None = None

    def over(self, expr: Column, window) -> Column:
        if self.agg == "last":
            return F.last(expr, ignorenulls=True).over(window)
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[self.agg](expr).over(window)

    def summary(self, order: Sequence[str]) -> Column:
        if self.agg == "last":
            place = F.when(self.expr.isNotNull(), F.struct(*_cols(order)))
            return (F.min_by if self.reverse else F.max_by)(self.expr, place)
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[self.agg](self.expr)

    def carry(self, summary: Column, window) -> Column:
        if self.agg == "count":
            return F.sum(summary).over(window)
        return self.over(summary, window)

    def merge(self, local: Column, carried: Column) -> Column:
        if self.agg in ("sum", "count"):
            return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        if self.agg == "min":
            return F.least(local, carried)
        if self.agg == "max":
            return F.greatest(local, carried)
        return F.coalesce(local, carried)


def running(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], outputs: Mapping[str, Scan],
) -> DataFrame:
    """Running aggregates per key along ``order``, computed chunk by chunk.

    ``chunk`` must never decrease along ``order`` within a key, and ``order`` must be unique within a key for a fixed
    result. All scans share one shuffle of the rows and one table of chunk summaries. ``value_bucket`` makes chunks that
    hold equal shares of the table whatever the density; a day or a clock interval will do where density is bounded.
    """
    keys, names = list(keys), list(outputs)
    scans = [outputs[n] for n in names]

    def window(partition: Sequence[str], by: Sequence[str], reverse: bool, end: int):
        arranged = [c.desc() if reverse else c.asc() for c in _cols(by)]
        return Window.partitionBy(*partition).orderBy(*arranged).rowsBetween(Window.unboundedPreceding, end)

    summaries = df.groupBy(*keys, chunk).agg(
        *[s.summary(s.order or order).alias(f"_s_{n}") for n, s in zip(names, scans)])
    carried = summaries.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*keys, chunk]],
        *[s.carry(F.col(f"_s_{n}"), window(keys, [chunk], s.reverse, -1)).alias(f"_c_{n}")
          for n, s in zip(names, scans)],
    )
    local = df.select("*", *[
        s.over(s.expr, window([*keys, chunk], s.order or order, s.reverse, 0 if s.inclusive else -1)).alias(f"_l_{n}")
        for n, s in zip(names, scans)])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, chunk]]
    return local.join(carried, on, "left").select(
        *df.columns, *[s.merge(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, s in zip(names, scans)])


def row_numbers(df: DataFrame, keys, chunk: str, order, out: str = "row_number") -> DataFrame:
    """1-based position of each row within its key."""
    return running(df, keys, chunk, order, {out: Scan("count", F.lit(1))})


def neighbours(
    df: DataFrame, keys, chunk: str, order, previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Values of the row before and the row after, across chunk borders."""
    scans, wanted = {}, []
    for fields, reverse, tag in ((previous, False, "_prev"), (following, True, "_next")):
        if fields:
            packed = F.struct(*[e.alias(n) for n, e in fields.items()])
            scans[tag] = Scan("last", packed, reverse=reverse, inclusive=False)
            wanted += [F.col(tag)[n].alias(n) for n in fields]
    return running(df, keys, chunk, order, scans).select(*df.columns, *wanted)


def parity(df: DataFrame, keys, chunk: str, order, out: str = "half") -> DataFrame:
    """0 for the first, third, fifth … row of a key, 1 for the others."""
    numbered = row_numbers(df, keys, chunk, order, "_position")
    return numbered.withColumn(out, ((F.col("_position") - 1) % 2).cast("int")).drop("_position")


def _edges(value: str, size: int) -> Column:
    """size - 1 approximate quantiles, close enough for parts that differ little in size."""
    levels = [i / size for i in range(1, size)]
    return F.percentile_approx(F.col(value).cast("double"), levels, max(10_000, 20 * size))


def _place(edges: Column, value: str, size: int) -> Column:
    """How many edges lie below the value, by halving."""
    steps = F.array(*[F.lit(2**b) for b in range(size.bit_length() - 2, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.element_at(edges, at + step) < F.col(value).cast("double"), at + step).otherwise(at))


def value_bucket(df: DataFrame, value: str, out: str, rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """Order-keeping chunk number of a numeric column, for chunks of about ``rows_per_chunk`` rows of ``df``.

    The number of chunks follows from the counted rows, and the edges from their quantiles, so that rows crowded into a
    short stretch are cut there. Equal values share a chunk. ``df`` is counted first and should be stored. Edges come as
    one small row, or, above ``MAX_EDGES`` chunks, as one row per coarse chunk, which is then cut again.
    """
    chunks = max(1, math.ceil(df.count() / rows_per_chunk))
    size = min(MAX_EDGES, 2 ** math.ceil(math.log2(chunks)))
    if size == 1:
        return df.withColumn(out, F.lit(0))
    tagged = df.withColumn("_edges", df.agg(_edges(value, size).alias("e")).scalar())
    tagged = tagged.withColumn(out, _place(F.col("_edges"), value, size)).drop("_edges")
    if chunks <= size:
        return tagged
    fine = min(MAX_EDGES, 2 ** math.ceil(math.log2(chunks / size)))
    cuts = tagged.groupBy(F.col(out).alias("_coarse")).agg(_edges(value, fine).alias("_edges"))
    cut = tagged.join(cuts, F.col(out) == F.col("_coarse"), "left")
    return cut.withColumn(out, F.col(out) * fine + _place(F.col("_edges"), value, fine)).drop("_edges", "_coarse")


def value_ranks(
    df: DataFrame, value: str, weight: Mapping[str, Column] | None = None, by: Sequence[str] = (), store: bool = True,
) -> DataFrame:
    """One row per distinct value: ``n_equal``, ``n_below`` and ``n_total``, for ranks, quantiles and AUC.

    Rows are counted by value before anything is ordered, so a value held by a third of the table is one row.
    ``weight`` adds further sums per distinct value; ``by`` ranks inside each label of a few (periods, floors). The
    counts are read several times, so they are stored first; ``store=False`` is for a table that is stored already.
    """
    weight, by = weight or {}, list(by)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n_equal"), *[F.sum(e).alias(n) for n, e in weight.items()])
    )
    counts = materialise(counts, "value-counts") if store else counts
    ranked = running(value_bucket(counts, value, "_bucket"), by, "_bucket", [value], {
        "n_below": Scan("sum", F.col("n_equal"), inclusive=False),
        "_n_above": Scan("sum", F.col("n_equal"), reverse=True, inclusive=False),
    })
    total = F.col("n_below") + F.col("n_equal") + F.col("_n_above")
    return ranked.withColumns({"n_below": F.col("n_below").cast("long"), "n_total": total.cast("long")}).drop(
        "_bucket", "_n_above")


def _rank_expr(method: str, descending: bool) -> Column:
    below = F.col("n_total") - F.col("n_below") - F.col("n_equal") if descending else F.col("n_below")
    if method == "min":
        return below + 1
    average = below + (F.col("n_equal") + 1) / F.lit(2.0)
    if method == "average":
        return average
    if method == "percent":
        return average / F.col("n_total")
    raise ValueError(f"unknown rank method {method!r}")


def with_ranks(
    df: DataFrame, ranks: Mapping[str, tuple[str, str, bool]], by: Sequence[str] = (), store: bool = True,
) -> DataFrame:
    """Add ranks: ``{out: (column, 'min' | 'average' | 'percent', descending)}``. A missing value has no rank.

    The table is stored first, since every rank reads it again; ``store=False`` is for one that is stored already.
    """
    out = df = materialise(df, "ranked") if store else df
    by_value: dict[str, dict[str, tuple[str, bool]]] = {}
    for name, (value, method, descending) in ranks.items():
        by_value.setdefault(value, {})[name] = (method, descending)
    for value, wanted in by_value.items():
        keys = [*by, value]
        table = value_ranks(df, value, by=by, store=False).select(
            *[F.col(k).alias(f"_r_{k}") for k in keys], *[_rank_expr(m, d).alias(n) for n, (m, d) in wanted.items()]
        )
        on = [F.col(b).eqNullSafe(F.col(f"_r_{b}")) for b in by] + [F.col(value) == F.col(f"_r_{value}")]
        out = out.join(table, on, "left").drop(*[f"_r_{k}" for k in keys])
    return out


def global_position(df: DataFrame, value: str, tie_hex: str, out: str = "position") -> DataFrame:
    """1-based position in the order (value, tie text), where the tie text is a hex digest.

    Rows sharing a value are spread by leading digits of the digest, as many as the counted rows need. ``df`` is read
    several times and should be stored.
    """
    digits = max(1, math.ceil(math.log(max(1, df.count() / CHUNK_ROWS), 16)))
    tagged = df.withColumn("_prefix", F.substring(tie_hex, 1, digits))
    counts = tagged.groupBy(value, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(value).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_in_value", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    starts = value_ranks(tagged, value, store=False).select(F.col(value).alias("_v"), "n_below")
    offsets = offsets.join(starts, F.col(value) == F.col("_v")).select(
        "_v", F.col("_prefix").alias("_p"), (F.col("n_below") + F.col("_in_value")).alias("_offset")
    )
    local = F.row_number().over(Window.partitionBy(value, "_prefix").orderBy(tie_hex))
    numbered = tagged.withColumn("_local", local)
    joined = numbered.join(offsets, (F.col(value) == F.col("_v")) & (F.col("_prefix") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_offset") + F.col("_local")).cast("long").alias(out))


def exact_quantiles(
    df: DataFrame, value: str, levels: Sequence[float], out: str = "quantiles", store: bool = True,
) -> DataFrame:
    """One row holding the linearly interpolated quantiles of a column, exact at any size."""
    return quantiles_of(value_ranks(df, value, store=store), value, levels, out)


def quantiles_of(ranks: DataFrame, value: str, levels: Sequence[float], out: str = "quantiles") -> DataFrame:
    """The same from a table of ranked distinct values."""
    reach = F.col("n_below") + F.col("n_equal")
    picks = []
    for i, level in enumerate(levels):
        at = (F.col("n_total") - 1) * F.lit(float(level))
        picks.append(F.min(F.when(reach > F.floor(at), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(reach > F.ceil(at), F.col(value))).alias(f"_hi{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
    row = ranks.agg(*picks)
    return row.select(F.array(*[
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}") for i in range(len(levels))
    ]).alias(out))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; each task keeps one row per key before rows move."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first ``k`` rows in the given order."""
    return df.orderBy(*order).limit(k)


def key_difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not hold."""
    return left.select(*on).distinct().join(right.select(*on), list(on), "left_anti")
