"""Bootstrap by exact resampling with replacement: every replicate draws as many rows of an entity as it has.

The draws of a replicate come down a binary tree over the bits of the row hash. A node's draws split between its halves by
a binomial whose odds are the halves' row counts and whose seed is the node itself; a leaf, some thousand rows, draws
uniformly among its rows in hash order. So the counts of an entity always sum to its size, nothing depends on
how the rows are spread over tasks, and a large entity is resampled by many tasks that only share the counts along
their path from the root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hex_word, md5_hex
from ..session import materialise
from .resampling import _finish, _point

LEAF_ROWS = 1024
ROWS_PER_CHUNK = 1 << 17
ROW_BITS = 60
_CELLS = 1 << 18  # draws looked at together
_STEP = 0x9E3779B1  # an odd number: its multiples run through all 32-bit numbers


def scramble(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 32-bit numbers; plain enough to be repeated in SQL."""
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(2246822507)
    h ^= h >> np.uint32(13)
    h *= np.uint32(3266489909)
    h ^= h >> np.uint32(16)
    return h


def _numbered(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP)).astype(np.uint32)


def leaf_sums(x: np.ndarray, draws: np.ndarray, seed: int, prefix: int) -> np.ndarray:
    """Per replicate the sum of ``draws`` values drawn uniformly from ``x``."""
    start = scramble(np.array([seed], np.uint32) ^ scramble(np.array([prefix & 0xFFFFFFFF], np.uint32)))
    with np.errstate(over="ignore"):
        base = scramble(start + _numbered(len(draws)))
    most = int(draws.max(initial=0))
    even = bool((draws == most).all())
    column, out = scramble(_numbered(most)), np.zeros(len(draws))
    slab = max(1, _CELLS // max(most, 1))
    for i in range(0, len(draws), slab):
        h = scramble(base[i:i + slab, None] ^ column[None, :])
        place = h.astype(np.uint64)
        place *= np.uint64(len(x))
        place >>= np.uint64(32)
        value = x.take(place.view(np.int64))
        if not even:
            value[np.arange(most)[None, :] >= draws[i:i + slab, None]] = 0.0
        out[i:i + slab] = value.sum(axis=1)
    return out


def _split(draws: np.ndarray, left: int, total: int, seed: int, level: int, prefix: int) -> np.ndarray:
    """The draws that go to the left half of a node."""
    if left in (0, total):
        return draws if left else np.zeros_like(draws)
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, level, prefix]))).binomial(draws, left / total)


def chunk_sums(x: np.ndarray, row: np.ndarray, n: int, seed: int, replicates: int, bits: int, chunk: int,
               path: Sequence[tuple[int, int]]) -> np.ndarray:
    """Per replicate the sum over the draws inside one chunk: the node ``chunk`` at level ``bits``.

    ``path`` has (rows in the left half, rows) of the nodes above it, from the root down. Rows come in hash order.
    """
    depth, draws = max(0, (n - 1) // LEAF_ROWS).bit_length(), np.full(replicates, n, np.int64)
    for level, (left, total) in enumerate(path):
        some = _split(draws, left, total, seed, level, chunk >> (bits - level))
        draws = draws - some if chunk >> (bits - level - 1) & 1 else some
    out, todo = np.zeros(replicates), [(bits, chunk, 0, len(row), draws)]
    while todo:
        level, prefix, lo, hi, draws = todo.pop()
        if lo == hi:
            continue
        if level >= depth:
            out += leaf_sums(x[lo:hi], draws, seed, prefix)
            continue
        middle = lo + int(np.searchsorted(row[lo:hi], (2 * prefix + 1) << (ROW_BITS - level - 1)))
        some = _split(draws, middle - lo, hi - lo, seed, level, prefix)
        todo += [(level + 1, 2 * prefix, lo, middle, some), (level + 1, 2 * prefix + 1, middle, hi, draws - some)]
    return out


def _bits(n: Column, rows: int) -> Column:
    """How often a number of rows is halved until a part has ``rows`` or fewer."""
    parts = F.call_function("div", n - 1, F.lit(rows).cast("long"))
    return F.when(parts > 0, F.length(F.bin(parts))).otherwise(F.lit(0)).cast("int")


def _paths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per chunk of the entities that have several: ``_path``, its left and total row counts from the root down."""
    counted = rows.where("_bits > 0").groupBy(*keys, "_bits", "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    counted = materialise(counted, "chunk-rows")
    above = F.explode(F.sequence(F.lit(0), F.col("_bits"))).alias("_level")
    nodes = counted.select(*keys, "_bits", "_chunk", "_rows", above).withColumn(
        "_node", F.expr("shiftright(_chunk, _bits - _level)"))
    sums = materialise(nodes.groupBy(*keys, "_level", "_node").agg(F.sum("_rows").alias("_rows")), "node-rows")
    own = sums.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_level").alias("_ol"), F.col("_node").alias("_on"), F.col("_rows").alias("_total"))
    left = sums.select(*[F.col(k).alias(f"_l_{k}") for k in keys], F.col("_level").alias("_ll"), F.col("_node").alias("_ln"), F.col("_rows").alias("_left"))
    steps = nodes.where("_level < _bits").drop("_rows")
    steps = steps.join(own, [*(F.col(k) == F.col(f"_o_{k}") for k in keys), F.col("_level") == F.col("_ol"), F.col("_node") == F.col("_on")])
    steps = steps.join(left, [*(F.col(k) == F.col(f"_l_{k}") for k in keys), F.col("_level") + 1 == F.col("_ll"), F.col("_node") * 2 == F.col("_ln")], "left")
    # At most one step for each halving of an entity.
    step = F.struct("_level", F.coalesce("_left", F.lit(0)).alias("left"), F.col("_total").alias("total"))
    return steps.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(step)).alias("_steps")).select(
        *keys, "_chunk", F.flatten(F.transform("_steps", lambda s: F.array(s["left"], s["total"]))).alias("_path"))


def resample(
    df: DataFrame, keys: Sequence[str], value: str, row_id: Sequence[Column | str], replicates: int = 2000,
    seed: int = 42, floor: int = 150, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per entity: 95 % interval of the total, standard error of the rate, and whether the interval excludes zero.

    Columns as in ``resampling.bootstrap``, whose Poisson weights this replaces by draws of exactly the entity's size.
    The result is the same for every ``rows_per_chunk`` (at least ``LEAF_ROWS``), row order and partitioning. ``row_id``
    must tell an entity's rows apart: rows of one hash are never split between tasks. A null value counts as 0 drawn.
    """
    if rows_per_chunk < LEAF_ROWS:
        raise ValueError(f"rows_per_chunk must be at least {LEAF_ROWS}")
    keys = list(keys)
    point = _point(df, keys, value, floor)
    sizes = point.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col("n").alias("_n"),
                         hex_word(md5_hex(*keys, F.lit(seed))).alias("_seed"), _bits(F.col("n"), rows_per_chunk).alias("_bits"))
    row = F.conv(F.substring(md5_hex(*row_id), 1, ROW_BITS // 4), 16, 10).cast("long")
    slim = df.dropna(subset=keys).select(*keys, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"), row.alias("_row"))
    rows = slim.join(sizes, [F.col(k) == F.col(f"_p_{k}") for k in keys]).drop(*[f"_p_{k}" for k in keys])
    rows = rows.withColumn("_chunk", F.expr(f"shiftright(_row, {ROW_BITS} - _bits)"))
    rows = materialise(rows, "resample-rows")
    # One more row per chunk brings its path and comes first.
    heads = _paths(rows, keys)
    both = rows.withColumn("_path", F.lit(None).cast("array<long>")).unionByName(heads, allowMissingColumns=True)
    arranged = both.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", F.col("_path").isNull(), "_row", "_x")
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
                           T.StructField("se", T.DoubleType()), T.StructField("n", T.LongType()),
                           T.StructField("sums", T.ArrayType(T.DoubleType()))])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, current = [], None

        def flush() -> tuple:
            part = pd.concat(held)
            path = part["_path"].iloc[0]
            part = part if path is None else part.iloc[1:]
            n, own, bits = (int(part[c].iloc[0]) for c in ("_n", "_seed", "_bits"))
            steps = [] if path is None else list(zip(path[0::2].tolist(), path[1::2].tolist()))
            sums = chunk_sums(part["_x"].to_numpy(), part["_row"].to_numpy().astype(np.int64), n, own, replicates, bits,
                              int(current[-1]), steps)
            if bits:
                return (*current[:-1], None, None, None, n, sums.tolist())
            lo, hi = np.percentile(sums, [2.5, 97.5])
            return (*current[:-1], lo, hi, (sums / n).std(ddof=1), n, None)

        for pdf in batches:
            marks, out = pdf[[*keys, "_chunk"]], []
            starts = np.flatnonzero((marks != marks.shift()).any(axis=1).to_numpy())
            for a, b in zip(starts, np.r_[starts[1:], len(pdf)]):
                unit = tuple(marks.iloc[a])
                if unit != current:
                    if held:
                        out.append(flush())
                    held, current = [], unit
                held.append(pdf.iloc[a:b])
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([flush()] if held else [], columns=names)

    parts = arranged.mapInPandas(run, schema)
    by_replicate = parts.select(*keys, "lo", "hi", "se", "n", F.posexplode_outer("sums").alias("rep", "part")).groupBy(*keys, "rep").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("se").alias("se"), F.max("n").alias("n"), F.sum("part").alias("total"))
    spread = by_replicate.groupBy(*keys).agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("se").alias("se"),
        F.percentile("total", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.stddev_samp(F.col("total") / F.col("n")).alias("sd"),
    ).select(*keys, F.coalesce("lo", F.col("q")[0]).alias("total_lo"), F.coalesce("hi", F.col("q")[1]).alias("total_hi"),
             F.coalesce("se", "sd").alias("oe_se"))
    return _finish(point, spread, keys)
