"""Bootstrap intervals per entity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from ..functions.hashing import md5_hex, poisson1_hex, poisson1_thresholds

ROWS_PER_CHUNK = 100_000
_SLAB = 1 << 20  # draws looked at together


def _point(df: DataFrame, keys: Sequence[str], value: str, floor: int) -> DataFrame:
    """Point estimates of the qualifying entities. Stored: the resampling reads their sizes, the result their values, and
    a stored table's size is known to the planner, which broadcasts it only if it is small."""
    point = df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("oe_total"), F.avg(value).alias("oe_rate"),
    ).where(F.col("n") >= floor)
    return materialise(point, "point-estimates")


def _finish(point: DataFrame, spread: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = point.join(spread.withColumnsRenamed({k: f"_k_{k}" for k in keys}),
                        [F.col(k) == F.col(f"_k_{k}") for k in keys])
    return joined.select(*keys, "n", "oe_total", "total_lo", "total_hi", "oe_rate", "oe_se").withColumn(
        "separable", (F.col("total_lo") > 0) | (F.col("total_hi") < 0))


def _arranged(df: DataFrame, point: DataFrame, keys: list[str], value: str, row: Column, rows_per_chunk: int) -> DataFrame:
    """Slim rows of the qualifying entities, hashed by (entity, chunk): ``_x``, ``_row``, ``_n`` and ``_chunk``.

    An entity has as many chunks as its size needs, so the largest is spread like the rest.
    """
    sizes = point.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col("n").alias("_n"))
    slim = df.dropna(subset=keys).select(*keys, F.col(value).cast("double").alias("_x"), row.alias("_row"))
    chunk = F.pmod(F.xxhash64("_row"), F.ceil(F.col("_n") / F.lit(rows_per_chunk)))
    rows = slim.join(sizes, [F.col(k) == F.col(f"_p_{k}") for k in keys])
    return rows.select(*keys, "_x", "_row", "_n", chunk.alias("_chunk")).repartition(*keys, "_chunk")


def hash_bootstrap(
    df: DataFrame, keys: Sequence[str], value: str, row_id: Sequence[Column | str], replicates: int = 20,
    seed: int = 42, floor: int = 150, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Poisson bootstrap with weights from md5 of (row, replicate), reproducible in any SQL engine.

    Every digest serves four replicates, whose sums are columns of one aggregate per entity, chunk and digest; only
    those sums are combined across chunks.
    """
    keys = list(keys)
    point = _point(df, keys, value, floor)
    rows = _arranged(df, point, keys, value, md5_hex(*row_id), rows_per_chunk)
    digests = F.explode(F.sequence(F.lit(0), F.lit((replicates + 3) // 4 - 1))).alias("_q")
    drawn = rows.select(*keys, "_chunk", "_n", "_x", "_row", digests).withColumn("_hex", md5_hex("_row", "_q", F.lit(seed)))
    sums, unpacked = [], []
    for i in range(4):
        weight = poisson1_hex(F.substring("_hex", 1 + 8 * i, 8))
        sums += [F.sum(weight * F.col("_x")).alias(f"_wx{i}"), F.sum(weight).alias(f"_w{i}")]
        unpacked.append(F.struct((F.col("_q") * 4 + i).alias("rep"), F.col(f"_wx{i}").alias("wx"), F.col(f"_w{i}").alias("w")))
    partial = drawn.groupBy(*keys, "_chunk", "_q", "_n").agg(*sums)
    rates = partial.select(*keys, "_n", F.explode(F.array(*unpacked)).alias("r")).where(F.col("r.rep") < replicates).groupBy(
        *keys, "_n", "r.rep").agg(F.try_divide(F.sum("r.wx"), F.sum("r.w")).alias("rate"))
    spread = rates.groupBy(*keys).agg(
        F.percentile(F.col("rate") * F.col("_n"), F.array(F.lit(0.025), F.lit(0.975))).alias("_q"),
        F.stddev_samp("rate").alias("oe_se"),
    ).select(*keys, F.col("_q")[0].alias("total_lo"), F.col("_q")[1].alias("total_hi"), "oe_se")
    return _finish(point, spread, keys)


# Cumulative Poisson(1) probabilities as 48-bit whole numbers: counts up to 16 occur.
_LIMITS = np.array([int(t * 2.0**48) for t in poisson1_thresholds(18) if t < 1.0 - 2.0**-50], dtype=np.uint64)


def _weight_table() -> tuple[np.ndarray, np.ndarray]:
    """Poisson(1) count for each 16-bit prefix of a draw, and whether the prefix leaves it open."""
    low = np.arange(65536, dtype=np.uint64) << np.uint64(32)
    first = np.searchsorted(_LIMITS, low, side="right")
    last = np.searchsorted(_LIMITS, low + np.uint64(2**32 - 1), side="right")
    return first.astype(np.float32), first != last


def _mix(z: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit counters over the whole range."""
    z = z ^ (z >> np.uint64(30))
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


# Beyond the first counts a prefix is rare enough to be looked up.
_PREFIXES = (_LIMITS >> np.uint64(32)).astype(np.uint16)[:5]


def _poisson_sums(x: np.ndarray, row: np.ndarray, replicates: int, table: tuple[np.ndarray, np.ndarray]):
    """(sum of weight times value, sum of weights) per replicate; each hash gives the prefixes of four draws.

    Counts below four follow from comparisons of the prefixes, others from the table. Few prefixes leave the count
    open; those draws take 32 more bits from a second hash.
    """
    counts_of, undecided = table
    words = (replicates + 3) // 4
    steps = _mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values, sums = np.vstack([x, np.ones(len(x))]), np.zeros((2, words * 4))
    slab = max(1, _SLAB // (words * 4))
    for at in range(0, len(x), slab):
        part = _mix(row[at:at + slab, None] ^ steps[None, :])
        prefix = part.view(np.uint16)
        w, rare = np.zeros(prefix.shape, np.uint8), prefix >= _PREFIXES[-1]
        for limit in _PREFIXES[:-1]:
            w += prefix >= limit
            rare |= prefix == limit
        i, j = np.divmod(np.flatnonzero(rare), words * 4)
        found = prefix[i, j]
        count, is_open = counts_of[found], undecided[found]
        i_open, j_open = i[is_open], j[is_open]
        more = _mix(part[i_open, j_open // 4] ^ _mix(j_open.astype(np.uint64) % np.uint64(4) + np.uint64(1))) >> np.uint64(32)
        count[is_open] = np.searchsorted(_LIMITS, (found[is_open].astype(np.uint64) << np.uint64(32)) | more, side="right")
        w[i, j] = count
        sums += values[:, at:at + slab] @ w.astype(np.float64)
    return sums[0, :replicates], sums[1, :replicates]


def bootstrap(
    df: DataFrame, keys: Sequence[str], value: str, row_id: Sequence[Column | str], replicates: int = 2000,
    seed: int = 42, floor: int = 150, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per entity: 95 % interval of the total, standard error of the rate, and whether the interval excludes zero.

    Slim rows (keys, value, row hash) move once, hashed by (entity, chunk), where an entity is cut into as many chunks
    as its size needs. The replicate weights are Poisson draws at every size: their sums add up across chunks, so the
    result doesn't depend on ``rows_per_chunk``. An entity of one chunk is finished inside its task. Weights depend on
    the row hash, so neither row order nor a retried task changes them.
    """
    keys = list(keys)
    point = _point(df, keys, value, floor)
    rows = _arranged(df, point, keys, value, F.xxhash64(F.lit(seed), *row_id), rows_per_chunk)
    arranged = rows.sortWithinPartitions(*keys, "_chunk")
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
                           T.StructField("se", T.DoubleType()),
                           T.StructField("sums", T.ArrayType(T.DoubleType())),
                           T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    names = schema.names

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _weight_table()
        held, current = [], None

        def flush():
            x = np.concatenate([h[0] for h in held])
            row = np.concatenate([h[1] for h in held]).view(np.uint64)
            *key, _, n = current
            whole = n <= rows_per_chunk
            sums, weights = _poisson_sums(x, row, replicates, table)
            if not whole:
                return (*key, None, None, None, sums.tolist(), weights.tolist(), n)
            rate = sums[weights > 0] / weights[weights > 0]
            lo, hi = np.percentile(rate * n, [2.5, 97.5])
            return (*key, lo, hi, rate.std(ddof=1), None, None, n)

        for pdf in batches:
            if pdf.empty:
                continue
            marks = pdf[[*keys, "_chunk"]]
            starts = np.flatnonzero((marks != marks.shift()).any(axis=1).to_numpy())
            x, row, out = pdf["_x"].to_numpy(), pdf["_row"].to_numpy(), []
            for a, b in zip(starts, np.r_[starts[1:], len(pdf)]):
                unit = (*marks.iloc[a], pdf["_n"].iloc[a])
                if unit != current:
                    if held:
                        out.append(flush())
                    held, current = [], unit
                held.append((x[a:b], row[a:b]))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([flush()] if held else [], columns=names)

    parts = arranged.mapInPandas(resample, schema)
    replicate = F.posexplode_outer(F.arrays_zip("sums", "weights")).alias("rep", "z")
    by_replicate = parts.select(*keys, "lo", "hi", "se", "n", replicate).groupBy(*keys, "rep").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("se").alias("se"), F.max("n").alias("n"),
        F.try_divide(F.sum("z.sums"), F.sum("z.weights")).alias("rate"))
    spread = by_replicate.groupBy(*keys).agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("se").alias("se"),
        F.percentile(F.col("rate") * F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        F.stddev_samp("rate").alias("sd"),
    ).select(*keys, F.coalesce("lo", F.col("q")[0]).alias("total_lo"), F.coalesce("hi", F.col("q")[1]).alias("total_hi"),
             F.coalesce("se", "sd").alias("oe_se"))
    return _finish(point, spread, keys)
