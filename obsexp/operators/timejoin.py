"""Joins on time: bands, nearest row, and nearest row without reuse."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import Scan, running, value_bucket


def band_join(
    events: DataFrame, frames: DataFrame, keys: Sequence[str], event_time: str, frame_time: str, window: float,
    how: str = "inner",
) -> DataFrame:
    """Pairs that agree on the keys and lie at most ``window`` apart.

    Time is cut into buckets one window wide. An event looks into its own bucket and the two beside it, so the join is
    an equality join on (keys, bucket) whose partitions stay small, with the exact range test on top. Frame columns
    must not share names with event columns other than the keys. ``how="left"`` adds the events without a pair, once
    each.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    width = F.lit(float(window))
    own = F.floor(F.col(event_time) / width)
    left = events.withColumn("_bucket", F.explode(F.array(own - 1, own, own + 1)))
    right = frames.withColumnsRenamed({k: f"_f_{k}" for k in keys}).withColumn(
        "_fbucket", F.floor(F.col(frame_time) / width))
    on = [F.col(k) == F.col(f"_f_{k}") for k in keys] + [F.col("_bucket") == F.col("_fbucket")]
    near = F.abs(F.col(frame_time) - F.col(event_time)) <= width
    pairs = left.join(right, [*on, near]).drop("_bucket", "_fbucket", *[f"_f_{k}" for k in keys])
    if how == "inner":
        return pairs
    # An event is without a pair only if none of its three buckets has one.
    row = F.struct(*[F.col(c) for c in events.columns])
    met = pairs.select(row.alias("_row")).distinct()
    alone = events.withColumn("_own", row).join(met, F.col("_own").eqNullSafe(F.col("_row")), "left_anti").drop("_own")
    return pairs.unionByName(alone, allowMissingColumns=True)


def pick_release(
    candidates: DataFrame, event_keys: Sequence[str], distance: str, height: str, position: str, held_distance: float,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One candidate per event: the highest within reach (``high``), or else the closest (``low``); earliest on ties.

    A plain aggregate: every task keeps one candidate per event before rows move.
    """
    payload = [F.col(position).alias("position"), *[F.col(c) for c in carry]]
    held = F.min(F.when(F.col(distance) <= held_distance, F.struct((-F.col(height)).alias("k"), *payload)))
    closest = F.min(F.struct(F.col(distance).alias("k"), *payload))
    picked = candidates.groupBy(*event_keys).agg(held.alias("_held"), closest.alias("_close"))
    best = F.coalesce(F.col("_held"), F.col("_close"))
    return picked.select(
        *event_keys, best["position"].alias(position), *[best[c].alias(c) for c in carry],
        F.when(F.col("_held").isNotNull(), "high").otherwise("low").alias("release_confidence"),
    )


def _tagged(left: DataFrame, right: DataFrame, keys, left_time, right_time, left_id, right_id, chunk_width: float | None):
    """Both sides in one table with a chunk per row: of fixed width, or cut so that chunks hold equal shares of all rows."""
    l = left.select(*keys, F.col(left_time).cast("double").alias("_t"), F.lit(1).alias("_side"),
                    F.col(left_id).alias("_id"))
    r = right.select(*keys, F.col(right_time).cast("double").alias("_t"), F.lit(0).alias("_side"),
                     F.col(right_id).alias("_id"))
    both = l.unionByName(r).where(F.col("_t").isNotNull())
    if chunk_width is None:
        return value_bucket(both, "_t", "_chunk")
    return both.withColumn("_chunk", F.floor(F.col("_t") / F.lit(float(chunk_width))))


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, left_id: str,
    right_id: str, tolerance: float, chunk_width: float | None = None,
) -> DataFrame:
    """For every left row the nearest right row of its key in either direction, if within the tolerance.

    Both sides are merged in time order and scanned once each way, so the cost is linear and no pairs are formed. Equal
    gaps go to the earlier right row, then to the smaller id. Result: left id, right id and gap.
    """
    both = _tagged(left, right, keys, left_time, right_time, left_id, right_id, chunk_width)
    both = both.withColumn("_back", -F.col("_id"))
    hit = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))
    both = running(both.withColumn("_turn", 1 - F.col("_side")), keys, "_chunk", ["_t"], {
        "_before": Scan("last", hit, order=["_t", "_side", "_back"]),
        "_after": Scan("last", hit, reverse=True, order=["_t", "_turn", "_id"]),
    })
    gap_before, gap_after = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    use_before = gap_after.isNull() | (gap_before <= gap_after)
    out = both.where(F.col("_side") == 1).select(
        *keys, F.col("_id").alias(left_id),
        F.when(use_before, F.col("_before.id")).otherwise(F.col("_after.id")).alias("match_id"),
        F.when(use_before, gap_before).otherwise(gap_after).alias("gap"),
    )
    inside = F.col("gap") <= tolerance
    return out.withColumns({"match_id": F.when(inside, F.col("match_id")), "gap": F.when(inside, F.col("gap"))})


def _greedy(keys: list[str], tolerance: float):
    """Streams one partition in (key, island, time) order; holds only the rows within one tolerance of the front."""

    def settle(waiting: deque, free: list, limit: float, out: list) -> None:
        while waiting and waiting[0][0] + tolerance < limit:
            t, left_id = waiting.popleft()
            options = [(abs(rt - t), rt, rid) for rt, rid in free if abs(rt - t) <= tolerance]
            if options:
                gap, rt, rid = min(options)
                free.remove((rt, rid))
                out.append((left_id, rid, gap))
            floor = (waiting[0][0] if waiting else t) - tolerance
            free[:] = [f for f in free if f[0] >= floor]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, waiting, free = None, deque(), []
        for pdf in batches:
            out: list[tuple] = []
            islands = list(zip(*[pdf[k] for k in [*keys, "_island"]]))
            for island, t, side, rid in zip(islands, pdf["_t"], pdf["_side"], pdf["_id"]):
                if island != current:
                    settle(waiting, free, float("inf"), out)
                    current, free = island, []
                settle(waiting, free, t, out)
                if side == 1:
                    waiting.append((t, rid))
                else:
                    free.append((t, rid))
            yield pd.DataFrame(out, columns=["left_id", "right_id", "gap"])
        out = []
        settle(waiting, free, float("inf"), out)
        yield pd.DataFrame(out, columns=["left_id", "right_id", "gap"])

    return run


def nearest_unused(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, left_id: str,
    right_id: str, tolerance: float, chunk_width: float | None = None,
) -> DataFrame:
    """Exclusive nearest match: left rows in time order each take the nearest right row nobody took, within tolerance.

    Rows further apart than the tolerance cannot interact, so every key is cut into islands at such gaps and islands
    are matched independently. Result: left_id, right_id, gap for matched rows.
    """
    keys = list(keys)
    both = _tagged(left, right, keys, left_time, right_time, left_id, right_id, chunk_width)
    order = ["_t", "_side", "_id"]
    both = running(both, keys, "_chunk", order, {"_prev": Scan("last", F.col("_t"), inclusive=False)})
    opens = F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > tolerance)
    both = running(both, keys, "_chunk", order, {"_island": Scan("last", F.when(opens, F.col("_t")))})
    arranged = both.select(*keys, "_island", "_t", "_side", "_id").repartition(*keys, "_island").sortWithinPartitions(
        *keys, "_island", *order)
    id_type = both.schema["_id"].dataType
    schema = T.StructType([T.StructField("left_id", id_type), T.StructField("right_id", id_type),
                           T.StructField("gap", T.DoubleType())])
    return arranged.mapInPandas(_greedy(keys, float(tolerance)), schema)
