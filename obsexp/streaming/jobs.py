"""Streams that stop by themselves once the files present are consumed, and resume from their checkpoint."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.frames import CLAIM_POSITIONS, CLAIM_SECONDS, HELD_DISTANCE, RELEASE_WINDOW_S


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000,
    pattern: str | None = None,
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Append a stream to a Parquet table until the input present now is consumed."""
    query = (df.writeStream.outputMode(mode).format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def ingest_stream(
    units: DataFrame, status: Callable[[], Column], good: str, empty: str, failed: str, checkpoint: str,
) -> None:
    """Route each arriving unit to the good, empty or failed table; an unknown or missing status counts as failed.

    Every batch overwrites its own folder, so a batch replayed after a failure replaces its rows instead of adding them.
    """
    targets = {"ok": good, "empty": empty, "failed": failed}

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = batch.withColumn("status", status())
        known = F.coalesce(F.col("status").isin(*targets), F.lit(False))
        routed = routed.withColumn("status", F.when(known, F.col("status")).otherwise("failed"))
        routed.persist()
        for name, path in targets.items():
            routed.where(F.col("status") == name).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        routed.unpersist()

    query = (units.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def dedup_stream(frames: DataFrame, keys: list[str], event_time: str, lateness: str) -> DataFrame:
    """First arrival per key; state older than the lateness bound is dropped."""
    return frames.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)


def running_oe(
    events: DataFrame, keys: list[str], event_time: str, outcome: str, expected: str, width: str, lateness: str,
) -> DataFrame:
    """Observed against expected per key and tumbling window, final once the watermark passes the window."""
    return (
        events.withWatermark(event_time, lateness)
        .groupBy(F.window(event_time, width), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("actual"), F.sum(expected).alias("expected_total"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n",
                "actual", "expected_total", (F.col("actual") - F.col("expected_total")).alias("oe_total"))
    )


def activity_runs(
    events: DataFrame, keys: list[str], event_time: str, outcome: str, expected: str, gap: str, lateness: str,
) -> DataFrame:
    """The same sums per run of activity, where a run ends after a gap."""
    return (
        events.withWatermark(event_time, lateness)
        .groupBy(F.session_window(event_time, gap), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("actual"), F.sum(expected).alias("expected_total"))
        .select(F.col("session_window.start").alias("run_start"), F.col("session_window.end").alias("run_end"), *keys,
                "n", "actual", "expected_total")
    )


_CLAIMED = "event_id long, pos long, release_confidence string"
# Claims still in reach and settled events, each with the chain (game, period, actor) it belongs to.
_CLAIM_STATE = "claim_chain array<string>, pos array<long>, clock array<double>, settled_chain array<string>, settled array<long>"
# State keys that the chains are dealt over. A stream's checkpoint is bound to the number it began with.
CLAIM_BUCKETS = 4096


def _claim(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, window: float) -> Iterator[pd.DataFrame]:
    claim_chains, claim_pos, claim_clock, settled_chains, settled = state.get if state.exists else ([], [], [], [], [])
    claims, done = defaultdict(list), defaultdict(set)
    for chain, pos, clock in zip(claim_chains, claim_pos, claim_clock):
        claims[chain].append((pos, clock))
    for chain, event_id in zip(settled_chains, settled):
        done[chain].add(event_id)
    rows = pd.concat(list(batches), ignore_index=True).dropna(subset=["event_id"])
    rows = rows.sort_values(["event_clock", "event_id"], ascending=[False, True], kind="stable", ignore_index=True)
    # Candidates of an event, the best first: held ones by height, then the others by distance; the first free one is taken.
    chain, event = rows["chain"].factorize()[0], rows.groupby(["chain", "event_id"], sort=False).ngroup().to_numpy()
    loose = ~(rows["ball_distance"] <= HELD_DISTANCE).to_numpy()
    worth = np.where(loose, rows["ball_distance"].fillna(np.inf), -rows["ball_z"].fillna(-np.inf))
    rows, event = (x.take(np.lexsort([rows["pos"], worth, loose, event, chain])) for x in (rows, event))
    starts = np.flatnonzero(np.diff(event, prepend=-1)) if len(event) else []
    chains, event_ids, reaches, pos, clock, gap = (rows[c].tolist() for c in (
        "chain", "event_id", "event_clock", "pos", "clock", "ball_distance"))
    out = []
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        own, event_id = chains[a], int(event_ids[a])
        if event_id in done[own]:
            continue
        done[own].add(event_id)
        # The clock runs down: claims of frames beyond this event's reach can no longer matter.
        reach = reaches[a] + window + CLAIM_SECONDS
        taken = claims[own] = [t for t in claims[own] if t[1] <= reach]
        for i in range(a, b):
            if not any(abs(pos[i] - p) <= CLAIM_POSITIONS and abs(clock[i] - c) <= CLAIM_SECONDS for p, c in taken):
                taken.append((int(pos[i]), float(clock[i])))
                out.append((event_id, int(pos[i]), "high" if gap[i] <= HELD_DISTANCE else "low"))
                break
    in_reach = [(k, p, c) for k, taken in claims.items() for p, c in taken]
    closed = [(k, event_id) for k, ids in done.items() for event_id in sorted(ids)]
    state.update((*([t[i] for t in in_reach] for i in range(3)), *([t[i] for t in closed] for i in range(2))))
    yield pd.DataFrame(out, columns=["event_id", "pos", "release_confidence"])


def claim_stream(candidates: DataFrame, buckets: int = CLAIM_BUCKETS, window: float = RELEASE_WINDOW_S) -> DataFrame:
    """Exclusive release frames over a stream of candidates; claims live in the state of (game, period, actor).

    Candidates lie at most ``window`` seconds from their event, which tells how long a claim stays in reach. A game's
    candidates must lie in one file, as its document does; whole files arrive together, so the batch size makes no
    difference. An event is settled once; candidates that come again change nothing. The state holds the claims still
    in reach and the numbers of the settled events. It has no timeout: with one, a run over the files present would not end.

    Chains are dealt by hash over ``buckets`` state keys, as a call for each chain would cost more than its events. A
    task holds the rows and the state of one bucket at a time, and a batch reads and writes the state of those it meets.
    """
    place = ["game_id", "period", "actor_id"]
    slim = candidates.select(
        F.pmod(F.xxhash64(*place), F.lit(buckets)).alias("bucket"), F.to_json(F.struct(*place)).alias("chain"),
        "event_id", "event_clock", "pos", "clock", "ball_z", "ball_distance")
    return slim.groupBy("bucket").applyInPandasWithState(
        partial(_claim, window=window), _CLAIMED, _CLAIM_STATE, "append", GroupStateTimeout.NoTimeout)
