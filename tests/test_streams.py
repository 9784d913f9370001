"""Streams against their batch forms, with late rows and a restart."""

import datetime

from pyspark.sql import functions as F

from obsexp.operators import frames as fr
from obsexp.plans.registry import QUERIES
from obsexp.session import scratch_path
from obsexp.streaming import jobs
from test_frames import sequential_claims

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, made int, expected double"


def put(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def test_running_totals_close_with_the_watermark_and_resume(spark):
    root = scratch_path(spark, "t-stream")
    put(spark, f"{root}/in", [("a", at(1), 1, 0.5), ("a", at(9), 0, 0.5), ("b", at(5), 1, 0.25), ("a", at(30), 1, 0.5)])
    schema = spark.read.parquet(f"{root}/in").schema

    def run():
        out = jobs.running_oe(jobs.read_stream(spark, f"{root}/in", schema), ["k"], "ts", "made", "expected", "10 minutes", "5 minutes")
        jobs.run_to_end(out, f"{root}/out", f"{root}/check")
        return sorted((r.k, r.n, r.actual, r.oe_total) for r in spark.read.parquet(f"{root}/out").collect())

    assert run() == [("a", 2, 1, 0.0), ("b", 1, 1, 0.75)]
    put(spark, f"{root}/in", [("a", at(2), 1, 0.5), ("a", at(60), 1, 0.5)])   # the first row comes too late
    assert run() == [("a", 1, 1, 0.5), ("a", 2, 1, 0.0), ("b", 1, 1, 0.75)]


def test_dedup_keeps_the_first_across_batches(spark):
    root = scratch_path(spark, "t-dedup")
    put(spark, f"{root}/in", [("a", at(1), 1, 0.5), ("b", at(2), 1, 0.5)])
    schema = spark.read.parquet(f"{root}/in").schema

    def run():
        jobs.run_to_end(jobs.dedup_stream(jobs.read_stream(spark, f"{root}/in", schema), ["k"], "ts", "1 hour"), f"{root}/out", f"{root}/check")
        return sorted((r.k, r.made) for r in spark.read.parquet(f"{root}/out").collect())

    run()
    put(spark, f"{root}/in", [("a", at(3), 0, 0.5), ("c", at(4), 1, 0.5)])
    assert run() == [("a", 1), ("b", 1), ("c", 1)]


def test_activity_runs_end_after_the_gap(spark):
    df = spark.createDataFrame([("a", at(0), 1, 0.5), ("a", at(4), 0, 0.5), ("a", at(9), 1, 0.5), ("a", at(30), 1, 0.5)], SCHEMA)
    out = jobs.activity_runs(df, ["k"], "ts", "made", "expected", "10 minutes", "1 minute").orderBy("run_start").collect()
    assert [(r.n, r.actual) for r in out] == [(3, 2), (1, 1)]


def test_ingest_routes_once_even_when_run_again(spark):
    root = scratch_path(spark, "t-ingest")
    schema = "file string, n_frames int, n_events int, n_rows int"
    put(spark, f"{root}/in", [("a", 5, 2, 2), ("b", 0, 2, 0), ("c", 5, 0, 0), ("d", 5, 2, 0)], schema)
    stream_schema = spark.read.parquet(f"{root}/in").schema

    def status():
        return F.when(F.col("n_frames") == 0, "empty").when((F.col("n_events") == 0) | (F.col("n_rows") == 0), "failed").otherwise("ok")

    for _ in range(2):
        jobs.ingest_stream(jobs.read_stream(spark, f"{root}/in", stream_schema), status, f"{root}/ok", f"{root}/empty", f"{root}/failed", f"{root}/check")
    found = {s: sorted(r.file for r in spark.read.parquet(f"{root}/{s}").collect()) for s in ("ok", "empty", "failed")}
    assert found == {"ok": ["a"], "empty": ["b"], "failed": ["c", "d"]}


def test_claims_with_state_follow_the_sequential_rule(spark):
    import random
    rng = random.Random(8)
    frames = [(i, 120 - i * 0.1, rng.random() * 5, rng.random() * 10) for i in range(1, 400)]
    events = [(n, round(rng.uniform(85, 120), 1)) for n in range(25)]
    rows = [("g", 1, 7, n, c, p, clock, z, d) for n, c in events for p, clock, d, z in frames if abs(clock - c) <= 5]
    schema = "game_id string, period int, actor_id long, event_id long, event_clock double, pos long, clock double, ball_z double, ball_distance double"
    root = scratch_path(spark, "t-claims")
    early = [r for r in rows if r[4] > 102]
    put(spark, f"{root}/in", early, schema)
    stream_schema = spark.read.parquet(f"{root}/in").schema

    def run():
        jobs.run_to_end(jobs.claim_stream(jobs.read_stream(spark, f"{root}/in", stream_schema)), f"{root}/out", f"{root}/check")
        return {r.event_id: (r.pos, r.release_confidence) for r in spark.read.parquet(f"{root}/out").collect()}

    run()
    put(spark, f"{root}/in", [r for r in rows if r[4] <= 102], schema)
    expected = sequential_claims(events, frames)
    assert run() == expected
    assert fr.CLAIM_POSITIONS == 50


def test_claims_do_not_depend_on_the_batch_size(spark):
    import random
    rng = random.Random(3)
    frames = [(i, 120 - i * 0.1, rng.random() * 5, rng.random() * 10) for i in range(1, 300)]
    events = [(n, round(rng.uniform(95, 120), 1)) for n in range(12)]
    rows = [(g, 1, 7, n, c, p, clock, z, d) for g in ("g", "h", "i") for n, c in events for p, clock, d, z in frames
            if abs(clock - c) <= 5]
    schema = "game_id string, period int, actor_id long, event_id long, event_clock double, pos long, clock double, ball_z double, ball_distance double"
    root = scratch_path(spark, "t-batches")
    for game in ("g", "h", "i"):
        put(spark, f"{root}/in", [r for r in rows if r[0] == game] * 2, schema)  # candidates come twice
    stream_schema = spark.read.parquet(f"{root}/in").schema
    found = []
    for size in (1, 1000):
        stream = jobs.read_stream(spark, f"{root}/in", stream_schema, files_per_batch=size)
        jobs.run_to_end(jobs.claim_stream(stream), f"{root}/out{size}", f"{root}/check{size}")
        found.append(sorted((r.event_id, r.pos, r.release_confidence) for r in spark.read.parquet(f"{root}/out{size}").collect()))
    assert found[0] == found[1] == sorted((n, *v) for n, v in sequential_claims(events, frames).items() for _ in range(3))


def claims_of_all_events(events, window=3600.0):
    """Every event asks for a frame of its game, in the order of the clock; the rule written as a loop over the events table."""
    import math

    games, out, second = {}, {}, 0
    for e in events:
        us = int((e.ts - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))
        x = float(e.user_id % 94)
        clock = round(86400.0 - us % 86400000000 / 1e6, 3)
        games.setdefault((e.user_id, us // 86400000000), []).append((us // 1000, str(e.event_id), clock, math.hypot(x + e.value / 50 - x, 0), e.value))
    for rows in games.values():
        first = {}
        for row in sorted(rows):
            first.setdefault(row[0], row)  # of frames at one time the first is kept
        frames = [(p, *row[2:]) for p, row in enumerate(sorted(first.values(), key=lambda r: (-r[2], r[1])), 1)]
        taken = []
        for _, event, at, *_ in sorted(rows, key=lambda r: (-r[2], int(r[1]))):
            near = sorted(((gap > fr.HELD_DISTANCE, gap if gap > fr.HELD_DISTANCE else -z, p), p, c) for p, c, gap, z in frames if abs(c - at) <= window)
            free = [n for n in near if not any(abs(n[1] - p) <= fr.CLAIM_POSITIONS and abs(n[2] - c) <= fr.CLAIM_SECONDS for p, c in taken)]
            if free:
                second += free[0] != near[0]
                taken.append(free[0][1:])
                out[int(event)] = (free[0][1], "low" if free[0][0][0] else "high")
    return out, second


def test_every_event_claims_a_frame_that_no_earlier_one_took(spark, small, tmp_path):
    """In crowded games events find their best frame taken, and many happen at the same time."""
    events = spark.read.parquet(f"{small}/events.parquet")
    crowd = events.withColumn("user_id", F.col("user_id") % 3).withColumn("ts", F.when(
        F.col("event_id") % 9 == 0, F.timestamp_seconds(F.lit(1400000000) + F.floor(F.col("event_id") / 90))).otherwise(F.col("ts")).cast("timestamp_ntz"))
    for name, table in (("plain", events), ("crowd", crowd)):
        table.coalesce(1).write.parquet(str(tmp_path / name / "events.parquet"))
        rows = spark.read.parquet(str(tmp_path / name / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()
        want, second = claims_of_all_events(rows)
        got = QUERIES["stream_claims"](spark, str(tmp_path / name)).collect()
        assert len(got) == len(want) and {r.event_id: (r.pos, r.release_confidence) for r in got} == want
        assert len(want) > 0.8 * len(rows) and (name == "plain" or second > 50)
