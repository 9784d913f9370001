"""Frames to events: one row of derived features per event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nearest_anchor
from ..operators import frames as fr
from ..session import materialise


def extract_events(frames: DataFrame, events: DataFrame, store: bool = False) -> DataFrame:
    """Release frame, distances, contact time and bounces for every event that a frame can be found for.

    ``frames`` comes from ``read_frames``; ``events`` holds event_num, game_id, period, player_id, player_name, made,
    is_3pt, reported_distance and clock_s. With ``store`` the frames without repeats, the ordered frames and the contacts
    are written once to the shared folder, so documents are parsed once; leave it off for small inputs.

    Once they are numbered, only frames of periods that an event asks for go on, and of their players the actors of
    those events: no other row can be claimed or belongs to an actor's run.
    """
    parsed = fr.dedup_frames(fr.split_roles(frames))
    parsed = materialise(parsed, "parsed") if store else parsed
    asked = events.select(
        F.col("event_num").cast("long").alias("event_id"), "game_id", "period", F.col("player_id").alias("actor_id"),
        F.col("clock_s").alias("event_clock"), "event_num", "player_name", "made", "is_3pt", "reported_distance")
    actors = asked.groupBy("game_id", "period").agg(F.collect_set("actor_id").alias("actors"))
    ordered = fr.number_frames(parsed).join(actors, ["game_id", "period"])
    ordered = materialise(ordered, "frames") if store else ordered
    contacts = fr.actor_contacts(ordered, among="actors")
    contacts = materialise(contacts, "contacts") if store else contacts
    claimed = fr.claim_frames(asked, contacts)
    chosen = asked.drop("event_clock").join(claimed, ["game_id", "event_id"])
    at_frame = chosen.join(
        ordered.select("game_id", "period", "pos", "game_date", "clock", "shot_clock", "ball_z", "players"),
        ["game_id", "period", "pos"])
    near = fr.nearest_others(at_frame)

    held = contacts.where(F.col("ball_distance") <= fr.HELD_DISTANCE).withColumn("_chunk", F.floor(F.col("pos") / 1000))
    runs = fr.contact_runs(held, ["game_id", "period", "actor_id"], "_chunk", ["pos"], F.lit(True), "ball_z", "ts_ms",
                           position="pos").select("game_id", "period", "actor_id", "pos", "run_span", "run_minima")
    full = near.join(runs, ["game_id", "period", "actor_id", "pos"], "left")
    shot = nearest_anchor("actor_x", "actor_y", fr.ANCHORS)
    rows = full.select(
        F.col("period").alias("quarter"), F.col("clock").alias("game_clock"), "shot_clock",
        F.round("actor_x", 3).alias("shooter_x"), F.round("actor_y", 3).alias("shooter_y"),
        F.round(shot["distance"], 2).alias("shot_dist_ft"),
        F.round("closest_distance", 2).alias("closest_def_dist_ft"),
        F.round("second_distance", 2).alias("second_def_dist_ft"),
        F.col("n_close").alias("n_defenders_within_6ft"), F.round("ball_z", 2).alias("ball_height_ft"),
        F.round(F.coalesce(F.col("run_span"), F.lit(0)) / 1000.0, 2).alias("touch_time_s"),
        F.coalesce(F.col("run_minima"), F.lit(0)).alias("dribbles"), "release_confidence", "game_id", "game_date",
        "event_num", F.col("actor_id").alias("player_id"), "player_name", "made", "is_3pt", "reported_distance",
    )
    return fr.demote(rows, "shot_dist_ft", "reported_distance").withColumnRenamed("dist_error", "dist_error_ft")
