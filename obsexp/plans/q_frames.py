"""Registered queries: high-rate rows, with the events table as ticks and documents of frames derived from it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import ordered as od
from ..session import materialise, scratch_path
from ..sources.readers import read_frames
from .extraction import extract_events
from .registry import load, query, r6, s6

_LIMIT = 80.0
# Seconds around an event in which its frame is looked for, as ticks are minutes apart.
CLAIM_WINDOW_S = 3600.0
# Events of one document, about, when a user and day has more.
DOCUMENT_EVENTS = 100_000


def ticks(spark, folder):
    events = load(spark, folder, "events")
    return events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
                         F.to_date("ts").alias("day"), F.col("value").alias("height"), "event_type")


def chunked_ticks(spark, folder):
    """Ticks with chunks that hold equal shares of the table, so a hot user or a hot day is cut up as well."""
    return od.value_bucket(ticks(spark, folder), "t", "chunk")


@query("touch_run", f"""
WITH o AS (SELECT *, epoch_us(ts) AS t, value <= {_LIMIT} AS held, row_number() OVER w AS i, lag(value) OVER w AS pv, lead(value) OVER w AS nv, lag(value <= {_LIMIT}) OVER w AS ph, lead(value <= {_LIMIT}) OVER w AS nh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(max(CASE WHEN NOT held THEN i END) OVER (PARTITION BY user_id ORDER BY i), 0) AS broken,
  CAST(held AND coalesce(ph AND nh AND value < pv AND value <= nv AND value < 40.0, false) AS INTEGER) AS low FROM o),
r AS (SELECT *, first_value(t) OVER (PARTITION BY user_id, broken, held ORDER BY i) AS t0,
  coalesce(sum(low) OVER (PARTITION BY user_id, broken, held ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lows FROM b)
SELECT event_id, CASE WHEN held THEN i - broken ELSE 0 END::BIGINT AS run_rows, CASE WHEN held THEN t - t0 ELSE 0 END::BIGINT AS run_span, CASE WHEN held THEN lows ELSE 0 END::BIGINT AS run_minima FROM r""")
def touch_run(spark, folder):
    runs = fr.contact_runs(chunked_ticks(spark, folder), ["user_id"], "chunk", ["t", "event_id"], F.col("height") <= _LIMIT, "height",
                           "t", bounce_height=40.0)
    return runs.select("event_id", "run_rows", "run_span", "run_minima")


@query("local_minima", """
WITH o AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value < pv AND value <= nv AND value < 40.0) AS minima FROM o GROUP BY 1""")
def local_minima(spark, folder):
    flagged = fr.local_minima(chunked_ticks(spark, folder), ["user_id"], "chunk", ["t", "event_id"], "height", 40.0)
    return flagged.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_minimum").alias("minima"))


@query("ticks_dedup", """
WITH d AS (SELECT *, epoch_us(ts) // 60000000 AS minute FROM events),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY minute ORDER BY event_id) AS rn FROM d) WHERE rn = 1)
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN value > 60 THEN 0.0 ELSE -value END, event_id, minute) AS pos FROM f""")
def ticks_dedup(spark, folder):
    frames = ticks(spark, folder).select(
        F.lit("g").alias("game_id"), F.floor(F.col("t") / 60000000).alias("ts_ms"), F.col("event_id").alias("event_idx"),
        F.floor(F.col("t") / 60000000).alias("moment_idx"), F.col("event_type").alias("period"),
        F.when(F.col("height") <= 60, F.col("height")).alias("clock"))
    ordered = fr.number_frames(fr.dedup_frames(frames))
    return ordered.select(F.col("event_idx").alias("event_id"), "pos")


@query("knn_at_frame", f"""
WITH p AS (SELECT vec_id, label, vec_id // 11 AS frame, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY vec_id) AS rn FROM p) WHERE rn = 1),
d AS (SELECT a.vec_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM a JOIN p b ON a.frame = b.frame AND a.label <> b.label)
SELECT vec_id, {s6('min(d)')} AS closest_distance, count(*) FILTER (WHERE d <= 6.0) AS n_close, count(*) AS n_others FROM d GROUP BY 1""")
def knn_at_frame(spark, folder):
    """Frames of eleven vectors; the first of each is the actor, those of other labels are the other side."""
    at = load(spark, folder, "embeddings").select(
        "vec_id", "label", F.floor(F.col("vec_id") / 11).alias("frame"),
        (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))
    others = at.select("frame", F.col("label").alias("o_label"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    actors = od.first_per_key(at, ["frame"], [F.asc("vec_id")])
    found = fr.nearest_by_rows(actors, others, ["frame"], ("x", "y"), ("ox", "oy"), F.col("label") != F.col("o_label"),
                               ["vec_id"], 6.0)
    return found.withColumn("closest_distance", r6("closest_distance"))


@query("demoted", f"""
SELECT doc_id, {s6('round(abs(length(text) / 100.0 - CASE WHEN lang <> \'de\' THEN n_chars / 90.0 END), 2)')} AS dist_error,
  CASE WHEN n_chars < 300 OR coalesce(round(abs(length(text) / 100.0 - CASE WHEN lang <> 'de' THEN n_chars / 90.0 END), 2) > 5.0, false) THEN 'low' ELSE 'high' END AS release_confidence FROM documents""")
def demoted(spark, folder):
    docs = load(spark, folder, "documents").select(
        "doc_id", (F.length("text") / F.lit(100.0)).alias("measured"),
        F.when(F.col("lang") != "de", F.col("n_chars") / F.lit(90.0)).alias("reported"),
        F.when(F.col("n_chars") < 300, "low").otherwise("high").alias("release_confidence"))
    return fr.demote(docs, "measured", "reported").select("doc_id", r6("dist_error").alias("dist_error"), "release_confidence")


def write_documents(spark, folder, grouped: bool = False) -> str:
    """Frame documents from the events table, one per line: the user is at a fixed spot, the ball is as high as the value.

    An event is a document of its own, or, ``grouped``, one of those of its user and day, with a second frame that
    repeats the time of the first. A user and day of many events is dealt over several documents.

    Events are dealt evenly before they are written: a table of few row groups would otherwise be written by few tasks,
    and the first of them, if its split of the table holds no row group, leaves a file of no length.
    """
    e = ticks(spark, folder).repartition("event_id")
    num = lambda c: c.cast("string")
    x = F.pmod("user_id", F.lit(94)).cast("double")
    entity = lambda *v: F.concat(F.lit("["), F.concat_ws(",", *v), F.lit("]"))
    entities = F.concat(
        F.lit("["), entity(F.lit("-1"), F.lit("-1"), num(x + F.col("height") / 50), F.lit("25.0"), num(F.col("height"))), F.lit(","),
        entity(F.lit("1"), num(F.col("user_id")), num(x), F.lit("25.0"), F.lit("0.0")), F.lit(","),
        entity(F.lit("2"), F.lit("-5"), num(x), num(F.pmod("event_id", F.lit(50)).cast("double")), F.lit("0.0")), F.lit(","),
        entity(F.lit("2"), F.lit("-6"), num(x + 3), F.lit("25.0"), F.lit("0.0")), F.lit("]"))
    clock = F.lit(86400.0) - F.pmod(F.col("t"), F.lit(86400000000)) / 1e6
    moment = F.concat(F.lit("["), F.concat_ws(",", F.lit("1"), num(F.floor(F.col("t") / 1000)), num(F.round(clock, 3)),
                                              F.lit("14.0"), F.lit("null"), entities), F.lit("]"))
    moments = F.concat_ws(",", moment, moment) if grouped else moment
    event = F.concat(F.lit('{"eventId":"'), num(F.col("event_id")), F.lit('","moments":['), moments, F.lit("]}"))
    e = e.select("user_id", "day", "t", "event_id", event.alias("events"))
    if grouped:
        parts = max(1, math.ceil(e.count() / DOCUMENT_EVENTS))
        part = F.pmod(F.xxhash64("event_id"), F.lit(parts))
        listed = F.array_sort(F.collect_list(F.struct("t", "event_id", "events")))
        e = e.groupBy("user_id", "day", part).agg(F.array_join(listed["events"], ",").alias("events"))
    doc = F.concat(
        F.lit('{"gameid":"'), num(F.col("user_id")), F.lit("-"), num(F.col("day")), F.lit('","gamedate":"'), num(F.col("day")),
        F.lit('","events":['), F.col("events"), F.lit("]}"))
    path = scratch_path(spark, "documents")
    e.select(doc.alias("value")).write.text(path)
    return path


_GAME = "user_id::VARCHAR || '-' || CAST(ts AS DATE)::VARCHAR"


@query("frames_scan", f"""
SELECT {_GAME} AS game_id, count(*) AS frames, count(DISTINCT event_id::VARCHAR) AS events, {s6('max(value)')} AS max_height, max(epoch_us(ts) // 1000)::BIGINT AS last_ms FROM events GROUP BY 1""")
def frames_scan(spark, folder):
    frames = read_frames(spark, write_documents(spark, folder), multi_line=False)
    return frames.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_distinct("event_id").alias("events"),
        r6(F.max(F.element_at(F.col("entities")[0], 5))).alias("max_height"), F.max("ts_ms").alias("last_ms"))


@query("frames_grouped", f"""
WITH f AS (SELECT {_GAME} AS game_id, epoch_us(ts) // 1000 AS ms, value, event_id::VARCHAR AS e FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY game_id, ms ORDER BY e) AS place FROM f)
SELECT game_id, 2 * count(*) AS frames, count(DISTINCT e) AS events, count(*) FILTER (WHERE place = 1) AS kept,
  {s6('max(value) FILTER (WHERE place = 1)')} AS max_height FROM k GROUP BY 1""")
def frames_grouped(spark, folder):
    """Documents of many events, whose frames repeat their time: of each time the first frame is kept."""
    frames = fr.split_roles(read_frames(spark, write_documents(spark, folder, grouped=True), multi_line=False))
    whole = frames.groupBy("game_id").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("event_id").alias("events"))
    kept = fr.dedup_frames(frames, order=["moment_idx", "event_id"]).groupBy("game_id").agg(
        F.count(F.lit(1)).alias("kept"), r6(F.max("ball_z")).alias("max_height"))
    return whole.join(kept, "game_id")


@query("split_roles", f"""
SELECT event_id::VARCHAR AS event_id, {s6('value')} AS ball_z, 3::INTEGER AS players, user_id AS first_player, {s6('user_id % 94')} AS first_x FROM events""")
def split_roles(spark, folder):
    frames = fr.split_roles(read_frames(spark, write_documents(spark, folder), multi_line=False))
    first = F.col("players")[0]
    return frames.select("event_id", r6("ball_z").alias("ball_z"), F.size("players").alias("players"),
                         first["entity_id"].alias("first_player"), r6(first["x"]).alias("first_x"))


def game_events(spark, folder, kind: str | None = None):
    """Events that ask for their frame, of one type or of all."""
    e = ticks(spark, folder)
    e = e if kind is None else e.where(F.col("event_type") == kind)
    clock = F.lit(86400.0) - F.pmod(F.col("t"), F.lit(86400000000)) / 1e6
    return e.select(
        F.col("event_id").alias("event_num"), F.concat_ws("-", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("game_id"),
        F.lit(1).alias("period"), F.col("user_id").alias("player_id"), F.col("user_id").cast("string").alias("player_name"),
        F.lit(1).alias("made"), F.lit(0).alias("is_3pt"), (F.col("height") / 10).alias("reported_distance"),
        F.round(clock, 3).alias("clock_s"))


def _shot_events(spark, folder):
    return game_events(spark, folder, "purchase")


def asking(events):
    """The columns of events that a claim needs."""
    return events.select(
        F.col("event_num").alias("event_id"), "game_id", "period", F.col("player_id").alias("actor_id"),
        F.col("clock_s").alias("event_clock"))


@query("claim_frames")
def claim_frames(spark, folder):
    """Exclusive frames with a window wide enough for ticks that are minutes apart."""
    # Stored, as frames are counted before they are numbered and contacts are read more than once.
    parsed = materialise(fr.dedup_frames(fr.split_roles(read_frames(spark, write_documents(spark, folder), False))), "parsed")
    frames = fr.number_frames(parsed)
    return fr.claim_frames(asking(_shot_events(spark, folder)), fr.actor_contacts(frames), CLAIM_WINDOW_S)


@query("extract_events")
def extract(spark, folder):
    frames = read_frames(spark, write_documents(spark, folder), multi_line=False)
    return extract_events(frames, _shot_events(spark, folder), store=True)


@query("nearest_at_frame", f"""
SELECT event_id::VARCHAR AS event_id, {s6('least(3.0, abs(event_id % 50 - 25))')} AS closest_distance, {s6('greatest(3.0, abs(event_id % 50 - 25))')} AS second_distance,
  (1 + CAST(abs(event_id % 50 - 25) <= 6 AS INTEGER))::INTEGER AS n_close FROM events""")
def nearest_at_frame(spark, folder):
    # Stored, as the planner would otherwise read the entities out of the document again for every use of them.
    parsed = materialise(read_frames(spark, write_documents(spark, folder), multi_line=False), "parsed")
    frames = fr.split_roles(parsed)
    near = fr.nearest_others(frames.withColumn("actor_id", F.element_at(F.split("game_id", "-"), 1).cast("long")))
    return near.select("event_id", r6("closest_distance").alias("closest_distance"), r6("second_distance").alias("second_distance"), "n_close")


@query("movement_gaps", f"""
WITH o AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(gap) AS gaps, max(gap)::BIGINT AS widest FROM o GROUP BY 1""")
def movement_gaps(spark, folder):
    seen = od.neighbours(chunked_ticks(spark, folder), ["user_id"], "chunk", ["t", "event_id"], previous={"before": F.col("t")})
    gap = F.col("t") - F.col("before")
    return seen.groupBy("user_id").agg(F.count(gap).alias("gaps"), F.max(gap).alias("widest"))
