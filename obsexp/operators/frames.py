"""High-rate position frames: cleaning, order, runs of contact, neighbours at a frame and exclusive claims."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import distance
from .ordered import CHUNK_ROWS, Scan, first_per_key, neighbours, row_numbers, running, value_bucket
from .timejoin import band_join

# Frame conventions and release detection.
BALL_ID = -1
ANCHORS = ((5.25, 25.0), (88.75, 25.0))
HELD_DISTANCE = 2.5
RELEASE_WINDOW_S = 5.0
CLAIM_SECONDS = 0.5
CLAIM_POSITIONS = 50
MAX_DISTANCE_ERROR = 5.0
BOUNCE_HEIGHT = 4.0
CLOSE_DISTANCE = 6.0


def split_roles(frames: DataFrame) -> DataFrame:
    """Split the entity list of each frame into ball columns and an array of player structs."""
    is_ball = lambda e: (e[0] == BALL_ID) | (e[1] == BALL_ID)
    balls = F.filter("entities", is_ball)
    ball = F.try_element_at(balls, F.lit(-1))
    players = F.transform(
        F.filter("entities", lambda e: ~is_ball(e)),
        lambda e: F.struct(e[0].cast("long").alias("team_id"), e[1].cast("long").alias("entity_id"),
                           e[2].alias("x"), e[3].alias("y")),
    )
    return frames.withColumn("_ball", ball).withColumns({
        "ball_x": F.col("_ball")[2], "ball_y": F.col("_ball")[3], "ball_z": F.col("_ball")[4], "players": players,
    }).drop("_ball", "entities")


def dedup_frames(frames: DataFrame, game: str = "game_id", ts: str = "ts_ms",
                 order: Sequence[str] = ("event_idx", "moment_idx")) -> DataFrame:
    """Keep the first frame of each timestamp within a game."""
    return first_per_key(frames, [game, ts], [F.col(c).asc() for c in order])


def number_frames(frames: DataFrame, keys: Sequence[str] = ("game_id", "period"), clock: str = "clock",
                  order: Sequence[str] = ("event_idx", "moment_idx"), out: str = "pos", window_rows: int = CHUNK_ROWS) -> DataFrame:
    """Position within the period: clock downwards (a missing clock counts as 0), then arrival order.

    Periods are numbered by one window each if none has more than ``window_rows`` frames, otherwise chunk by chunk.
    ``frames`` is counted first and should be stored.
    """
    elapsed = frames.withColumn("_down", -F.coalesce(F.col(clock), F.lit(0.0)))
    largest = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= window_rows:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("_down", *order))
        return elapsed.withColumn(out, place.cast("long")).drop("_down")
    elapsed = value_bucket(elapsed, "_down", "_chunk")
    return row_numbers(elapsed, keys, "_chunk", ["_down", *order], out).drop("_down", "_chunk")


def contact_runs(
    rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], held: Column, height: str, ts: str,
    position: str | None = None, bounce_height: float = BOUNCE_HEIGHT,
) -> DataFrame:
    """For every row, the unbroken run of held rows that ends there: ``run_rows``, ``run_span`` and ``run_minima``.

    A row that is not held gives zeros. With ``position`` a gap in the position also ends a run, so rows that are not
    held can be left out beforehand. ``run_span`` is 0 for runs of one row. Minima are strict on the left, weak on the
    right, below the bounce height and inside the run.

    Runs are first found inside each chunk, from one sort of the rows. A chunk's summary (its border rows and the run at
    its end) then tells the next chunk what its first run continues, and one join brings that back.
    """
    at = F.col(position) if position else F.lit(0)
    step = 1 if position else 0
    # Nulls are equal inside a struct, so rows stay where the windows put them when the carried runs are joined.
    base = rows.select("*", F.struct(*keys, chunk).alias("_place"), F.coalesce(held, F.lit(False)).alias("_held"))
    here = F.struct(F.col("_held").alias("held"), F.col(height).alias("height"), at.alias("at"))

    def follows(later: Column, earlier: Column) -> Column:
        return F.coalesce(later["held"] & earlier["held"] & (later["at"] - earlier["at"] == step), F.lit(False))

    def down(row: Column, before: Column) -> Column:
        return F.coalesce((row["height"] < before["height"]) & (row["height"] < bounce_height), F.lit(False))

    def up(row: Column, after: Column) -> Column:
        return F.coalesce(row["height"] <= after["height"], F.lit(False))

    inside = Window.partitionBy("_place").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    seen = base.select("*", here.alias("_here"), F.lag(here).over(inside).alias("_before"),
                       F.lead(here).over(inside).alias("_after"), F.row_number().over(inside).alias("_row"))
    marked = seen.withColumns({
        "_opens": F.col("_held") & ~follows(F.col("_here"), F.col("_before")),
        "_down": follows(F.col("_here"), F.col("_before")) & down(F.col("_here"), F.col("_before")),
        "_up": follows(F.col("_after"), F.col("_here")) & up(F.col("_here"), F.col("_after")),
    })
    counted = marked.withColumn("_lows", F.coalesce(F.sum((F.col("_down") & F.col("_up")).cast("long")).over(
        inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opened = F.struct(F.col("_row").alias("row"), F.col(ts).alias("ts"), F.col("_lows").alias("lows"))
    local = counted.withColumn("_start", F.last(F.when(F.col("_opens"), opened), ignorenulls=True).over(so_far)).withColumns({
        "_n": F.when(F.col("_held"), F.col("_row") - F.col("_start.row") + 1).otherwise(0).cast("long"),
        "_n_lows": F.when(F.col("_held"), F.col("_lows") - F.col("_start.lows")).otherwise(0).cast("long"),
    })
    carried = _carried_runs(local, keys, chunk, follows, down, up)

    first_run = F.coalesce(F.col("_held") & (F.col("_start.row") == 1) & F.col("_into").isNotNull(), F.lit(False))
    joined = local.join(carried, F.col("_place") == F.col("_carried_to"), "left").withColumns({
        "_n": F.col("_n") + F.when(first_run, F.col("_into.n")).otherwise(0),
        "_n_lows": F.col("_n_lows") + F.when(first_run, F.col("_into.lows") + F.when(
            F.col("_row") > 1, F.col("_first_low").cast("long")).otherwise(0)).otherwise(0),
        "_since": F.when(first_run, F.col("_into.ts")).otherwise(F.col("_start.ts")),
    })
    many = F.col("_n") > 1
    return joined.select(
        *rows.columns, F.col("_n").alias("run_rows"),
        F.when(many, F.abs(F.col(ts) - F.col("_since"))).otherwise(0).alias("run_span"),
        F.when(many, F.col("_n_lows")).otherwise(0).cast("long").alias("run_minima"),
    )


def _carried_runs(local: DataFrame, keys: Sequence[str], chunk: str, follows, down, up) -> DataFrame:
    """``_carried_to``, ``_into`` and ``_first_low`` of each chunk whose first row continues a run.

    ``_into`` is that run at the end of the chunk before: its rows, its first ``ts`` and its minima, the last row among
    them. ``_first_low`` tells whether the chunk's own first row is a minimum. A chunk that lies inside one run whole
    passes it on, so runs add up over any number of chunks.
    """
    ends = local.groupBy("_place").agg(
        F.min_by("_here", "_row").alias("_first"), F.min_by("_up", "_row").alias("_first_up"),
        F.max_by(F.struct(
            F.col("_here").alias("here"), F.col("_n").alias("n"), F.col("_n_lows").alias("lows"), F.col("_start.ts").alias("ts"),
            F.col("_down").alias("down"), (F.col("_n") == F.col("_row")).alias("whole")), "_row").alias("_last"),
        F.count(F.lit(1)).alias("_size"))
    named = {f"_k_{k}": F.col("_place")[k] for k in [*keys, chunk]}  # as columns, so that all windows share one exchange
    by = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy(f"_k_{chunk}")
    up_to = by.rowsBetween(Window.unboundedPreceding, 0)
    first, last = F.col("_first"), F.col("_last.here")
    borders = ends.withColumns(named).select("*", F.lag(last).over(by).alias("_before"), F.lead(first).over(by).alias("_after")).withColumns({
        "_continues": follows(first, F.col("_before")),
        "_last_up": follows(F.col("_after"), last) & up(last, F.col("_after")),
    })
    borders = borders.withColumns({
        "_first_low": F.col("_continues") & down(first, F.col("_before")) & F.when(
            F.col("_size") > 1, F.col("_first_up")).otherwise(F.col("_last_up")),
        "_last_low": (F.col("_size") > 1) & F.col("_last.down") & F.col("_last_up"),
        "_passes": F.col("_continues") & F.col("_last.whole"),
    })
    lows = (F.col("_last.lows") + (F.col("_last.whole") & F.col("_first_low")).cast("long") + F.col("_last_low").cast("long"))
    totals = borders.withColumn("_lows", lows).withColumns({
        "_sum_n": F.sum("_last.n").over(up_to), "_sum_lows": F.sum("_lows").over(up_to)})
    origin = F.struct((F.col("_sum_n") - F.col("_last.n")).alias("n"), (F.col("_sum_lows") - F.col("_lows")).alias("lows"),
                      F.col("_last.ts").alias("ts"))
    totals = totals.withColumn("_from", F.last(F.when(~F.col("_passes"), origin), ignorenulls=True).over(up_to))
    run = F.struct((F.col("_sum_n") - F.col("_from.n")).alias("n"), (F.col("_sum_lows") - F.col("_from.lows")).alias("lows"),
                   F.col("_from.ts").alias("ts"))
    return totals.withColumn("_into", F.lag(run).over(by)).where("_continues").select(
        F.col("_place").alias("_carried_to"), "_into", "_first_low")


def local_minima(rows: DataFrame, keys, chunk: str, order, height: str, below: float, out: str = "is_minimum") -> DataFrame:
    """Flag rows lower than the one before, not higher than the one after, and under the limit."""
    seen = neighbours(rows, keys, chunk, order, previous={"_p": F.col(height)}, following={"_n": F.col(height)})
    low = (F.col(height) < F.col("_p")) & (F.col(height) <= F.col("_n")) & (F.col(height) < below)
    return seen.withColumn(out, F.coalesce(low, F.lit(False))).select(*rows.columns, out)


def nearest_others(
    chosen: DataFrame, actor: str = "actor_id", players: str = "players", close: float = CLOSE_DISTANCE,
) -> DataFrame:
    """Distances from the actor to entities of the other side, from the player array of the chosen frame.

    Adds the actor's place, the first and second distance and the count within ``close``. Rows whose actor is absent,
    or that hold no opponent, are dropped.
    """
    me = F.try_element_at(F.filter(players, lambda p: p["entity_id"] == F.col(actor)), F.lit(1))
    placed = chosen.withColumn("_me", me).where(F.col("_me").isNotNull())
    gaps = F.array_sort(F.transform(
        F.filter(players, lambda p: p["team_id"] != F.col("_me.team_id")),
        lambda p: F.hypot(F.col("_me.x") - p["x"], F.col("_me.y") - p["y"]),
    ))
    return placed.withColumn("_gaps", gaps).where(F.size("_gaps") > 0).withColumns({
        "actor_x": F.col("_me.x"), "actor_y": F.col("_me.y"),
        "closest_distance": F.col("_gaps")[0],
        "second_distance": F.try_element_at("_gaps", F.lit(2)),
        "n_close": F.size(F.filter("_gaps", lambda d: d <= close)),
    }).drop("_me", "_gaps")


def nearest_by_rows(
    left: DataFrame, others: DataFrame, keys: Sequence[str], left_xy: tuple[str, str], other_xy: tuple[str, str],
    other_side: Column, left_id: Sequence[str], close: float,
) -> DataFrame:
    """The row form of ``nearest_others``, for frames stored one entity per row.

    One actor per frame meets the frame's other rows, so the join is as long as ``others``; it is reduced to the closest
    distance and two counts.
    """
    other = others.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_o_{k}") for k in keys]
    paired = left.join(other, on).where(other_side)
    gap = distance(left_xy[0], left_xy[1], other_xy[0], other_xy[1])
    return paired.withColumn("_d", gap).groupBy(*left_id).agg(
        F.min("_d").alias("closest_distance"), F.count_if(F.col("_d") <= close).alias("n_close"),
        F.count(F.lit(1)).alias("n_others"))


def demote(df: DataFrame, measured: str, reported: str, limit: float = MAX_DISTANCE_ERROR,
           confidence: str = "release_confidence") -> DataFrame:
    """Lower the confidence of rows whose measurement is far from an independent one; no report changes nothing."""
    err = F.round(F.abs(F.col(measured) - F.col(reported)), 2)
    far = F.coalesce(err > limit, F.lit(False))
    return df.withColumns({"dist_error": err, confidence: F.when(far, "low").otherwise(F.col(confidence))})


def actor_contacts(frames: DataFrame, carry: Sequence[str] = (), among: str | None = None) -> DataFrame:
    """One row per frame and player present, with the distance from the ball.

    ``among`` names a column with the ids of the players wanted; the others are left out before anything is exploded.
    """
    players = F.col("players")
    if among is not None:
        players = F.filter(players, lambda p: F.array_contains(F.col(among), p["entity_id"]))
    rows = frames.where(F.col("ball_x").isNotNull()).select(
        "game_id", "period", "pos", "ts_ms", "clock", "ball_x", "ball_y", "ball_z", *carry, F.explode(players).alias("p"))
    return rows.select(
        "game_id", "period", "pos", "ts_ms", "clock", "ball_z", *carry, F.col("p.entity_id").alias("actor_id"),
        F.hypot(F.col("ball_x") - F.col("p.x"), F.col("ball_y") - F.col("p.y")).alias("ball_distance"),
    )


_CHAIN = ["game_id", "period", "actor_id", "chain"]


def _claim_chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settles events in order; each takes a candidate no earlier event of its chain has claimed.

    Rows arrive sorted by chain, event and position. The last event of a batch waits for the next batch, which may
    hold more of its candidates.
    """
    names = ["game_id", "event_id", "pos", "release_confidence"]
    chain, claims, rest = None, [], None

    def settle(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        nonlocal chain, claims
        keys = list(zip(*[pdf[c].to_numpy()[starts] for c in _CHAIN]))
        events, pos, clock = pdf["event_id"].to_numpy(), pdf["pos"].to_numpy(), pdf["clock"].to_numpy()
        gap, height, out = pdf["ball_distance"].to_numpy(), pdf["ball_z"].to_numpy(), []
        for key, a, b in zip(keys, starts, ends):
            if key != chain:
                chain, claims = key, []
            free = np.ones(b - a, dtype=bool)
            for taken_pos, taken_clock in claims:
                free &= ~((np.abs(pos[a:b] - taken_pos) <= CLAIM_POSITIONS) &
                          (np.abs(clock[a:b] - taken_clock) <= CLAIM_SECONDS))
            if not free.any():
                continue
            held = free & (gap[a:b] <= HELD_DISTANCE)
            sure = held.any()
            at = a + int(np.argmax(np.where(held, height[a:b], -np.inf)) if sure
                         else np.argmin(np.where(free, gap[a:b], np.inf)))
            claims.append((pos[at], clock[at]))
            out.append((key[0], int(events[a]), int(pos[at]), "high" if sure else "low"))
        return pd.DataFrame(out, columns=names)

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        changed = np.zeros(len(pdf), dtype=bool)
        changed[0] = True
        for column in (*_CHAIN, "event_id"):
            values = pdf[column].to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(changed)
        yield settle(pdf, cuts[:-1], cuts[1:])
        rest = pdf.iloc[cuts[-1]:]
    if rest is not None and len(rest):
        rest = rest.reset_index(drop=True)
        yield settle(rest, np.array([0]), np.array([len(rest)]))


def claim_frames(events: DataFrame, contacts: DataFrame, window: float = RELEASE_WINDOW_S) -> DataFrame:
    """Release frame per event, never shared between events of one actor and period: game, event, pos, confidence.

    ``events`` holds event_id (unique in its game), game_id, period, actor_id and event_clock; ``contacts`` comes from ``actor_contacts``.
    Events so far apart that their windows and claims cannot meet are put into separate chains, which are settled in
    parallel; inside a chain the order matters and rows stream through one task, one event at a time.
    """
    keys = ["game_id", "period", "actor_id"]
    usable = events.dropna(subset=["period", "event_clock"]).select("event_id", *keys, "event_clock")
    timed = usable.withColumn("_down", -F.col("event_clock")).withColumn("_chunk", F.floor(F.col("_down") / 60))
    order = ["_down", "event_id"]
    timed = running(timed, keys, "_chunk", order, {"_prev": Scan("last", F.col("_down"), inclusive=False)})
    reach = 2 * window + CLAIM_SECONDS
    opens = F.col("_prev").isNull() | (F.col("_down") - F.col("_prev") > reach)
    chained = running(timed, keys, "_chunk", order, {"chain": Scan("last", F.when(opens, F.col("_down")))})
    seen = contacts.where(F.col("clock").isNotNull()).select(
        *keys, "pos", "clock", "ball_z", "ball_distance")
    found = band_join(chained.select(*keys, "event_id", "event_clock", "_down", "chain"), seen, keys, "event_clock",
                      "clock", window)
    arranged = found.repartition(*keys, "chain").sortWithinPartitions(*keys, "chain", "_down", "event_id", "pos")
    schema = T.StructType([events.schema["game_id"], T.StructField("event_id", T.LongType()),
                           T.StructField("pos", T.LongType()), T.StructField("release_confidence", T.StringType())])
    return arranged.mapInPandas(_claim_chains, schema)
