"""Row cleaning and the full feature frame."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply the missing-value rule to every floating-point column of an input table."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({n: C.nan_to_null(n) for n in floats}) if floats else df


def dedup_exact(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or distinct rows of a projection."""
    return (df.select(*cols) if cols else df).distinct()


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that hold a value in every listed column."""
    return df.dropna(subset=list(cols))


def null_if(df: DataFrame, col: str, invalid: Column) -> DataFrame:
    """Blank a column where ``invalid`` holds."""
    return df.withColumn(col, F.when(~F.coalesce(invalid, F.lit(False)), F.col(col)))


def harmonise(df: DataFrame, mapping: Mapping[str, tuple[Column | str, str]], bounds: Mapping[str, float]) -> DataFrame:
    """Cast a source to a shared schema and keep rows inside the upper bounds (a missing value fails)."""
    shared = df.select(*[(F.col(e) if isinstance(e, str) else e).cast(t).alias(n) for n, (e, t) in mapping.items()])
    for col, limit in bounds.items():
        shared = shared.where(F.col(col) <= F.lit(limit))
    return shared


def high_confidence(df: DataFrame, col: str = "release_confidence", level: str = "high") -> DataFrame:
    return df.where(F.col(col) == level)


def with_efficiency(df: DataFrame, n: str = "n", made: str = "made", points: str = "points") -> DataFrame:
    """Success rate and effective rate of an aggregated table."""
    return df.withColumns({
        "pct": F.try_divide(F.col(made).cast("double"), F.col(n)),
        "efg": C.effective_rate(points, n),
    })


# The event-log rules.
CLOCK_LIMIT_S = 24.0
LATE_LIMIT_S = 4.0
ZONE_EDGES = (-math.inf, 4.0, 14.0, 23.75, math.inf)
ZONE_LABELS = ("at_rim", "short_midrange", "long_midrange", "three_plus")
TOUCH_EDGES = (-math.inf, 2.0, 6.0, math.inf)
TOUCH_LABELS = ("quick", "balanced", "hold")
MATCHUP_PATTERN = r"\w{3} \d{2}, \d{4} - ([A-Z]{2,3}) (?:@|vs\.) ([A-Z]{2,3})"
MATCHUP_DATE_PATTERN = r"^(\w{3} \d{2}, \d{4})"
MATCHUP_DATE_FORMAT = "MMM dd, yyyy"
NUMERIC_FEATURES = ("SHOT_NUMBER", "PERIOD", "SHOT_CLOCK", "DRIBBLES", "TOUCH_TIME", "SHOT_DIST", "CLOSE_DEF_DIST",
                    "GAME_CLOCK_SECONDS")
CATEGORICAL_FEATURES = ("LOCATION", "PTS_TYPE", "SHOT_DIST_ZONE", "TOUCH_TIME_BUCKET", "LATE_CLOCK", "SHOT_CLOCK_OFF")
OUTCOME_COLUMNS = ("FINAL_MARGIN", "W")


def derive_features(events: DataFrame) -> DataFrame:
    """All derived columns of the event log as two projections, without a shuffle."""
    game_clock = C.clock_seconds("GAME_CLOCK")
    clock, off = C.fill_from("SHOT_CLOCK", "GAME_CLOCK_SECONDS", CLOCK_LIMIT_S)
    actor, opponent = C.extract_groups("MATCHUP", MATCHUP_PATTERN, ["actor_team", "opponent_team"])
    first = events.withColumns({
        "GAME_CLOCK_SECONDS": game_clock,
        "made": C.binary_outcome("SHOT_RESULT", "made"),
        "actor_team": actor,
        "opponent_team": opponent,
        "event_date": C.parse_date("MATCHUP", MATCHUP_DATE_PATTERN, MATCHUP_DATE_FORMAT),
        "TOUCH_TIME": C.keep_if("TOUCH_TIME", F.col("TOUCH_TIME") >= 0),
    })
    return first.withColumns({
        "SHOT_CLOCK": clock,
        "SHOT_CLOCK_OFF": F.when(off, "clock_off").otherwise("clock_on"),
        "SHOT_DIST_ZONE": C.bin_column("SHOT_DIST", ZONE_EDGES, ZONE_LABELS),
        "TOUCH_TIME_BUCKET": C.bin_column("TOUCH_TIME", TOUCH_EDGES, TOUCH_LABELS),
        "LATE_CLOCK": C.flag_below(clock, LATE_LIMIT_S, CLOCK_LIMIT_S, "late_clock", "normal_clock"),
    })


def modelling_frame(events: DataFrame) -> DataFrame:
    """The feature frame without rows that lack an outcome or an entity."""
    return require(derive_features(events), ["SHOT_RESULT", "player_name"])
