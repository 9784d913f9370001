"""Scalar column rules. Each returns Column expressions, so a whole feature frame stays one projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN means missing at ingest; the engine carries NULL only."""
    return F.nullif(_c(c), F.lit(float("nan")))


def parse_ts(c: Column | str, fmt: str | None = None) -> Column:
    """Timestamp, or NULL when the text does not parse."""
    return F.try_to_timestamp(_c(c), F.lit(fmt)) if fmt else F.try_to_timestamp(_c(c))


def parse_date(c: Column | str, pattern: str, fmt: str) -> Column:
    """Date from the first capture of ``pattern``; text that does not match gives NULL."""
    text = F.nullif(F.regexp_extract(_c(c), pattern, 1), F.lit(""))
    return F.to_date(text, fmt)


def clock_seconds(c: Column | str, style: str = "m:s") -> Column:
    """Clock text to seconds: ``m:s`` reads ``11:22``, ``iso`` reads ``PT11M22.00S``. Malformed text gives NULL."""
    patterns = {"m:s": r"^\s*(\d+):(\d+)\s*$", "iso": r"^PT(\d+)M(\d+(?:\.\d*)?)S?$"}
    if style not in patterns:
        raise ValueError(f"unknown clock style {style!r}; use one of {sorted(patterns)}")
    minutes = F.regexp_extract(_c(c), patterns[style], 1).try_cast("double")
    seconds = F.regexp_extract(_c(c), patterns[style], 2).try_cast("double")
    return minutes * 60 + seconds


def extract_groups(c: Column | str, pattern: str, names: Sequence[str]) -> list[Column]:
    """One column per capture group, NULL where the text does not match."""
    return [F.nullif(F.regexp_extract(_c(c), pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)]


def fill_from(target: Column | str, source: Column | str, limit: float) -> tuple[Column, Column]:
    """(filled, flag): a missing target takes the source when the source is at most ``limit``."""
    target, source = _c(target), _c(source)
    flag = F.coalesce(target.isNull() & (source <= limit), F.lit(False))
    return F.when(flag, source).otherwise(target), flag


def keep_if(c: Column | str, ok: Column) -> Column:
    """The value where ``ok`` holds, NULL elsewhere."""
    return F.when(ok, _c(c))


def bin_column(
    c: Column | str,
    edges: Sequence[float],
    labels: Sequence,
    closed: str = "right",
    include_lowest: bool = False,
) -> Column:
    """Label of the interval holding the value; NULL when it is missing or outside the edges.

    ``closed`` names the closed end of each interval. ``include_lowest`` also admits the first edge of right-closed
    bins. Infinite edges leave that end open.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("there must be one more edge than labels")
    if closed not in ("right", "left"):
        raise ValueError("closed must be 'right' or 'left'")
    c, result = _c(c), None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        tests = []
        if not math.isinf(lo):
            tests.append(c >= lo if closed == "left" or (include_lowest and i == 0) else c > lo)
        if not math.isinf(hi):
            tests.append(c < hi if closed == "left" else c <= hi)
        inside = c.isNotNull()
        for test in tests:
            inside = inside & test
        result = F.when(inside, F.lit(label)) if result is None else result.when(inside, F.lit(label))
    return result


def flag_below(c: Column | str, limit: float, default: float, yes: str, no: str) -> Column:
    """``yes`` when the value, or ``default`` for a missing one, is at most ``limit``."""
    return F.when(F.coalesce(_c(c), F.lit(default)) <= limit, F.lit(yes)).otherwise(F.lit(no))


def binary_outcome(c: Column | str, success) -> Column:
    """1 where the value equals ``success``, else 0; a missing value counts as 0."""
    return F.coalesce(_c(c) == F.lit(success), F.lit(False)).cast("int")


def points_for(made: Column | str, is_three: Column | str) -> Column:
    return F.when(_c(is_three) == 1, _c(made) * 3).otherwise(_c(made) * 2)


def effective_rate(points: Column | str, n: Column | str) -> Column:
    """Points per event, halved, so that a two-point success counts as one."""
    return F.try_divide(_c(points).cast("double") / 2, _c(n))


def distance(x1, y1, x2, y2) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))
    return F.hypot(lit(x1) - lit(x2), lit(y1) - lit(y2))


def nearest_anchor(x: Column | str, y: Column | str, anchors: Sequence[tuple[float, float]]) -> dict[str, Column]:
    """Distance to the nearest fixed point, and the offset along each axis from it (the first wins a tie)."""
    x, y = _c(x), _c(y)
    options = [F.struct(distance(x, y, ax, ay).alias("d"), F.lit(i).alias("i"),
                        F.abs(x - F.lit(float(ax))).alias("depth"), F.abs(y - F.lit(float(ay))).alias("lateral"))
               for i, (ax, ay) in enumerate(anchors)]
    best = F.least(*options) if len(options) > 1 else options[0]
    return {name: best[field] for name, field in
            (("distance", "d"), ("anchor", "i"), ("depth", "depth"), ("lateral", "lateral"))}


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(_c(c), places)
