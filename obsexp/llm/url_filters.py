"""URL filters with dated lists: every capture is judged by the entries that were in force when it was fetched.

A list is a history of additions and removals. Each pattern's history becomes intervals of validity that don't overlap;
an interval is stored under every period it touches, so that the as-of join is an equality join on (pattern, period)
and a pattern's captures spread over periods. Of the entries in force the most specific pattern decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

PERIOD_DAYS = 32
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
# host and first path segment; anything without a scheme and a host has neither
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^/?#]*)?"


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; null without one."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.+$", "")
    return F.when(host != "", host)


def folder_of(url: Column) -> Column:
    """``host/segment``, the most specific pattern of a URL; null without a path segment."""
    segment = F.regexp_extract(url, URL, 2)
    return F.when(F.length(segment) > 1, F.concat(host_of(url), segment))


def path_of(url: Column) -> Column:
    """``host/a/b``: the host and the whole path, its case kept; null without a path segment."""
    path = F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", "")
    return F.when(path != "", F.concat(host_of(url), path))


def pattern_of(entry: Column) -> Column:
    """Hosts don't depend on case, paths do; a slash at the end says nothing."""
    host = F.substring_index(entry, "/", 1)
    return F.regexp_replace(F.concat(F.lower(host), F.substr(entry, F.length(host) + 1)), "/+$", "")


def intervals(entries: DataFrame, horizon: Column | None = None) -> DataFrame:
    """``(pattern, action, valid_from, valid_to)`` from dated entries ``(pattern, action, listed)``.

    ``action`` is ``block``, ``allow`` or ``remove``; an entry holds from its date up to the pattern's next date. Of
    several on one date the last of remove, block, allow in that order of strength stands: ``remove`` beats ``block``,
    ``block`` beats ``allow``. Entries with a null part or another action are left out, and so is what is removed.
    """
    strength = F.when(F.col("action") == "remove", 3).when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1)
    daily = entries.select(pattern_of(F.col("pattern")).alias("pattern"), "action", F.col("listed").cast("date").alias("listed"),
                           strength.alias("strength")).dropna()
    daily = daily.groupBy("pattern", "listed").agg(F.max_by("action", "strength").alias("action"))
    following = F.lead("listed").over(Window.partitionBy("pattern").orderBy("listed"))
    return daily.select("pattern", "action", F.col("listed").alias("valid_from"), following.alias("valid_to")).where(
        "action <> 'remove'")


def _period(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / F.lit(PERIOD_DAYS)).cast("int")


def judge(captures: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url",
          fetched: str = "fetched") -> DataFrame:
    """``page_id, url, fetched, host, decision, pattern, listed`` of every capture.

    ``decision`` is that of the most specific entry in force on the day of the fetch: the longest path of whole
    segments, then the host, then its parent domains from long to short; ``default`` without one, with null ``pattern`` and ``listed``. Captures
    without a date or a host are ``default`` too. Repeated rows are judged each. Other columns are not read, so their
    names don't matter.
    """
    rows = captures.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                           F.col(fetched).cast("date").alias("fetched"))
    spans = materialise(intervals(entries), "url-list")
    # Of a path only the lengths that occur in the list can match.
    depths = sorted(r.n for r in spans.select((F.size(F.split("pattern", "/")) - 1).alias("n")).distinct().collect() if r.n)
    path = F.substring_index(path_of(F.col("url")), "/", max(depths, default=0) + 1)
    rows = rows.withColumns({"host": host_of(F.col("url")), "folder": F.coalesce(path, F.lit(""))})
    # Captures of one folder and day are judged once: counts of a frequent host shrink before anything moves.
    asked = rows.where(F.col("host").isNotNull() & F.col("fetched").isNotNull()).select("host", "folder", "fetched").distinct()
    asked = materialise(asked, "url-days")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = [F.when(F.size(F.split("folder", "/")) > n, F.substring_index("folder", "/", n + 1)) for n in reversed(depths)]
    patterns = F.concat(F.array_compact(F.array(*paths)), parents) if paths else parents
    keyed = asked.select("host", "folder", "fetched", F.posexplode(patterns).alias("place", "_key")).withColumn(
        "_period", _period(F.col("fetched")))
    # An open interval ends with the last capture.
    last = asked.agg(F.max("fetched")).first()[0]
    spans = spans.withColumn("end", F.coalesce(F.date_sub("valid_to", 1), F.lit(last).cast("date")))
    spans = spans.where("end >= valid_from").select(
        "pattern", "action", "valid_from", "end", F.explode(F.sequence(_period(F.col("valid_from")), _period(F.col("end")))).alias("period"))
    spans = materialise(spans, "url-intervals")
    inside = (F.col("_key") == F.col("pattern")) & (F.col("_period") == F.col("period")) & F.col("fetched").between(
        F.col("valid_from"), F.col("end"))
    first = F.struct("place", "action", "pattern", "valid_from")
    decided = keyed.join(spans, inside).groupBy("host", "folder", "fetched").agg(F.min(first).alias("x"))
    decided = materialise(decided.select(F.col("host").alias("_h"), F.col("folder").alias("_f"), F.col("fetched").alias("_d"), "x"),
                          "url-decisions")
    on = (F.col("host") == F.col("_h")) & (F.col("folder") == F.col("_f")) & (F.col("fetched") == F.col("_d"))
    return rows.join(decided, on, "left").select(
        "page_id", "url", "fetched", "host", F.coalesce("x.action", F.lit("default")).alias("decision"),
        F.col("x.pattern").alias("pattern"), F.col("x.valid_from").alias("listed"))


def allowed(captures: DataFrame, entries: DataFrame, **columns) -> DataFrame:
    """Judgements of the captures that no entry blocks."""
    return judge(captures, entries, **columns).where("decision <> 'block'")
