"""Incremental ingest: what is new, what came of it, where it went, and when the whole may be published.

The ledger is an append-only table of (file, status, reason, rows) with status ``ok``, ``empty`` or ``failed``. Files
that are ``ok`` or ``empty`` are settled and never read again; failed ones are tried again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

LEDGER = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("rows", T.LongType()),
])
SETTLED = ("ok", "empty")
COMMITS = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("units", T.LongType()),
    T.StructField("rows", T.LongType()), T.StructField("digest", T.LongType()),
])
# Files that one extraction job takes; only their paths are ever held by the driver's Python.
BATCH_FILES = 10_000


def list_files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """Files below a path (or several), without their contents."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return listing.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def list_units(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """``list_files``, stored, with the files of no length that a scan leaves out.

    Their names come from the file index, which the driver holds for every read of a folder.
    """
    found = list_files(spark, path, pattern)
    named = [(unquote(f), unquote(f).rsplit("/", 1)[-1]) for f in found.inputFiles()]
    indexed = spark.createDataFrame(named, "path string, file string")
    void = indexed.join(found.select("file"), "file", "left_anti").select("path", "file", F.lit(0).cast("long").alias("length"))
    return materialise(found.unionByName(void), "units")


def latest_status(ledger: DataFrame) -> DataFrame:
    """One row per file: settled if it ever settled."""
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "empty", 1).otherwise(2)
    return ledger.groupBy("file").agg(F.min_by(F.struct("status", "reason", "rows"), rank).alias("s")).select(
        "file", "s.status", "s.reason", "s.rows")


def pending(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed files that are not settled yet."""
    settled = ledger.where(F.col("status").isin(*SETTLED)).select("file").distinct()
    return listing.join(settled, "file", "left_anti")


def route_outcomes(units: DataFrame, frames: str = "n_frames", events: str = "n_events", rows: str = "n_rows",
                   corrupt: str | None = None) -> DataFrame:
    """Status of each unit from its counts: no frames is empty; no events, or nothing extracted, is a failure.

    ``corrupt`` names a flag of units whose document does not parse; they are failures with a reason of their own.
    """
    broken = F.coalesce(F.col(corrupt), F.lit(False)) if corrupt else F.lit(False)
    status = (F.when(broken, "failed").when(F.coalesce(F.col(frames), F.lit(0)) == 0, "empty")
              .when(F.coalesce(F.col(events), F.lit(0)) == 0, "failed")
              .when(F.coalesce(F.col(rows), F.lit(0)) == 0, "failed").otherwise("ok"))
    reason = (F.when(broken, "document does not parse").when(F.coalesce(F.col(frames), F.lit(0)) == 0, "no frames in any event")
              .when(F.coalesce(F.col(events), F.lit(0)) == 0, "no event table")
              .when(F.coalesce(F.col(rows), F.lit(0)) == 0, "nothing extracted"))
    return units.withColumns({"status": status, "reason": reason})


def ingest_status(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: files in total, extracted, empty, remaining, rows so far, open failures."""
    state = listing.join(latest_status(ledger), "file", "left")
    return state.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("extracted"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(~F.coalesce(F.col("status").isin(*SETTLED), F.lit(False))).alias("remaining"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("rows"))), F.lit(0)).alias("rows"),
        F.count_if(F.col("status") == "failed").alias("open_failures"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty before the first run."""
    from .readers import MissingTable, read_table

    try:
        return read_table(spark, path, schema=LEDGER)
    except MissingTable:
        return spark.createDataFrame([], LEDGER)


def ingest_new(
    spark: SparkSession, source: str | list[str], out: str, ledger_path: str,
    extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], pattern: str = "*", limit: int | None = None,
    routes: str | None = None, batch: int = BATCH_FILES,
) -> DataFrame:
    """Extract files that are not settled, write their rows and their outcomes, and return the status report.

    ``extract`` maps the pending files (path, file, length) to (rows with a ``file`` column, per-file counts, with an
    optional flag ``corrupt``). Every pending file gets its line in the ledger: one that ``extract`` says nothing about,
    such as a file of no length, has no frames. Only rows of files that came out ``ok`` are written, and a failure that
    repeats itself is not noted twice. ``routes`` names a folder for side outputs: new outcomes below ``status=ok``,
    ``status=empty`` and ``status=failed``, by one write.

    Files are processed by one job per ``batch`` files, dealt by hash. Rows are written before the ledger, below a folder
    per file, so a run that dies in between is repeated without duplicates and keeps the batches before.
    """
    listing = list_units(spark, source, pattern)
    todo = pending(listing, read_ledger(spark, ledger_path))
    if limit:
        todo = todo.orderBy("file").limit(limit)
    todo = materialise(todo, "pending")
    jobs = math.ceil(todo.count() / batch)
    for turn in range(jobs):
        part = todo.where(F.pmod(F.xxhash64("file"), F.lit(jobs)) == turn)
        if part.isEmpty():
            continue
        rows, units = extract(part)
        flag = "corrupt" if "corrupt" in units.columns else None
        seen = part.select(F.col("file").alias("_file")).join(units, F.col("_file") == F.col("file"), "left").drop("file")
        routed = materialise(route_outcomes(seen.withColumnRenamed("_file", "file"), corrupt=flag).select(
            "file", "status", "reason", F.when(F.col("status") == "ok", F.col("n_rows")).cast("long").alias("rows")), "outcomes")
        good = routed.where("status = 'ok'").select(F.col("file").alias("_good"))
        rows.join(good, F.col("file") == F.col("_good"), "left_semi").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("file").parquet(out)
        known = read_ledger(spark, ledger_path).select(*[F.col(c).alias(f"_{c}") for c in ("file", "status", "reason")])
        repeat = (F.col("file") == F.col("_file")) & (F.col("status") == F.col("_status")) & F.col("reason").eqNullSafe(F.col("_reason"))
        fresh = materialise(routed.join(known, repeat, "left_anti"), "outcomes")
        if routes:
            fresh.write.mode("append").partitionBy("status").parquet(routes)
        fresh.write.mode("append").parquet(ledger_path)
    return ingest_status(listing, read_ledger(spark, ledger_path))


def read_route(spark: SparkSession, routes: str, status: str) -> DataFrame:
    """Units that came out as ``ok``, ``empty`` or ``failed`` at some time, once per reason."""
    kept = [f for f in LEDGER if f.name != "status"]
    table = spark.read.schema(T.StructType([*kept, T.StructField("status", T.StringType())])).parquet(routes)
    return table.where(F.col("status") == status).select(*LEDGER.names).dropDuplicates(["file", "reason"])


def all_settled(listing: DataFrame, ledger: DataFrame, limited: bool = False) -> bool:
    """Whether the combined table may be written: nothing is pending and the run was not limited."""
    return not limited and pending(listing, ledger).isEmpty()


def publish(spark: SparkSession, listing: DataFrame, rows_path: str, ledger_path: str, target: str,
            limited: bool = False) -> bool:
    """Write the combined table of all listed units, if every one of them is settled; says whether it did or stands.

    The table is staged in a folder of its own below ``target`` and becomes visible by one line in ``target``/commits,
    written last: readers see the version before or the new one, and a run that dies leaves nothing but an unnamed folder.
    A set of units that is published already is not written again. Without any row there is a line and no table.
    """
    ledger = read_ledger(spark, ledger_path)
    if not all_settled(listing, ledger, limited):
        return False
    state = materialise(listing.select("file").join(latest_status(ledger), "file"), "settled")
    mark = state.agg(F.count(F.lit(1)).alias("units"), F.sum("rows").alias("rows"),
                     F.bit_xor(F.xxhash64("file", "status", "rows")).alias("digest")).first()
    last = _last_commit(spark, target)
    if last and (last.units, last.digest) == (mark.units, mark.digest):
        return True
    version = uuid.uuid4().hex
    good = state.where("status = 'ok'").select(F.col("file").alias("_good"))
    staged = f"{target}/versions/{version}"
    if mark.rows:
        rows = spark.read.parquet(rows_path)
        rows.join(good, F.col("file") == F.col("_good"), "left_semi").hint("rebalance").write.parquet(staged)
    line = spark.createDataFrame([(version, mark.units, mark.rows or 0, mark.digest)],
                                 "version string, units long, rows long, digest long")
    line.withColumn("at", F.current_timestamp()).select(*COMMITS.names).coalesce(1).write.mode("append").parquet(
        f"{target}/commits")
    return True


def _last_commit(spark: SparkSession, target: str):
    from .readers import MissingTable, read_table

    try:
        commits = read_table(spark, f"{target}/commits", schema=COMMITS)
    except MissingTable:
        return None
    return commits.orderBy(F.col("at").desc(), "version").first()


def read_published(spark: SparkSession, target: str) -> DataFrame:
    """The version of the combined table that was committed last."""
    from .readers import MissingTable, read_table

    last = _last_commit(spark, target)
    if last is None:
        raise MissingTable(f"{target}: nothing is published yet")
    return read_table(spark, f"{target}/versions/{last.version}")
