"""Table scans. Schemas are given, never inferred, so a scan costs one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import nan_to_null


class MissingTable(FileNotFoundError):
    """A table another step should have written."""


def read_events_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row. Fields that do not parse become NULL."""
    return nan_to_null(spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", enforceSchema=False))


def read_table(spark: SparkSession, path: str, produced_by: str = "", schema: T.StructType | None = None) -> DataFrame:
    """Parquet table of this library (missing values are NULL already, so filters reach the files).

    If it is not there, the error names the step that writes it.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        hint = f"; run {produced_by} first" if produced_by else ""
        raise MissingTable(f"{path} not found{hint}") from err


def read_periods(spark: SparkSession, glob: str, pattern: str, column: str = "season") -> DataFrame:
    """All files of a glob as one table; the period comes from the file name, missing columns are NULL."""
    table = spark.read.option("mergeSchema", True).parquet(glob)
    return nan_to_null(table.withColumn(column, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)))


_DOCUMENT = T.StructType([
    T.StructField("gameid", T.StringType()),
    T.StructField("gamedate", T.StringType()),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("eventId", T.StringType()),
        T.StructField("moments", T.ArrayType(T.VariantType())),
    ]))),
    T.StructField("corrupt", T.StringType()),
])


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Frame documents, one row each; the mixed arrays inside are parsed once, to variants.

    A document that does not parse is a row with its text in ``corrupt`` and nothing else.
    """
    docs = spark.read.schema(_DOCUMENT).json(path, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")
    return docs.withColumn("file", F.col("_metadata.file_name"))


def flatten_frames(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per frame: a position array holds period, timestamp, clock, shot clock, a blank and the entities.

    ``keep`` names columns of the documents that go along.
    """
    events = documents.select(*keep, F.col("gameid").alias("game_id"), F.col("gamedate").alias("game_date"),
                              F.posexplode("events").alias("event_idx", "event"))
    moments = events.select(*keep, "game_id", "game_date", "event_idx", F.col("event.eventId").alias("event_id"),
                            F.posexplode("event.moments").alias("moment_idx", "moment"))
    part = lambda i, kind: F.try_variant_get("moment", f"$[{i}]", kind)
    frames = moments.select(
        *keep, "game_id", "game_date", "event_idx", "event_id", "moment_idx",
        part(0, "int").alias("period"), part(1, "long").alias("ts_ms"), part(2, "double").alias("clock"),
        part(3, "double").alias("shot_clock"),
        # As a generated column, so that the filter below tests it and does not read the entities a second time.
        F.explode(F.array(part(5, "array<array<double>>"))).alias("entities"),
    )
    return frames.where(F.size("entities") > 0)


def read_frames(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Frame documents straight to frames. Each file is one task; documents may also come one per line."""
    return flatten_frames(read_documents(spark, path, multi_line))
