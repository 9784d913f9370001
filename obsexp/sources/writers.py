"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", order: Sequence[Column | str] = (),
    partition_by: Sequence[str] = (), mode: str = "overwrite",
) -> None:
    """Write Parquet or CSV. ``order`` range-sorts rows, so files follow the order and statistics prune reads."""
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt must be 'parquet' or 'csv'")
    out = df.orderBy(*order) if order else df
    writer = out.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.parquet(path)


def compact(source: DataFrame, path: str, period: str = "season", confident: Column | None = None,
            rows_per_file: int = 5_000_000) -> DataFrame:
    """Rewrite many small outputs partitioned by period, and report rows and the share of confident ones.

    Rows gather by period; the adaptive planner splits a period that is too large for one task.
    """
    source.hint("rebalance", period).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(
        period).parquet(path)
    written = source.sparkSession.read.parquet(path)
    share = F.avg(F.coalesce(confident, F.lit(False)).cast("int")) if confident is not None else F.lit(None).cast("double")
    return written.groupBy(period).agg(F.count(F.lit(1)).alias("n"), share.alias("confident_share"))
