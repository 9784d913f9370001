"""The result manifest: one nested document, one flat row per number, and one row per test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_manifest(spark: SparkSession, sections: Mapping[str, DataFrame]) -> DataFrame:
    """One row with a struct per section and the whole as JSON. Every section is a one-row table."""
    packed = {name: table.select(F.struct(*table.columns)).scalar() for name, table in sections.items()}
    row = spark.range(1).select(*[column.alias(name) for name, column in packed.items()])
    return row.withColumn("document", F.to_json(F.struct(*sections)))


def flat_manifest(sections: Mapping[str, DataFrame]) -> DataFrame:
    """Section, statistic and value, one row per number; text and structs are left out."""
    out = None
    for name, table in sections.items():
        numbers = [f.name for f in table.schema.fields
                   if f.dataType.typeName() in ("double", "float", "long", "integer", "boolean")]
        pairs = F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in numbers])
        rows = table.select(F.lit(name).alias("section"), F.explode(pairs).alias("x")).select("section", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def test_table(tests: Sequence[tuple[str, DataFrame, str, Sequence[str]]]) -> DataFrame:
    """One row per test: its name and its headline, written from columns of a one-row table by a format pattern."""
    out = None
    for name, table, pattern, columns in tests:
        row = table.select(F.lit(name).alias("test"), F.format_string(pattern, *columns).alias("headline"))
        out = row if out is None else out.unionByName(row)
    return out
