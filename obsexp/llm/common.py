"""Helpers shared by the text and vector operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_runtime_conf, materialise, scratch_path

# What separates words in every contract of this subpackage: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
# Rows and bytes of one Arrow batch: texts may be long, so the default of 10,000 rows is no bound on memory.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Library settings plus small Arrow batches."""
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_bucket(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def stored_texts(df: DataFrame, label: str) -> DataFrame:
    """``materialise`` for tables that hold whole texts: compressed harder."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either a component or has one edge, to a component; ``u`` is always the larger end."""
    ends = F.array(*[F.struct(F.col(end).alias("node"), F.lit(up).alias("up")) for end, up in (("u", 1), ("v", 0))])
    nodes = edges.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("low"))
    return nodes.where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0))).isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: ``edges(u long, v long)`` to ``(node, component)``, the component being its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until only stars are left. Every step
    is a partial aggregate (the smallest neighbour of a node) and a join whose two sides are shuffled tables, so that
    a node holding a third of all edges is split at run time. Each round is written to the shared folder. Nodes without
    an edge are not returned. Loops and null ends are ignored.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = edges.where(F.col("u") != F.col("v"))
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("_m", "u").alias("m"))
        least = materialise(least, "least")
        large = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        least = materialise(least, "least")
        joined = large.join(least, F.col("u") == F.col("_u"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()
        edges = materialise(small, "small-star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
