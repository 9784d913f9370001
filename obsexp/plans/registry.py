"""Registered queries: a name, a DataFrame function of (spark, table folder), and the same result as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.cleaning import derive_features  # noqa: F401  (re-exported for the query modules)
from ..session import apply_runtime_conf
from .board import score_by_cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return add


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table as it is: they hold no NaN, so the rule that turns NaN into NULL is left to the readers."""
    apply_runtime_conf(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def s6(expr: str, places: int = 6) -> str:
    """The SQL side of ``r6``; adding zero turns a negative zero positive."""
    return f"(round(({expr})::DOUBLE, {places}) + 0.0)"


# The event role: lineitem rows, success when returned, difficulty cells from quantity, price and discount.
QUANTITY = ((-float("inf"), 10.0, 25.0, 40.0, float("inf")), ("q1", "q2", "q3", "q4"))
PRICE = ((-float("inf"), 20000.0, 40000.0, 60000.0, float("inf")), ("p1", "p2", "p3", "p4"))
DISCOUNT = ((0.0, 0.025, 0.055, 0.085, 0.2), ("d1", "d2", "d3", "d4"))
CELLS = ("q_band", "p_band", "d_band")
LINE_ID = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
SEED = 42


def banded(lines: DataFrame) -> DataFrame:
    return lines.withColumns({
        "made": C.binary_outcome("l_returnflag", "R"),
        "q_band": C.bin_column("l_quantity", *QUANTITY),
        "p_band": C.bin_column("l_extendedprice", *PRICE),
        "d_band": C.bin_column("l_discount", *DISCOUNT, include_lowest=True),
    })


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitem with cross-fitted cell-mean expectations; the md5 folds can be repeated in SQL."""
    return score_by_cells(banded(load(spark, folder, "lineitem")), "l_orderkey", "made", CELLS, 5, SEED, "md5")


def line_row_id() -> list[Column]:
    """Columns that tell lineitem rows apart, as whole numbers and text."""
    cents = [F.round(F.col(c) * 100).cast("long") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return [*[F.col(c) for c in LINE_ID], *cents, F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))]


SCORED = """
base AS (
  SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS made,
    CASE WHEN l_quantity <= 10 THEN 'q1' WHEN l_quantity <= 25 THEN 'q2' WHEN l_quantity <= 40 THEN 'q3' ELSE 'q4' END AS q_band,
    CASE WHEN l_extendedprice <= 20000 THEN 'p1' WHEN l_extendedprice <= 40000 THEN 'p2'
         WHEN l_extendedprice <= 60000 THEN 'p3' ELSE 'p4' END AS p_band,
    CASE WHEN l_discount < 0 OR l_discount > 0.2 THEN NULL WHEN l_discount <= 0.025 THEN 'd1' WHEN l_discount <= 0.055 THEN 'd2'
         WHEN l_discount <= 0.085 THEN 'd3' ELSE 'd4' END AS d_band,
    CAST(CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold
  FROM lineitem),
cell_sums AS (SELECT q_band, p_band, d_band, fold, count(*) AS n, sum(made) AS s FROM base GROUP BY ALL),
cell_priors AS (
  SELECT *, (sum(s) OVER () - sum(s) OVER (PARTITION BY fold))::DOUBLE / (sum(n) OVER () - sum(n) OVER (PARTITION BY fold)) AS prior,
    sum(s) OVER (PARTITION BY q_band, p_band, d_band) - s AS os, sum(n) OVER (PARTITION BY q_band, p_band, d_band) - n AS onn
  FROM cell_sums),
scored AS (
  SELECT base.*, (os::DOUBLE + 20.0 * prior) / (onn::DOUBLE + 20.0) AS expected,
    made - (os::DOUBLE + 20.0 * prior) / (onn::DOUBLE + 20.0) AS residual
  FROM base JOIN cell_priors c ON base.q_band IS NOT DISTINCT FROM c.q_band AND base.p_band IS NOT DISTINCT FROM c.p_band
    AND base.d_band IS NOT DISTINCT FROM c.d_band AND base.fold = c.fold)
"""


def with_scored(rest: str) -> str:
    return f"WITH {SCORED.strip()}{rest}"
