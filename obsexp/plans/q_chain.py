"""Registered queries: rows scored once and stored, and the validation chain that reads them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialise, scratch_path
from . import board as bd
from .q_stat import EFFECT, HALF_ORDER, HALF_SQL, SWEEP_SQL
from .registry import line_row_id, load, query, r6, s6, scored, with_scored


def hub(spark, folder):
    """The scored table of a folder, written once by period and read back."""
    rows = scored(spark, folder).withColumns({
        "period": F.year("l_shipdate"), "pts": C.points_for("made", (F.col("l_linenumber") >= 4).cast("int"))})
    path = scratch_path(spark, "scored")
    bd.write_scored(rows, path, "period")
    return bd.read_scored(spark, path, rows.schema)


@query("scored_hub", with_scored(f"""
SELECT year(l_shipdate) AS period, l_suppkey, count(*) AS n, sum(made)::BIGINT AS made, {s6('sum(expected)')} AS expected, {s6('sum(residual)')} AS residual
FROM scored GROUP BY 1, 2"""))
def scored_hub(spark, folder):
    return hub(spark, folder).groupBy(F.col("period").cast("long").alias("period"), "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("made").cast("long").alias("made"),
        r6(F.sum("expected")).alias("expected"), r6(F.sum("residual")).alias("residual"))


@query("reliability_report", " UNION ALL ".join(
    f"SELECT * FROM ({with_scored(halves + _select)})" for halves, _select in (
        (HALF_SQL[design], f"""
SELECT '{design}' AS design, count(*) AS n, {s6('corr(half_a, half_b)')} AS half_r,
  {s6('2 * corr(half_a, half_b) / (1 + corr(half_a, half_b))')} AS corrected FROM halves""") for design in ("alternate", "date"))))
def reliability_report(spark, folder):
    report = bd.reliability_report(hub(spark, folder), ["l_suppkey"], "l_shipdate", HALF_ORDER)
    return report.withColumns({"half_r": r6("half_r"), "corrected": r6("corrected")})


@query("stability_report", with_scored(SWEEP_SQL))
def stability_report(spark, folder):
    rows = hub(spark, folder)
    sweep = bd.stability_report(rows.where("period <= 1998"), rows.where("period > 1998"), "l_suppkey", "made", "pts")[2]
    return sweep.select("floor", "metric", "n", r6("r").alias("r"), r6("rho").alias("rho"))


def regional_board(spark, folder):
    """The board of suppliers at 2,000 replicates, with the planted effect and their region as profile."""
    rows = hub(spark, folder).withColumn("residual", F.col("residual") + (F.col("l_suppkey") % 7 - 3) * F.lit(EFFECT))
    board = materialise(bd.scored_board(rows, ["l_suppkey"], line_row_id()), "board")
    home = load(spark, folder, "supplier").join(
        load(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("profile"))
    return board.join(home, F.col("l_suppkey") == F.col("s_suppkey"))


@query("fairness_report")
def fairness_report(spark, folder):
    return bd.fairness_report(regional_board(spark, folder))[0]


@query("fairness_omnibus")
def fairness_omnibus(spark, folder):
    return bd.fairness_report(regional_board(spark, folder))[1]
