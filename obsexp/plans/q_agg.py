"""Registered queries: observed-versus-expected tables, descriptive aggregates, ranks and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import ordered as od
from ..operators import scores as sc
from ..operators.folds import base_rate, group_holdout
from .registry import banded, load, query, r6, s6, scored, with_scored

OE_SQL = """,
oe AS (SELECT l_suppkey, count(*) AS n, sum(made)::BIGINT AS actual, sum(expected) AS expected_total, avg(made) AS actual_rate, avg(expected) AS expected_rate
  FROM scored GROUP BY 1 HAVING count(*) >= 150)"""


def supplier_oe(spark, folder):
    return ag.oe_table(scored(spark, folder), ["l_suppkey"], floor=150)


@query("oe_by_supplier", with_scored(OE_SQL + f"""
SELECT l_suppkey, n, actual, {s6('expected_total')} AS expected_total, {s6('actual_rate')} AS actual_rate, {s6('expected_rate')} AS expected_rate,
  {s6('actual - expected_total')} AS oe_total, {s6('actual_rate - expected_rate')} AS oe_rate FROM oe"""))
def oe_by_supplier(spark, folder):
    table = supplier_oe(spark, folder)
    return table.select("l_suppkey", "n", "actual", *[r6(c).alias(c) for c in (
        "expected_total", "actual_rate", "expected_rate", "oe_total", "oe_rate")]).orderBy(F.desc("oe_total"), "l_suppkey")


@query("oe_by_two_keys", with_scored(f"""
SELECT nullif(l_returnflag, 'A') AS flag, l_linestatus, count(*) AS n, sum(made)::BIGINT AS actual, {s6('sum(made) - sum(expected)')} AS oe_total FROM scored
GROUP BY 1, 2 HAVING count(*) >= 150"""))
def oe_by_two_keys(spark, folder):
    tagged = scored(spark, folder).withColumn("flag", F.nullif("l_returnflag", F.lit("A")))
    return ag.oe_table(tagged, ["flag", "l_linestatus"], floor=150).select("flag", "l_linestatus", "n", "actual",
                                                                           r6("oe_total").alias("oe_total"))


_RANKS = """,
t AS (SELECT l_suppkey, count(*) AS n, sum(made)::BIGINT AS made, sum(CASE WHEN made = 1 THEN CASE WHEN l_linenumber >= 4 THEN 3 ELSE 2 END ELSE 0 END)::BIGINT AS points,
  sum(expected) AS expected_total FROM scored GROUP BY 1 HAVING count(*) >= 150),
k AS (SELECT *, made::DOUBLE / n AS pct, points / 2.0 / n AS efg, made::DOUBLE / n - expected_total / n AS oe_rate FROM t),
ranks AS (SELECT *, rank() OVER (ORDER BY pct DESC) AS pct_rank, rank() OVER (ORDER BY efg DESC) AS efg_rank, rank() OVER (ORDER BY oe_rate DESC) AS oe_rank FROM k)"""


def ranked_suppliers(spark, folder):
    tagged = scored(spark, folder).withColumn("pts", C.points_for("made", (F.col("l_linenumber") >= 4).cast("int")))
    return ag.rank_table(tagged, ["l_suppkey"], "made", "pts")


@query("rank_table", with_scored(_RANKS + f"""
SELECT l_suppkey, n, made, points, {s6('pct')} AS pct, {s6('efg')} AS efg, {s6('oe_rate')} AS oe_rate, pct_rank, efg_rank, oe_rank,
  pct_rank - oe_rank AS shift_vs_pct, efg_rank - oe_rank AS shift_vs_efg FROM ranks"""))
def rank_table(spark, folder):
    return ranked_suppliers(spark, folder).select(
        "l_suppkey", "n", "made", "points", r6("pct").alias("pct"), r6("efg").alias("efg"), r6("oe_rate").alias("oe_rate"),
        "pct_rank", "efg_rank", "oe_rank", "shift_vs_pct", "shift_vs_efg").orderBy(F.desc("shift_vs_pct"), "l_suppkey")


@query("movers", with_scored(_RANKS + """,
s AS (SELECT l_suppkey, pct_rank - oe_rank AS shift FROM ranks)
(SELECT 'up' AS direction, l_suppkey, shift FROM s ORDER BY shift DESC, l_suppkey LIMIT 8) UNION ALL
(SELECT 'down' AS direction, l_suppkey, shift FROM s ORDER BY shift, l_suppkey LIMIT 8)"""))
def movers(spark, folder):
    shifts = ranked_suppliers(spark, folder).select("l_suppkey", F.col("shift_vs_pct").alias("shift"))
    up = od.top_k(shifts, 8, [F.desc("shift"), F.asc("l_suppkey")])
    down = od.top_k(shifts, 8, [F.asc("shift"), F.asc("l_suppkey")])
    return up.select(F.lit("up").alias("direction"), "*").unionByName(down.select(F.lit("down").alias("direction"), "*"))


@query("sorted_board", with_scored(f"""
SELECT s_nationkey, l_suppkey, {s6('sum(residual)')} AS oe_total, row_number() OVER (PARTITION BY s_nationkey ORDER BY round(sum(residual), 6) DESC, l_suppkey) AS place
FROM scored JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""))
def sorted_board(spark, folder):
    names = load(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    board = scored(spark, folder).groupBy("l_suppkey").agg(r6(F.sum("residual")).alias("oe_total"))
    named = board.join(names, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("_chunk", F.floor(-F.col("oe_total")))
    named = named.withColumn("_down", -F.col("oe_total"))
    placed = od.row_numbers(named, ["s_nationkey"], "_chunk", ["_down", "l_suppkey"], "place")
    return placed.select("s_nationkey", "l_suppkey", "oe_total", "place").orderBy(F.asc("s_nationkey"), F.desc("oe_total"), "l_suppkey")


_SCORES = """SELECT l_suppkey, count(*) AS n, avg(made) AS pct, avg(expected) AS expected_pct,
  sum(CASE WHEN made = 1 THEN CASE WHEN l_linenumber >= 4 THEN 3 ELSE 2 END ELSE 0 END)::BIGINT AS points, min(l_linestatus) AS label
  FROM scored WHERE year(l_shipdate) {years} GROUP BY 1 HAVING count(*) >= {floor}"""


def period_scores(lines, years, floor: int = 100):
    tagged = lines.where(years).withColumn("pts", C.points_for("made", (F.col("l_linenumber") >= 4).cast("int")))
    return ag.entity_scores(tagged, "l_suppkey", "made", "pts", floor=floor, label="l_linestatus")


@query("entity_scores", with_scored(f""", p AS ({_SCORES.format(years='<= 1998', floor=100)})
SELECT l_suppkey, n, {s6('pct')} AS pct, {s6('expected_pct')} AS expected_pct, points, label AS l_linestatus, {s6('points / 2.0 / n')} AS efg, {s6('pct - expected_pct')} AS oe_rate FROM p"""))
def entity_scores(spark, folder):
    out = period_scores(scored(spark, folder), F.year("l_shipdate") <= 1998)
    return out.withColumns({c: r6(c) for c in ("pct", "expected_pct", "efg", "oe_rate")})


@query("profile_customers", f"""
SELECT o_custkey, count(*) AS n, {s6('avg(l_quantity)')} AS mean_quantity, {s6('avg(l_extendedprice)', 4)} AS mean_price,
  {s6('avg(l_tax)')} AS mean_tax, {s6('avg(CASE WHEN coalesce(l_linenumber = 3, false) THEN 1 ELSE 0 END)')} AS third_rate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) >= 20""")
def profile_customers(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = load(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = ag.entity_profile(lines, ["o_custkey"], {"mean_quantity": "l_quantity", "mean_price": "l_extendedprice",
                                                   "mean_tax": "l_tax"}, {"third_rate": F.col("l_linenumber") == 3}, 20)
    return out.select("o_custkey", "n", r6("mean_quantity").alias("mean_quantity"), r6("mean_price", 4).alias("mean_price"),
                      r6("mean_tax").alias("mean_tax"), r6("third_rate").alias("third_rate"))


CONTEXT_SQL = """m AS (SELECT l_partkey, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS allowed FROM lineitem GROUP BY 1),
ctx AS (SELECT l_suppkey, count(*) AS n, avg(allowed) AS opponent_allowed, avg(CAST(l_linestatus = 'O' AS INTEGER)) AS home_share
  FROM lineitem JOIN m USING (l_partkey) GROUP BY 1 HAVING count(*) >= 150)"""


def supplier_context(spark, folder):
    return ag.context_exposure(banded(load(spark, folder, "lineitem")), "l_suppkey", "l_partkey", "made",
                               F.col("l_linestatus") == "O")


@query("context_exposure", f"""
WITH {CONTEXT_SQL} SELECT l_suppkey, n, {s6('opponent_allowed')} AS opponent_allowed, {s6('home_share')} AS home_share FROM ctx""")
def context_exposure(spark, folder):
    return supplier_context(spark, folder).select("l_suppkey", "n", r6("opponent_allowed").alias("opponent_allowed"),
                                                  r6("home_share").alias("home_share"))


@query("calibration_bins", with_scored(f""",
ordered AS (SELECT expected, made, row_number() OVER (ORDER BY expected) - 1 AS i, count(*) OVER () AS n FROM scored),
levels AS (SELECT unnest(generate_series(1, 9)) / 10.0::DOUBLE AS q),
edges AS (SELECT DISTINCT lo + (hi - lo) * f AS e FROM (
  SELECT q, max(CASE WHEN i = floor((n - 1) * q) THEN expected END) AS lo, max(CASE WHEN i = ceil((n - 1) * q) THEN expected END) AS hi,
    max((n - 1) * q - floor((n - 1) * q)) AS f FROM ordered, levels WHERE i IN (floor((n - 1) * q), ceil((n - 1) * q)) GROUP BY q)),
v AS (SELECT expected, sum(made) AS s, count(*) AS n FROM scored GROUP BY 1),
b AS (SELECT v.*, (SELECT count(*) FROM edges WHERE e < v.expected) AS bin FROM v)
SELECT bin::INTEGER AS bin, {s6('sum(expected * n) / sum(n)')} AS mean_predicted, {s6('sum(s) / sum(n)')} AS mean_actual, sum(n)::BIGINT AS n FROM b GROUP BY 1"""))
def calibration_bins(spark, folder):
    return ag.calibration(scored(spark, folder), "expected", "made").withColumns(
        {"mean_predicted": r6("mean_predicted"), "mean_actual": r6("mean_actual")})


@query("pivot_mean", f"""
WITH b AS (SELECT CASE WHEN l_quantity <= 10 THEN 'q1' WHEN l_quantity <= 25 THEN 'q2' WHEN l_quantity <= 40 THEN 'q3' ELSE 'q4' END AS q_band,
  CASE WHEN l_discount <= 0.025 THEN 'd1' WHEN l_discount <= 0.055 THEN 'd2' WHEN l_discount <= 0.085 THEN 'd3' ELSE 'd4' END AS d, CAST(l_returnflag = 'R' AS INTEGER) AS made FROM lineitem)
SELECT q_band, {', '.join(s6(f"avg(made) FILTER (WHERE d = '{d}') * 100") + f' AS {d}' for d in ('d1', 'd2', 'd3', 'd4'))} FROM b GROUP BY 1""")
def pivot_mean(spark, folder):
    labels = ["d1", "d2", "d3", "d4"]
    grid = ag.pivot_mean(banded(load(spark, folder, "lineitem")), "q_band", "d_band", labels, "made")
    return grid.withColumns({d: r6(d) for d in labels})


@query("stratum_profile", f"""
WITH b AS (SELECT *, CASE WHEN l_quantity <= 10 THEN 'q1' WHEN l_quantity <= 25 THEN 'q2' WHEN l_quantity <= 40 THEN 'q3' ELSE 'q4' END AS q_band FROM lineitem)
SELECT q_band, count(*) AS n, {s6("avg(CAST(l_returnflag = 'R' AS INTEGER)) * 100")} AS outcome_pct, {s6('avg(l_extendedprice)', 4)} AS mean_covariate,
  {s6('avg(CAST(l_extendedprice >= 23750 AS INTEGER)) * 100')} AS share_above_pct FROM b GROUP BY 1""")
def stratum_profile(spark, folder):
    out = ag.stratum_profile(banded(load(spark, folder, "lineitem")), "q_band", "made", "l_extendedprice", 23750.0)
    return out.select("q_band", "n", r6("outcome_pct").alias("outcome_pct"), r6("mean_covariate", 4).alias("mean_covariate"),
                      r6("share_above_pct").alias("share_above_pct"))


@query("bucket_share", f"""
WITH b AS (SELECT CASE WHEN l_extendedprice <= 20000 THEN 'p1' WHEN l_extendedprice <= 40000 THEN 'p2' WHEN l_extendedprice <= 60000 THEN 'p3' ELSE 'p4' END AS p_band,
  CAST(l_returnflag = 'R' AS INTEGER) AS made FROM lineitem)
SELECT p_band, count(*) AS n, sum(made)::BIGINT AS made, {s6('sum(made) * 100.0 / count(*)')} AS rate_pct, {s6('count(*) * 100.0 / sum(count(*)) OVER ()')} AS share_pct FROM b GROUP BY 1""")
def bucket_share(spark, folder):
    return ag.bucket_share(banded(load(spark, folder, "lineitem")), "p_band", "made").withColumns(
        {"rate_pct": r6("rate_pct"), "share_pct": r6("share_pct")})


_AUC = """ranked AS (SELECT *, avg(rn) OVER (PARTITION BY {by}p) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY p) AS rn FROM long))"""


@query("calibration_gap", with_scored(f""",
long AS (SELECT CASE WHEN year(l_shipdate) <= 1998 THEN 'early' ELSE 'late' END AS period, made AS y, expected AS p FROM scored),
{_AUC.format(by='period, ', part='period')}
SELECT period, {s6('avg(p)')} AS mean_expected, {s6('avg(y)')} AS mean_actual, {s6('avg(p) - avg(y)')} AS gap,
  {s6('(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))')} AS auc FROM ranked GROUP BY 1"""))
def calibration_gap(spark, folder):
    tagged = scored(spark, folder).withColumn("period", F.when(F.year("l_shipdate") <= 1998, "early").otherwise("late"))
    return sc.calibration_gap(tagged, ["period"], "made", "expected").withColumns(
        {c: r6(c) for c in ("mean_expected", "mean_actual", "gap", "auc")})


_EPS = 2.220446049250313e-16


@query("scorecard", with_scored(f""",
flagged AS (SELECT *, CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|7'), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 AS is_test FROM scored),
base_mean AS (SELECT avg(made) AS m FROM flagged WHERE NOT is_test),
long AS (SELECT 'expected' AS model, made AS y, expected AS p FROM flagged WHERE is_test UNION ALL
  SELECT 'base_rate' AS model, made AS y, m AS p FROM flagged, base_mean WHERE is_test),
{_AUC.format(by='model, ', part='model')}
SELECT model, {s6('avg(CAST(CAST(p > 0.5 AS INTEGER) = y AS INTEGER))')} AS accuracy,
  {s6('(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))')} AS auc,
  {s6('avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END)')} AS log_loss, {s6('avg((p - y) ** 2)')} AS brier, count(*) AS n FROM ranked GROUP BY 1"""))
def scorecard(spark, folder):
    flagged = group_holdout(scored(spark, folder), "l_orderkey", 0.2, 7, "md5")
    test = base_rate(flagged, "made", ~F.col("is_test")).where("is_test")
    return sc.scorecard(test, "made", ["expected", "base_rate"]).select(
        "model", r6("accuracy").alias("accuracy"), r6("auc").alias("auc"), r6("log_loss").alias("log_loss"),
        r6("brier").alias("brier"), "n")


@query("group_holdout", """
SELECT CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 AS is_test, count(*) AS n, count(DISTINCT l_orderkey) AS groups FROM lineitem GROUP BY 1""")
def holdout(spark, folder):
    return group_holdout(load(spark, folder, "lineitem"), "l_orderkey", 0.2, 42, "md5").groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("groups"))


@query("base_rate", """
WITH f AS (SELECT *, CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 AS is_test FROM lineitem)
SELECT l_linenumber, count(*) AS n, (round(max((SELECT avg(CAST(l_returnflag = 'R' AS INTEGER)) FROM f WHERE NOT is_test)), 6) + 0.0) AS base_rate FROM f WHERE is_test GROUP BY 1""")
def base_rate_query(spark, folder):
    flagged = group_holdout(banded(load(spark, folder, "lineitem")), "l_orderkey", 0.2, 42, "md5")
    return base_rate(flagged, "made", ~F.col("is_test")).where("is_test").groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max("base_rate")).alias("base_rate"))


@query("profile_tables", f"""
SELECT count(*) AS n, count(DISTINCT user_id) AS entities, count(DISTINCT event_type) AS types, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date,
  {s6("avg(CAST(event_type = 'purchase' AS INTEGER))")} AS purchase_share FROM events""")
def profile_tables(spark, folder):
    events = load(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return ag.profile(events, {"entities": "user_id", "types": "event_type"}, "day",
                      {"purchase_share": F.col("event_type") == "purchase"}).withColumn("purchase_share", r6("purchase_share"))


@query("error_metrics", f"""
WITH d AS (SELECT n_chars::DOUBLE AS a, length(replace(text, ' ', ''))::DOUBLE AS b, lang = 'en' AS confident, length(text) % 2 = 0 AS agree FROM documents),
s AS (SELECT 'all' AS subset, * FROM d UNION ALL SELECT 'confident' AS subset, * FROM d WHERE confident)
SELECT subset, count(*) AS n, {s6('avg(abs(a - b))')} AS mae, {s6('avg(CAST(abs(a - b) <= 100 AS INTEGER))')} AS share_within, {s6('corr(a, b)')} AS pearson,
  {s6('avg(CAST(agree AS INTEGER))')} AS agreement FROM s GROUP BY 1""")
def error_metrics(spark, folder):
    docs = load(spark, folder, "documents").select(
        F.col("n_chars").cast("double").alias("a"), F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("double").alias("b"),
        (F.col("lang") == "en").alias("confident"), (F.length("text") % 2 == 0).alias("agree"))
    return ag.error_metrics(docs, "a", "b", 100.0, F.col("confident"), F.col("agree")).withColumns(
        {c: r6(c) for c in ("mae", "share_within", "pearson", "agreement")})


@query("percentile_gap", with_scored(f""",
e AS (SELECT l_suppkey, avg(residual) AS a, avg(l_extendedprice * made) AS b, round(avg(l_quantity), 0) AS c FROM scored GROUP BY 1),
r AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY a) AS ra, count(*) OVER (PARTITION BY a) AS ta, rank() OVER (ORDER BY b) AS rb, count(*) OVER (PARTITION BY b) AS tb,
  rank() OVER (ORDER BY c) AS rc, count(*) OVER (PARTITION BY c) AS tc FROM e)
SELECT l_suppkey, {s6('(ra + (ta - 1) / 2.0) / n')} AS residual_pct, {s6('(rb + (tb - 1) / 2.0) / n')} AS value_pct, {s6('(rc + (tc - 1) / 2.0) / n')} AS quantity_pct,
  {s6('(ra + (ta - 1) / 2.0) / n - (rb + (tb - 1) / 2.0) / n')} AS gap FROM r"""))
def percentile_gap(spark, folder):
    entities = scored(spark, folder).groupBy("l_suppkey").agg(
        F.avg("residual").alias("a"), F.avg(F.col("l_extendedprice") * F.col("made")).alias("b"),
        F.round(F.avg("l_quantity"), 0).alias("c"))
    ranked = od.with_ranks(entities, {"pa": ("a", "percent", False), "pb": ("b", "percent", False),
                                      "pc": ("c", "percent", False)})
    return ranked.select("l_suppkey", r6("pa").alias("residual_pct"), r6("pb").alias("value_pct"),
                         r6("pc").alias("quantity_pct"), r6(F.col("pa") - F.col("pb")).alias("gap"))


@query("sequence_parity", f"""
WITH o AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 AS half FROM events)
SELECT user_id, half::INTEGER AS half, count(*) AS n, {s6('sum(value)')} AS total FROM o GROUP BY ALL""")
def sequence_parity(spark, folder):
    events = load(spark, folder, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    chunked = od.value_bucket(events, "t", "chunk")
    return od.parity(chunked, ["user_id"], "chunk", ["t", "event_id"]).groupBy("user_id", "half").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("exact_quantiles", f"""
SELECT {s6('quantile_cont(l_extendedprice, 0.025)', 4)} AS lo, {s6('quantile_cont(l_extendedprice, 0.5)', 4)} AS mid, {s6('quantile_cont(l_extendedprice, 0.975)', 4)} AS hi FROM lineitem""")
def exact_quantiles(spark, folder):
    row = od.exact_quantiles(load(spark, folder, "lineitem"), "l_extendedprice", [0.025, 0.5, 0.975])
    return row.select(*[r6(F.col("quantiles")[i], 4).alias(n) for i, n in enumerate(("lo", "mid", "hi"))])


@query("labelled_counts", """
SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def labelled_counts(spark, folder):
    dims = [jn.Dimension(load(spark, folder, "nation"), [("s_nationkey", "n_nationkey")], ["n_name", "n_regionkey"]),
            jn.Dimension(load(spark, folder, "region"), [("n_regionkey", "r_regionkey")], ["r_name"])]
    return jn.enrich(load(spark, folder, "supplier"), dims).groupBy("n_name", "r_name").agg(
        F.count(F.lit(1)).alias("suppliers"))
