"""Registered queries: joins and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import ordered as od
from ..operators import timejoin as tj
from .registry import banded, load, query, r6, s6, scored, with_scored

_H12 = 12 * 3600.0


@query("enrich_star", f"""
SELECT n_name, p_brand, o_orderstatus, count(*) AS n, {s6('sum(l_quantity)', 2)} AS quantity
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def enrich_star(spark, folder):
    lines = load(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity")
    dims = [
        jn.Dimension(load(spark, folder, "supplier"), [("l_suppkey", "s_suppkey")], ["s_nationkey"]),
        jn.Dimension(load(spark, folder, "nation"), [("s_nationkey", "n_nationkey")], ["n_name"]),
        jn.Dimension(load(spark, folder, "part"), [("l_partkey", "p_partkey")], ["p_brand"]),
        jn.Dimension(load(spark, folder, "orders"), [("l_orderkey", "o_orderkey")], ["o_orderstatus"]),
    ]
    return jn.enrich(lines, dims).groupBy("n_name", "p_brand", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity"), 2).alias("quantity"))


@query("enrich_composite", """
WITH g AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day, 1 AS hit FROM events WHERE value > 50)
SELECT e.event_type, count(*) AS n, count(hit) AS matched FROM events e
LEFT JOIN g ON e.user_id = g.user_id AND e.event_type = g.event_type AND CAST(e.ts AS DATE) = g.day GROUP BY 1""")
def enrich_composite(spark, folder):
    events = load(spark, folder, "events").withColumn("day", F.to_date("ts"))
    games = events.where("value > 50").withColumn("hit", F.lit(1))
    dim = jn.Dimension(games, [("user_id", "user_id"), ("event_type", "event_type"), ("day", "day")], ["hit"])
    return jn.enrich(events.select("user_id", "event_type", "day"), [dim]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("matched"))


@query("join_report", """
WITH l AS (SELECT l_orderkey AS k, count(*) AS c FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, count(*) AS c FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT sum(l.c)::BIGINT AS left_rows, sum(o.c)::BIGINT AS right_rows, sum(l.c * o.c)::BIGINT AS joined_rows,
  sum(CASE WHEN o.c IS NULL THEN l.c ELSE 0 END)::BIGINT AS left_unmatched, count(*) FILTER (WHERE l.c > 1) AS left_repeated_keys,
  count(*) FILTER (WHERE o.c > 1) AS right_repeated_keys FROM l FULL JOIN o ON l.k = o.k""")
def join_report(spark, folder):
    lines = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"))
    orders = load(spark, folder, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return jn.join_report(lines, orders, ["k"])


@query("checked_join", f"""
SELECT o_orderpriority, count(*) AS n, {s6('sum(l_quantity)', 2)} AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def checked_join(spark, folder):
    lines = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    joined = jn.checked_join(lines, orders, ["k"], ["same_rows", "unique_right", "covered"])
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity"), 2).alias("quantity"))


@query("group_mean_back", f"""
WITH m AS (SELECT l_partkey, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS allowed FROM lineitem GROUP BY 1)
SELECT l_suppkey, count(*) AS n, {s6('avg(allowed)')} AS mean_allowed, {s6('max(allowed)')} AS max_allowed
FROM lineitem JOIN m USING (l_partkey) GROUP BY 1""")
def group_mean_back(spark, folder):
    lines = banded(load(spark, folder, "lineitem"))
    return ag.group_mean_back(lines, "l_partkey", "made", "allowed").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("allowed")).alias("mean_allowed"), r6(F.max("allowed")).alias("max_allowed"))


def _timed(spark, folder):
    events = load(spark, folder, "events")
    return events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))


_T = "epoch_us(ts) / 1e6 AS t"


@query("nearest_event", f"""
WITH e AS (SELECT *, {_T} FROM events), p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'),
v AS (SELECT event_id AS vid, user_id, t AS vt FROM e WHERE event_type = 'view'),
j AS (SELECT p.event_id, vid, abs(vt - t) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(vt - t), vt, vid) AS rn
      FROM p JOIN v ON p.user_id = v.user_id AND abs(vt - t) <= {_H12})
SELECT p.user_id, p.event_id, j.vid AS match_id, {s6('j.gap', 3)} AS gap FROM p LEFT JOIN j ON p.event_id = j.event_id AND rn = 1""")
def nearest_event(spark, folder):
    e = _timed(spark, folder)
    found = tj.nearest(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "t", "t",
                       "event_id", "event_id", _H12)
    return found.withColumn("gap", r6("gap", 3))


@query("nearest_unused")
def nearest_unused(spark, folder):
    e = _timed(spark, folder)
    found = tj.nearest_unused(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "t", "t",
                              "event_id", "event_id", _H12)
    return found.select(F.col("left_id").alias("purchase_id"), F.col("right_id").alias("view_id"), r6("gap", 3).alias("gap"))


def _band(spark, folder):
    e = _timed(spark, folder)
    purchases = e.where("event_type = 'purchase'").select("user_id", "event_id", "t", F.col("value").alias("asked"))
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("t").alias("vt"), "value")
    return tj.band_join(purchases, views, ["user_id"], "t", "vt", _H12)


_BAND = f"""e AS (SELECT *, {_T} FROM events),
b AS (SELECT p.event_id, p.user_id, p.value AS asked, v.event_id AS view_id, v.value, v.t AS vt, p.t FROM e p JOIN e v
  ON p.user_id = v.user_id AND p.event_type = 'purchase' AND v.event_type = 'view' AND abs(v.t - p.t) <= {_H12})"""


@query("band_join", f"""
WITH {_BAND} SELECT event_id, count(*) AS n, {s6('sum(value)')} AS total, min(view_id) AS first_view, {s6('max(abs(vt - t))', 3)} AS widest FROM b GROUP BY 1""")
def band_join(spark, folder):
    return _band(spark, folder).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"), F.min("view_id").alias("first_view"),
        r6(F.max(F.abs(F.col("vt") - F.col("t"))), 3).alias("widest"))


@query("pick_best", f"""
WITH {_BAND}, c AS (SELECT *, abs(value - asked) AS d FROM b),
h AS (SELECT event_id, view_id, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN d <= 10 THEN 0 ELSE 1 END,
  CASE WHEN d <= 10 THEN -value ELSE d END, view_id) AS rn, CASE WHEN d <= 10 THEN 'high' ELSE 'low' END AS release_confidence FROM c)
SELECT event_id, view_id, release_confidence FROM h WHERE rn = 1""")
def pick_best(spark, folder):
    near = _band(spark, folder).withColumn("d", F.abs(F.col("value") - F.col("asked")))
    return tj.pick_release(near, ["event_id"], "d", "value", "view_id", 10.0)


_SHARE = """SELECT q_band AS bucket, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM (
  SELECT CASE WHEN l_quantity <= 10 THEN 'q1' WHEN l_quantity <= 25 THEN 'q2' WHEN l_quantity <= 40 THEN 'q3' ELSE 'q4' END AS q_band
  FROM lineitem WHERE {where}) GROUP BY 1"""


def _compared(spark, folder):
    lines = banded(load(spark, folder, "lineitem")).withColumn("bucket", F.col("q_band"))
    returned = ag.bucket_share(lines.where("l_returnflag = 'R' AND l_quantity <= 40"), "bucket", "made")
    others = ag.bucket_share(lines.where("l_returnflag <> 'R' AND l_quantity > 10"), "bucket", "made")
    return jn.compare_buckets(returned, others, "bucket")


@query("compare_buckets", f"""
WITH a AS ({_SHARE.format(where="l_returnflag = 'R' AND l_quantity <= 40")}), b AS ({_SHARE.format(where="l_returnflag <> 'R' AND l_quantity > 10")})
SELECT coalesce(a.bucket, b.bucket) AS bucket, a.n AS n_a, {s6('a.share')} AS share_a, b.n AS n_b, {s6('b.share')} AS share_b FROM a FULL JOIN b ON a.bucket = b.bucket""")
def compare_buckets(spark, folder):
    return _compared(spark, folder).select("bucket", "n_a", r6("share_pct_a").alias("share_a"), "n_b",
                                           r6("share_pct_b").alias("share_b"))


@query("mean_gap", f"""
WITH a AS ({_SHARE.format(where="l_returnflag = 'R' AND l_quantity <= 40")}), b AS ({_SHARE.format(where="l_returnflag <> 'R' AND l_quantity > 10")})
SELECT {s6('avg(abs(a.share - b.share))')} AS mean_abs_gap FROM a FULL JOIN b ON a.bucket = b.bucket""")
def mean_gap(spark, folder):
    return jn.mean_gap(_compared(spark, folder), "share_pct_a", "share_pct_b").select(r6("mean_abs_gap").alias("mean_abs_gap"))


@query("best_pair", with_scored(f""",
e AS (SELECT l_suppkey, count(*) AS n, avg(made) AS rate, avg(residual) AS score FROM scored GROUP BY 1 HAVING count(*) >= 500),
p AS (SELECT a.l_suppkey AS entity_high, b.l_suppkey AS entity_low, a.score AS score_high, b.score AS score_low, a.rate AS rate_high, b.rate AS rate_low,
  a.score - b.score AS gap FROM e a JOIN e b ON a.l_suppkey <> b.l_suppkey AND b.rate >= a.rate - 0.004 AND b.rate <= a.rate + 0.004)
SELECT entity_high, entity_low, {s6('score_high')} AS score_high, {s6('score_low')} AS score_low, {s6('rate_high')} AS rate_high,
  {s6('rate_low')} AS rate_low, {s6('gap')} AS gap FROM p ORDER BY p.gap DESC, entity_high, entity_low LIMIT 1"""))
def best_pair(spark, folder):
    entities = scored(spark, folder).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("made").alias("rate"), F.avg("residual").alias("score"))
    pair = jn.best_pair(entities, "l_suppkey", "rate", "score", 0.004, F.col("n") >= 500)
    return pair.select("entity_high", "entity_low", *[r6(c).alias(c) for c in
                                                      ("score_high", "score_low", "rate_high", "rate_low", "gap")])


@query("map_label", """
SELECT label, CASE label WHEN 0 THEN 'interior' WHEN 1 THEN 'creator' WHEN 2 THEN 'shooter' ELSE 'other' END AS profile, count(*) AS n
FROM embeddings GROUP BY ALL""")
def map_label(spark, folder):
    named = jn.map_label(load(spark, folder, "embeddings"), "label", {0: "interior", 1: "creator", 2: "shooter"}, "profile",
                         "other")
    return named.groupBy("label", "profile").agg(F.count(F.lit(1)).alias("n"))


@query("key_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark, folder):
    return od.key_difference(load(spark, folder, "documents"), load(spark, folder, "labels"), ["doc_id"])


@query("latest_row", f"""
SELECT o_custkey, o_orderkey, {s6('o_totalprice', 2)} AS o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def latest_row(spark, folder):
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    first = od.first_per_key(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return first.withColumn("o_totalprice", r6("o_totalprice", 2))
