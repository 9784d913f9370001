"""Registered queries: sources, sinks, ingest and streams. Each writes what it needs below the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators.ordered import top_k
from ..operators.timejoin import band_join
from ..session import materialise, scratch_path
from ..sources import ledger as lg
from ..sources.manifest import build_manifest, flat_manifest, test_table
from ..sources.readers import flatten_frames, read_documents, read_events_csv, read_frames, read_periods, read_table
from ..sources.writers import compact, write_table
from ..streaming import jobs
from . import q_agg, q_stat
from .q_frames import CLAIM_WINDOW_S, asking, game_events, write_documents
from .registry import banded, load, query, r6, s6, scored, with_scored


@query("csv_scan", f"""
SELECT event_type, count(*) AS n, {s6('sum(value)', 4)} AS total, max(event_id) AS last_id, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1""")
def csv_scan(spark, folder):
    events = load(spark, folder, "events").select("event_id", F.to_date("ts").alias("day"), "user_id", "event_type", "value")
    path = scratch_path(spark, "events-csv")
    write_table(events, path, "csv")
    back = read_events_csv(spark, path, "event_id long, day date, user_id long, event_type string, value double")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total"),
                                          F.max("event_id").alias("last_id"), F.min("day").alias("first_day"))


@query("table_scan", "SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last_key FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def table_scan(spark, folder):
    load(spark, folder, "orders")
    orders = read_table(spark, f"{folder}/orders.parquet", "the order export")
    return orders.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


@query("periods_scan", """
SELECT 'customer' AS season, count(*) AS n, count(c_custkey) AS customers, 0::BIGINT AS suppliers FROM customer UNION ALL
SELECT 'supplier' AS season, count(*) AS n, 0::BIGINT AS customers, count(s_suppkey) AS suppliers FROM supplier""")
def periods_scan(spark, folder):
    load(spark, folder, "customer")
    both = read_periods(spark, f"{folder}/{{customer,supplier}}.parquet", r"^(\w+)\.parquet$")
    return both.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("customers"),
                                      F.count("s_suppkey").alias("suppliers"))


@query("compact", f"""
SELECT year(l_shipdate)::INTEGER AS season, count(*) AS n, {s6("avg(CAST(l_linestatus = 'O' AS INTEGER))")} AS confident_share FROM lineitem GROUP BY 1""")
def compact_query(spark, folder):
    lines = load(spark, folder, "lineitem").withColumn("season", F.year("l_shipdate"))
    report = compact(lines, scratch_path(spark, "season"), "season", F.col("l_linestatus") == "O")
    return report.withColumn("confident_share", r6("confident_share"))


def _extract(spark):
    """Frames and per-file counts of frame documents: a unit without moments is empty, one without usable frames fails."""
    def run(todo):
        files = [row.path for row in todo.select("path").collect()]  # at most BATCH_FILES
        docs = read_documents(spark, files, multi_line=False)
        moments = F.aggregate("events", F.lit(0), lambda n, e: n + F.coalesce(F.size(e["moments"]), F.lit(0)))
        rows = flatten_frames(docs, ["file"]).select("file", "game_id", "event_id", "ts_ms")
        units = docs.groupBy("file").agg(
            F.sum(moments).alias("n_frames"), F.sum(F.size("events")).alias("n_events"),
            F.bool_or(F.col("corrupt").isNotNull()).alias("corrupt"))
        written = rows.groupBy(F.col("file").alias("_f")).agg(F.count(F.lit(1)).alias("n_rows"))
        return rows, units.join(written, F.col("file") == F.col("_f"), "left").drop("_f")
    return run


@query("ingest_new", """
SELECT count(*)::BIGINT AS rows, 0::BIGINT AS remaining, 0::BIGINT AS open_failures FROM events""")
def ingest_new(spark, folder):
    """Two runs over the same folder: the second finds nothing to do and the totals stay."""
    source, out, book = write_documents(spark, folder), scratch_path(spark, "ingested"), scratch_path(spark, "ledger")
    lg.ingest_new(spark, source, out, book, _extract(spark), "*.txt", limit=2)
    lg.ingest_new(spark, source, out, book, _extract(spark), "*.txt")
    return lg.ingest_new(spark, source, out, book, _extract(spark), "*.txt").select("rows", "remaining", "open_failures")


@query("season_gate", """
WITH e AS (SELECT count(*)::BIGINT AS n, count(DISTINCT user_id::VARCHAR || '-' || CAST(ts AS DATE)::VARCHAR)::BIGINT AS g FROM events)
SELECT 'all units' AS attempt, false AS published, 2::BIGINT AS empty, 1::BIGINT AS failed, n AS extracted, 0::BIGINT AS rows, 0::BIGINT AS games FROM e UNION ALL
SELECT 'corrupt unit withdrawn', true, 2, 1, n, n, g FROM e""")
def season_gate(spark, folder):
    """A season with a corrupt, an empty and a zero-length unit: shut while one is open, published once it is withdrawn."""
    source, out, book, routes, season = (scratch_path(spark, f"season-{c}") for c in ("in", "rows", "ledger", "routes", "out"))
    good = write_documents(spark, folder)
    docs = spark.read.text(good)
    one = docs.where(F.col("value") == docs.agg(F.min("value")).scalar()).limit(1)
    one.select(F.expr("left(value, length(value) - 9)").alias("value")).write.text(f"{source}/corrupt")
    one.select(F.regexp_replace("value", r'"moments":.*$', '"moments":[]}]}').alias("value")).write.text(f"{source}/empty")
    docs.where("value is null").limit(0).write.text(f"{source}/void")
    places, attempts = [good, f"{source}/empty", f"{source}/void"], []
    lg.ingest_new(spark, [*places, f"{source}/corrupt"], out, book, _extract(spark), "*.txt", limit=1, routes=routes)
    for name, listed in (("all units", [*places, f"{source}/corrupt"]), ("corrupt unit withdrawn", places)):
        status = lg.ingest_new(spark, listed, out, book, _extract(spark), "*.txt", routes=routes)
        done = lg.publish(spark, lg.list_units(spark, listed, "*.txt"), out, book, season)
        table = lg.read_published(spark, season).select("game_id") if done else spark.createDataFrame([], "game_id string")
        side = [lg.read_route(spark, routes, s).agg(F.count_distinct("file")).scalar() for s in ("empty", "failed")]
        size, games = table.agg(F.count(F.lit(1))).scalar(), table.agg(F.count_distinct("game_id")).scalar()
        attempts.append(status.select(
            F.lit(name).alias("attempt"), F.lit(done).alias("published"), side[0].alias("empty"), side[1].alias("failed"),
            F.col("rows").alias("extracted"), size.alias("rows"), games.alias("games")))
    return attempts[0].unionByName(attempts[1])


def _units(spark, folder):
    """Users as units: views are frames, purchases events, cheap purchases rows."""
    return load(spark, folder, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file")).agg(
        F.count_if(F.expr("event_type = 'view' AND value > 60")).alias("n_frames"),
        F.count_if(F.col("event_type") == "purchase").alias("n_events"),
        F.count_if(F.expr("event_type = 'purchase' AND value < 20")).alias("n_rows"))


_ROUTE = """u AS (SELECT 'u' || user_id::VARCHAR AS file, count(*) FILTER (WHERE event_type = 'view' AND value > 60) AS f, count(*) FILTER (WHERE event_type = 'purchase') AS e,
  count(*) FILTER (WHERE event_type = 'purchase' AND value < 20) AS r FROM events GROUP BY 1),
s AS (SELECT file, CASE WHEN f = 0 THEN 'empty' WHEN e = 0 THEN 'failed' WHEN r = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN f = 0 THEN 'no frames in any event' WHEN e = 0 THEN 'no event table' WHEN r = 0 THEN 'nothing extracted' END AS reason, r FROM u)"""


@query("route_outcomes", f"WITH {_ROUTE} SELECT file, status, reason FROM s")
def route_outcomes(spark, folder):
    return lg.route_outcomes(_units(spark, folder)).select("file", "status", "reason")


@query("ingest_status", f"""WITH {_ROUTE}, l AS (SELECT 'u' || user_id::VARCHAR AS file FROM events GROUP BY 1 UNION ALL SELECT 'c' || c_custkey::VARCHAR FROM customer)
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS extracted, count(*) FILTER (WHERE status = 'empty') AS empty, count(*) FILTER (WHERE status IS NULL OR status = 'failed') AS remaining,
  coalesce(sum(r) FILTER (WHERE status = 'ok'), 0)::BIGINT AS rows, count(*) FILTER (WHERE status = 'failed') AS open_failures FROM l LEFT JOIN s USING (file)""")
def ingest_status(spark, folder):
    units = lg.route_outcomes(_units(spark, folder))
    listing = units.select("file").unionByName(
        load(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file")))
    return lg.ingest_status(listing, units.select("file", "status", "reason", F.col("n_rows").alias("rows")))


@query("sorted_sink", f"SELECT s_suppkey, {s6('s_acctbal', 2)} AS s_acctbal FROM supplier")
def sorted_sink(spark, folder):
    path = scratch_path(spark, "suppliers")
    write_table(load(spark, folder, "supplier").select("s_suppkey", "s_acctbal"), path, order=[F.desc("s_acctbal"), "s_suppkey"])
    return read_table(spark, path, "sorted_sink").withColumn("s_acctbal", r6("s_acctbal", 2))


def _sections(spark, folder):
    board = q_agg.supplier_oe(spark, folder)
    top = top_k(board, 1, [F.desc("oe_total"), F.asc("l_suppkey")])
    return {
        "data": q_agg.profile_tables(spark, folder).select("n", "entities", "purchase_share"),
        "board": board.agg(F.count(F.lit(1)).alias("qualified"), r6(F.avg("n")).alias("mean_events")),
        "first": top.select("l_suppkey", "n", r6("oe_total").alias("oe_total")),
        "reliability": q_stat.half_correlation(spark, folder).select("half_r", "corrected"),
    }


_MANIFEST = with_scored(q_agg.OE_SQL + q_stat._HALF_ALT + f""",
d AS (SELECT count(*) AS n, count(DISTINCT user_id) AS entities, {s6("avg(CAST(event_type = 'purchase' AS INTEGER))")} AS purchase_share FROM events),
b AS (SELECT count(*) AS qualified, {s6('avg(n)')} AS mean_events FROM oe),
t AS (SELECT l_suppkey, n, {s6('actual - expected_total')} AS oe_total FROM oe ORDER BY actual - expected_total DESC, l_suppkey LIMIT 1),
h AS (SELECT {s6('corr(half_a, half_b)')} AS half_r, {s6('2 * corr(half_a, half_b) / (1 + corr(half_a, half_b))')} AS corrected FROM halves)
SELECT 'data' AS section, 'n' AS statistic, n::DOUBLE AS value FROM d UNION ALL SELECT 'data', 'entities', entities::DOUBLE FROM d UNION ALL SELECT 'data', 'purchase_share', purchase_share FROM d
UNION ALL SELECT 'board', 'qualified', qualified::DOUBLE FROM b UNION ALL SELECT 'board', 'mean_events', mean_events FROM b
UNION ALL SELECT 'first', 'l_suppkey', l_suppkey::DOUBLE FROM t UNION ALL SELECT 'first', 'n', n::DOUBLE FROM t UNION ALL SELECT 'first', 'oe_total', oe_total FROM t
UNION ALL SELECT 'reliability', 'half_r', half_r FROM h UNION ALL SELECT 'reliability', 'corrected', corrected FROM h""")


@query("manifest_flat", _MANIFEST)
def manifest_flat(spark, folder):
    return flat_manifest(_sections(spark, folder))


@query("manifest")
def manifest(spark, folder):
    return build_manifest(spark, _sections(spark, folder)).select("document")


@query("test_table", with_scored(q_stat.SHRUNK_SQL + q_stat._HALF_ALT + """
SELECT 'Error bars' AS test, printf('%d of %d entities separable', count(*) FILTER (WHERE separable), count(*)) AS headline FROM shrunk UNION ALL
SELECT 'Reliability', printf('r %.3f over %d entities, corrected %.3f', corr(half_a, half_b), count(*), 2 * corr(half_a, half_b) / (1 + corr(half_a, half_b))) FROM halves"""))
def test_rows(spark, folder):
    rows = q_stat.stored_scores(spark, folder)
    return test_table([
        ("Error bars", q_stat.board_summary(spark, folder, rows), "%d of %d entities separable", ["n_separable", "n_entities"]),
        ("Reliability", q_stat.half_correlation(spark, folder, rows), "r %.3f over %d entities, corrected %.3f",
         ["half_r", "n", "corrected"]),
    ])


def _streamed(spark, folder, table):
    stream = jobs.read_stream(spark, folder, load(spark, folder, table).schema, pattern=f"{table}.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_ingest", f"WITH {_ROUTE.replace('user_id::VARCHAR', 'event_id::VARCHAR')} SELECT status, count(*) AS n FROM s GROUP BY 1")
def stream_ingest(spark, folder):
    units = _streamed(spark, folder, "events").select(
        "event_id", F.expr("int(event_type = 'view' AND value > 60)").alias("n_frames"),
        F.expr("int(event_type = 'purchase')").alias("n_events"), F.expr("int(event_type = 'purchase' AND value < 20)").alias("n_rows"))
    root = scratch_path(spark, "stream-ingest")
    paths = {s: f"{root}/{s}" for s in ("ok", "empty", "failed")}

    def status():
        return (F.when(F.col("n_frames") == 0, "empty").when(F.col("n_events") == 0, "failed")
                .when(F.col("n_rows") == 0, "failed").otherwise("ok"))

    jobs.ingest_stream(units, status, paths["ok"], paths["empty"], paths["failed"], f"{root}/checkpoint")
    tables = [spark.read.parquet(p).select("status", "event_id") for p in paths.values()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("stream_dedup", "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def stream_dedup(spark, folder):
    events = _streamed(spark, folder, "events")
    firsts = jobs.dedup_stream(events, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
    root = scratch_path(spark, "stream-dedup")
    jobs.run_to_end(firsts, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("kinds"))


_STREAM_WINDOWS = """
WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, sum(CAST(value > 50 AS INTEGER))::BIGINT AS actual, (round(sum(0.4::DOUBLE), 6) + 0.0) AS expected_total FROM events GROUP BY 1, 2)
SELECT event_type, CAST(window_start AS DATE) AS day, n, actual, expected_total FROM w WHERE window_start + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)"""


@query("stream_running_oe", _STREAM_WINDOWS)
def stream_running_oe(spark, folder):
    """Daily windows that the watermark has closed by the end of the input."""
    events = _streamed(spark, folder, "events").withColumns({
        "hit": (F.col("value") > 50).cast("int"), "expected": F.lit(0.4)})
    out = jobs.running_oe(events, ["event_type"], "ts", "hit", "expected", "1 day", "1 hour")
    root = scratch_path(spark, "stream-oe")
    jobs.run_to_end(out, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select(
        "event_type", F.to_date("window_start").alias("day"), "n", "actual", r6("expected_total").alias("expected_total"))


@query("windowed_oe", """
SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(value > 50 AS INTEGER))::BIGINT AS actual FROM events GROUP BY 1, 2""")
def windowed_oe(spark, folder):
    """The batch form of the windowed aggregate."""
    events = load(spark, folder, "events").withColumns({"hit": (F.col("value") > 50).cast("int"), "expected": F.lit(0.4)})
    out = jobs.running_oe(events, ["event_type"], "ts", "hit", "expected", "1 day", "1 hour")
    return out.select("event_type", F.to_date("window_start").alias("day"), "n", "actual")


@query("activity_runs", """
WITH o AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o)
SELECT user_id, run::BIGINT - 1 AS place, count(*) AS n, sum(CAST(value > 50 AS INTEGER))::BIGINT AS actual FROM r GROUP BY 1, 2""")
def activity_runs(spark, folder):
    """The batch form of the activity runs, numbered in time order."""
    from ..operators.ordered import row_numbers

    events = load(spark, folder, "events").withColumns({"hit": (F.col("value") > 50).cast("int"), "expected": F.lit(0.4)})
    runs = jobs.activity_runs(events, ["user_id"], "ts", "hit", "expected", "6 hours", "1 hour")
    placed = row_numbers(runs.withColumn("day", F.to_date("run_start")), ["user_id"], "day", ["run_start"], "place")
    return placed.select("user_id", (F.col("place") - 1).alias("place"), "n", "actual")


@query("stream_claims")
def stream_claims(spark, folder):
    """Frame documents as a stream of candidates, claimed with state: every event asks for a frame of its actor within the hour."""
    path, order = write_documents(spark, folder, grouped=True), ["moment_idx", "event_id"]
    parsed = fr.dedup_frames(fr.split_roles(read_frames(spark, path, multi_line=False)), order=order)
    frames = fr.number_frames(materialise(parsed, "frames"), order=order)  # documents are parsed once
    contacts = fr.actor_contacts(frames).where(F.col("clock").isNotNull()).drop("ts_ms")
    found = band_join(asking(game_events(spark, folder)), contacts, ["game_id", "period", "actor_id"], "event_clock", "clock",
                      CLAIM_WINDOW_S)
    root = scratch_path(spark, "stream-claims")
    found.repartition("game_id").write.parquet(f"{root}/in")  # a game in one file
    claimed = jobs.claim_stream(jobs.read_stream(spark, f"{root}/in", found.schema), window=CLAIM_WINDOW_S)
    jobs.run_to_end(claimed, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")
