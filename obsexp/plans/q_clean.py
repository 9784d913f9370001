"""Registered queries: cleaning, parsing and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.names import normalise_key
from ..operators import cleaning as cl
from ..operators.joins import match_on_key
from .registry import load, query, r6, s6


@query("dedup_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedup_rows(spark, folder):
    return cl.dedup_exact(load(spark, folder, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"])


@query("dedup_whole_rows", """
SELECT l_returnflag, count(*) AS n, sum(copies)::BIGINT AS rows_before FROM (
  SELECT *, count(*) AS copies FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem) GROUP BY ALL)
GROUP BY l_returnflag""")
def dedup_whole_rows(spark, folder):
    lines = load(spark, folder, "lineitem")
    doubled = lines.unionByName(lines)
    before = doubled.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows_before"))
    return cl.dedup_exact(doubled).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).join(before, "l_returnflag")


@query("require_fields", f"""
SELECT event_id, {s6('value')} AS value FROM events WHERE event_type <> 'error' AND value >= 1.0""")
def require_fields(spark, folder):
    events = load(spark, folder, "events").withColumn("label", F.nullif("event_type", F.lit("error")))
    blanked = cl.null_if(events, "value", F.col("value") < 1.0)
    return cl.require(blanked, ["label", "value"]).select("event_id", r6("value").alias("value"))


@query("parse_timestamps", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(epoch(ts) AS BIGINT) - CASE WHEN epoch(ts) < CAST(epoch(ts) AS BIGINT) THEN 1 ELSE 0 END END AS parsed_s
FROM events""")
def parse_timestamps(spark, folder):
    events = load(spark, folder, "events")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("bad-"), F.col("event_id").cast("string"))).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return events.select("event_id", F.unix_seconds(C.parse_ts(text)).alias("parsed_s"))


@query("parse_dates", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date FROM orders""")
def parse_dates(spark, folder):
    orders = load(spark, folder, "orders")
    day = F.upper(F.date_format("o_orderdate", "MMM dd, yyyy"))
    text = F.when(F.col("o_orderstatus") == "P", F.lit("garbage")).otherwise(F.concat(day, F.lit(" - CHA @ BKN")))
    return orders.select("o_orderkey", C.parse_date(text, cl.MATCHUP_DATE_PATTERN, cl.MATCHUP_DATE_FORMAT).alias("order_date"))


@query("clock_fields", f"""
WITH c AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE minute(ts) * 60.0 + second(ts) END AS clock,
    CASE WHEN event_type = 'signup' THEN NULL ELSE minute(ts) * 60.0 + second(ts) END AS iso_clock,
    CASE WHEN value > 60 THEN NULL ELSE value END AS short_clock FROM events),
f AS (SELECT *, short_clock IS NULL AND coalesce(clock <= 240.0, false) AS clock_off FROM c),
g AS (SELECT *, CASE WHEN clock_off THEN clock ELSE short_clock END AS filled FROM f)
SELECT event_id, {s6('clock')} AS clock, {s6('iso_clock')} AS iso_clock, {s6('filled')} AS filled, clock_off,
  CASE WHEN coalesce(filled, 24.0) <= 4 THEN 'late_clock' ELSE 'normal_clock' END AS late FROM g""")
def clock_fields(spark, folder):
    events = load(spark, folder, "events")
    text = F.when(F.col("event_type") != "error", F.date_format("ts", "m:ss"))
    iso = F.when(F.col("event_type") == "signup", F.lit("11:22")).otherwise(F.date_format("ts", "'PT'mm'M'ss'.00S'"))
    timed = events.select("event_id", C.clock_seconds(text).alias("clock"), C.clock_seconds(iso, "iso").alias("iso_clock"),
                          C.keep_if("value", F.col("value") <= 60).alias("short_clock"))
    filled, off = C.fill_from("short_clock", "clock", 240.0)
    return timed.select(
        "event_id", r6("clock").alias("clock"), r6("iso_clock").alias("iso_clock"), r6(filled).alias("filled"),
        off.alias("clock_off"), C.flag_below(filled, 4.0, 24.0, "late_clock", "normal_clock").alias("late"))


_URL = r"^https?://([^/]+)/([a-z]{2})/(\d+)"


@query("extract_url", f"""
SELECT page_id, nullif(regexp_extract(url, '{_URL}', 1), '') AS host, nullif(regexp_extract(url, '{_URL}', 2), '') AS lang,
  nullif(regexp_extract(url, '{_URL}', 3), '') AS number FROM pages""")
def extract_url(spark, folder):
    pages = load(spark, folder, "pages")
    return pages.select("page_id", *C.extract_groups("url", _URL, ["host", "lang", "number"]))


@query("bin_bands", """
WITH b AS (
  SELECT l_returnflag,
    CASE WHEN l_quantity <= 4 THEN 'at_rim' WHEN l_quantity <= 14 THEN 'short' WHEN l_quantity <= 23.75 THEN 'long' ELSE 'far' END AS open_right,
    CASE WHEN l_quantity < 0 OR l_quantity > 40 THEN NULL WHEN l_quantity <= 2 THEN '0-2' WHEN l_quantity <= 4 THEN '2-4' WHEN l_quantity <= 6 THEN '4-6' ELSE '6+' END AS with_lowest,
    CASE WHEN l_quantity < 2 THEN 'tight' WHEN l_quantity < 6 THEN 'open' WHEN l_quantity < 45 THEN 'wide' END AS closed_left
  FROM lineitem)
SELECT open_right, with_lowest, closed_left, l_returnflag, count(*) AS n FROM b GROUP BY ALL""")
def bin_bands(spark, folder):
    inf = float("inf")
    lines = load(spark, folder, "lineitem").select(
        "l_returnflag",
        C.bin_column("l_quantity", (-inf, 4, 14, 23.75, inf), ("at_rim", "short", "long", "far")).alias("open_right"),
        C.bin_column("l_quantity", (0, 2, 4, 6, 40), ("0-2", "2-4", "4-6", "6+"), include_lowest=True).alias("with_lowest"),
        C.bin_column("l_quantity", (0, 2, 6, 45), ("tight", "open", "wide"), closed="left").alias("closed_left"))
    return lines.groupBy("open_right", "with_lowest", "closed_left", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("binary_outcome", f"""
SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS made,
  {s6("avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)")} AS rate FROM orders GROUP BY 1""")
def binary_outcome(spark, folder):
    orders = load(spark, folder, "orders")
    status = F.nullif("o_orderstatus", F.lit("P"))
    return orders.withColumn("made", C.binary_outcome(status, "F")).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("made").alias("made"), r6(F.avg("made")).alias("rate"))


_PERIOD_SQL = """
  SELECT l_suppkey AS entity_id, lower(trim(l_linestatus)) AS label, l_quantity AS distance, CAST(l_linenumber >= 4 AS INTEGER) AS is_three,
    CAST(l_returnflag = 'R' AS INTEGER) AS made, CAST(l_orderkey AS VARCHAR) AS grp, {season} AS season{extra}
  FROM lineitem WHERE l_quantity <= 47 AND l_discount <= 0.09 AND year(l_shipdate) {years}"""


@query("union_periods", f"""
WITH u AS ({_PERIOD_SQL.format(season="'early'", extra=', l_tax AS tax', years='<= 1998')} UNION ALL
  {_PERIOD_SQL.format(season="'late'", extra=', NULL AS tax', years='> 1998')})
SELECT season, label, count(*) AS n, count(tax) AS n_tax, count(DISTINCT entity_id) AS entities, sum(made)::BIGINT AS made,
  sum(is_three)::BIGINT AS threes, count(DISTINCT grp) AS groups, {s6('avg(distance)')} AS mean_distance FROM u GROUP BY ALL""")
def union_periods(spark, folder):
    lines = load(spark, folder, "lineitem")
    mapping = {
        "entity_id": ("l_suppkey", "long"), "label": (F.lower(F.trim("l_linestatus")), "string"),
        "distance": ("l_quantity", "double"), "discount": ("l_discount", "double"),
        "is_three": ((F.col("l_linenumber") >= 4), "int"), "made": (C.binary_outcome("l_returnflag", "R"), "int"),
        "grp": ("l_orderkey", "string"),
    }
    bounds = {"distance": 47.0, "discount": 0.09}
    early = cl.harmonise(lines.where(F.year("l_shipdate") <= 1998), {**mapping, "tax": ("l_tax", "double")}, bounds)
    late = cl.harmonise(lines.where(F.year("l_shipdate") > 1998), mapping, bounds)
    both = early.withColumn("season", F.lit("early")).unionByName(late.withColumn("season", F.lit("late")),
                                                                  allowMissingColumns=True)
    return both.groupBy("season", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count("tax").alias("n_tax"), F.count_distinct("entity_id").alias("entities"),
        F.sum("made").alias("made"), F.sum("is_three").alias("threes"), F.count_distinct("grp").alias("groups"),
        r6(F.avg("distance")).alias("mean_distance"))


@query("confident_rows", """
SELECT doc_id, lang FROM documents WHERE abs(n_chars - length(replace(text, ' ', ''))) <= 100""")
def confident_rows(spark, folder):
    docs = load(spark, folder, "documents")
    measured = F.length(F.replace("text", F.lit(" "), F.lit("")))
    tagged = docs.withColumn("release_confidence", F.when(F.abs(F.col("n_chars") - measured) <= 100, "high").otherwise("low"))
    return cl.high_confidence(tagged).select("doc_id", "lang")


_NAMES_A = "SELECT DISTINCT p_name FROM part"
_NAMES_B = "SELECT DISTINCT upper(replace(p_name, ' ', '-')) || ' Jr.' AS other FROM part WHERE p_name NOT LIKE 'b%'"


def _name_sides(spark, folder):
    part = load(spark, folder, "part")
    ours = part.select("p_name").distinct()
    theirs = part.where(~F.col("p_name").startswith("b")).select(
        F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(" Jr.")).alias("other")).distinct()
    return ours, theirs


@query("match_names", f"""
WITH a AS ({_NAMES_A}), b AS ({_NAMES_B})
SELECT a.p_name AS key, a.p_name, b.other FROM a JOIN b ON a.p_name = lower(replace(replace(b.other, ' Jr.', ''), '-', ' '))""")
def match_names(spark, folder):
    ours, theirs = _name_sides(spark, folder)
    return match_on_key(ours, theirs, "p_name", "other")[0].select("key", "p_name", "other")


@query("match_unmatched", f"""
WITH a AS ({_NAMES_A}) SELECT p_name AS key FROM a WHERE p_name LIKE 'b%'""")
def match_unmatched(spark, folder):
    ours, theirs = _name_sides(spark, folder)
    return match_on_key(ours, theirs, "p_name", "other")[1]


@query("normalised_names", """
SELECT c_custkey, 'customer#' || substr(c_name, 10) AS key FROM customer
UNION ALL SELECT s_suppkey + 1000000000 AS c_custkey, 'oleaux ss supplier#' || substr(s_name, 10) AS key FROM supplier""")
def normalised_names(spark, folder):
    customers = load(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("  "), F.replace("c_name", F.lit("o"), F.lit("ö")), F.lit("  III")).alias("name"))
    suppliers = load(spark, folder, "supplier").select(
        (F.col("s_suppkey") + 1000000000).alias("c_custkey"),
        F.concat(F.lit("Ø'Léaux-ß. "), F.upper("s_name"), F.lit(" jr")).alias("name"))
    return customers.unionByName(suppliers).select("c_custkey", normalise_key("name").alias("key"))


@query("efficiency", f"""
WITH t AS (SELECT l_suppkey, count(*) AS n, sum(CAST(l_returnflag = 'R' AS INTEGER))::BIGINT AS made,
    sum(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber >= 4 THEN 3 ELSE 2 END ELSE 0 END)::BIGINT AS points FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, made, points, {s6('made::DOUBLE / n')} AS pct, {s6('points / 2.0 / n')} AS efg FROM t""")
def efficiency(spark, folder):
    lines = load(spark, folder, "lineitem").withColumns({
        "hit": C.binary_outcome("l_returnflag", "R"), "three": (F.col("l_linenumber") >= 4).cast("int")})
    totals = lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("made"),
                                            F.sum(C.points_for("hit", "three")).alias("points"))
    return cl.with_efficiency(totals).withColumns({"pct": r6("pct"), "efg": r6("efg")})


@query("geometry", f"""
WITH p AS (SELECT vec_id, (embedding[1]::DOUBLE + 0.5) * 94 AS x, (embedding[2]::DOUBLE + 0.5) * 50 AS y FROM embeddings),
d AS (SELECT *, sqrt((x - 5.25) ** 2 + (y - 25) ** 2) AS a, sqrt((x - 88.75) ** 2 + (y - 25) ** 2) AS b FROM p)
SELECT vec_id, {s6('least(a, b)')} AS distance, {s6('CASE WHEN a <= b THEN abs(x - 5.25) ELSE abs(x - 88.75) END')} AS depth,
  {s6('abs(y - 25)')} AS lateral FROM d""")
def geometry(spark, folder):
    at = load(spark, folder, "embeddings").select(
        "vec_id", ((F.col("embedding")[0].cast("double") + 0.5) * 94).alias("x"),
        ((F.col("embedding")[1].cast("double") + 0.5) * 50).alias("y"))
    near = C.nearest_anchor("x", "y", ((5.25, 25.0), (88.75, 25.0)))
    return at.select("vec_id", *[r6(near[n]).alias(n) for n in ("distance", "depth", "lateral")])


def event_log(spark, folder):
    """The events table written as a raw event log, with its gaps and text fields."""
    e = load(spark, folder, "events")
    code = lambda c: F.concat(F.lit("T"), F.char((F.lit(65) + c).cast("int")))
    day = F.upper(F.date_format("ts", "MMM dd, yyyy"))
    home = F.pmod("event_id", F.lit(2)) == 0
    return e.select(
        "event_id", F.to_date("ts").cast("string").alias("GAME_ID"),
        F.concat(day, F.lit(" - "), code(F.pmod("user_id", F.lit(26))), F.when(home, " vs. ").otherwise(" @ "),
                 code(F.pmod(F.col("user_id") + 1, F.lit(26)))).alias("MATCHUP"),
        F.when(home, "H").otherwise("A").alias("LOCATION"), F.date_format("ts", "m:ss").alias("GAME_CLOCK"),
        F.when(F.col("value") <= 24, F.col("value")).alias("SHOT_CLOCK"),
        F.when(F.col("event_type") == "signup", -F.col("value")).otherwise(F.col("value") / 20).alias("TOUCH_TIME"),
        (F.col("value") / 4).alias("SHOT_DIST"),
        F.when(F.col("event_type") == "purchase", "made").when(F.col("event_type") != "error", "missed").alias("SHOT_RESULT"),
        F.col("user_id").alias("player_id"),
        F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).alias("player_name"))


@query("feature_frame", f"""
WITH l AS (
  SELECT event_id, 'T' || chr((65 + user_id % 26)::INTEGER) AS actor_team, 'T' || chr((65 + (user_id + 1) % 26)::INTEGER) AS opponent_team,
    CAST(ts AS DATE) AS event_date, minute(ts) * 60.0 + second(ts) AS game_clock, CASE WHEN value <= 24 THEN value END AS sc,
    CASE WHEN event_type = 'signup' THEN -value ELSE value / 20 END AS tt, value / 4 AS dist, CAST(event_type = 'purchase' AS INTEGER) AS made
  FROM events WHERE event_type NOT IN ('error', 'view')),
m AS (SELECT *, CASE WHEN sc IS NULL AND game_clock <= 24 THEN game_clock ELSE sc END AS clock,
    sc IS NULL AND game_clock <= 24 AS off, CASE WHEN tt >= 0 THEN tt END AS touch FROM l)
SELECT event_id, actor_team, opponent_team, event_date, {s6('game_clock')} AS game_clock, {s6('clock')} AS shot_clock,
  CASE WHEN off THEN 'clock_off' ELSE 'clock_on' END AS clock_state, {s6('touch')} AS touch,
  CASE WHEN dist <= 4 THEN 'at_rim' WHEN dist <= 14 THEN 'short_midrange' WHEN dist <= 23.75 THEN 'long_midrange' ELSE 'three_plus' END AS zone,
  CASE WHEN touch <= 2 THEN 'quick' WHEN touch <= 6 THEN 'balanced' WHEN touch > 6 THEN 'hold' END AS touch_bucket,
  CASE WHEN coalesce(clock, 24) <= 4 THEN 'late_clock' ELSE 'normal_clock' END AS late, made FROM m""")
def feature_frame(spark, folder):
    out = cl.modelling_frame(event_log(spark, folder))
    return out.select(
        "event_id", "actor_team", "opponent_team", "event_date", r6("GAME_CLOCK_SECONDS").alias("game_clock"),
        r6("SHOT_CLOCK").alias("shot_clock"), F.col("SHOT_CLOCK_OFF").alias("clock_state"), r6("TOUCH_TIME").alias("touch"),
        F.col("SHOT_DIST_ZONE").alias("zone"), F.col("TOUCH_TIME_BUCKET").alias("touch_bucket"),
        F.col("LATE_CLOCK").alias("late"), "made")
