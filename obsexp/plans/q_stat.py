"""Registered queries: uncertainty, reliability, association and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import poisson1_thresholds
from ..operators import aggregates as ag
from ..operators import association as st
from ..operators import joins as jn
from ..operators import ordered as od
from ..operators import panel as pn
from ..operators import shrinkage as sh
from ..operators.folds import group_folds
from ..operators.multinomial import resample
from ..operators.resampling import bootstrap, hash_bootstrap
from ..session import materialise
from .q_agg import CONTEXT_SQL, period_scores, supplier_context
from .registry import LINE_ID, banded, line_row_id, load, query, r6, s6, scored, with_scored

_U = poisson1_thresholds()
_POISSON = "CASE " + " ".join(f"WHEN u < {t!r} THEN {j}" for j, t in enumerate(_U)) + f" ELSE {len(_U)} END"
# Driver tables carry no entity effect, so one is planted: without it nothing is repeatable and shrinkage is constant.
EFFECT = 0.02
PLANTED_SQL = f""",
planted AS (SELECT * REPLACE (residual + (l_suppkey % 7 - 3) * {EFFECT} AS residual) FROM scored)"""
BOOT_SQL = PLANTED_SQL + f""",
point AS (SELECT l_suppkey, count(*) AS n, sum(residual) AS oe_total, avg(residual) AS oe_rate FROM planted GROUP BY 1 HAVING count(*) >= 150),
ids AS (SELECT l_suppkey, residual, md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, CAST(round(l_quantity * 100) AS BIGINT),
  CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))) AS row_id FROM planted),
hexed AS (SELECT l_suppkey, residual, q, md5(row_id || '|' || q || '|42') AS h FROM ids, (SELECT unnest(generate_series(0, 4)) AS q)),
draws AS (SELECT l_suppkey, residual, q * 4 + w AS rep, CAST('0x' || substr(h, 1 + 8 * w::INTEGER, 8) AS BIGINT) / 4294967296.0 AS u FROM hexed, (SELECT unnest(generate_series(0, 3)) AS w)),
reps AS (SELECT l_suppkey, rep, sum(residual * ({_POISSON})) AS wx, sum({_POISSON}) AS w FROM draws GROUP BY 1, 2),
rates AS (SELECT r.l_suppkey, n, wx::DOUBLE / w AS rate FROM reps r JOIN point USING (l_suppkey)),
spread AS (SELECT l_suppkey, quantile_cont(rate * n, 0.025) AS total_lo, quantile_cont(rate * n, 0.975) AS total_hi, stddev_samp(rate) AS oe_se FROM rates GROUP BY 1),
board AS (SELECT p.*, total_lo, total_hi, oe_se, total_lo > 0 OR total_hi < 0 AS separable FROM point p JOIN spread USING (l_suppkey))"""
DL_SQL = BOOT_SQL + """,
fixed AS (SELECT sum(oe_rate / (oe_se * oe_se)) / sum(1 / (oe_se * oe_se)) AS m FROM board),
qc AS (SELECT count(*) AS k, sum((oe_rate - m) ** 2 / (oe_se * oe_se)) AS q, sum(1 / (oe_se * oe_se)) - sum(1 / (oe_se * oe_se) ** 2) / sum(1 / (oe_se * oe_se)) AS c FROM board, fixed),
tau AS (SELECT k, greatest(0.0, (q - (k - 1)) / c) AS tau2 FROM qc),
mom AS (SELECT max(k) AS k, sum(oe_rate / (oe_se * oe_se + tau2)) / sum(1 / (oe_se * oe_se + tau2)) AS mu, max(tau2) AS tau2 FROM board, tau)"""
SHRUNK_SQL = DL_SQL + """,
shrunk AS (SELECT b.*, tau2 / (tau2 + oe_se * oe_se) AS reliability, mu + tau2 / (tau2 + oe_se * oe_se) * (oe_rate - mu) AS rate_shrunk,
  (mu + tau2 / (tau2 + oe_se * oe_se) * (oe_rate - mu)) * n AS total_shrunk FROM board b, mom)"""


def stored_scores(spark, folder):
    """What the md5 board and the split halves read of the scored rows, stored for a query that shows both."""
    numbers = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return materialise(scored(spark, folder).select(*LINE_ID, *numbers, "l_shipdate", "residual"), "scored")


def planted(spark, folder, rows=None):
    rows = scored(spark, folder) if rows is None else rows
    return rows.withColumn("residual", F.col("residual") + (F.col("l_suppkey") % 7 - 3) * F.lit(EFFECT))


def board_md5(spark, folder, rows=None):
    return hash_bootstrap(planted(spark, folder, rows), ["l_suppkey"], "residual", line_row_id(), 20)


def shrunk(spark, folder, rows=None):
    return sh.shrink(board_md5(spark, folder, rows))


_BOARD = ("total_lo", "total_hi", "oe_total")


@query("bootstrap_md5", with_scored(BOOT_SQL + f"""
SELECT l_suppkey, n, {s6('oe_total')} AS oe_total, {s6('total_lo')} AS total_lo, {s6('total_hi')} AS total_hi, {s6('oe_rate')} AS oe_rate, {s6('oe_se')} AS oe_se, separable FROM board"""))
def bootstrap_md5(spark, folder):
    return board_md5(spark, folder).withColumns({c: r6(c) for c in ("oe_total", "total_lo", "total_hi", "oe_rate", "oe_se")})


def _scrambled(name: str, source: str, number: str, keep: str) -> str:
    """CTEs that end in ``name``: the columns ``keep`` and the scrambled 32-bit number ``h``."""
    return f"""{name}_a AS (SELECT {keep}, {number} AS h FROM {source}),
{name}_b AS (SELECT {keep}, (xor(h, h >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT AS h FROM {name}_a),
{name}_c AS (SELECT {keep}, (xor(h, h >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT AS h FROM {name}_b),
{name} AS (SELECT {keep}, xor(h, h >> 16) AS h FROM {name}_c)"""


# Entities of one leaf: a thousand rows or fewer, as all suppliers of the driver tables have.
_RESAMPLE = with_scored(BOOT_SQL.split("hexed AS")[0] + f"""
placed AS (SELECT l_suppkey, residual, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST('0x' || substr(row_id, 1, 15) AS BIGINT), residual) - 1 AS place FROM ids),
{_scrambled('leaf', 'point', "CAST('0x' || substr(md5(l_suppkey || '|42'), 1, 8) AS BIGINT)", 'l_suppkey, n')},
many AS (SELECT l_suppkey, n, h AS start, unnest(generate_series(1, 200)) AS rep FROM leaf),
{_scrambled('begun', 'many', '(start + rep * 2654435761) % 4294967296', 'l_suppkey, n, rep')},
series AS (SELECT unnest(generate_series(1, 1024)) AS j),
{_scrambled('cols', 'series', '(j * 2654435761) % 4294967296', 'j')},
pairs AS (SELECT l_suppkey, n, rep, xor(begun.h, cols.h) AS both_h FROM begun JOIN cols ON j <= n),
{_scrambled('drawn', 'pairs', 'both_h', 'l_suppkey, n, rep')},
sums AS (SELECT d.l_suppkey, n, rep, sum(residual) AS total FROM drawn d JOIN placed p ON d.l_suppkey = p.l_suppkey AND (d.h * n) >> 32 = p.place GROUP BY 1, 2, 3),
spread AS (SELECT l_suppkey, quantile_cont(total, 0.025) AS total_lo, quantile_cont(total, 0.975) AS total_hi, stddev_samp(total / n) AS oe_se FROM sums GROUP BY 1)
SELECT l_suppkey, n, {s6('oe_total')} AS oe_total, {s6('total_lo')} AS total_lo, {s6('total_hi')} AS total_hi, {s6('oe_rate')} AS oe_rate, {s6('oe_se')} AS oe_se,
  total_lo > 0 OR total_hi < 0 AS separable FROM point JOIN spread USING (l_suppkey)""")


@query("bootstrap_multinomial", _RESAMPLE)
def bootstrap_multinomial(spark, folder):
    out = resample(planted(spark, folder), ["l_suppkey"], "residual", line_row_id(), 200)
    return out.withColumns({c: r6(c) for c in ("oe_total", "total_lo", "total_hi", "oe_rate", "oe_se")})


@query("bootstrap_poisson")
def bootstrap_poisson(spark, folder):
    return bootstrap(scored(spark, folder), ["l_suppkey"], "residual", line_row_id(), 2000)


@query("random_effects", with_scored(DL_SQL + f" SELECT k, {s6('mu', 9)} AS mu, {s6('tau2', 12)} AS tau2 FROM mom"))
def random_effects(spark, folder):
    return sh.dersimonian_laird(board_md5(spark, folder)).select("k", r6("mu", 9).alias("mu"), r6("tau2", 12).alias("tau2"))


@query("shrink", with_scored(SHRUNK_SQL + f"""
SELECT l_suppkey, n, {s6('reliability')} AS reliability, {s6('rate_shrunk')} AS rate_shrunk, {s6('total_shrunk', 4)} AS total_shrunk FROM shrunk"""))
def shrink(spark, folder):
    return shrunk(spark, folder).select("l_suppkey", "n", r6("reliability").alias("reliability"),
                                        r6("rate_shrunk").alias("rate_shrunk"), r6("total_shrunk", 4).alias("total_shrunk"))


@query("board_summary", with_scored(SHRUNK_SQL + f"""
SELECT count(*) AS n_entities, count(*) FILTER (WHERE separable) AS n_separable, {s6('avg(n)')} AS mean_events, {s6('avg((total_hi - total_lo) / 2)')} AS mean_half_width,
  {s6('avg(oe_rate)')} AS mean_rate, {s6('min(reliability)')} AS reliability_min, {s6('max(reliability)')} AS reliability_max, {s6('quantile_cont(n::DOUBLE, 0.5)')} AS median_events,
  {s6('quantile_cont(reliability, 0.5)')} AS reliability_median FROM shrunk"""))
def board_summary(spark, folder, rows=None):
    out = ag.board_summary(shrunk(spark, folder, rows))
    return out.select("n_entities", "n_separable", *[r6(F.col(c).cast("double")).alias(c) for c in (
        "mean_events", "mean_half_width", "mean_rate", "reliability_min", "reliability_max", "median_events",
        "reliability_median")])


_LEADER = with_scored(SHRUNK_SQL + f"""
SELECT l_suppkey, n_name, n, {s6('total_shrunk', 4)} AS total_shrunk, {s6('total_lo')} AS total_lo, {s6('total_hi')} AS total_hi, separable,
  {s6('avg(CAST(separable AS INTEGER)) OVER ()')} AS separable_share
FROM shrunk JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n >= 300
ORDER BY round(shrunk.total_shrunk, 4) DESC, l_suppkey LIMIT 20""")


@query("leaderboard", _LEADER)
def leaderboard(spark, folder):
    dims = [jn.Dimension(load(spark, folder, "supplier"), [("l_suppkey", "s_suppkey")], ["s_nationkey"]),
            jn.Dimension(load(spark, folder, "nation"), [("s_nationkey", "n_nationkey")], ["n_name"])]
    entities = materialise(shrunk(spark, folder), "board")
    share = entities.where("n >= 300").agg(F.avg(F.col("separable").cast("int"))).scalar()
    view = jn.enrich(entities.where("n >= 300"), dims).select(
        "l_suppkey", "n_name", "n", r6("total_shrunk", 4).alias("total_shrunk"), r6("total_lo").alias("total_lo"),
        r6("total_hi").alias("total_hi"), "separable", r6(share).alias("separable_share"))
    return od.top_k(view, 20, [F.desc("total_shrunk"), F.asc("l_suppkey")])


@query("entity_card", with_scored(SHRUNK_SQL + f""",
pct AS (SELECT *, (rank() OVER (ORDER BY rate_shrunk) + (count(*) OVER (PARTITION BY rate_shrunk) - 1) / 2.0) / count(*) OVER () AS percentile FROM shrunk),
late AS (SELECT l_suppkey, count(*) AS n_late, avg(residual) AS late_rate FROM scored WHERE year(l_shipdate) > 1998 GROUP BY 1 HAVING count(*) >= 100)
SELECT l_suppkey, n, {s6('rate_shrunk')} AS rate_shrunk, {s6('percentile')} AS percentile, n_late, {s6('late_rate')} AS late_rate
FROM pct LEFT JOIN late USING (l_suppkey) WHERE l_suppkey = 7"""))
def entity_card(spark, folder):
    entities = materialise(board_md5(spark, folder), "board")
    ranked = od.with_ranks(sh.shrink(entities, store=False), {"percentile": ("rate_shrunk", "percent", False)})
    late = scored(spark, folder).where(F.year("l_shipdate") > 1998).groupBy(F.col("l_suppkey").alias("_k")).agg(
        F.count(F.lit(1)).alias("n_late"), F.avg("residual").alias("late_rate")).where("n_late >= 100")
    card = ranked.where("l_suppkey = 7").join(late, F.col("l_suppkey") == F.col("_k"), "left")
    return card.select("l_suppkey", "n", r6("rate_shrunk").alias("rate_shrunk"),
                       r6("percentile").alias("percentile"), "n_late", r6("late_rate").alias("late_rate"))


_HALF_ALT = """,
seq AS (SELECT l_suppkey, residual, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1) % 2 AS half FROM scored),
halves AS (SELECT l_suppkey, count(*) AS n, avg(residual) FILTER (WHERE half = 0) AS half_a, avg(residual) FILTER (WHERE half = 1) AS half_b FROM seq GROUP BY 1 HAVING count(*) >= 150)"""
_HALF_DATE = """,
mid AS (SELECT l_suppkey, quantile_cont(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))::DOUBLE, 0.5) AS m FROM scored GROUP BY 1),
halves AS (SELECT l_suppkey, count(*) AS n, avg(residual) FILTER (WHERE date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) <= m) AS half_a,
  avg(residual) FILTER (WHERE date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) > m) AS half_b FROM scored JOIN mid USING (l_suppkey) GROUP BY 1 HAVING count(*) >= 150)"""
_HALF_OUT = f" SELECT l_suppkey, n, {s6('half_a')} AS half_a, {s6('half_b')} AS half_b FROM halves"
_ORDER = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
          "l_linestatus"]
HALF_SQL, HALF_ORDER = {"alternate": _HALF_ALT, "date": _HALF_DATE}, _ORDER


def halves(spark, folder, design, rows=None):
    rows = scored(spark, folder) if rows is None else rows
    return sh.split_half(rows, ["l_suppkey"], "residual", "l_shipdate", _ORDER, design)


@query("split_half_alternate", with_scored(_HALF_ALT + _HALF_OUT))
def split_half_alternate(spark, folder):
    return halves(spark, folder, "alternate").withColumns({"half_a": r6("half_a"), "half_b": r6("half_b")})


@query("split_half_date", with_scored(_HALF_DATE + _HALF_OUT))
def split_half_date(spark, folder):
    return halves(spark, folder, "date").withColumns({"half_a": r6("half_a"), "half_b": r6("half_b")})


@query("half_correlation", with_scored(_HALF_ALT + f"""
SELECT 'alternate' AS design, count(*) AS n, {s6('corr(half_a, half_b)')} AS half_r, {s6('2 * corr(half_a, half_b) / (1 + corr(half_a, half_b))')} AS corrected FROM halves"""))
def half_correlation(spark, folder, rows=None):
    return sh.half_correlation(halves(spark, folder, "alternate", rows), "alternate").withColumns(
        {"half_r": r6("half_r"), "corrected": r6("corrected")})


def _period(years, floor):
    return f"""SELECT l_suppkey, count(*) AS n, avg(made) AS pct, avg(expected) AS expected_pct, avg(made) - avg(expected) AS oe_rate,
  sum(CASE WHEN made = 1 THEN CASE WHEN l_linenumber >= 4 THEN 3 ELSE 2 END ELSE 0 END) / 2.0 / count(*) AS efg, min(l_linestatus) AS label
  FROM scored WHERE year(l_shipdate) {years} GROUP BY 1 HAVING count(*) >= {floor}"""


_PANEL = f""",
early AS ({_period('<= 1998', 100)}), late AS ({_period('> 1998', 100)}),
panel AS (SELECT e.l_suppkey, e.label, e.n AS n_a, e.pct AS pct_a, e.efg AS efg_a, e.oe_rate AS oe_a, l.n AS n_b, l.pct AS pct_b, l.efg AS efg_b, l.oe_rate AS oe_b FROM early e JOIN late l USING (l_suppkey))"""


def panelled(spark, folder, floor=100):
    lines = scored(spark, folder)
    early = period_scores(lines, F.year("l_shipdate") <= 1998, floor)
    late = period_scores(lines, F.year("l_shipdate") > 1998, floor)
    return early, late, pn.panel(early, late, "l_suppkey", floor, shared=["l_linestatus"])


@query("panel", with_scored(_PANEL + f"""
SELECT l_suppkey, label AS l_linestatus, n_a, n_b, {', '.join(f"{s6(f'{c}_{x}')} AS {c}_{x}" for c in ('pct', 'efg') for x in 'ab')}, {s6('oe_a')} AS oe_rate_a, {s6('oe_b')} AS oe_rate_b FROM panel"""))
def panel(spark, folder):
    return panelled(spark, folder)[2].select(
        "l_suppkey", "l_linestatus", "n_a", "n_b",
        *[r6(c).alias(c) for c in ("pct_a", "pct_b", "efg_a", "efg_b", "oe_rate_a", "oe_rate_b")])


def _rank(c):
    return f"(rank() OVER (PARTITION BY floor ORDER BY {c}) + (count(*) OVER (PARTITION BY floor, {c}) - 1) / 2.0)"


SWEEP_SQL = f""",
early AS ({_period('<= 1998', 50)}), late AS ({_period('> 1998', 50)}),
swept AS (SELECT floor, e.pct AS pct_a, e.efg AS efg_a, e.oe_rate AS oe_rate_a, l.pct AS pct_b, l.efg AS efg_b, l.oe_rate AS oe_rate_b
  FROM early e JOIN late l USING (l_suppkey), (SELECT unnest([50, 100, 150, 200, 250]) AS floor) WHERE e.n >= floor AND l.n >= floor),
rk AS (SELECT *, {', '.join(f"{_rank(f'{m}_{x}')} AS r_{m}_{x}" for m in ('pct', 'efg', 'oe_rate') for x in 'ab')} FROM swept)
""" + " UNION ALL ".join(f"SELECT floor, '{m}' AS metric, count(*) AS n, {s6(f'corr({m}_a, {m}_b)')} AS r, {s6(f'corr(r_{m}_a, r_{m}_b)')} AS rho FROM rk GROUP BY 1"
                        for m in ("pct", "efg", "oe_rate"))


@query("threshold_sweep", with_scored(SWEEP_SQL))
def threshold_sweep(spark, folder):
    early, late, _ = panelled(spark, folder, 50)
    out = pn.threshold_sweep(early, late, "l_suppkey", ["pct", "efg", "oe_rate"], p_value=False)
    return out.select("floor", "metric", "n", r6("r").alias("r"), r6("rho").alias("rho"))


@query("panel_correlations")
def panel_correlations(spark, folder):
    return pn.panel_correlations(panelled(spark, folder)[2], ["oe_rate", "pct", "efg"])


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_quantity", "made")]
_LINE = "l AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS made FROM lineitem)"


@query("pearson", f"WITH {_LINE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {s6(f'corr({a}, {b})')} AS r, count(*) AS n FROM l" for a, b in _PAIRS))
def pearson(spark, folder):
    return st.pearson(banded(load(spark, folder, "lineitem")), _PAIRS, p_value=False).withColumn("r", r6("r"))


@query("pearson_test")
def pearson_test(spark, folder):
    return st.pearson(banded(load(spark, folder, "lineitem")), _PAIRS)


def _ranks(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("spearman", f"WITH {_LINE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {s6('corr(x, y)')} AS rho, count(*) AS n FROM (SELECT {_ranks(a)} AS x, {_ranks(b)} AS y FROM l)"
    for a, b in _PAIRS))
def spearman(spark, folder):
    out = st.spearman(banded(load(spark, folder, "lineitem")), _PAIRS, p_value=False)
    return out.select("a", "b", r6("rho").alias("rho"), "n")


@query("spearman_test")
def spearman_test(spark, folder):
    return st.spearman(banded(load(spark, folder, "lineitem")), _PAIRS)


# supplier estimates with a closed-form standard error, grouped by nation
_EST = """est AS (SELECT l_suppkey, s_nationkey, n_regionkey, count(*) AS n, avg(CAST(l_returnflag = 'R' AS INTEGER)) - 0.33 AS oe_rate,
  stddev_samp(CAST(l_returnflag = 'R' AS INTEGER)) / sqrt(count(*)) AS oe_se, avg(l_quantity) AS x1, avg(l_discount) AS x2, avg(l_tax) AS x3
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


def estimates(spark, folder):
    lines = banded(load(spark, folder, "lineitem"))
    by = lines.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("made") - 0.33).alias("oe_rate"),
        (F.stddev_samp("made") / F.sqrt(F.count(F.lit(1)))).alias("oe_se"), F.avg("l_quantity").alias("x1"),
        F.avg("l_discount").alias("x2"), F.avg("l_tax").alias("x3"))
    dims = [jn.Dimension(load(spark, folder, "supplier"), [("l_suppkey", "s_suppkey")], ["s_nationkey"]),
            jn.Dimension(load(spark, folder, "nation"), [("s_nationkey", "n_nationkey")], ["n_regionkey"])]
    return jn.enrich(by, dims)


@query("weighted_mean", f"""
WITH {_EST} SELECT n_regionkey, count(*) AS n, {s6('sum(oe_rate / (oe_se * oe_se)) / sum(1 / (oe_se * oe_se))')} AS weighted_mean, {s6('sqrt(1 / sum(1 / (oe_se * oe_se)))')} AS weighted_se FROM est GROUP BY 1""")
def weighted_mean(spark, folder):
    return st.weighted_mean_test(estimates(spark, folder), ["n_regionkey"]).select(
        "n_regionkey", "n", r6("weighted_mean").alias("weighted_mean"), r6("weighted_se").alias("weighted_se"))


@query("weighted_mean_test")
def weighted_mean_test(spark, folder):
    return st.weighted_mean_test(estimates(spark, folder), ["n_regionkey"])


@query("group_mean", f"""
WITH {_EST} SELECT n_regionkey, count(*) AS n, {s6('avg(oe_rate)')} AS mean, {s6('stddev_samp(oe_rate) / sqrt(count(*))')} AS se,
  {s6('avg(CAST(abs(oe_rate) > 1.96 * oe_se AS INTEGER))')} AS separable_share, {s6('avg(x1)')} AS mean_covariate FROM est GROUP BY 1 HAVING count(*) >= 2""")
def group_mean(spark, folder):
    e = estimates(spark, folder).withColumn("sure", F.abs("oe_rate") > 1.96 * F.col("oe_se"))
    return st.group_mean_ci(e, ["n_regionkey"], "oe_rate", "sure", "x1").select(
        "n_regionkey", "n", *[r6(c).alias(c) for c in ("mean", "se", "separable_share", "mean_covariate")])


@query("group_mean_ci")
def group_mean_ci(spark, folder):
    e = estimates(spark, folder).withColumn("sure", F.abs("oe_rate") > 1.96 * F.col("oe_se"))
    return st.group_mean_ci(e, ["n_regionkey"], "oe_rate", "sure", "x1")


@query("kruskal", f"""
WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, (rank() OVER (ORDER BY round(o_totalprice / 1000)) + (count(*) OVER (PARTITION BY round(o_totalprice / 1000)) - 1) / 2.0) AS rk,
  count(*) OVER (PARTITION BY round(o_totalprice / 1000)) AS t, count(*) OVER () AS n FROM orders),
g AS (SELECT g, sum(rk) AS s, count(*) AS c, max(n)::DOUBLE AS n FROM r GROUP BY 1),
ties AS (SELECT sum(t::DOUBLE * t - 1) AS tie, max(n)::DOUBLE AS n FROM r)
SELECT {s6('(12 / (max(g.n) * (max(g.n) + 1)) * sum(s * s / c) - 3 * (max(g.n) + 1)) / (1 - max(tie) / (max(g.n) ** 3 - max(g.n)))', 4)} AS h, count(*) - 1 AS dof, max(g.n)::BIGINT AS n FROM g, ties""")
def kruskal(spark, folder):
    orders = load(spark, folder, "orders").withColumn("v", F.round(F.col("o_totalprice") / 1000))
    return st.kruskal(orders, "o_orderpriority", "v").select(r6("h", 4).alias("h"), "dof", "n")


@query("kruskal_test")
def kruskal_test(spark, folder):
    return st.kruskal(load(spark, folder, "orders"), "o_orderpriority", "o_totalprice")


@query("ols_one", f"""
WITH m AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2,
  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS mx FROM lineitem),
s AS (SELECT *, sqrt((syy - b * b * sxx) / (n - 2)) AS sd FROM m)
SELECT 'intercept' AS term, {s6('a', 3)} AS beta, {s6('sd * sqrt(1.0 / n + mx * mx / sxx)', 3)} AS se, {s6('r2')} AS r2, n FROM s UNION ALL
SELECT 'l_quantity' AS term, {s6('b', 3)} AS beta, {s6('sd / sqrt(sxx)', 3)} AS se, {s6('r2')} AS r2, n FROM s""")
def ols_one(spark, folder):
    return st.ols(load(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"]).select(
        "term", r6("beta", 3).alias("beta"), r6("se", 3).alias("se"), r6("r2").alias("r2"), "n")


def _two(y, a, b, table):
    return f"""m2 AS (SELECT count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_samp({a}) AS saa, var_samp({b}) AS sbb, covar_samp({a}, {b}) AS sab,
  covar_samp({a}, {y}) AS say, covar_samp({b}, {y}) AS sby, var_samp({y}) AS syy FROM {table}),
f2 AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM m2),
g2 AS (SELECT *, my - ba * ma - bb * mb AS b0, (ba * say + bb * sby) / syy AS r2, sqrt((syy - ba * say - bb * sby) * (n - 1) / (n - 3)) AS sd,
  (saa * sbb - sab * sab) * (n - 1) AS det FROM f2)"""


@query("ols_two", f"""
WITH {_two('l_extendedprice', 'l_quantity', 'l_discount', 'lineitem')}
SELECT 'intercept' AS term, {s6('b0', 3)} AS beta, {s6('sd * sqrt(1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)', 3)} AS se, {s6('1 - (1 - r2) * (n - 1) / (n - 3)')} AS adj_r2 FROM g2 UNION ALL
SELECT 'l_quantity', {s6('ba', 3)}, {s6('sd * sqrt(sbb / det)', 3)}, {s6('1 - (1 - r2) * (n - 1) / (n - 3)')} FROM g2 UNION ALL
SELECT 'l_discount', {s6('bb', 3)}, {s6('sd * sqrt(saa / det)', 3)}, {s6('1 - (1 - r2) * (n - 1) / (n - 3)')} FROM g2""")
def ols_two(spark, folder):
    return st.ols(load(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).select(
        "term", r6("beta", 3).alias("beta"), r6("se", 3).alias("se"), r6("adj_r2").alias("adj_r2"))


@query("ols_four")
def ols_four(spark, folder):
    return st.ols(load(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


def _swept(y, xs, table):
    """SQL of least squares on any number of columns: the moment matrix, swept on one column after the other."""
    names, k = [*xs, y], len(xs)
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    steps = [f"w0 AS (SELECT count(*) AS n, var_samp({y}) * (count(*) - 1) AS syy, " + ", ".join(
        [f"avg({c}) AS m{i}" for i, c in enumerate(names)]
        + [f"covar_samp({names[i]}, {names[j]}) * (count(*) - 1) AS {at(i, j)}" for i, j in pairs]) + f" FROM {table})"]
    for p in range(k):
        def cell(i, j):
            if i == j == p:
                return f"-1 / {at(p, p)}"
            return f"{at(i, j)} / {at(p, p)}" if p in (i, j) else f"{at(i, j)} - {at(i, p)} * {at(p, j)} / {at(p, p)}"
        kept = ", ".join(["n", "syy", *[f"m{i}" for i in range(k + 1)]])
        steps.append(f"w{p + 1} AS (SELECT {kept}, " + ", ".join(f"{cell(i, j)} AS {at(i, j)}" for i, j in pairs) + f" FROM w{p})")
    spread = " + ".join(f"m{i} * m{j} * (-{at(i, j)})" for i in range(k) for j in range(k))
    fits = [("intercept", f"m{k} - " + " - ".join(f"m{i} * {at(i, k)}" for i in range(k)), f"1.0 / n + {spread}")]
    fits += [(c, at(i, k), f"-{at(i, i)}") for i, c in enumerate(xs)]
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(
        f"SELECT '{term}' AS term, {s6(beta, 3)} AS beta, {s6(f'sqrt({at(k, k)} / (n - {k + 1}) * ({var}))', 3)} AS se, "
        f"{s6(f'1 - {at(k, k)} / syy')} AS r2, n FROM w{k}" for term, beta, var in fits)


def _terms(fit):
    return fit.select("term", r6("beta", 3).alias("beta"), r6("se", 3).alias("se"), r6("r2").alias("r2"), "n")


_FOUR = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("ols_four_terms", _swept("l_extendedprice", _FOUR, "lineitem"))
def ols_four_terms(spark, folder):
    return _terms(st.ols(load(spark, folder, "lineitem"), "l_extendedprice", _FOUR))


@query("ols_dropped_term", _swept("l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "lineitem") + """
UNION ALL SELECT 'mixed', NULL, NULL, (round((1 - a3_3 / syy)::DOUBLE, 6) + 0.0), n FROM w3""")
def ols_dropped_term(spark, folder):
    """A column that two others make up is reported without a coefficient; the others keep theirs."""
    rows = load(spark, folder, "lineitem").withColumn("mixed", F.col("l_quantity") / 50 - 3 * F.col("l_discount"))
    return _terms(st.ols(rows, "l_extendedprice", ["l_quantity", "l_discount", "mixed", "l_tax"]))


_ADJ = f"""WITH {CONTEXT_SQL}, est AS (SELECT l_suppkey, avg(CAST(l_returnflag = 'R' AS INTEGER)) - 0.33 AS oe_rate FROM lineitem GROUP BY 1),
d AS (SELECT ctx.*, oe_rate FROM ctx JOIN est USING (l_suppkey)), {_two('oe_rate', 'opponent_allowed', 'home_share', 'd')},
adj AS (SELECT l_suppkey, d.n, oe_rate - (b0 + ba * opponent_allowed + bb * home_share) + my AS adjusted, oe_rate * d.n AS total_before FROM d, g2),
rk AS (SELECT *, adjusted * n AS total_after, rank() OVER (ORDER BY total_before DESC) AS rank_before, rank() OVER (ORDER BY adjusted * n DESC) AS rank_after FROM adj)"""


def adjusted(spark, folder):
    context = supplier_context(spark, folder)
    rates = banded(load(spark, folder, "lineitem")).groupBy(F.col("l_suppkey").alias("_k")).agg(
        (F.avg("made") - 0.33).alias("oe_rate"))
    return st.residualise(context.join(rates, F.col("l_suppkey") == F.col("_k")).drop("_k"), "oe_rate",
                          ["opponent_allowed", "home_share"])


@query("residualise", _ADJ + f""" SELECT l_suppkey, n, {s6('adjusted')} AS adjusted, {s6('total_before', 4)} AS total_before, {s6('total_after', 4)} AS total_after,
  rank_before, rank_after, rank_before - rank_after AS shift FROM rk""")
def residualise(spark, folder):
    return adjusted(spark, folder).select(
        "l_suppkey", "n", r6("adjusted").alias("adjusted"), r6("total_before", 4).alias("total_before"),
        r6("total_after", 4).alias("total_after"), "rank_before", "rank_after", "shift")


@query("shift_summary", _ADJ + f""" SELECT count(*) AS n, {s6('avg(abs(rank_before - rank_after))')} AS mean_abs_shift,
  {s6('avg(abs(rank_before - rank_after)) FILTER (WHERE rank_before <= 20)')} AS top_mean_abs_shift, max(abs(rank_before - rank_after)) FILTER (WHERE rank_before <= 20) AS top_max_abs_shift,
  {s6('corr(avg_before, avg_after)')} AS spearman FROM (SELECT *, rank_before + (count(*) OVER (PARTITION BY total_before) - 1) / 2.0 AS avg_before,
    rank_after + (count(*) OVER (PARTITION BY total_after) - 1) / 2.0 AS avg_after FROM rk)""")
def shift_summary(spark, folder):
    return st.shift_summary(adjusted(spark, folder)).select(
        "n", r6("mean_abs_shift").alias("mean_abs_shift"), r6("top_mean_abs_shift").alias("top_mean_abs_shift"),
        "top_max_abs_shift", r6("spearman").alias("spearman"))


@query("incremental_r2", f"""
WITH {_two('l_extendedprice', 'l_quantity', 'l_discount', 'lineitem')},
b AS (SELECT regr_r2(l_extendedprice, l_quantity) AS r2b, corr(l_discount, l_extendedprice) AS rx, corr(l_quantity, l_extendedprice) AS rb FROM lineitem)
SELECT n, {s6('1 - (1 - r2b) * (n - 1) / (n - 2)')} AS adj_r2_base, {s6('1 - (1 - r2) * (n - 1) / (n - 3)')} AS adj_r2_full,
  {s6('(1 - (1 - r2) * (n - 1) / (n - 3)) - (1 - (1 - r2b) * (n - 1) / (n - 2))', 9)} AS gain, {s6('bb', 3)} AS extra_beta, {s6('rx')} AS r_extra, {s6('rb')} AS r_base FROM g2, b""")
def incremental_r2(spark, folder):
    out = st.incremental_r2(load(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"], "l_discount")
    return out.select("n", r6("adj_r2_base").alias("adj_r2_base"), r6("adj_r2_full").alias("adj_r2_full"),
                      r6("gain", 9).alias("gain"), r6("extra_beta", 3).alias("extra_beta"), r6("r_extra").alias("r_extra"),
                      r6("r_base").alias("r_base"))


def _oe_estimates(spark, folder):
    return planted(spark, folder).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("made").alias("actual_rate"), F.avg("expected").alias("expected_rate"),
        F.avg("residual").alias("oe_rate"), (F.stddev_samp("residual") / F.sqrt(F.count(F.lit(1)))).alias("oe_se"))


_OE_EST = PLANTED_SQL + """,
board AS (SELECT l_suppkey, count(*) AS n, avg(made) AS actual_rate, avg(expected) AS expected_rate, avg(residual) AS oe_rate, stddev_samp(residual) / sqrt(count(*)) AS oe_se FROM planted GROUP BY 1)""" + DL_SQL[len(BOOT_SQL):]


@query("variance_share", with_scored(_OE_EST + f"""
SELECT {s6('corr(actual_rate, expected_rate) ** 2')} AS r2_expected, {s6('corr(expected_rate, oe_rate)')} AS corr_expected_oe, {s6('var_samp(oe_rate)', 9)} AS var_oe_rate,
  {s6('max(mom.tau2)', 9)} AS tau2, {s6('max(mom.tau2) / var_samp(oe_rate)')} AS repeatable_share,
  (SELECT {s6('var_samp(residual)', 9)} FROM scored) AS residual_variance FROM board, mom"""))
def variance_share(spark, folder):
    entities = materialise(_oe_estimates(spark, folder), "entities")
    single = scored(spark, folder).agg(F.var_samp("residual")).scalar()
    out = st.variance_share(entities, sh.dersimonian_laird(entities, store=False), single)
    return out.select(r6("r2_expected").alias("r2_expected"), r6("corr_expected_oe").alias("corr_expected_oe"),
                      r6("var_oe_rate", 9).alias("var_oe_rate"), r6("tau2", 9).alias("tau2"),
                      r6("repeatable_share").alias("repeatable_share"), r6("residual_variance", 9).alias("residual_variance"))


@query("n_for_reliability", with_scored(_OE_EST + f""",
s AS (SELECT var_samp(residual) AS s2 FROM scored),
need AS (SELECT r AS reliability, CASE WHEN tau2 > 0 THEN CAST(round(s2 * r / ((1 - r) * tau2)) AS BIGINT) END AS events_needed FROM s, mom, (SELECT unnest([0.5::DOUBLE, 0.6, 0.7, 0.8]) AS r))
SELECT reliability, events_needed, {s6('avg(CAST(n >= events_needed AS INTEGER))')} AS share_reaching FROM need, board GROUP BY 1, 2"""))
def n_for_reliability(spark, folder):
    lines = scored(spark, folder)
    entities = materialise(_oe_estimates(spark, folder), "entities")
    s2 = lines.agg(F.var_samp("residual")).scalar()
    tau2 = sh.dersimonian_laird(entities, store=False).select("tau2").scalar()
    out = st.n_for_reliability(entities, s2, tau2)
    return out.withColumn("share_reaching", r6("share_reaching"))


@query("folds_hash", """
SELECT CAST(CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS n, count(DISTINCT l_orderkey) AS groups,
  sum(CAST(l_returnflag = 'R' AS INTEGER))::BIGINT AS made FROM lineitem GROUP BY 1""")
def folds_hash(spark, folder):
    return group_folds(banded(load(spark, folder, "lineitem")), "l_orderkey", 5, 42, hash_method="md5").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("groups"), F.sum("made").alias("made"))


@query("folds_balanced", """
WITH g AS (SELECT l_orderkey, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS rate, md5(CAST(l_orderkey AS VARCHAR) || '|42') AS tie FROM lineitem GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY rate, tie) - 1 AS pos FROM g),
f AS (SELECT l_orderkey, CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS fold FROM p)
SELECT l_orderkey, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM lineitem JOIN f USING (l_orderkey) GROUP BY ALL""")
def folds_balanced(spark, folder):
    folded = group_folds(banded(load(spark, folder, "lineitem")), "l_orderkey", 5, 42, "made", "balanced")
    return folded.groupBy("l_orderkey", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("cross_fit_cells", with_scored(f"""
SELECT q_band, p_band, d_band, fold, count(*) AS n, sum(made)::BIGINT AS made, {s6('max(expected)')} AS expected FROM scored GROUP BY ALL"""))
def cross_fit_cells(spark, folder):
    return scored(spark, folder).groupBy("q_band", "p_band", "d_band", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("made").alias("made"), r6(F.max("expected")).alias("expected"))
