"""Registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_pairs, embedding_dedup, hard_negatives, html_text, katz, lexical_search, mixing, near_dedup, pieces, secrets, toxicity, url_filters
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return add


@query("op4_secret_scans")
def op4_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(table(spark, folder, "documents"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS m FROM documents),
t AS (SELECT *, ('0x' || substr(m, 1, 8))::BIGINT * 1048576 + ('0x' || substr(m, 9, 5))::BIGINT AS draw FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, sum(cap) OVER q - cap AS held, sum(weight) OVER () - (sum(weight) OVER q - weight) AS open,
    sum(source_size) OVER () AS total FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
r AS (SELECT max((total - held) / open) FILTER ((total - held) / open * weight <= cap) AS rate FROM o),
g AS (SELECT source, source_size, least(cap, weight * coalesce(rate, 0)) AS target FROM w, r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM g),
i AS (SELECT t.source, ceil(sqrt(size))::BIGINT AS imp, sum(size)::BIGINT AS words, any_value(target - whole * source_size) AS rest
  FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source WHERE size > 0 GROUP BY 1, 2),
c AS (SELECT source, imp, (rest - (sum(words) OVER (PARTITION BY source ORDER BY imp DESC ROWS UNBOUNDED PRECEDING) - words))
    / sum(imp * words) OVER (PARTITION BY source ORDER BY imp ROWS UNBOUNDED PRECEDING)::DOUBLE AS rate FROM i),
f AS (SELECT source, arg_max(rate, imp) FILTER (rate * imp < 1) AS rate FROM c GROUP BY source),
h AS (SELECT t.*, source_size, target, whole, target - whole * source_size AS rest, (draw + 0.5) / 4503599627370496.0::DOUBLE AS u,
    least(1.0::DOUBLE, coalesce(f.rate, 0) * ceil(sqrt(size))) AS odds
  FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source LEFT JOIN f ON t.source IS NOT DISTINCT FROM f.source),
e AS (SELECT *, CASE WHEN odds >= 1 THEN 0.0::DOUBLE WHEN odds <= 0 THEN 'inf'::DOUBLE
    ELSE u / (1 - u) * (1 - odds) / odds END AS place FROM h),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST, draw, size ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
  (size * (whole + CASE WHEN size > 0 AND (upto <= rest OR (upto - size < rest AND upto - rest < rest - upto + size))
    THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""


@query("op2_source_mixing", MIX_SQL)
def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(table(spark, folder, "documents"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    out = byte_pairs.encode_documents(table(spark, folder, "documents"), decoded=True)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_embedding_dedup")
def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


SEARCH_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT r, doc_id, ts, len(ts) AS n FROM w WHERE len(ts) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
e AS (SELECT r, unnest(ts) AS term FROM d),
f AS (SELECT r, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY r, term),
i AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, c GROUP BY term, docs),
a AS (
  SELECT f.r, d.doc_id, f.term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)) AS impact
  FROM f JOIN d ON f.r = d.r, c),
s AS (
  SELECT item_id, a.r, a.doc_id, sum(weight * impact)::BIGINT AS score FROM q JOIN i ON q.term = i.term JOIN a ON q.term = a.term
  GROUP BY item_id, a.r, a.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


@query("op12_lexical_search", SEARCH_SQL)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query("op9_minhash_dedup")
def op9_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op7_katz_scores")
def op7_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score_documents(table(spark, folder, "documents"))


# The tables hold no fetch dates and no lists. Both follow from the pages by rule: a page is fetched on a day that its
# number fixes; every host, parent domain and every seventh folder has a history of three entries whose days and actions
# follow from the smallest page number seen under it.

def dated_captures(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("page_id") * 37) % 700).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """Entries for every page: its host, the domain above, its first folder, its whole path, and the folder in capitals.

    The folder's host is written in capitals, which match like small letters; those of a path do not.
    """
    host, folder = url_filters.host_of(F.col("url")), url_filters.folder_of(F.col("url"))
    segment = F.substr(folder, F.length(host) + 1)
    patterns = F.array(host, F.regexp_replace(host, r"^[^.]*\.", ""), F.concat(F.upper(host), segment),
                       url_filters.path_of(F.col("url")), F.concat(host, F.upper(segment)))
    names = pages.select("page_id", F.explode(patterns).alias("pattern"))
    seen = names.where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.min("page_id").alias("n"))
    start = F.lit("2019-12-01").cast("date")
    first = F.when(F.col("n") % 2 == 0, "block").otherwise("allow")
    history = F.array(*[F.struct(a.alias("action"), F.date_add(start, d.cast("int")).alias("listed")) for a, d in (
        (first, F.col("n") * 53 % 400), (F.lit("remove"), 200 + F.col("n") * 29 % 300), (F.lit("block"), 380 + F.col("n") * 17 % 300))])
    return seen.select("pattern", F.inline(history))


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, url, date '2020-01-01' + ((page_id * 37) % 700)::INTEGER AS fetched,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^/?#]*)?', 1)), '\.+$', ''), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^/?#]*)?', 2) AS segment
  FROM pages),
rows AS (
  SELECT *, CASE WHEN length(segment) > 1 THEN segment END AS part,
    nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+$', ''), '') AS path FROM parts),
names AS (
  SELECT page_id, unnest([host, regexp_replace(host, '^[^.]*\.', ''), upper(host) || part, host || path, host || upper(part)]) AS pattern FROM rows),
seen AS (SELECT pattern, min(page_id) AS n FROM names WHERE pattern IS NOT NULL GROUP BY pattern),
entries AS (
  SELECT pattern, CASE WHEN n % 2 = 0 THEN 'block' ELSE 'allow' END AS action, date '2019-12-01' + (n * 53 % 400)::INTEGER AS listed FROM seen
  UNION ALL SELECT pattern, 'remove', date '2019-12-01' + (200 + n * 29 % 300)::INTEGER FROM seen
  UNION ALL SELECT pattern, 'block', date '2019-12-01' + (380 + n * 17 % 300)::INTEGER FROM seen),
daily AS (
  SELECT regexp_replace(lower(split_part(pattern, '/', 1)) || substr(pattern, length(split_part(pattern, '/', 1)) + 1), '/+$', '') AS pattern,
    listed, arg_max(action, CASE action WHEN 'remove' THEN 3 WHEN 'block' THEN 2 ELSE 1 END) AS action FROM entries GROUP BY 1, 2),
spans AS (SELECT *, lead(listed) OVER (PARTITION BY pattern ORDER BY listed) AS until FROM daily),
keys AS (
  SELECT row_number() OVER () AS r, page_id, url, fetched, host,
    CASE WHEN path IS NULL THEN [] ELSE list_transform(range(len(string_split(path, '/')), 1, -1),
      lambda i: host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/')) END || list_transform(range(1, len(string_split(host, '.')) + 1),
      lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) AS ks FROM rows),
places AS (SELECT r, fetched, unnest(ks) AS k, generate_subscripts(ks, 1) AS place FROM keys),
found AS (
  SELECT p.r, arg_min(struct_pack(action := s.action, pattern := s.pattern, listed := s.listed), p.place) AS x
  FROM places p JOIN spans s ON p.k = s.pattern AND s.action <> 'remove' AND p.fetched >= s.listed AND (s.until IS NULL OR p.fetched < s.until)
  GROUP BY p.r)
SELECT page_id, url, fetched, host, coalesce(x.action, 'default') AS decision, x.pattern AS pattern, x.listed AS listed
FROM keys LEFT JOIN found ON keys.r = found.r
"""


@query("op3_url_filters", URL_SQL)
def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filters.judge(dated_captures(pages), dated_list(pages))
