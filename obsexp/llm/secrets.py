"""Secret scans: regular patterns in every text, judged by how many owners and documents share a value across the corpus.

A value that turns up under many owners, or in many documents of one, is an example that people copy (documentation,
tutorials, default settings); a value that one or two owners hold in a few documents is most likely a live credential. Base patterns are always reported. Opaque tokens
that no base pattern covers are reported only if their corpus-wide ownership is narrow.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import stored_texts

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# (kind, pattern, group that holds the value, least length of the value). A run of the class is matched whole, so for
# the last three asking for the least length inside the pattern finds the same matches as dropping short ones after.
BASE = (
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_DISTINCT_CHARS = 8
MAX_OWNERS = 2
MAX_DOCS = 10
KINDS = ("assign", "access", "hex", "owned")
BLOCK = 256
SPANS = "array<struct<s:int,k:int,e:int,h:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a lambda body evaluates what it names again for each element."""
    return F.transform(F.array(value), body)[0]


def _append_sum(acc: Column, x: Column) -> Column:
    return F.array_append(acc, F.element_at(acc, -1) + x)


def _prefix_sums(steps: Column) -> Column:
    """Inclusive prefix sums of a non-empty int array, in blocks so that long arrays are not copied per element."""
    def blocks(a: Column) -> Column:
        count = F.floor((F.size(a) - 1) / F.lit(BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))

    def spread(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        starts = F.aggregate(sums, F.array(F.lit(0)), _append_sum)
        return _let(starts, lambda at: F.flatten(F.transform(parts, lambda p, i: _tail(
            F.aggregate(p, F.array(at[i]), _append_sum)))))

    return _let(steps, lambda a: _let(blocks(a), spread))


def _tail(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.size(a) - 1)


def _find(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches: pieces between matches give the positions of the matches."""
    lit = F.lit(pattern)

    def spans(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m")),
                            lambda z: F.length(z["g"]) + F.length(z["m"]))
        return F.transform(
            F.arrays_zip(_prefix_sums(steps).alias("e"), found.alias("m")),
            lambda z: F.struct(
                (z["e"] - F.length(z["m"])).alias("s"), F.lit(kind).alias("k"), z["e"].alias("e"),
                (F.regexp_extract(z["m"], pattern, group) if group else z["m"]).alias("h")))

    found = _let(F.regexp_extract_all(text, lit, F.lit(0)), spans)
    long_enough = F.filter(found, lambda x: F.length(x["h"]) >= least)
    return F.when(text.rlike(pattern), long_enough).otherwise(F.array().cast(SPANS))


def _opaque(text: Column, base: Column) -> Column:
    """Long tokens mixing letters and digits that touch no base span."""
    kept = F.filter(_find(text, OPAQUE, len(BASE), 0, 1), lambda x: (
        x["h"].rlike("[0-9]") & x["h"].rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(x["h"], ""))) >= MIN_DISTINCT_CHARS)))
    free = _let(base, lambda b: F.filter(kept, lambda x: ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))))
    return F.when(F.size(kept) > 0, free).otherwise(kept)


def _hashed(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"], F.sha2(x["h"], 256).alias("h")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidates(docs: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "source",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, owner, base spans and opaque candidates, values replaced by their sha256."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(owner).cast("string").alias("owner"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"), *keep)
    base = F.concat(*[_find(F.col("text"), p, i, g, n) for i, (_, p, g, n) in enumerate(BASE)])
    rows = rows.withColumn("base", base)
    rows = rows.withColumn("more", _opaque(F.col("text"), F.col("base")))
    return rows.select("doc_id", "owner", *keep, _hashed(F.col("base")).alias("base"), _hashed(F.col("more")).alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """``(h, n_docs, n_owners)``: in how many documents and under how many owners each value occurs.

    Counts combine before each shuffle: a value that every document holds leaves a task as one row per owner.
    """
    values = F.array_distinct(F.transform(F.concat("base", "more"), lambda x: x["h"]))
    each = found.select("doc_id", "owner", F.explode(values).alias("h"))
    per_doc = each.distinct()
    per_owner = per_doc.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("h").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_owners"))


def _narrow(max_owners: int, max_docs: int) -> Column:
    return (F.col("n_owners") <= max_owners) & (F.col("n_docs") <= max_docs)


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda x: x["k"] == kind


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "source",
         max_owners: int = MAX_OWNERS, max_docs: int = MAX_DOCS) -> DataFrame:
    """Spans of every document, with counts of owner-specific and widely copied values.

    Columns: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``found`` (arrays of start, kind number,
    end and value hash; ``found`` adds the opaque tokens held by at most ``max_owners`` owners in at most
    ``max_docs`` documents), ``n_live`` and ``n_copied`` (spans whose value keeps within both bounds, or doesn't).

    Null and empty texts have no spans. A null id or owner counts as one id or owner. Repeated rows each give a row, and
    count once in the ownership. Other columns are not read, so their names don't matter.
    """
    found = candidates(docs, doc, text, owner)
    # The texts are read once: what is needed later is small.
    found = materialise(found.withColumn("rid", F.monotonically_increasing_id()), "secret-candidates")
    owned = materialise(ownership(found), "secret-owners").select(
        F.col("h").alias("value"), _narrow(max_owners, max_docs).alias("narrow"))
    each = found.select("rid", F.explode(F.concat("base", "more")).alias("x"))
    judged = each.join(owned, F.col("x.h") == F.col("value")).groupBy("rid").agg(
        F.collect_list(F.when(F.col("x.k") == len(BASE), F.when(F.col("narrow"), F.col("x")))).alias("added"),
        F.count_if(F.col("narrow")).alias("n_live"),
        F.count_if(~F.col("narrow")).alias("n_copied"))
    judged = judged.withColumnRenamed("rid", "jid")
    out = found.join(judged, F.col("rid") == F.col("jid"), "left")
    none = F.array().cast(SPANS)
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *counts, "base", F.concat("base", F.coalesce("added", none)).alias("found"),
                      F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def report(docs: DataFrame, **columns) -> DataFrame:
    """``scan`` with the spans as text: ``base_sha256`` and ``spans``."""
    out = scan(docs, **columns)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                      listed(F.col("found")).alias("spans"), "n_live", "n_copied")


def redact(docs: DataFrame, mark: str = "[SECRET]", doc: str = "doc_id", text: str = "text", owner: str = "source",
           max_owners: int = MAX_OWNERS, max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``, overlapping spans by one. All columns are kept.

    Opaque values are looked up by hash: only the values of few owners and documents that actually occur are joined, per document.
    Clean documents come back unchanged, null texts stay null.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    flat = packed.select("row", F.col("row")[doc].alias("doc_id"), F.col("row")[owner].alias("source"),
                         F.col("row")[text].alias("text"))
    found = stored_texts(candidates(flat, keep=("row",)).withColumn("rid", F.monotonically_increasing_id()), "redact")
    owned = materialise(ownership(found).where(_narrow(max_owners, max_docs)), "secret-owners")
    each = found.select("rid", F.explode("more").alias("x")).join(
        owned.select(F.col("h").alias("value")), F.col("x.h") == F.col("value"))
    added = each.groupBy(F.col("rid").alias("jid")).agg(F.collect_list("x").alias("added"))
    out = found.join(added, F.col("rid") == F.col("jid"), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS))))
    clean = F.when(F.size(spans) > 0, _cut(F.col("row")[text], spans, mark)).otherwise(F.col("row")[text])
    return out.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in names])


def _cut(body: Column, spans: Column, mark: str) -> Column:
    """Texts between merged spans, joined by ``mark``."""
    span = "struct<s:int,e:int>"
    start = F.array().cast(f"array<{span}>")

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        touches = (F.size(acc) > 0) & (x["s"] < F.get(acc, F.size(acc) - 1)["e"])
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        fresh = F.struct(x["s"].alias("s"), x["e"].alias("e"))
        return F.when(touches, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(
            F.array_append(acc, fresh))

    def pieces(cuts: Column) -> Column:
        begin = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["e"]))
        end = F.concat(F.transform(cuts, lambda c: c["s"]), F.array(F.length(body)))
        return F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")),
                           lambda z: F.substring(body, z["b"] + 1, z["e"] - z["b"]))

    return F.array_join(_let(F.aggregate(spans, start, merge), pieces), mark)
