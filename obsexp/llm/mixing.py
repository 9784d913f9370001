"""Mixing sources to target weights by Pareto order sampling.

Each source gets a number of words. Whole copies of every document cover the whole part of target / size; the rest is a
Pareto sample (Rosén 1997): document i, to be included with probability p_i, gets the rank u_i/(1-u_i) : p_i/(1-p_i)
with u_i uniform, and the documents of smallest rank are taken until the wanted size is reached. The size is counted in
words, so the taken words miss the target by half a document at most, however unequal the documents are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hex_word
from ..session import materialise
from .common import partitions, word_count

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
# Rows of one source and rank interval that are put in order by one task.
INTERVAL_ROWS = 4096
SEED = 11


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to a stored table ``(source, source_size)``.

    The weights repeat over the sources in code-point order, null last. ``share`` of all words is dealt by weight; a
    target stops at ``max_copies`` times its source's size and the excess is dealt again until none is above. Every
    round is one aggregate over the source table.
    """
    spark = sources.sparkSession
    # Numbering without one task for all sources: ranges of sources, numbered inside, plus the sizes of earlier ranges.
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(partitions(spark), F.col("source").isNull(), F.col("source"))
    ranged = materialise(ranged.withColumn("_part", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    table = ranged.withColumn("_place", place).join(starts, F.col("_part") == F.col("_p"))
    table = table.select("source", "source_size",
                         listed[((F.col("_place") + F.col("_start")) % len(weights)).cast("int")].alias("weight"))
    table = materialise(table, "source-weights")

    cap = F.col("source_size") * float(max_copies)
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, settled = 0.0, 0
    while total:
        full = cap <= F.col("weight") * F.lit(rate) if rate else F.lit(False)
        row = table.agg(F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("w"),
                        F.count_if(full).alias("n")).first()
        if row.w is None or (rate and row.n == settled):
            break
        settled, rate = row.n, (total - (row.held or 0.0)) / row.w
    return table.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(rate)).alias("target"))


def _draw(seed: int, doc: Column, text: Column) -> Column:
    """A 52-bit draw from id and text: the same on every run and engine, and apart for texts that share a null id."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc.cast("string"), F.lit("")), F.md5(text)))
    return hex_word(mixed) * F.lit(1 << 20) + F.conv(F.substring(mixed, 9, 5), 16, 10).cast("long")


def _whole(column: Column) -> Column:
    """Odds as whole numbers, in 2^-20, so that their sums are the same in any order; null, NaN and negative are 0."""
    known = F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.round(F.least(F.greatest(known, F.lit(0.0)), F.lit(float(1 << 40))) * F.lit(float(1 << 20))).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_copies: int = MAX_COPIES,
        doc: str = "doc_id", text: str = "text", source: str = "source", importance: str | None = None,
        seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken, draw``.

    ``size`` counts words, ``copies`` how often the document is taken, ``taken`` is their product. A residual copy has
    the inclusion odds min(1, c * importance), with c such that the expected words of the source meet its target.
    ``importance`` names a column of numbers from 0; without it, it is the square root of the size, rounded up: the
    longer of two documents is likelier, without crowding the short ones out.

    Null and empty texts have size 0 and are taken 0 times. An importance that is null, NaN, 0 or negative comes after
    all others. Null sources form one source, ordered last. Repeated rows are documents of their own; those that agree
    in id and text share a draw, and which of them is taken makes no difference to the result. An empty table gives no
    rows. Other columns are not read, so their names don't matter.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    size = word_count(text_col)
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       size.alias("size"), _draw(seed, F.col(doc), text_col).alias("draw"),
                       (_whole(F.col(importance)) if importance else F.ceil(F.sqrt(size))).alias("imp"))
    slim = materialise(slim, "mix-sizes")  # the texts are read once
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    sources = materialise(sources, "mix-sources")
    targets = source_targets(sources.select("source", "source_size"), weights, share, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.select(
        F.col("source").alias("_s"), "source_size", "target", F.least(F.floor(ratio), F.lit(max_copies)).cast("long").alias("whole"))
    plan = plan.join(sources.select(F.col("source").alias("_t"), "n"), F.col("_s").eqNullSafe(F.col("_t")))
    plan = plan.drop("_t").withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = _with_rate(slim, plan)
    # 1. Rank and interval of ranks per row; words per (source, interval), combined before they move.
    sums = _ranked(slim, plan).where("size > 0").groupBy("source", "interval").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # 2. One interval per source holds the cut: those of smaller ranks are in, those of larger ranks are out.
    ends = sums.join(plan.select("_s", "rest"), F.col("source").eqNullSafe(F.col("_s"))).where(
        F.col("before") + F.col("words") > F.col("rest"))
    ends = ends.groupBy(F.col("source").alias("_e")).agg(F.min("interval").alias("cut"), F.min("before").alias("before"))
    plan = materialise(plan.join(ends, F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e"), "mix-cuts")
    # 3. That interval alone is put in order.
    rows = _ranked(slim, plan)
    split = F.coalesce((F.col("interval") == F.col("cut")) & (F.col("before") < F.col("rest")), F.lit(False)) & (
        F.col("size") > 0)
    inside = F.col("cut").isNull() | (F.col("interval") < F.col("cut"))
    upto = Window.partitionBy("source").orderBy("key", "doc_id", "draw", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    running = F.col("before") + F.sum("size").over(upto)
    near = (running <= F.col("rest")) | ((running - F.col("size") < F.col("rest"))
                                         & (running - F.col("rest") < F.col("rest") - running + F.col("size")))
    chosen = rows.where(split).withColumn("extra", near.cast("long"))
    settled = rows.where(~split).withColumn("extra", (inside & (F.col("rest") > 0)).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0)).cast("long")
    return settled.unionByName(chosen).select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), "draw")


def _ranked(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their plan, Pareto rank ``key`` and ``interval``.

    A rank r falls into interval floor(r/(1+r) * count). The cut comes to lie near r = 1, where at most 4p(1-p) times as
    many rows share an interval as would with ranks spread evenly, whatever p is: INTERVAL_ROWS or fewer.
    """
    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    u = (F.col("draw") + 0.5) / F.lit(float(1 << 52))
    p = F.least(F.lit(1.0), F.col("rate") * F.col("imp"))
    key = F.when(p >= 1.0, F.lit(0.0)).when(p <= 0.0, F.lit(float("inf"))).otherwise(u / (1 - u) * (1 - p) / p)
    at = F.when(key == F.lit(float("inf")), F.lit(1.0)).otherwise(key / (1 + key))
    count = F.greatest(F.ceil(F.col("n") / F.lit(INTERVAL_ROWS)), F.lit(1))
    rows = rows.withColumn("key", key)
    return rows.withColumn("interval", F.least(F.floor(at * count), count - 1).cast("long"))


def _with_rate(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """The factor c per source with sum(min(1, c * importance) * size) = rest.

    Documents that become certain raise c for the others, which can make more of them certain: repeated until no source
    gains any. The rounds run over a row per source and importance.
    """
    odds = slim.where("size > 0").groupBy(F.col("source").alias("_k"), "imp").agg(F.sum("size").alias("words"))
    odds = materialise(odds, "mix-odds")
    exact = "decimal(19,0)"
    plan = materialise(plan.withColumns({"rate": F.lit(0.0), "certain": F.lit(-1).cast("long")}), "mix-rate")
    while True:
        sure = F.col("rate") * F.col("imp") >= 1
        seen = odds.join(plan.select("_s", "rate"), F.col("_k").eqNullSafe(F.col("_s")))
        sums = seen.groupBy("_k").agg(
            F.coalesce(F.sum(F.when(sure, F.col("words"))), F.lit(0)).alias("now"),
            F.sum(F.when(~sure, F.col("imp").cast(exact) * F.col("words").cast(exact))).cast("double").alias("open"))
        now = F.coalesce(F.col("now"), F.lit(0))
        rate = F.when(F.col("open") > 0, (F.col("rest") - now) / F.col("open")).otherwise(F.col("rate"))
        plan = materialise(plan.join(sums, F.col("_s").eqNullSafe(F.col("_k")), "left").withColumns(
            {"rate": F.greatest(F.col("rate"), rate), "gained": F.col("certain") != now, "certain": now}).drop(
            "_k", "now", "open"), "mix-rate")
        if not plan.where("gained").limit(1).count():
            return plan.drop("gained", "certain")
        plan = plan.drop("gained")


def mixed_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
                    seed: int = SEED, **options) -> DataFrame:
    """``docs`` with every row repeated as often as it is taken; rows taken 0 times go. All columns are kept."""
    names = docs.columns
    text_col = F.coalesce(F.col(text), F.lit(""))
    decided = mix(docs, doc=doc, text=text, source=source, seed=seed, **options).where("copies > 0")
    # Rows that agree in id, source and text can take different numbers of copies: they are numbered on both sides.
    same = ["doc_id", "source", "draw"]
    number = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("copies").desc()))
    decided = materialise(decided.select(*same, "copies", number.alias("_n")), "mix-copies").select(
        *[F.col(c).alias(f"_{c}") for c in same], "copies", "_n")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(doc).alias("doc_id"),
                       F.col(source).cast("string").alias("source"), _draw(seed, F.col(doc), text_col).alias("draw"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    on = (F.col("draw") == F.col("_draw")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (
        F.col("source").eqNullSafe(F.col("_source"))) & (F.col("number") == F.col("_n"))
    out = rows.join(decided, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("row")[c].alias(c) for c in names])
