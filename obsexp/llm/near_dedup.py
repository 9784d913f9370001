"""Near-duplicate documents by ProbMinHash on weighted shingles, banding and exact verification.

Texts of equal word sequences are one class; only one document of each takes part in the search. Documents that agree
in a band are candidates. A bucket is not verified pair by pair: every member is verified against the bucket's leader, the
document that meets most others, and what that joins is one component. Members still apart meet a second leader. What
remains apart then is compared in blocks inside the tasks: an index of the block's shingles gives an upper bound of every
similarity, what the bound allows is verified at once, and a task returns a spanning forest of the links it found, never
pairs. So no link between different texts of a bucket is lost, and no step makes more rows than it has members.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from . import shingles
from .common import components, stored_texts

THRESHOLD = 0.8
# At a similarity of 0.8, four registers agree with probability 0.41 and some of 24 bands do with 0.999997.
BANDS, ROWS = 24, 4
LEADER_ROUNDS = 2
# Members, and bytes of their texts, that one side of a comparison holds; bytes of one call, few enough that even short
# texts, which take more time a byte, make calls for all cores.
BLOCK, BLOCK_BYTES, BATCH_BYTES = 512, 8 << 20, 1 << 20
# Shingle sets that a verifying task remembers.
MEMORY_TEXTS = 200

SIGNED = "rid long, doc_id long, key binary, bands array<long>"


def signed(docs: DataFrame, doc: str, text: str, bands: int, rows: int, size: int, keep: tuple[str, ...]) -> DataFrame:
    """Stored: a row number, id, hash of the word sequence (null without words), band hashes, text and kept columns."""
    fields = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc).cast("long").alias("doc_id"),
                         F.col(text).alias("text"), *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shingles.WordHashes()
        for batch in batches:
            words = [shingles.words_of(t) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
            sets = [shingles.shingle_counts(w, hashes, size) for w in words]
            found = shingles.band_hashes(shingles.signatures(sets, bands * rows), bands)
            listed = [list(b) if k else [] for b, k in zip(found.tolist(), keys)]
            arrays = [batch.column("rid"), batch.column("doc_id"), pa.array(keys, pa.binary()),
                      pa.array(listed, pa.list_(pa.int64())), batch.column(whole)]
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", "doc_id", "key", "bands", whole])

    # The text is stored once, inside the kept columns if there are any.
    whole = "row" if keep else "text"
    schema = T.StructType.fromDDL(SIGNED).add(whole, source.schema[whole].dataType)
    out = stored_texts(source.mapInArrow(run, schema), "signed-documents")
    return out.withColumn("text", F.col("row")[text]) if keep else out


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Stored ``(u, v, similarity)`` of pairs, from the whole texts."""
    a, b = (texts.select(F.col("rid").alias(f"_{s}"), F.col("text").alias(f"text_{s}")) for s in "uv")
    both = pairs.join(a, F.col("u") == F.col("_u")).join(b, F.col("v") == F.col("_v")).select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = shingles.WordHashes(), OrderedDict()

        def counts(rid: int, text: str):
            found = seen.pop(rid, None)
            if found is None:
                found = shingles.shingle_counts(shingles.words_of(text), hashes, size)
                if len(seen) >= MEMORY_TEXTS:
                    seen.popitem(last=False)
            seen[rid] = found
            return found

        for batch in batches:
            u, v, tu, tv = (batch.column(c).to_pylist() for c in ("u", "v", "text_u", "text_v"))
            sims = [shingles.probability_jaccard(counts(i, s), counts(j, t)) for i, j, s, t in zip(u, v, tu, tv)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(sims, pa.float64())],
                                             names=["u", "v", "similarity"])

    return materialise(both.mapInArrow(run, "u long, v long, similarity double"), "verified-pairs")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _among(rows: DataFrame, numbers: DataFrame, label: str) -> DataFrame:
    """The rows whose ``rid`` is in the column ``_r`` of ``numbers``: a join with one bitmap for every 32,768 numbers.

    The bitmaps take a bit for each row of the table, so the planner can mostly send them to the tasks and leave the
    texts where they are; where they are too large for that, it shuffles.
    """
    bits = numbers.groupBy(F.bitmap_bucket_number("_r").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_r")).alias("_bits"))
    bits = materialise(bits, label)
    place = F.bitmap_bit_position("rid")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    return rows.join(bits, F.bitmap_bucket_number("rid") == F.col("_bucket")).where(held).drop("_bucket", "_bits")


def compare(rid: np.ndarray, part: np.ndarray, side: np.ndarray, sets: list, threshold: float) -> list[tuple[int, int]]:
    """A forest of the links between members of different parts: of all members, or across the two sides if both occur."""
    root, edges = {int(x): int(x) for x in part}, []
    # Members of the largest part only meet those outside it: what is linked already is not compared again.
    values, sizes = np.unique(part, return_counts=True)
    main = part == values[sizes.argmax()]
    if not side.any():
        _meet(np.flatnonzero(~main), np.arange(len(part)), rid, part, sets, threshold, root, edges)
    else:
        _meet(np.flatnonzero(~side & ~main), np.flatnonzero(side), rid, part, sets, threshold, root, edges)
        _meet(np.flatnonzero(~side & main), np.flatnonzero(side & ~main), rid, part, sets, threshold, root, edges)
    return edges


def _meet(left: np.ndarray, right: np.ndarray, rid: np.ndarray, part: np.ndarray, sets: list, threshold: float,
          root: dict[int, int], edges: list[tuple[int, int]]) -> None:
    """Add the links between members on the left and on the right to the forest ``edges`` of the parts in ``root``."""
    if not len(left) or not len(right):
        return

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # The shingles of the right side, each with the members that hold it and their probability of it.
    sizes = np.array([len(sets[j][0]) for j in right])
    every = np.concatenate([sets[j][0] for j in right])
    order = np.argsort(every, kind="stable")
    holder = np.repeat(np.arange(len(right)), sizes)[order]
    weight = np.concatenate([sets[j][1] / sets[j][1].sum() for j in right])[order]
    shingle, starts = np.unique(every[order], return_index=True)
    starts = np.append(starts, len(every))
    for i in left:
        own, p = sets[i][0], sets[i][1] / sets[i][1].sum()
        at = np.minimum(np.searchsorted(shingle, own), len(shingle) - 1)
        known = shingle[at] == own
        at, p = at[known], p[known]
        length = starts[at + 1] - starts[at]
        ends = np.cumsum(length)
        flat = np.repeat(starts[at] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
        # Probability Jaccard is at most what either side gives to the common shingles.
        bound = np.minimum(np.bincount(holder[flat], np.repeat(p, length), len(right)),
                           np.bincount(holder[flat], weight[flat], len(right)))
        for j in right[bound >= threshold - 1e-9]:
            a, b = find(int(part[i])), find(int(part[j]))
            if a != b and shingles.probability_jaccard(sets[i], sets[j]) >= threshold:
                root[max(a, b)] = min(a, b)
                edges.append((int(rid[i]), int(rid[j])))


def _remaining(members: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Stored links ``(u, v)`` that join the components still apart inside buckets, each bucket compared in blocks."""
    keys = ["band", "hash", "lo", "hi"]
    members = members.join(texts.select(F.col("rid").alias("_r"), "text"), F.col("rid") == F.col("_r")).drop("_r")
    members = members.withColumn("bytes", F.octet_length("text") + 100)
    sums = members.groupBy(F.col("band").alias("_sb"), F.col("hash").alias("_sh")).agg(F.sum("bytes").alias("total"))
    sums = materialise(sums, "bucket-bytes")
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("total") / F.lit(BLOCK_BYTES))).cast("int")
    moved = sums.agg(F.sum("total")).first()[0] or 0
    rows = members.join(sums, (F.col("band") == F.col("_sb")) & (F.col("hash") == F.col("_sh"))).withColumn("blocks", blocks)
    # Block i meets every block j: (i, i) once, and (min, max) from both sides.
    rows = rows.withColumns({"own": F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"),
                             "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": F.col("own") > F.col("other")})
    batch = F.pmod(F.xxhash64(*keys), F.lit(int(moved // BATCH_BYTES + 1))).alias("batch")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, known, edges = shingles.WordHashes(), {}, []
        for _, group in pdf.groupby(keys, sort=False):
            if group["component"].nunique() < 2:
                continue
            sets = []
            for rid, text in zip(group["rid"].tolist(), group["text"]):
                if rid not in known:
                    known[rid] = shingles.shingle_counts(shingles.words_of(text), hashes, size)
                sets.append(known[rid])
            edges += compare(*(group[c].to_numpy() for c in ("rid", "component", "side")), sets, threshold)
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    found = rows.select(batch, *keys, "side", "rid", "component", "text").groupBy("batch").applyInPandas(run, "u long, v long")
    return materialise(found, "remaining-links")


def links(stored: DataFrame, heads: DataFrame, threshold: float = THRESHOLD, size: int = shingles.WORDS) -> DataFrame:
    """``(node, component)`` over the rows of ``stored`` numbered in ``heads`` (``_r``); lone rows are not returned."""
    entries = _among(stored.select("rid", "bands"), heads, "head-bits").select("rid", F.posexplode("bands").alias("band", "hash"))
    shared = entries.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(shared.select(F.col("band").alias("_b"), F.col("hash").alias("_h"), "n"), "buckets")
    on = (F.col("band") == F.col("_b")) & (F.col("hash") == F.col("_h"))
    entries = materialise(entries.join(shared, on).select("rid", "band", "hash", "n"), "bucket-entries")
    # How many others a document meets, over all bands: the original of many copies meets most.
    wanted = materialise(entries.groupBy(F.col("rid").alias("_r")).agg(F.sum("n").alias("met")), "candidates")
    texts = stored_texts(_among(stored.select("rid", "text"), wanted, "candidate-bits"), "candidate-texts")
    entries = materialise(entries.join(wanted, F.col("rid") == F.col("_r")).select("rid", "band", "hash", "met"), "bucket-entries")
    # Components grow from turn to turn: the stars of the last turn and the links that the next one adds.
    stars = lambda p: p.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    tested, parts = None, None
    for turn in range(LEADER_ROUNDS + 1):
        members = entries.withColumn("component", F.col("rid"))
        if parts is not None:
            members = entries.join(parts, F.col("rid") == F.col("node"), "left").select(
                "rid", "band", "hash", "met", F.coalesce("component", "rid").alias("component"))
            members = materialise(members, "bucket-members")
        # A bucket of two is settled once its members have met.
        buckets = members.groupBy("band", "hash").agg(
            F.max_by(F.struct("rid", "component"), F.struct("met", "rid") if turn == 0 else F.xxhash64(F.lit(turn), "rid")).alias("leader"),
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where(
            (F.col("low") != F.col("high")) & (F.col("size") > (2 if turn else 1))).select(
            F.col("band").alias("_b"), F.col("hash").alias("_h"), "leader", "size")
        buckets = materialise(buckets, "open-buckets")
        if turn == LEADER_ROUNDS:
            rest = _remaining(members.join(buckets, on).select("rid", "band", "hash", "component", "size"), texts, threshold, size)
            return parts if rest.isEmpty() else materialise(components(stars(parts).unionByName(rest)), "components")
        pairs = _ordered(members.join(buckets, on).where("component <> leader.component").select(
            F.col("rid").alias("u"), F.col("leader.rid").alias("v")))
        if tested is not None:
            pairs = pairs.join(tested.select(F.col("u").alias("_tu"), F.col("v").alias("_tv")),
                               (F.col("u") == F.col("_tu")) & (F.col("v") == F.col("_tv")), "left_anti")
        found = _verified(pairs, texts, size)
        tested = found if tested is None else tested.unionByName(found)
        near = found.where(F.col("similarity") >= threshold).select("u", "v")
        if parts is None:
            parts = materialise(components(near), "components")
        elif not near.isEmpty():
            parts = materialise(components(stars(parts).unionByName(near)), "components")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, size: int = shingles.WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, class_id, kept`` of every row (and the struct ``row`` of the columns in ``keep``).

    ``class_id`` is the smallest id reachable by links; linked are texts whose shingles, weighted by their counts, have a
    probability Jaccard similarity of at least ``threshold``. One row of each class is kept: that of the smallest id.
    Shingles have ``size`` words; a shorter text is one shingle. Null, empty and blank texts link with nothing. Repeated
    rows are of one class, and one is kept. A null id is ordered last: its class has an id only if another row brings
    one. Other columns are not read unless kept, so their names don't matter.
    """
    stored = signed(docs, doc, text, bands, rows, size, keep)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    heads = stored.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(place).alias("head"))
    heads = materialise(heads.select(F.col("key").alias("_key"), "head"), "text-classes")
    parts = links(stored, heads.select(F.col("head.rid").alias("_r")), threshold, size)
    grouped = heads.join(parts, F.col("head.rid") == F.col("node"), "left").select(
        "_key", "head", F.coalesce("component", F.col("head.rid")).alias("part"))
    grouped = materialise(grouped, "grouped-classes")
    best = materialise(grouped.groupBy("part").agg(F.min("head").alias("best")).withColumnRenamed("part", "_part"), "class-heads")
    named = materialise(grouped.join(best, F.col("part") == F.col("_part")).select("_key", "best"), "named-classes")
    out = stored.join(named, F.col("key") == F.col("_key"), "left")
    own = F.col("best").isNull()
    return out.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        (own | (F.col("best.rid") == F.col("rid"))).alias("kept"), *(["row"] if keep else []))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class. All columns are kept."""
    names = docs.columns
    out = near_duplicates(docs, keep=tuple(names), **options).where("kept")
    return out.select(*[F.col("row")[c].alias(c) for c in names])
