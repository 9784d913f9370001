"""Ranked lexical search over impact vectors in norm buckets, after LEMP (Teflioudi, Gemulla, Mykytiuk 2015).

A document is the vector of its terms' impacts, an item the set of its terms, each with a weight; the score is their
weighted sum. Written with the square roots of the weights on both sides it is an inner product, so that by
Cauchy-Schwarz no score exceeds the product of the lengths. Documents are dealt out in descending length and compared in
buckets. For an item, a bucket is left out if its longest vector can't reach the item's threshold, the score of its k-th
best document so far. Inside a bucket the item's heaviest terms are scored first; what the others can add is bounded by
the length that is left and, coordinate by coordinate, by the largest impact of each term in the bucket. Documents whose bound
reaches the threshold are scored again, over all terms, in 64-bit integers. Bounds are raised by a margin for rounding, so
no document is lost.

The longest vectors go first, in a step of their own: their results are the thresholds that all other tasks start from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import partitions

TOP = 50
# Characters that are no term: ASCII but for letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
# Bytes of the items' terms that one pass over the documents looks for.
PASS_BYTES = 8 << 20
# Documents and term entries of one bucket.
BUCKET_ROWS, BUCKET_ENTRIES = 2048, 2_000_000
# An item's heaviest terms, scored before the others are bounded.
FOCUS = 8
# The share of documents, longest first, whose results start the thresholds; and their least number.
FIRST_SHARE, FIRST_ROWS = 0.02, 4096
MARGIN = 1.0 + 1e-9
SCHEMA = "item_id long, doc_id long, rid long, score long"


def term_weight(holders: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def impact(tf: np.ndarray, n: int, documents: int, terms: int) -> np.ndarray:
    """Of terms that occur ``tf`` times in a document of ``n`` terms."""
    m = 100 - 50 + 50 * n * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass
class Items:
    """The items of one pass: ids, and the terms (numbers) and weights of each, heaviest first."""

    ids: list[int | None]
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Bucket:
    """Documents of similar length: row number, id (and whether it is null), length; entries by term."""

    rid: np.ndarray
    doc: np.ndarray
    none: np.ndarray
    length: np.ndarray
    terms: np.ndarray  # distinct, ascending
    starts: np.ndarray
    rows: np.ndarray
    impacts: np.ndarray

    @classmethod
    def of(cls, rid, doc, none, length, sizes, terms, impacts) -> Bucket:
        row = np.repeat(np.arange(len(rid)), sizes)
        order = np.argsort(terms, kind="stable")
        distinct, starts = np.unique(terms[order], return_index=True)
        return cls(rid, doc, none, length, distinct, np.append(starts, len(terms)), row[order], impacts[order])


class Search:
    """The k best documents of each item among the buckets met, and how much the bounds left out."""

    def __init__(self, items: Items, k: int, least: np.ndarray | None = None):
        self.items, self.k = items, k
        count = len(items.ids)
        self.least = np.zeros(count, np.int64) if least is None else least.copy()  # thresholds
        self.held = [tuple(np.zeros(0, np.int64) for _ in range(4)) for _ in range(count)]  # score, none, doc, rid
        roots = np.concatenate([[0.0], np.cumsum(items.weights.astype(float))])
        self.length = np.sqrt(roots[items.starts[1:]] - roots[items.starts[:-1]]) * MARGIN
        self.met = Counter()

    def add(self, bucket: Bucket) -> None:
        if not len(bucket.rid):
            return
        self.met["buckets"] += len(self.items.ids)
        self.met["documents"] += len(self.items.ids) * len(bucket.rid)
        for i in np.flatnonzero(self.length * bucket.length.max() >= self.least):
            self._item(int(i), bucket)

    def _item(self, i: int, bucket: Bucket) -> None:
        lo, hi = self.items.starts[i], self.items.starts[i + 1]
        terms, weights = self.items.terms[lo:hi], self.items.weights[lo:hi]
        at = np.searchsorted(bucket.terms, terms)
        known = at < len(bucket.terms)
        known[known] = bucket.terms[at[known]] == terms[known]
        at, weights = at[known], weights[known]
        self.met["buckets compared"] += 1
        score = np.zeros(len(bucket.rid), np.int64)
        left = bucket.length ** 2
        for t, w in zip(at[:FOCUS], weights[:FOCUS]):
            a, b = bucket.starts[t], bucket.starts[t + 1]
            score[bucket.rows[a:b]] += w * bucket.impacts[a:b]
            left[bucket.rows[a:b]] -= w * bucket.impacts[a:b].astype(float) ** 2
        rest, rest_weights = at[FOCUS:], weights[FOCUS:]
        if len(rest):
            by_length = math.sqrt(float(rest_weights.sum())) * np.sqrt(np.maximum(left, 0.0) + bucket.length ** 2 * 1e-12)
            highest = sum(int(w) * int(bucket.impacts[bucket.starts[t]:bucket.starts[t + 1]].max()) for t, w in zip(rest, rest_weights))
            open_ = (score + np.minimum(by_length * MARGIN, highest) * MARGIN + 1 >= self.least[i])
        else:
            open_ = score >= self.least[i]
        if not open_.any():
            return
        self.met["documents scored"] += int(open_.sum())
        for t, w in zip(rest, rest_weights):
            a, b = bucket.starts[t], bucket.starts[t + 1]
            some = open_[bucket.rows[a:b]]
            score[bucket.rows[a:b][some]] += w * bucket.impacts[a:b][some]
        fit = np.flatnonzero(open_ & (score > 0) & (score >= self.least[i]))
        if not len(fit):
            return
        new = score[fit], bucket.none[fit].astype(np.int64), bucket.doc[fit], bucket.rid[fit]
        both = [np.concatenate(pair) for pair in zip(self.held[i], new)]
        order = np.lexsort((both[3], both[2], both[1], -both[0]))[:self.k]
        self.held[i] = tuple(part[order] for part in both)
        if len(order) == self.k:
            self.least[i] = max(int(self.least[i]), int(self.held[i][0][-1]))

    def results(self) -> pa.RecordBatch:
        sizes = [len(h[0]) for h in self.held]
        score, none, doc, rid = (np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*self.held)) if self.held else (
            np.zeros(0, np.int64),) * 4
        ids = pa.array([x for x, n in zip(self.items.ids, sizes) for _ in range(n)], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(doc, mask=none.astype(bool)), pa.array(rid), pa.array(score)],
                                          names=["item_id", "doc_id", "rid", "score"])


def document_terms(docs: DataFrame, vocabulary: list[bytes], doc: str, text: str) -> DataFrame:
    """``rid, doc_id, n, t, tf``: documents with a term; ``n`` counts all terms, ``t`` and ``tf`` those of the vocabulary."""
    send = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc).cast("long").alias("doc_id"),
                       F.col(text).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {term: i for i, term in enumerate(send.value)}
        for batch in batches:
            keep, n, t, tf = [], [], [], []
            for i, whole in enumerate(batch.column("text").to_pylist()):
                words = whole.encode("utf-8", "replace").translate(TO_TERMS).split()
                if words:
                    found = {numbers[w]: c for w, c in Counter(words).items() if w in numbers}
                    keep.append(i)
                    n.append(len(words))
                    t.append(list(found))
                    tf.append(list(found.values()))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid").take(at), batch.column("doc_id").take(at), pa.array(n, pa.int64()),
                 pa.array(t, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["rid", "doc_id", "n", "t", "tf"])

    return rows.mapInArrow(run, "rid long, doc_id long, n long, t array<int>, tf array<int>")


def _impacts(vectors: DataFrame, weights: np.ndarray, documents: int, terms: int) -> DataFrame:
    """``rid, doc_id, length, t, a``: the length counts each impact with the root of its term's weight."""
    send = vectors.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = send.value.astype(float)
        for batch in batches:
            lengths, out = [], []
            for n, t, tf in zip(*(batch.column(c).to_pylist() for c in ("n", "t", "tf"))):
                a = impact(np.array(tf, np.int64), n, documents, terms)
                lengths.append(float(np.sqrt((weight[np.array(t, np.int64)] * a.astype(float) ** 2).sum())))
                out.append(a)
            t = batch.column("t")
            flat = np.concatenate([np.zeros(0, np.int64), *out]).astype(np.int32)  # an impact is below a million
            ends = t.offsets.to_numpy() - t.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(lengths, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(ends), t.flatten()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["rid", "doc_id", "length", "t", "a"])

    return vectors.where(F.size("t") > 0).mapInArrow(run, "rid long, doc_id long, length double, t array<int>, a array<int>")


def _dealt(rows: DataFrame) -> DataFrame:
    """In descending length; equal vectors of a large group of copies are told apart by row number."""
    order = [F.desc("length"), F.asc("rid")]
    return rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def _searched(vectors: DataFrame, items: Items, k: int, least: np.ndarray | None) -> DataFrame:
    """The k best documents of each item in each task, whose rows come in descending length."""
    parts = (items.ids, items.starts, items.terms, items.weights)
    send = vectors.sparkSession.sparkContext.broadcast((parts, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(Items(*send.value[0]), k, send.value[1])

        def settle(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            if not table.num_rows:
                return
            doc, t = table["doc_id"].combine_chunks(), table["t"].combine_chunks()
            search.add(Bucket.of(
                table["rid"].to_numpy(), doc.fill_null(0).to_numpy(), np.asarray(doc.is_null()), table["length"].to_numpy(),
                np.diff(t.offsets.to_numpy()), t.flatten().to_numpy(), table["a"].combine_chunks().flatten().to_numpy().astype(np.int64)))

        held, rows, entries = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, entries = rows + batch.num_rows, entries + len(batch.column("t").flatten())
            if rows >= BUCKET_ROWS or entries >= BUCKET_ENTRIES:
                settle(held)
                held, rows, entries = [], 0, 0
        if held:
            settle(held)
        yield search.results()

    return vectors.mapInArrow(run, SCHEMA)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("rid")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)


def _pass_items(terms: DataFrame) -> tuple[list[int | None], list[bytes], np.ndarray, np.ndarray]:
    """Item ids, vocabulary, and (item, term) as numbers, of about PASS_BYTES of terms."""
    table = terms.toArrow()
    items = table["item_id"].combine_chunks().dictionary_encode("encode") if table.num_rows else None
    if items is None:
        return [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = table["term"].combine_chunks().dictionary_encode()
    return (items.dictionary.to_pylist(), [w.encode("utf-8", "replace") for w in words.dictionary.to_pylist()],
            items.indices.to_numpy().astype(np.int64), words.indices.to_numpy().astype(np.int64))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents of a score above 0.

    Terms are runs of ASCII letters, digits and other characters above 127, A to Z lower-cased; null and empty texts have
    none, and documents without a term count nowhere. Texts are read whole. Rows of one item id are one item with the terms
    of all, those without an id one item of null id. Repeated document rows are documents of their own; equal scores are
    ordered by id, null last. Empty tables give no rows. Other columns are not read, so their names don't matter.

    The documents are read once for every ``pass_bytes`` of item terms, which bounds what a task holds.
    """
    spark = docs.sparkSession
    lower = F.translate(F.col(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col(item).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), 0)).alias("term"))
    terms = materialise(terms.distinct(), "item-terms")
    total = terms.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    path = scratch_path(spark, "lexical-results")
    for number in range(passes):
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        _one_pass(docs, part, k, doc, text).write.mode("append").parquet(path)
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(path)


def _one_pass(docs: DataFrame, item_terms: DataFrame, k: int, doc: str, text: str) -> DataFrame:
    ids, vocabulary, of_item, of_term = _pass_items(item_terms)
    vectors = materialise(document_terms(docs, vocabulary, doc, text), "document-terms")
    count = vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    holders = np.zeros(len(vocabulary), np.int64)
    held = vectors.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row per term of the pass
    holders[held["t"].to_numpy()] = held["n"].to_numpy()
    weights = np.array([term_weight(int(x), count["documents"]) for x in holders], np.int64)
    order = np.lexsort((of_term, -weights[of_term], of_item))
    items = Items(ids, np.searchsorted(of_item[order], np.arange(len(ids) + 1)), of_term[order], weights[of_term[order]])
    dealt = _impacts(vectors, weights, count["documents"], count["terms"] or 1).where("length > 0")
    dealt = materialise(_dealt(dealt), "impact-vectors")
    share = max(FIRST_SHARE, min(1.0, FIRST_ROWS / max(1, count["documents"])))
    cut = dealt.agg(F.approx_percentile("length", 1 - share, 1000)).first()[0] or 0.0
    first = materialise(_best(_searched(_dealt(dealt.where(F.col("length") >= cut)), items, k, None), k), "first-results")
    numbers = {x: i for i, x in enumerate(ids)}
    least = np.zeros(len(ids), np.int64)
    for row in first.where(F.col("rank") == k).select("item_id", "score").collect():  # a row per item of the pass
        least[numbers[row.item_id]] = row.score
    later = _searched(dealt.where(F.col("length") < cut), items, k, least)
    out = _best(first.drop("rank").unionByName(later), k)
    return out.select("item_id", "rank", "doc_id", "score")
