"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index.

Terms are stems, the first four characters of a word, which keeps inflected and lengthened forms together. Weights are
plain tf-idf; document frequencies come from all documents.

The examples are ordered so that similar ones stand together (halved again and again along their main direction) and cut
into blocks. A term's postings are kept by block, with the largest weight in each. The sums of these maxima bound every
cosine of a block: the blocks of the highest bounds are scored first, and a block whose bound stays below the k-th best
cosine so far is never opened.

The neighbours' votes count by squared cosine. Their share is calibrated by isotonic regression on the examples, each
scored by all others, so that a score is the share of toxic ones among texts with such neighbours. The examples are a
bounded sample of labelled rows (``EXAMPLES_PER_LABEL``); where it holds the labels in other shares than the table, votes
and calibration weigh them back.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import crc_bucket

EXAMPLES_PER_LABEL = 2500
STEM = 4
# Bounds of the index in bytes: stems known at all (those in most examples), and stems of one example (its heaviest).
MAX_TERMS, MAX_TERMS_PER_EXAMPLE = 100_000, 2000
NEIGHBOURS = 25
BLOCK = 128  # examples of one block
FIRST_BLOCKS = 4  # scored before any is left out
# Terms in more than this share of the examples, and at most so many, stand in one small matrix for each block instead.
COMMON = (0.05, 512)
BATCH_TEXTS = 64  # searched together: a block's matrix is read once for all that open it
PRIOR_WEIGHT = 0.2
THRESHOLD = 0.3
HELD_OUT = (4, 2)  # modulus and remainder of the rows that labels are never learnt from
MEMORY_WORDS = 400_000
TO_SPACE = bytes(32 if chr(i) in string.punctuation else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words, lower-cased, cut at ASCII punctuation and white space."""
    return (text or "").lower().encode("utf-8", "replace").translate(TO_SPACE).split()


def stem_of(word: bytes) -> bytes:
    return word if len(word) <= STEM else word.decode("utf-8")[:STEM].encode("utf-8")


class Stems(dict):
    """The number of each word's stem, -1 for unknown ones, remembered per word."""

    def __init__(self, terms: list[bytes]):
        super().__init__()
        self.numbers = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        found = self[word] = self.numbers.get(stem_of(word), -1)
        return found

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the text's known stems, ascending, and how often each occurs."""
        words = words_of(text)
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.unique(found[found >= 0], return_counts=True)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def arrange(sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int, block: int) -> np.ndarray:
    """Rows in an order that puts similar ones together: halves along the main direction, down to one block."""
    ends = np.cumsum(sizes)
    starts, out, todo = ends - sizes, [], [np.arange(len(sizes))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        flat = _ranges(starts[rows], sizes[rows])
        line, t, v = np.repeat(np.arange(len(rows)), sizes[rows]), terms[flat], values[flat]
        x = np.cos(np.arange(len(rows)) + 1.0)
        for _ in range(5):
            x = x - x.mean()
            x /= np.sqrt(x @ x) or 1.0
            x = np.bincount(line, v * np.bincount(t, v * x[line], n_terms)[t], len(rows))
        rows = rows[np.argsort(x, kind="stable")]
        half = (len(rows) + block - 1) // block // 2 * block
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Index:
    """Examples in blocks. Arrays and byte strings only, so that it travels without this package."""

    terms: list[bytes]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray  # of each example: the share of its label in the table over that in the sample
    largest: np.ndarray  # terms x blocks: the largest weight, rounded up
    common: np.ndarray  # of each term: its line in the blocks' matrices, or -1
    matrices: np.ndarray  # blocks x common terms x examples of a block
    starts: np.ndarray  # terms x (blocks + 1): where the term's postings of a block start
    inside: np.ndarray  # postings by term, then example: the example and its weight
    values: np.ndarray
    background: float = 0.0  # the score of a text without a known term
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))  # calibration: from this raw score on ...
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))  # ... this score

    @classmethod
    def of(cls, terms: list[bytes], idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, t: np.ndarray,
           n: np.ndarray, votes: tuple[float, float] = (1.0, 1.0), block: int = BLOCK) -> Index:
        """``sizes``: how many of the terms ``t`` and their counts ``n`` each example has; ``votes``: of labels 0 and 1."""
        each = np.where(labels > 0, votes[1], votes[0])
        row = np.repeat(np.arange(len(ids)), sizes)
        raw = n * idf[t]
        raw = raw / np.sqrt(np.maximum(np.bincount(row, raw * raw, len(ids)), 1e-300))[row]
        order = arrange(sizes, t, raw, len(idf), block)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        some = raw > 0
        row, t, raw = place[row[some]], t[some], raw[some]
        by = np.lexsort((row, t))
        row, t, raw = row[by], t[by], raw[by]
        n_blocks = -(-len(ids) // block)
        pair = t * n_blocks + row // block
        starts = np.searchsorted(pair, np.arange(len(idf) * n_blocks + 1)).astype(np.int32)
        largest = np.zeros(len(idf) * n_blocks, np.float32)
        held = np.flatnonzero(starts[1:] > starts[:-1])
        if len(held):
            largest[held] = np.nextafter(np.maximum.reduceat(raw, starts[held]).astype(np.float32), np.float32(2))
        bare = np.bincount(row, minlength=len(ids)) == 0
        labels, each = labels[order].astype(float), each[order]
        mean = float(each @ labels / each.sum()) if len(labels) else 0.0
        # Texts without a term resemble the examples without one, plus one example of the average kind.
        background = (float(each[bare] @ labels[bare]) + mean) / (float(each[bare].sum()) + 1)
        at = np.arange(len(idf))[:, None] * n_blocks + np.arange(n_blocks + 1)
        starts = starts[at]
        share, most = COMMON
        holders = starts[:, -1] - starts[:, 0]
        lines = np.argsort(-holders, kind="stable")[:min(most, int((holders > share * len(ids)).sum()))]
        common = np.full(len(idf), -1, np.int32)
        common[lines] = np.arange(len(lines))
        matrices = np.zeros((n_blocks, len(lines), block))
        line = common[t]
        matrices[row[line >= 0] // block, line[line >= 0], row[line >= 0] % block] = raw[line >= 0]
        return cls(terms, idf, ids[order], labels, each, largest.reshape(len(idf), n_blocks), common, matrices, starts, row, raw, background)

    def parts(self) -> tuple:
        return tuple(getattr(self, f.name) for f in fields(self))


class Scorer:
    """Searches an index; counts the blocks that could hold a neighbour (``met``) and those opened."""

    def __init__(self, index: Index):
        self.index = index
        self.stems = Stems(index.terms)
        self.place = {int(i): p for p, i in enumerate(index.ids)}
        self.met = self.opened = 0

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the text and their weights, of length 1."""
        t, n = self.stems.counts(text)
        w = n * self.index.idf[t]
        t, w = t[w > 0], w[w > 0]
        return t, w / (math.sqrt(float(w @ w)) or 1.0)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int,
                without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the cosines above 0 and positions of its k nearest examples, ties to the smaller id.

        ``without`` names one example per query that is left out.
        """
        x = self.index
        n_blocks, n_common, block = x.matrices.shape
        known, bound = np.zeros((len(queries), n_common)), np.zeros((len(queries), n_blocks))
        rare = []
        for i, (t, w) in enumerate(queries):
            lines = x.common[t]
            known[i, lines[lines >= 0]] = w[lines >= 0]
            rare.append((x.starts[t[lines < 0]], w[lines < 0]))
            bound[i] = w @ x.largest[t]
        cosine = np.zeros((len(queries), n_blocks * block))

        def score(chosen: np.ndarray) -> None:
            """Cosines of the examples in the blocks marked in ``chosen``, queries x blocks."""
            for b in np.flatnonzero(chosen.any(axis=0)):
                who = np.flatnonzero(chosen[:, b])
                cosine[who, b * block:(b + 1) * block] = known[who] @ x.matrices[b]
            for i, (starts, w) in enumerate(rare):
                at = np.flatnonzero(chosen[i])
                low = starts[:, at]
                length = (starts[:, at + 1] - low).ravel()
                flat = _ranges(low.ravel(), length)
                weight = np.repeat(np.repeat(w, len(at)), length)
                cosine[i] += np.bincount(x.inside[flat], weight * x.values[flat], cosine.shape[1])
            if without is not None:
                cosine[np.arange(len(queries)), without] = 0.0

        could = bound > 0
        first = np.zeros(bound.shape, bool)
        highest = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        np.put_along_axis(first, highest, True, axis=1)
        first &= could
        score(first)
        least = np.partition(cosine, -k, axis=1)[:, -k] if cosine.shape[1] >= k else np.zeros(len(queries))
        rest = could & ~first & (bound >= least[:, None] - 1e-6)
        score(rest)
        self.met += int(could.sum())
        self.opened += int(first.sum() + rest.sum())
        for row in cosine:
            # Cosines are compared to twelve digits, so that equal ones tie whatever the order of their sums.
            least = np.partition(row, -k)[-k] if len(row) > k else 0.0
            at = np.flatnonzero((row > 0) & (row >= least - 1e-11))
            found = np.round(row[at], 12)
            order = np.lexsort((x.ids[at], -found))[:k]
            yield found[order], at[order]

    def raw(self, texts: list[str | None], k: int, own: list[int] | None = None) -> Iterator[tuple[float | None, list[int]]]:
        """Per text the neighbours' share of toxic votes, drawn to the background, and their ids; no share without neighbours.

        ``own`` are the ids of texts that are examples themselves and no neighbours of their own.
        """
        x = self.index
        for i in range(0, len(texts), BATCH_TEXTS):
            without = None if own is None else [self.place[j] for j in own[i:i + BATCH_TEXTS]]
            for cosine, near in self.nearest([self.query(t) for t in texts[i:i + BATCH_TEXTS]], k, without):
                if not len(near):
                    yield None, []
                    continue
                weight = cosine * cosine
                vote = weight * x.votes[near]
                # The votes settle the share of toxic ones, the cosines alone how far it outweighs the background.
                share, total = float(vote @ x.labels[near]) / (float(vote.sum()) or 1.0), float(weight.sum())
                yield (total * share + PRIOR_WEIGHT * x.background) / (total + PRIOR_WEIGHT), x.ids[near].tolist()

    def scores(self, texts: list[str | None], k: int = NEIGHBOURS) -> Iterator[tuple[float, list[int]]]:
        """Per text the calibrated score and the ids of the neighbours."""
        x = self.index
        for value, near in self.raw(texts, k):
            if value is None:
                value = x.background
            elif len(x.knots):
                value = float(x.levels[max(0, int(np.searchsorted(x.knots, value + 1e-12, side="right")) - 1)])
            yield min(1.0, max(0.0, value)), near


def isotonic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps closest to the labels: where each begins, and its level. A step counts one average row on top."""
    steps: list[list[float]] = []
    order = np.argsort(raw, kind="stable")
    for x, y, w in zip(raw[order].tolist(), label[order].tolist(), weight[order].tolist()):
        steps.append([x, y * w, w])
        while len(steps) > 1 and (steps[-2][0] == steps[-1][0] or steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]):
            _, s, w = steps.pop()
            steps[-1][1] += s
            steps[-1][2] += w
    levels = np.array([(s + mean) / (w + 1) for _, s, w in steps])
    return np.array([x for x, _, _ in steps]), np.maximum.accumulate(levels) if len(levels) else levels


def _sample(labels: DataFrame, doc: str, label: str, per_label: int) -> tuple[DataFrame, list[int]]:
    """At most ``per_label`` labelled ids of each label, in hash order; a repeated id counts once, its larger label.

    And how many learnable ids have label 0 and 1.
    """
    modulus, remainder = HELD_OUT
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc).cast("long").alias("doc_id")).agg(
        F.max(label).cast("int").alias("label"))
    known = materialise(known.where(crc_bucket("doc_id", modulus) != remainder), "learnable-ids")
    order = [F.xxhash64(F.lit(5), F.col("doc_id")), F.col("doc_id")]
    picks = [known.where(F.col("label") == y).orderBy(*order).limit(per_label) for y in (0, 1)]
    counted = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return picks[0].unionByName(picks[1]), [counted.get(y, 0) for y in (0, 1)]


def _thinned(examples: DataFrame, size: int = 4, keys: int = 3) -> DataFrame:
    """Stored: one example of each label for each smallest hash of its word shingles, for several hashes in turn.

    Near copies share a smallest hash as often as they share shingles; unrelated texts hardly ever do.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}
                least.append([min(xxhash.xxh3_64_intdigest(x, k) for x in found) >> 1 for k in range(keys)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("text", "label", "doc_id")),
                 *(pa.array([x[k] for x in least], pa.int64()) for k in range(keys))],
                names=["text", "label", "doc_id", *(f"k{k}" for k in range(keys))])

    names = [f"k{k}" for k in range(keys)]
    rows = examples.mapInArrow(run, "text string, label int, doc_id long, " + ", ".join(f"{n} long" for n in names))
    for name in names:
        whole = F.struct("doc_id", "text", *[n for n in names if n != name])
        rows = rows.groupBy("label", name).agg(F.min(whole).alias("x")).select("label", name, "x.*")
    # An id may stand for several texts; each example has an id of its own.
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("label", "text")).alias("x"))
    return materialise(rows.select("x.text", "x.label", "doc_id"), "toxic-examples")


def _vocabulary(examples: DataFrame) -> list[bytes]:
    """The stems of most examples, at most MAX_TERMS, counted inside a task before rows move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update({stem_of(w) for w in words_of(text)})
            if len(seen) > MAX_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    counted = examples.select("text").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return sorted(counted.orderBy(F.desc("n"), "term").limit(MAX_TERMS).select("term").toArrow()["term"].to_pylist())


def _document_frequencies(rows: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """The number of all documents, and in how many of them each term occurs: one row per task and term moves."""
    send = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, total = Stems(send.value), 0
        held = np.zeros(len(send.value), np.int64)
        for batch in batches:
            total += batch.num_rows
            for text in batch.column("text").to_pylist():
                held[stems.counts(text)[0]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(held[some], total))],
                                         names=["t", "n"])

    got = rows.select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[got["t"].to_numpy()] = got["n"].to_numpy()  # the total stands at -1, the last place
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic",
        per_label: int = EXAMPLES_PER_LABEL, k: int = NEIGHBOURS) -> Index:
    """Index of a bounded sample of labelled rows, none of them held out, with its calibration.

    Copies and near copies of one label would vote many times, so they are thinned out first.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    picked, learnable = _sample(labels, doc, label, per_label)
    # At most 2 * per_label ids of 12 bytes: small enough to send to every task.
    examples = rows.join(F.broadcast(picked), "doc_id").groupBy("text", "label").agg(F.min("doc_id").alias("doc_id"))
    examples = examples.orderBy(F.xxhash64("doc_id", "text"), "label").limit(2 * per_label)
    examples = _thinned(materialise(examples, "toxic-sample"))
    sizes = {r.label: r.n for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = [sizes.get(y, 0) for y in (0, 1)]
    if not all(kept):
        return Index.of([], np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    votes = tuple((n / sum(learnable)) / (m / sum(kept)) for n, m in zip(learnable, kept))
    terms = _vocabulary(examples)
    total, held = _document_frequencies(rows, terms)
    idf = np.log((total + 1) / (held + 1))
    index = Index.of(terms, idf, *_example_vectors(examples, terms, idf), votes)
    # Each example scored by all others; a row per example comes back.
    scored_ = _mapped(examples, index, lambda scorer, texts, own: [g[:1] for g in scorer.raw(texts, k, own)], "raw double", ("doc_id", "label"), True)
    got = scored_.where("raw is not null").toArrow()
    raw, y = got["raw"].to_numpy(), got["label"].to_numpy().astype(float)
    weight = np.where(y > 0, votes[1], votes[0])
    index.knots, index.levels = isotonic(raw, y, weight, float(weight @ y / weight.sum()) if len(y) else 0.0)
    return index


def _example_vectors(examples: DataFrame, terms: list[bytes], idf: np.ndarray) -> tuple:
    """Ids, labels, sizes, terms and counts of the examples, on the driver: at most MAX_TERMS_PER_EXAMPLE entries each."""
    send = examples.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = send.value
        stems = Stems(known)
        for batch in batches:
            ts, ns = [], []
            for text in batch.column("text").to_pylist():
                t, n = stems.counts(text)
                heaviest = np.sort(np.argsort(-n * weight[t], kind="stable")[:MAX_TERMS_PER_EXAMPLE])
                ts.append(t[heaviest].astype(np.int32))
                ns.append(n[heaviest].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(ts, pa.list_(pa.int32())),
                                              pa.array(ns, pa.list_(pa.int32()))], names=["doc_id", "label", "t", "n"])

    got = examples.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, t array<int>, n array<int>").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    t, n = got["t"].combine_chunks(), got["n"].combine_chunks()
    return (got["doc_id"].to_numpy(), got["label"].to_numpy().astype(float), np.diff(t.offsets.to_numpy()).astype(np.int64),
            t.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(float))


def _mapped(rows: DataFrame, index: Index, answer, fields_ddl: str, keep: tuple[str, ...], own: bool = False) -> DataFrame:
    """The columns ``keep`` of every row beside ``answer(scorer, texts, own ids)``. No rows move."""
    send = rows.sparkSession.sparkContext.broadcast(index.parts())  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Index(*send.value))
        for batch in batches:
            got = answer(scorer, batch.column("text").to_pylist(), batch.column("doc_id").to_pylist() if own else None)
            arrays = [pa.array([g[j] for g in got], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, *names])

    answered = T.StructType.fromDDL(fields_ddl)
    names = answered.names
    kinds = [pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType) else pa.float64() for f in answered]
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *answered]))


def scored(docs: DataFrame, index: Index, doc: str = "doc_id", text: str = "text", extra: tuple[str, ...] = (),
           k: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, score, neighbours`` of every row, plus a struct ``row`` of the ``extra`` columns. No rows move."""
    more = [F.struct(*[F.col(f"`{c}`") for c in extra]).alias("row")] if extra else []
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)
    return _mapped(rows, index, lambda scorer, texts, own: list(scorer.scores(texts, k)), "score double, neighbours array<bigint>",
                   ("doc_id", "row") if extra else ("doc_id",))


def held_out(doc: str = "doc_id") -> Column:
    return crc_bucket(doc, HELD_OUT[0]) == HELD_OUT[1]


def score_documents(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic",
                    threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours``: one row per document, ``neighbours`` being the evidence.

    Null and empty texts, and texts without a stem of any example, get the background score and no neighbours. Labels other
    than 0 and 1, null ids and labels of unknown documents are left out; without examples of both labels every score is
    0. Repeated rows get equal scores. Other columns are not read, so their names don't matter.
    """
    out = scored(docs, fit(docs, labels, doc, text, label, **bounds), doc, text)
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours")


def clean_documents(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic",
                    threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """``docs`` without those scored at ``threshold`` or above. All columns are kept."""
    names = docs.columns
    out = scored(docs, fit(docs, labels, doc, text, label, **bounds), doc, text, tuple(names))
    return out.where(F.col("score") < threshold).select(*[F.col("row")[c].alias(c) for c in names])
