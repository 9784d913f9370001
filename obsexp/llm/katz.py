"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

Word pairs seen in training have P(w | v) = d_r r / c(v), with r their count and d_r the Good-Turing discount of counts up
to ``CUTOFF``; other words share what the discounts leave over, in proportion to their unigram probability. Unigrams
are discounted alike, and what they leave over is the probability of any unknown word.

Counts and scores go through the same exchange. Texts become chunks of word numbers. Every chunk sends its distinct
words, then its distinct word pairs, to tables partitioned by word and by context; each partition adds up the training
counts and answers every chunk with the totals that it asked for. What moves are packed arrays of distinct pairs, not a
row per token, and no task holds the model. Pairs of a frequent context are dealt out by pair instead of by context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import crc_bucket, partitions
from .shingles import mix

HELD_OUT = (7, 2)  # modulus and remainder of the rows that are not learnt from
CUTOFF = 5  # counts above are not discounted
CHUNK_TOKENS = 3_000_000
TOKENS_PER_PARTITION = 2_000_000
HOT_CONTEXT = 500_000  # training tokens from which a context's pairs are dealt out one by one
END = b"\n"  # no word holds a line feed

CHUNK = "chunk long, doc_ids array<long>, named array<boolean>, held array<boolean>, sizes array<int>, codes binary, words binary"
PIECE = "part int, chunk long, a binary, b binary, c binary, d binary, e binary"
ANSWER = "kind string, chunk long, part int, word long, a binary, b binary, stats array<double>"


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def discounts(n: np.ndarray) -> np.ndarray:
    """d_0 .. d_k from n_1 .. n_{k+1}, the numbers of types of each count (d_0 is 0).

    d_r = (r*/r - q) / (1 - q) with r* = (r + 1) n_{r+1} / n_r and q = (k + 1) n_{k+1} / n_1. Where few types make that
    fall outside (0, 1), half a count is taken off instead.
    """
    k = len(n) - 1
    out = np.zeros(k + 1)
    q = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - q) / (1 - q) if n[r - 1] and q != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d_r r of every count."""
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


class Unigrams:
    """Unigram probabilities from the total, the type counts and their discounts."""

    def __init__(self, total: int, n: np.ndarray):
        self.d = discounts(n)
        left = float(sum(n[r - 1] * r * (1 - self.d[r]) for r in range(1, len(self.d))))
        # Without discounted types one extra count is left for unknown words.
        self.total = total if left > 0 else total + 1
        self.unknown = (left if left > 0 else 1.0) / self.total

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.total, self.unknown)


def chunked(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Stored rows of about ``CHUNK_TOKENS`` tokens: ids, lengths, local word numbers, hashes of the local words."""
    modulus, remainder = HELD_OUT
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), (crc_bucket(doc, modulus) == remainder).alias("held"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                value = self[word] = len(self)
                return value

        number, base = 0, TaskContext.get().partitionId() << 32
        ids, held, parts, known, tokens = [], [], [], Numbers(), 0

        def row() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
            return pa.RecordBatch.from_arrays(
                [pa.array([base + number]), pa.array([[i or 0 for i in ids]], pa.list_(pa.int64())),
                 pa.array([[i is not None for i in ids]], pa.list_(pa.bool_())), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), pa.array([pack(np.concatenate(parts))]),
                 pa.array([pack(hashes)])], names=["chunk", "doc_ids", "named", "held", "sizes", "codes", "words"])

        for batch in batches:
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text"))):
                words = t.encode("utf-8", "replace").lower().split()  # bytes: only A to Z change, only ASCII space cuts
                words.append(END)
                parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                ids.append(i)
                held.append(h)
                tokens += len(words)
                if tokens >= CHUNK_TOKENS:
                    yield row()
                    number += 1
                    ids, held, parts, known, tokens = [], [], [], Numbers(), 0
        if parts:
            yield row()

    return materialise(rows.mapInArrow(run, CHUNK), "token-chunks")


class Chunk:
    """One stored row, unpacked."""

    def __init__(self, row):
        self.chunk = int(row["chunk"])
        ids = pd.array(np.asarray(row["doc_ids"], np.int64), dtype="Int64")
        ids[~np.asarray(row["named"], bool)] = pd.NA
        self.doc_ids, self.held = ids, np.asarray(row["held"], bool)
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.codes, self.words = unpack(row["codes"], np.int32), unpack(row["words"], np.uint64)
        self.train = np.repeat(~self.held, self.sizes)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.train], minlength=len(self.words))

    def by_part(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers in the order of their partitions, and where each partition starts."""
        part = (self.words % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def learn_words(self, answers: pd.DataFrame, parts: int) -> None:
        """Corpus-wide number and training count of each word, from the answers of the word partitions."""
        order, bounds = self.by_part(parts)
        self.number, self.count = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        for part, a, b in zip(answers["part"], answers["a"], answers["b"]):
            at = order[bounds[part]:bounds[part + 1]]
            self.number[at], self.count[at] = unpack(a, np.int64), unpack(b, np.int64)

    def pairs(self, inverse: bool = False):
        """Distinct pairs (context, word) as local numbers; the start of a text is the context ``len(words)``."""
        width = len(self.words) + 1
        before = np.empty(len(self.codes), np.int64)
        before[1:] = self.codes[:-1]
        before[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])] = width - 1
        key = before * width + self.codes
        if inverse:
            unique, at = np.unique(key, return_inverse=True)
            return unique // width, unique % width, at
        unique = np.unique(key)
        seen, times = np.unique(key[self.train], return_counts=True)
        counts = np.zeros(len(unique), np.int64)
        counts[np.searchsorted(unique, seen)] = times
        return unique // width, unique % width, counts

    def contexts(self, hot: int) -> None:
        """Number, training count and heat of every context; the start counts as often as the end."""
        end = self.codes[self.sizes[0] - 1]
        self.context_number = np.append(self.number, -1)
        self.context_count = np.append(self.count, self.count[end])
        self.hot = self.context_count >= hot

    def pair_order(self, context: np.ndarray, word: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        own = mix(self.context_number.astype(np.uint64))
        with np.errstate(over="ignore"):
            spread = np.where(self.hot[context], self.number[word].astype(np.uint64), np.uint64(0))
            part = (mix(own[context] + spread) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))


def _word_pieces(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                counts, (order, bounds) = chunk.word_counts(), chunk.by_part(parts)
                rows = [(p, order[bounds[p]:bounds[p + 1]]) for p in range(parts) if bounds[p] < bounds[p + 1]]
                none = pa.array([None] * len(rows), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int32()), pa.array([chunk.chunk] * len(rows), pa.int64()),
                     pa.array([pack(chunk.words[at]) for _, at in rows]), pa.array([pack(counts[at]) for _, at in rows]),
                     none, none, none], names=["part", "chunk", "a", "b", "c", "d", "e"])
    return run


def _answers(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "chunk", "part", "word", "a", "b", "stats"])
    return out.astype({"chunk": "Int64", "word": "Int64"})


def _totals(answers: DataFrame, size: int) -> list[float]:
    sums = [F.sum(F.col("stats")[i]) for i in range(size)]
    return [x or 0.0 for x in answers.where("kind = 'total'").agg(*sums).first()]


def _type_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, CUTOFF + 2), minlength=CUTOFF + 3)[1:CUTOFF + 2]


def _add_words(parts: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        hashes, counts = [unpack(a, np.uint64) for a in pdf["a"]], [unpack(b, np.int64) for b in pdf["b"]]
        unique, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(unique)).astype(np.int64)
        rows, start = [], 0
        for chunk, h in zip(pdf["chunk"], hashes):
            own = at[start:start + len(h)]
            start += len(h)
            rows.append(("word", int(chunk), part, None, pack(own * parts + part), pack(total[own]), None))
        stats = [float(total.sum()), float((total > 0).sum()), *_type_counts(total).astype(float)]
        return _answers([*rows, ("total", None, part, None, None, None, stats)])
    return run


def _pair_pieces(parts: int, hot: int):
    def run(key: tuple, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(chunks.iloc[0])
        chunk.learn_words(answers, parts)
        chunk.contexts(hot)
        context, word, counts = chunk.pairs()
        order, bounds = chunk.pair_order(context, word, parts)
        rows = []
        for p in range(parts):
            at = order[bounds[p]:bounds[p + 1]]
            if len(at):
                first = np.flatnonzero(np.append(True, np.diff(context[at]) != 0))
                lengths = np.diff(np.append(first, len(at)))
                own = context[at][first]
                rows.append((p, chunk.chunk, pack(np.stack([chunk.context_number[own], chunk.hot[own].astype(np.int64)])),
                             pack(lengths), pack(chunk.number[word[at]]), pack(counts[at]), pack(chunk.count[word[at]])))
        return pd.DataFrame(rows, columns=["part", "chunk", "a", "b", "c", "d", "e"])
    return run


def _add_pairs(unigrams: Unigrams):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        heads = [unpack(a, np.int64).reshape(2, -1) for a in pdf["a"]]
        lengths = [unpack(b, np.int64) for b in pdf["b"]]
        words = np.concatenate([unpack(c, np.int64) for c in pdf["c"]])
        counts = np.concatenate([unpack(d, np.int64) for d in pdf["d"]])
        word_counts = np.concatenate([unpack(e, np.int64) for e in pdf["e"]])
        contexts, at_context = np.unique(np.concatenate([h[0] for h in heads]), return_inverse=True)
        owner = np.repeat(at_context, np.concatenate(lengths))
        known, at_word = np.unique(words, return_inverse=True)
        unique, first, at = np.unique(owner * len(known) + at_word, return_index=True, return_inverse=True)
        total = np.bincount(at, counts, len(unique)).astype(np.int64)
        seen = total > 0
        context = (unique // len(known))[seen]
        t, share = total[seen], unigrams.of(word_counts[first][seen])
        stats = np.stack([np.bincount(context[t == r], minlength=len(contexts)) for r in range(1, CUTOFF + 1)]
                         + [np.bincount(context, share, len(contexts))], axis=1)
        rows, pair, head = [], 0, 0
        for chunk, h, n in zip(pdf["chunk"], heads, lengths):
            size = int(n.sum())
            rows.append(("pair", int(chunk), part, None, pack(total[at[pair:pair + size]]),
                         pack(stats[at_context[head:head + h.shape[1]]].T), None))
            pair, head = pair + size, head + h.shape[1]
            rows += [("ask", int(chunk), part, int(c), None, None, None) for c in h[0][h[1] > 0]]
        hot = np.unique(np.concatenate([h[0][h[1] > 0] for h in heads]))
        for c, s in zip(hot, stats[np.searchsorted(contexts, hot)]):
            rows.append(("hot", None, part, int(c), None, None, s.tolist()))
        return _answers([*rows, ("total", None, part, None, None, None, _type_counts(t).astype(float).tolist())])
    return run


def _score(parts: int, hot: int, unigrams: Unigrams, total: int, types: int, d: np.ndarray):
    def run(key: tuple, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(chunks.iloc[0])
        kinds = answers["kind"]
        chunk.learn_words(answers[kinds == "word"], parts)
        chunk.contexts(hot)
        context, word, at = chunk.pairs(inverse=True)
        order, bounds = chunk.pair_order(context, word, parts)
        pair_count, stats = np.zeros(len(context), np.int64), np.zeros((len(chunk.context_count), CUTOFF + 1))
        for part, a, b in zip(*(answers[kinds == "pair"][c] for c in ("part", "a", "b"))):
            where = order[bounds[part]:bounds[part + 1]]
            pair_count[where] = unpack(a, np.int64)
            own = context[where][np.append(True, np.diff(context[where]) != 0)]
            stats[own] = unpack(b, np.float64).reshape(CUTOFF + 1, -1).T
        hot_rows = answers[kinds == "hot"]
        if len(hot_rows):
            places = {int(n): i for i, n in enumerate(chunk.context_number) if chunk.hot[i]}
            for number, s in zip(hot_rows["word"], hot_rows["stats"]):
                if int(number) in places:
                    stats[places[int(number)]] = s
        # Backoff: what the discounts of a context leave over, spread over the words not seen after it.
        r = np.arange(1, CUTOFF + 1)
        left = (stats[:, :CUTOFF] * (r * (1 - d[1:]))).sum(axis=1)
        whole = np.where(left > 0, chunk.context_count, chunk.context_count + 1).astype(float)
        left = np.where(left > 0, left, 1.0) / whole
        backoff = np.where(chunk.context_count > 0, left / np.maximum(1.0 - stats[:, CUTOFF], 1e-300), 1.0)
        p1 = unigrams.of(chunk.count)
        p2 = np.where(pair_count > 0, discounted(pair_count, d) / whole[context], backoff[context] * p1[word])
        starts = np.concatenate([[0], np.cumsum(chunk.sizes)[:-1]])

        def add(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, starts)

        counts = chunk.count[chunk.codes]
        return pd.DataFrame({
            "doc_id": chunk.doc_ids, "held_out": chunk.held, "n_tokens": chunk.sizes, "n_known": add((counts > 0).astype(np.int64)),
            "train_tokens": np.full(len(chunk.sizes), total, np.int64),
            "base_score": add(np.log10((counts + 1) / (total + types + 1))), "score": add(np.log10(p2)[at])})
    return run


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", hot: int = HOT_CONTEXT,
                    tokens_per_partition: int = TOKENS_PER_PARTITION) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; scores are log10.

    Held-out rows are scored and not learnt from. Null and empty texts consist of the end token alone. Repeated rows are
    learnt from and scored each. Without training rows every probability is that of an unknown word, 1. A null id hashes
    like empty text. Other columns are not read, so their names don't matter.
    """
    chunks = chunked(docs, doc, text)
    n_tokens = chunks.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-n_tokens // tokens_per_partition))
    words = chunks.mapInArrow(_word_pieces(parts), PIECE).groupBy("part").applyInPandas(_add_words(parts), ANSWER)
    words = materialise(words, "word-counts")
    total, types, *n1 = _totals(words, CUTOFF + 3)
    unigrams = Unigrams(int(total), np.array(n1))
    word_answers = words.where("kind = 'word'")
    pieces = chunks.groupBy("chunk").cogroup(word_answers.groupBy("chunk")).applyInPandas(_pair_pieces(parts, hot), PIECE)
    pairs = materialise(pieces.groupBy("part").applyInPandas(_add_pairs(unigrams), ANSWER), "pair-counts")
    d = discounts(np.array(_totals(pairs, CUTOFF + 1)))
    # The partitions of a frequent context add up to one row, which goes to the chunks that hold the context.
    sums = F.array(*[F.sum(F.col("stats")[i]) for i in range(CUTOFF + 1)])
    frequent = pairs.where("kind = 'hot'").groupBy(F.col("word").alias("_w")).agg(sums.alias("sums"))
    frequent = materialise(frequent, "frequent-contexts")
    asked = pairs.where("kind = 'ask'").select("chunk", "word").distinct()
    frequent = asked.join(frequent, F.col("word") == F.col("_w")).select(
        F.lit("hot").alias("kind"), "chunk", F.lit(0).alias("part"), "word", F.lit(None).cast("binary").alias("a"),
        F.lit(None).cast("binary").alias("b"), F.col("sums").alias("stats"))
    answers = word_answers.unionByName(pairs.where("kind = 'pair'")).unionByName(frequent)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        _score(parts, hot, unigrams, int(total), int(types), d), schema)
