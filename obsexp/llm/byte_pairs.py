"""Byte-level BPE encoding and decoding; the merge order comes from a segment tree.

A text is cut by the vocabulary's pattern, and each match is merged on its own. The tree's leaves are the byte positions
of a match; a leaf holds the rank of the pair that starts there, an inner node the smallest rank below it, the leftmost
one on ties. A merge reads the root, joins the two live neighbours it names and changes three leaves, each at the cost
of one path to the root. So a match of n bytes takes n log n steps, however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encoded matches remembered by one task; the memory is emptied when full, and long matches stay out of it.
MEMORY_MATCHES, MEMORY_BYTES = 1_000_000, 64
# A leaf without a pair. Real leaves are rank << SHIFT | position, so the smallest is the leftmost of the lowest rank.
SHIFT = 32
NONE = (1 << 62)


def default_vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of base64 bytes and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def merge(match: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: lowest rank first, leftmost on ties. Every single byte must have a rank."""
    n, rank_of = len(match), ranks.get
    if n == 1:
        return [ranks[match]]
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = rank_of(match[i:i + 2])
        if rank is not None:
            tree[size + i] = rank << SHIFT | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n))  # the live neighbours' first bytes
    least = tree[1]
    while least < NONE:
        i = least & ((1 << SHIFT) - 1)
        gone, first = after[i], before[i]
        end = after[i] = after[gone]
        before[end] = i
        # The pair that started at the joined neighbour goes; those that start here and before get their new ranks.
        rank = rank_of(match[i:after[end]]) if end < n else None
        leaves = [(gone, NONE), (i, NONE if rank is None else rank << SHIFT | i)]
        if first >= 0:
            rank = rank_of(match[first:end])
            leaves.append((first, NONE if rank is None else rank << SHIFT | first))
        for leaf, value in leaves:
            k = size + leaf
            while k and tree[k] != value:
                tree[k] = value
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
        least = tree[1]
    out, i = [], 0
    while i < n:
        out.append(ranks[match[i:after[i]]])
        i = after[i]
    return out


class Matches(dict):
    """The ids of a match as bytes of 32-bit numbers, remembered per match."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, match: str) -> bytes:
        raw = match.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = np.array([whole] if whole is not None else merge(raw, self.ranks), np.int32).tobytes()
        if len(raw) <= MEMORY_BYTES:
            if len(self) >= MEMORY_MATCHES:
                self.clear()
            self[match] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.cut = regex.compile(pattern).findall
        self.matches = Matches(ranks)
        self.spelled = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.spelled[i] = raw

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as 32-bit numbers; null and empty give none. What the pattern doesn't match is left out."""
        return np.frombuffer(b"".join(map(self.matches.__getitem__, self.cut(text or ""))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id outside the vocabulary is an error."""
        if len(ids) and int(ids.min()) < 0:
            raise ValueError("negative id")
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))


def _vocabulary(ranks_file: str | None, pattern: str | None) -> tuple[bytes, str]:
    """The rank file's content, which travels with the tasks, and the pattern."""
    if ranks_file is None or pattern is None:
        own_file, own_pattern = default_vocabulary()
        ranks_file, pattern = ranks_file or own_file, pattern or own_pattern
    with open(ranks_file, "rb") as file:
        return file.read(), pattern


def encode_documents(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None, doc: str = "doc_id",
                     text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; with ``decoded`` also the bytes that the ids spell.

    Null and empty texts have no ids. Repeated rows are encoded each, null ids stay null; an empty table gives no rows.
    Texts are taken whole. Strings that name special tokens are ordinary text. Other columns are not read, so their
    names don't matter. No rows move; the driver reads the rank file (under a megabyte) and sends it along.
    """
    spark = docs.sparkSession
    content, pattern = _vocabulary(ranks_file, pattern)
    send = spark.sparkContext.broadcast((content, pattern))
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(parse_ranks(send.value[0]), send.value[1])
            ids = [codec.encode(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            arrays = [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)),
                      pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decoded:
                arrays.append(pa.array([codec.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids", "decoded"][:len(arrays)])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>" + (", decoded binary" if decoded else ""))


def decode_documents(encoded: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, decoded`` (bytes) from ``doc_id, ids``; null ids give no bytes, an id outside the vocabulary is an error."""
    content, pattern = _vocabulary(ranks_file, pattern)
    send = encoded.sparkSession.sparkContext.broadcast((content, pattern))
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(parse_ranks(send.value[0]), send.value[1])
            out = [codec.decode(np.array(i or [], np.int32)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return rows.mapInArrow(run, "doc_id long, decoded binary")
