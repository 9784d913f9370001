"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

The automaton holds all pieces. While it reads a string, the output links of its state name every piece that ends at
the current position; each relaxes the best score there. No candidate outside the text is ever looked up, and the pass
is linear in the text plus the matches.

Pieces come from a public vocabulary file. Its scores are used as they are: the result is the segmentation of the
highest total score, earlier (longer) last pieces winning ties. For a vocabulary trained by pair merging this is the
best-scoring segmentation, not the replay of its merges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
# Encoded words remembered by one task; the memory is emptied when full.
MEMORY_WORDS = 400_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Pieces:
    """The vocabulary: texts and scores by id, and which of them are byte pieces."""

    texts: list[str]
    scores: list[float]
    matched: list[int]
    byte_ids: dict[int, int] = field(default_factory=dict)
    unknown: int = 0

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """Read a vocabulary file; control and unknown symbols are never matched in a text."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        texts = [sp.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = {int(texts[i][3:-1], 16): i for i in ids if sp.is_byte(i)}
        return cls(texts, [sp.get_score(i) for i in ids], plain, byte_ids, sp.unk_id())

    def __post_init__(self) -> None:
        # No piece continues over a mark after other text, so words (marks, then other text) can be taken one by one.
        self.by_word = all(MARK not in self.texts[i].lstrip(MARK) for i in self.matched)
        self.floor = min((self.scores[i] for i in self.matched), default=0.0) - UNKNOWN_PENALTY


class Encoder:
    """Viterbi over the automaton's matches, one word at a time, remembering words."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for i in pieces.matched:
            self.automaton.add_word(pieces.texts[i], (i, len(pieces.texts[i]), pieces.scores[i]))
        self.automaton.make_automaton()
        self.seen: dict[str, tuple[int, ...]] = {}
        # Byte pieces stand as the character of their value, or as the surrogate that escapes it.
        self.spelled = [t.replace(MARK, " ") for t in pieces.texts]
        for value, i in pieces.byte_ids.items():
            self.spelled[i] = chr(value) if value < 128 else chr(0xDC00 + value)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation; characters that no piece spells become bytes, or the unknown symbol."""
        n, floor, never = len(text), self.pieces.floor, float("-inf")
        best, ids, sizes = [0.0] + [never] * n, [-1] * (n + 1), [1] * (n + 1)
        at, single = 1, False  # the position being relaxed, and whether a one-character piece ends there
        for end, (i, size, score) in self.automaton.iter(text):
            while at <= end:
                if not single and best[at - 1] + floor > best[at]:
                    best[at], ids[at], sizes[at] = best[at - 1] + floor, -1, 1
                at, single = at + 1, False
            value = best[at - size] + score
            if value > best[at]:  # longer pieces come first, so they win ties
                best[at], ids[at], sizes[at] = value, i, size
            single = single or size == 1
        while at <= n:
            if not single and best[at - 1] + floor > best[at]:
                best[at], ids[at], sizes[at] = best[at - 1] + floor, -1, 1
            at, single = at + 1, False
        out, j = [], n
        while j:
            size = sizes[j]
            j -= size
            out.append(ids[j + size] if ids[j + size] >= 0 else -1 - ord(text[j]))
        out.reverse()
        return self._spell_unknown(out)

    def _spell_unknown(self, ids: list[int]) -> list[int]:
        if all(i >= 0 for i in ids):
            return ids
        out, table = [], self.pieces.byte_ids
        for i in ids:
            if i >= 0:
                out.append(i)
            elif table:
                out.extend(table[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.pieces.unknown)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text: spaces become marks and one mark leads, as the vocabulary expects. Null and empty: none."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.pieces.by_word:
            return self.viterbi(marked)
        seen, out = self.seen, []
        lead = 0  # marks not yet followed by text
        for part in marked[1:].split(MARK):
            if not part:
                lead += 1
                continue
            word = MARK * (lead + 1) + part
            lead = 0
            ids = seen.get(word)
            if ids is None:
                if len(seen) >= MEMORY_WORDS:
                    seen.clear()
                ids = tuple(self.viterbi(word))
                if len(word) <= 64:
                    seen[word] = ids
            out.extend(ids)
        if lead:
            out.extend(self.viterbi(MARK * lead))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of encoded ids: pieces side by side, byte runs read as UTF-8, the leading mark dropped."""
        spelled = self.spelled
        text = "".join([spelled[i] for i in ids])
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


SCHEMA = "doc_id long, source string, n_tokens long, ids array<int>, exact boolean"


def encode_documents(docs: DataFrame, model_file: str = DEFAULT_MODEL, doc: str = "doc_id", text: str = "text",
                     source: str = "source") -> DataFrame:
    """``doc_id, source, n_tokens, ids, exact`` of every document; ``exact`` says whether the ids decode to the text.

    Null and empty texts have no ids and are exact. Repeated rows are encoded each. A text that starts with a space
    keeps it; one that spells the mark character itself decodes to a space there and is not exact. Other columns are
    not read, so their names don't matter. No rows move between tasks; the vocabulary is loaded once per task.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Pieces.load(model_file))
            texts = batch.column("text").to_pylist()
            ids = [encoder.encode(t) for t in texts]
            exact = [encoder.decode(i) == t for i, t in zip(ids, texts)]
            sizes = np.array([len(i) for i in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.fromiter((i for one in ids for i in one), np.int32, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(exact, pa.bool_())],
                names=["doc_id", "source", "n_tokens", "ids", "exact"])

    return rows.mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Pieces.load(model_file))
            texts = [encoder.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")
