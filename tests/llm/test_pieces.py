"""Piece encoding against a quadratic search over all segmentations, and round trips."""

import random

import pytest

from obsexp.llm import pieces
from obsexp.llm.pieces import MARK, Encoder, Pieces

SCHEMA = "doc_id long, text string, source string, ids int, n_tokens string"


@pytest.fixture(scope="module")
def public():
    return Encoder(Pieces.load(pieces.DEFAULT_MODEL))


def best_score(vocab, text):
    """Highest total score, trying every piece at every position."""
    scores = {vocab.texts[i]: vocab.scores[i] for i in vocab.matched}
    best = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 16), j):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
        if text[j - 1] not in scores:
            best[j] = max(best[j], best[j - 1] + vocab.floor)
    return best[-1]


def score_of(vocab, ids, text):
    total, j = 0.0, 0
    byte = set(vocab.byte_ids.values())
    while ids:
        if ids[0] in byte:
            n = len(text[j].encode())
            ids, total, j = ids[n:], total + vocab.floor, j + 1
        else:
            total, j, ids = total + vocab.scores[ids[0]], j + len(vocab.texts[ids[0]]), ids[1:]
    assert j == len(text)
    return total


TEXTS = ["", " ", "  a  b ", "Hello world\n\n\tnew  line", "naïve café 中文 𝒳𝒴 \u3000x", "x" * 300, "end  ", "\r\n",
         "The quick brown fox; jumps over: the (lazy) dog? 12345.678"]


def test_scores_are_the_best_and_round_trips_exact(public):
    rng = random.Random(3)
    letters = "abcdeé \n中1.,T"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(200)]
    for text in texts:
        ids = public.encode(text)
        assert public.decode(ids) == text
        if text:
            marked = MARK + text.replace(" ", MARK)
            assert score_of(public.pieces, list(ids), marked) == best_score(public.pieces, marked)
            assert list(ids) == public.viterbi(marked)


def test_overlapping_pieces_follow_output_links():
    small = Pieces(["a", "b", "ab", "bab", "abab"], [-1.0, -1.0, -3.0, -1.5, -2.6], [0, 1, 2, 3, 4])
    assert Encoder(small).viterbi("abab") == [0, 3]
    assert Encoder(small).viterbi("axb") == [0, small.unknown, 1]


def test_documents_with_nulls_repeats_and_no_rows(spark):
    rows = [(1, None, None, 1, "x"), (2, "", "s", 1, "x"), (3, "long " * 20000, "s", None, None), (3, "long " * 20000, "s", 1, "x"),
            (None, f"a{MARK}b", "s", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pieces.encode_documents(df)
    out = got.collect()
    assert len(out) == 5 and [r.n_tokens for r in out if r.doc_id in (1, 2)] == [0, 0]
    assert all(r.exact == (r.doc_id is not None) and r.n_tokens == len(r.ids) for r in out)
    back = pieces.decode_documents(got).collect()
    assert sorted(len(r.text) for r in back if r.doc_id == 3) == [100000, 100000]
    assert pieces.encode_documents(df.limit(0)).collect() == []


def test_registered_query(spark, small, registered):
    rows = registered.queries()["op5_sentencepiece"](spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert len(rows) == docs and all(r.exact for r in rows)
