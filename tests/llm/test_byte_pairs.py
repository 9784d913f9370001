"""Byte-level BPE against the plain merge loop, the tiktoken library and exact round trips."""

import hashlib
import random

import numpy as np
import pytest

from obsexp.llm import byte_pairs as B

SCHEMA = "doc_id long, text string, ids string, n_tokens int, source string"
TEXTS = ["", " ", "   a  b ", "Hello world's\n\n\tnew  line  ", "naïve café 中文 𝒳𝒴 　x", "x" * 3000, "ab" * 700, "end  ", "\r\n",
         "12345.678!!!??? <|endoftext|> they'LL we'll", "  \x1c\x85", "é​", "\x00\x01"]


@pytest.fixture(scope="module")
def public():
    path, pattern = B.default_vocabulary()
    return B.Codec(B.parse_ranks(open(path, "rb").read()), pattern)


@pytest.fixture(scope="module")
def library(public):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=B.default_vocabulary()[1], mergeable_ranks=public.matches.ranks, special_tokens={})


def plain_merge(match, ranks):
    """The leftmost pair of the lowest rank, searched anew for every merge."""
    parts = [match[i:i + 1] for i in range(len(match))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_tree_merges_like_the_plain_search():
    rng = random.Random(4)
    ranks = {bytes([b]): b for b in range(256)}
    # A small alphabet and random merges: many ties, overlapping pairs, and merges that only other merges allow.
    parts = [b"a", b"b", b"c"]
    while len(ranks) < 310:
        new = rng.choice(parts) + rng.choice(parts)
        if new not in ranks:
            ranks[new] = len(ranks)
            parts.append(new)
    order = list(range(256, len(ranks)))
    rng.shuffle(order)
    shuffled = {k: (v if v < 256 else order[v - 256]) for k, v in ranks.items()}
    for table in (ranks, shuffled):
        for size in [1, 2, 3, 4, 5, 7, 8, 9, 31, 64, 65] * 12:
            match = bytes(rng.choices(b"abcd", k=size))
            assert B.merge(match, table) == plain_merge(match, table)


def test_ids_are_those_of_the_library(public, library):
    rng = random.Random(5)
    letters = "abcdeé \n中1.,T's\t "
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(300)]
    texts += ["".join(chr(c) for c in range(a, a + 700) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3400, 700)]
    for text in texts:
        ids = public.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert public.decode(ids) == text.encode()


def test_a_long_match_takes_n_log_n_steps(public, library):
    text = "".join(random.Random(6).choices("etaoinshrdlu", k=200_000))
    assert public.encode(text).tolist() == library.encode_ordinary(text)


def test_documents_with_nulls_repeats_and_no_rows(spark):
    rows = [(1, None, None, 1, "x"), (2, "", "s", 1, "x"), (3, "long " * 20000, "s", None, None), (3, "long " * 20000, "s", 1, "x"),
            (None, "a b", "s", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = B.encode_documents(df, decoded=True)
    out = got.collect()
    assert len(out) == 5 and [r.n_tokens for r in out if r.doc_id in (1, 2)] == [0, 0]
    assert all(r.n_tokens == len(r.ids) for r in out)
    assert {bytes(r.decoded) for r in out if r.doc_id == 3} == {b"long " * 20000}
    back = B.decode_documents(got.select("doc_id", "ids")).collect()
    assert sorted(len(r.decoded) for r in back) == [0, 0, 3, 100000, 100000]
    assert B.encode_documents(df.limit(0)).collect() == []


def test_registered_query(spark, small, registered, library):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in registered.queries()["op11_byte_bpe"](spark, small).collect())
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_vocabularies_must_spell_every_byte():
    with pytest.raises(ValueError):
        B.Codec({b"a": 0}, ".")
    assert np.array_equal(B.Codec({bytes([b]): b for b in range(256)}, r"[\s\S]").encode("é"), [0xC3, 0xA9])
