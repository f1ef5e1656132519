"""Byte BPE and word tokens against the libraries; packing plans against their capacity and bounds."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quantgrid.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.one_of(st.sampled_from(list("ab tion the.,'s\n\t\r  12é ß \x1c\x85  İſ中<|")), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def library():
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORDS)


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).integers(0, 2**63, 10_000, dtype=np.uint64)
    keys = np.unique(keys)
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert bpe.PerfectHash(np.array([], np.uint64)).slots(keys[:3]).tolist() == [-1] * 3


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_byte_bpe_equals_library(library, texts):
    enc = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, enc.encode_batch(texts)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert enc.decode(ids.tolist()) == text.encode()


def test_byte_bpe_long_match(library):
    text = "".join(random.Random(1).choice("abcde") for _ in range(20_000))
    enc = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    assert enc.encode_batch([text])[0].tolist() == library.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_word_ids_equal_library(words, text):
    got = np.frombuffer(packing.encoder(WORDS).encode(text), "<u4").tolist()
    assert got == words.encode(text, add_special_tokens=False).ids, repr(text)


def bins(counts, capacity):
    plan = packing.plan_sequences(counts, capacity)
    used = {}
    for r in plan.itertuples():
        for rank in range(r.first, r.until):
            seq = r.sequence + (rank - r.first) // r.uses
            used.setdefault(seq, []).append((r.offset + (rank - r.first) % r.uses * r.length, r.length))
    return used


def fewest(sizes, capacity):
    """Exact optimum by search, for a handful of sizes."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1:])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plan_is_gapless_and_near_optimal(sizes):
    counts = {n: sizes.count(n) for n in set(sizes)}
    used = bins(counts, 20)
    assert sorted(n for v in used.values() for _, n in v) == sorted(sizes)
    for v in used.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 20
    if sizes:
        assert len(used) <= fewest(sorted(sizes, reverse=True), 20) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_reduction_keeps_the_optimum(sizes):
    counts = {n: sizes.count(n) for n in set(sizes)}
    best = fewest(sorted(sizes, reverse=True), 20)
    fixed = sum(n for _, n in packing.reduce_lengths(counts, 20))
    rest = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    assert fixed + fewest(rest, 20) == best


def test_pack_edge_rows(spark, words):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "null id"), (4, "word " * 9000), (5, "Idiot-proof <|endoftext|> ünï")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank", "3 as piece")
    got = packing.pack(df, WORDS).collect()
    want = []
    for doc, text in rows:
        ids = words.encode(text or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(ids), 4096):
            part = np.array(ids[i:i + 4096], "<u4")
            want.append((doc, i // 4096, i, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(map(repr, want))
    place = {}
    for r in got:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in place.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_bpe_edge_rows(spark, library):
    rows = [(1, "a  b\n\n c"), (1, "a  b\n\n c"), (2, None), (3, ""), (None, "x"), (4, "tion" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = bpe.round_trip_digests(df, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.encode_ids(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
