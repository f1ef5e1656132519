"""Syncmer fingerprints against a plain version, the neighbour order and the defined cases."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quantgrid.llm import queries, syncmers


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        a, b, c = map(syncmers.fingerprint, (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), syncmers.render(a), syncmers.render(b),
                    syncmers.likeness(a, b), syncmers.likeness(a, c)))
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcde é中"), max_size=80))
def test_closed_syncmers_by_definition(text):
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        at, _ = syncmers.anchors(codes)
        inner = syncmers._scramble(syncmers._rolling(codes, syncmers.S)).tolist() if len(codes) >= syncmers.S else []
    w = syncmers.K - syncmers.S + 1
    want = [i for i in range(len(text) - syncmers.K + 1) if min(inner[i:i + w]) in (inner[i], inner[i + w - 1])]
    assert at.tolist() == want


def test_anchors_survive_shifts():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    a, b = syncmers.fingerprint(text), syncmers.fingerprint("xx" + text)
    assert syncmers.likeness(a, b) > 0.95 and syncmers.likeness(a, a) == 1
    other = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    assert syncmers.likeness(a, syncmers.fingerprint(other)) < 0.1
    assert syncmers.likeness([], []) == 1 and syncmers.likeness([], a) == 0


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_short_passage_in_long_texts():
    """50 words shared by two texts of 20,000 are matched, at the share of all anchors that they hold."""
    rng = random.Random(4)
    passage = words(rng, 50)
    a, b = (f"{words(rng, 9_000)} {passage} {words(rng, 10_950)}" for _ in range(2))
    alike = syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b))
    assert 0.5 * 50 / 20_000 < alike < 2 * 50 / 20_000


def test_likeness_of_a_long_edit_is_the_kept_share():
    rng = random.Random(6)
    text = words(rng, 20_000)
    third = len(text) // 3
    edited = text[:-third] + words(rng, 20_000)[:third]
    assert abs(syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(edited)) - 2 / 3) < 0.005


def test_fingerprint_holds_every_anchor_and_is_read_again():
    rng = random.Random(5)
    for text in ("", "short", words(rng, 2_000), words(rng, 1) * 50 + words(rng, 30), "x" * 70_000 + words(rng, 9), "ab" * 300 + words(rng, 9)):
        mark = syncmers.fingerprint(text)
        back = syncmers.parse(syncmers.render(mark))
        assert back.tolist() == mark.tolist()
        with np.errstate(over="ignore"):
            at, h = syncmers.anchors(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64))
        if len(at):
            first = {}
            for p, x in zip(at.tolist(), h.tolist()):
                first.setdefault(x >> 32, p)
            assert sorted((m >> 32, m & 0xFFFFFFFF) for m in mark.tolist()) == sorted(first.items())


def test_query_equals_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op5(spark, sf).collect()]
    assert sorted(got) == sorted(plain(rows))
    assert np.mean([r[5] for r in got]) > 0.5


def test_edge_rows(spark):
    text = "some longer text with enough letters to have anchors "
    rows = [(5, text * 3), (5, text * 3), (5, "b"), (2, None), (1, ""), (None, "no id"), (9, "é中" * 40_000), (10**15, "far"), (-7, "x" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as own", "3 as n_chars")
    for width in (1, 3, 8):
        got = [tuple(r) for r in syncmers.edited_prints(df, width).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))
    one = df.where("doc_id = 9")
    assert [tuple(r) for r in syncmers.edited_prints(one, 4).collect()] == plain(rows[6:7])
    assert syncmers.edited_prints(df.limit(0), 4).count() == 0
