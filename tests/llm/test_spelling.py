"""Spelling variants against a plain version, rotations and the defined cases."""

import random
import re
import zlib
from collections import Counter

from quantgrid.llm import queries, spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:]


def brute(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    places = {}  # words by what is left when a code point goes, found by another way than rotations
    for w in n:
        for s in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} if len(w) < 1000 else {w[:300], w[-300:]}:
            places.setdefault(s, []).append(w)
    around = {w: set() for w in n}
    for group in places.values():
        for a in group:
            around[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, c in n.items():
        best = min(around[w], key=lambda b: (-n[b], b), default=None)
        if best is not None and n[best] >= 2 * c:
            form[w] = best
    out = []
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(around[w]), n[form[w]] if w in form else None))
    return out


def ordered(rows):
    return sorted(map(repr, map(tuple, rows)))


def check(df, rows):
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert ordered(got.collect()) == ordered(brute(rows))


def test_query_equals_the_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op13(spark, sf)
    assert [t for _, t in got.dtypes] == ["string"] * 3 + ["bigint"] * 3
    want = brute(rows)
    assert ordered(got.collect()) == ordered(want) and sum(w[1] is not None for w in want) > 100


def test_dense_neighbourhoods(spark):
    """Short words over few letters: doubled letters, many ties, chains of forms."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([5, 5, 6, 7]))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words[: 1 + int(400 * rng.random() ** 2)]) for _ in range(60))) for i in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_long_words_and_the_border(spark):
    rng = random.Random(7)
    rows = []
    for n in (63, 64, 65, 66, 130, 2000):
        w = "".join(rng.choice("abcdefghij") for _ in range(n))
        for v, times in ((w, 9), (w[:5] + w[6:], 4), (w[:-1], 3), ("x" + w[1:], 3), (w + "z", 3), (w[:20] + "q" + w[21:], 4)):
            rows += [(len(rows) + i, v) for i in range(times)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_rotations_meet_in_one_range_for_every_near_pair():
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))) for _ in range(150)}
    words |= {w * 12 for w in list(words)[:20]} | {w * 12 + "a" for w in list(words)[:20]}
    rows = {w: list(spelling.rotations(w)) for w in words}
    for a in words:
        for b in words:
            if a != b:
                met = [(k, l) for p, k in rows[a] for q, l in rows[b] if p == q]
                met = [m for m in met if m[0] and m[1] or sorted(m) == [spelling.WHOLE, spelling.FIRST]]
                assert len(met) == near(a, b)


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "KEPT_WORDS", 5)
    rows = [(1, None), (2, ""), (None, "Nobody nobody NOBODY nobodies"), (3, "x" * 100_000), (4, "x" * 100_000), (5, "x" * 100_000), (6, "x" * 100_001)]
    rows += [(7, "naïve naïve naive naive naive ÀÉÎõü ÀÉÎõü ÀÉÎõü àÉÎõü 12a 34")] * 40 + [(8, "nobodi " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as wid", "'a' as word", "3 as form", "4 as root")
    check(df, rows)
    assert spelling.variants(df.limit(0)).count() == 0
