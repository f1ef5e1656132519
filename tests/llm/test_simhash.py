"""SimHash links against all pairs, parts of the index, long runs and the defined cases."""

import random
import re

import numpy as np
import pytest
import xxhash

from quantgrid.llm import queries, simhash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, distance=4):
    """Class of each distinct fingerprint by comparing all."""
    left, out = set(fps), {}
    while left:
        root = left.pop()
        open_ = [root]
        while open_:
            x = open_.pop()
            out[x] = root
            near = {y for y in left if (x ^ y).bit_count() <= distance}
            left -= near
            open_ += near
    return out


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    of = classes(prints)
    low = {}
    for (d, _), p in zip(rows, prints):
        low[of[p]] = min((x for x in (low.get(of[p]), d) if x is not None), default=None)
    return [(d, f"{p:016x}", low[of[p]]) for (d, _), p in zip(rows, prints)]


def ordered(rows):
    return sorted(map(repr, map(tuple, rows)))


def planted(n, seed):
    """Fingerprints in chains and balls around a few centres, and single ones."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n // 20):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            out.add(x)
            y = x
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                y ^= 1 << b
            x = y if rng.random() < 0.5 else x
            out.add(y)
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


def edges_to_classes(fps, edges):
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def grouped(of):
    groups = {}
    for x, r in of.items():
        groups.setdefault(r, set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op12(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    got = got.collect()
    assert ordered(got) == ordered(brute(rows)) and sum(r.doc_id != r.component_id for r in got) > 50


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_some_key_is_first_for_every_pair(distance):
    rng = random.Random(distance)
    masks = simhash.segments(distance)
    assert sum(masks) == 2**64 - 1 and len(masks) == distance // 2 + 1
    for _ in range(200):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(distance + 1)))
        first = simhash._first_key(np.full(64, diff, np.uint64), np.arange(64), distance)
        assert first.sum() == 1
        bit = int(np.flatnonzero(first)[0])
        mask = next(m for m in masks if m >> bit & 1)
        assert diff & mask & ~(1 << bit) == 0


@pytest.mark.parametrize("small, run, batch", [(32, 1 << 14, 10_000), (2, 30, 300), (1, 45, 1000)])
def test_links_over_runs_of_any_size(spark, monkeypatch, small, run, batch):
    """Short runs, long runs, runs beyond RUN, runs over several batches: always the same classes."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "RUN", run)
    fps = planted(160, 5)
    # one dense ball, so that runs are long
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = sorted(set(fps) | {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
        found = simhash.links(simhash.variants(nodes))
        members = found.where("key is not null").select("key", "a")
        more = simhash.long_run_links(members).collect()
        edges = [(r.a, r.b) for r in found.where("key is null").collect()] + [(r.a, r.b) for r in more]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (run < 100) == bool(more)
    edges = [(a % 2**64, b % 2**64) for a, b in edges]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in edges)
    assert edges_to_classes(fps, edges) == grouped(classes(fps))


def test_whole_texts_in_slices(monkeypatch):
    from quantgrid.llm import words
    monkeypatch.setattr(words, "SLICE_BYTES", 40)
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 5, 30, 400):
        text = "".join(rng.choice(["Ab", "é x", "c" * 50, "d"]) + rng.choice([" ", "\t", "\n \r", "\x0b\x0c"]) for _ in range(n))
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_edge_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (None, "one two"), (7, long), (8, long + " end"), (9, "alone here"),
            (9, "alone here"), (None, "null only"), (0, "x" * 200_000)] + [(100 + i, "the very same copy of a text") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as low", "3 as component", "4 as key", "5 as a")
    assert ordered(simhash.near_duplicates(docs).collect()) == ordered(brute(rows))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_hot_join_equals_a_plain_join(spark, monkeypatch):
    from quantgrid.llm import skew
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(500)] + [(900, None)], "i int, k string")
    facts = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(35))], "k string, v int")
    want = rows.join(facts, "k")
    got = skew.hot_join(rows, facts, "k")
    assert got.columns == want.columns and ordered(got.collect()) == ordered(want.collect())
