"""The Jaccard join against all pairs, its parts, and the defined cases."""

import random

import numpy as np

from quantgrid.llm import jaccard, queries


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc_id, rep, class_id, n_links) by comparing all rows that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where[x]:
                common[j] = common.get(j, 0) + 1
        near = {j for j, c in common.items() if 5 * c >= 4 * (len(s) + len(sets[j]) - c)}
        near |= {j for j, (_, t) in enumerate(rows) if (t or "") == (rows[i][1] or "")}
        for j in near - {i}:
            links[i] += 1
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    low, same = {}, {}
    for i, (d, t) in enumerate(rows):
        for table, k in ((low, find(i)), (same, t or "")):
            table[k] = min((x for x in (table.get(k), d) if x is not None), default=None)
    return [(d, same[t or ""], low[find(i)], links[i]) for i, (d, t) in enumerate(rows)]


def family(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_pruning_table():
    need = jaccard.fewest_matches()
    assert all(need[n] <= 0.8 * n for n in need) and need[jaccard.HASHES] > 0.4 * jaccard.HASHES
    assert 1 - (1 - 0.8**jaccard.ROWS) ** jaccard.BANDS > 1 - 2e-5


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (8000, 1000, 1000))
    agree = (jaccard.minhash(np.concatenate([common, a])) == jaccard.minhash(np.concatenate([common, b]))).mean()
    assert abs(agree - 0.8) < 0.12


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(6)
    name = [rng.randrange(2**60) for _ in range(900)]
    edges = [(i, i + 1) for i in range(300)] + [(400, i) for i in range(401, 700)] + [(700 + i, 700 + (i + 1) % 100) for i in range(100)] + [(850, 850)]
    df = spark.createDataFrame([(name[x], name[y]) for x, y in edges], "a long, b long")
    groups = {}
    for r in jaccard.components(df).collect():
        groups.setdefault(r.root, set()).add(r.node)
    want = [set(name[:301]), set(name[400:700]), set(name[700:800])]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
    assert jaccard.components(df.limit(0)).count() == 0


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.rep, r.class_id, r.n_links) for r in queries.op4(spark, sf).collect()]
    want = brute(rows)
    assert sorted(got) == sorted(want) and sum(w[3] > 0 for w in want) > 50


def test_large_family_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 40)
    texts = family(150, 120, 6, 1) + family(60, 40, 3, 2) + family(30, 6, 1, 3)
    rows = list(enumerate(texts * 2 + texts[:20]))
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.rep, r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect()]
    assert sorted(got) == sorted(brute(rows))
    kept = jaccard.keep_one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({g[2] for g in got})


def test_edge_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "one two"), (None, "one two"), (7, long), (8, long + " end"),
            (9, "alone here"), (9, "alone here"), (10, "a b c d e"), (11, "a b c d f"), (None, "null only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as root", "3 as copies", "4 as chunk")
    got = [(r.doc_id, r.rep, r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [1, 3, 4, 7, 9, 10, 11, None]))
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
