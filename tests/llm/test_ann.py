"""Learned partitions: balance, recall against brute force, exactness of what is returned, defined cases."""

import numpy as np

from quantgrid.llm import ann, queries


def brute(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            s = (x * v).sum(1)
            s[ids == i] = -np.inf
            best = np.lexsort((ids, -s))[:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in best if s[j] > -np.inf]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(8, 16)) * 4
    x = centre[np.arange(1600) % 8] + rng.normal(size=(1600, 16)) * 0.1
    near = ann.exact_neighbours(x / np.linalg.norm(x, axis=1, keepdims=True), 10)
    part = ann.balanced_parts(near, 8)
    assert np.bincount(part, minlength=8).tolist() == [200] * 8
    assert (part[near] == part[:, None]).mean() > 0.9


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.table(spark, sf, "embeddings").toPandas()
    want = brute(rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64), 20)
    got = listed(queries.op10(spark, sf))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    x = dict(zip(rows["vec_id"], np.stack(rows["embedding"]).astype(np.float64)))
    for q, found in got.items():
        assert all(abs(s - float(x[q] @ x[i])) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_edge_rows_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 8)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 0.5, 0.25]) for i in range(200)] + [(i, rng.normal(size=4).tolist()) for i in range(200, 400)]
    bad = [(400, None), (420, [0.0] * 4), (440, [1.0, None, 1.0, 1.0]), (460, [float("nan"), 1.0, 1.0, 1.0]), (480, [float("inf"), 1.0, 1.0, 1.0]),
           (500, [1.0, 2.0]), (None, [1.0] * 4), (520, [])]
    df = spark.createDataFrame(rows + bad + rows[:5] + rows[390:], "vec_id long, embedding array<double>").selectExpr("*", "1 as part", "2 as rank", "3 as score")
    got = listed(ann.nearest(df, "vec_id % 20 = 0", 20))
    want = brute(np.array([i for i, _ in rows]), np.array([v for _, v in rows]), 20)
    assert got.keys() == want.keys()
    hot = [q for q in want if q < 200]
    assert all(got[q] == want[q] for q in hot)
    few = df.where("vec_id < 6 or vec_id > 395")
    got = listed(ann.nearest(few, "vec_id % 20 = 0", 20))
    assert got.keys() == {0} and len(got[0]) == 9
    assert ann.nearest(df.limit(0), "vec_id % 20 = 0", 20).count() == 0


def test_visits_go_on_until_enough_rows_are_held():
    router = ann.Router(1.0, *[np.zeros(0)] * 4, reach=0.5)
    p = np.array([[0.6, 0.25, 0.1, 0.05], [0.05, 0.1, 0.25, 0.6]])
    rows = np.array([5, 10, 0, 30])
    assert router.visits(p).tolist() == [[True, False, False, False], [False, False, False, True]]
    assert router.visits(p, rows, 21).tolist() == [[True] * 4, [False, False, False, True]]
    assert router.visits(p, rows, 15).tolist() == [[True, True, False, False], [False, False, False, True]]
    assert router.visits(p, rows, 50).all()


def test_full_lists_with_a_hot_third_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_PART", 16)
    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile(rng.normal(size=8) * 3, (300, 1)), np.tile(rng.normal(size=8) * 3, (500, 1)),
                        np.repeat(rng.normal(size=(20, 8)) * 3, 5, 0) + rng.normal(size=(100, 8)) * 0.05])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = listed(ann.nearest(df, "vec_id >= 0", 20))
    assert len(got) == 900 and {len(v) for v in got.values()} == {20}
    assert all(q not in [i for i, _ in v] and len({i for i, _ in v}) == 20 for q, v in got.items())


def test_recall_and_visited_share_beyond_the_sample(spark, monkeypatch):
    """24,000 vectors around 300 centres, three times the sample: unseen queries, few rows visited."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(300, 24))
    x = centre[rng.integers(0, 300, 24_000)] + 0.35 * rng.normal(size=(24_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(24_000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    seen, plain = [], ann.search
    monkeypatch.setattr(ann, "search", lambda indexed, routed, rows, k: seen.append((routed, rows)) or plain(indexed, routed, rows, k))
    got = listed(ann.nearest(df, "vec_id % 100 = 0", 20))
    want = {}
    for i in range(0, 24_000, 100):
        s = x @ x[i]
        s[i] = -np.inf
        want[i] = set(np.argsort(-s, kind="stable")[:20].tolist())
    recall = np.mean([len({a for a, _ in got[q]} & want[q]) / 20 for q in want])
    routed, rows = seen[0]
    visited = np.mean([sum(rows.get(p, 0) for p in r.visit) for r in routed.collect()]) / 24_000
    print(f"recall {recall:.3f}, visited {visited:.3f}")
    assert len(got) == 240 and recall >= 0.9 and visited < 0.4
