"""Held-out accuracy and defined cases of the two classifiers."""

import zlib

import numpy as np
import pytest

from quantgrid.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("op, target, fewest", [(queries.op2, "toxic", 0.97), (queries.op6, "quality", 0.98)])
def test_held_out_accuracy(spark, op, target, fewest):
    got = op(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert (got["predicted"] == (got["score"] >= (0.5 if target == "toxic" else 0.3))).all()
    labels = queries.table(spark, SF, "labels").toPandas().set_index("doc_id")[target]
    both = got.join(labels, how="inner")
    both = both[both["held_out"]]
    assert (both["predicted"] == both[target]).mean() >= fewest
    for c in (0, 1):
        assert (both["predicted"] == both[target])[both[target] == c].mean() >= 0.85


def rows(spark):
    text = [(i, f"good words number {i} here") for i in range(30)] + [(i, f"idiot {i} ### $$$ %%%") for i in range(30, 60)]
    text += [(60, None), (61, ""), (62, "x" * 200_000), (3, "good words number 3 here"), (None, "no id")]
    docs = spark.createDataFrame(text, "doc_id long, text string").selectExpr("*", "1 as label", "2 as score", "3 as predicted", "'a' as terms")
    labels = spark.createDataFrame([(i, int(i < 30), int(i >= 30)) for i in range(60)] + [(None, 1, 1), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_rows(spark, module):
    docs, labels = rows(spark)
    got = module.judge(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    wanted = {i: int(i < 30) if module is quality else int(i >= 30) for i in range(60)}
    known = got[got["doc_id"].isin(list(wanted))]
    assert (known["predicted"] == known["doc_id"].map(wanted)).mean() > 0.95
    assert got[got["doc_id"] == 3]["score"].nunique() == 1
    none = module.judge(docs, labels.limit(0)).toPandas()
    assert none["score"].nunique() == 1
    assert module.judge(docs.limit(0), labels).count() == 0


def test_margin_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = toxicity.FactorizationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)), rng.random(50) < 0.8)
    for n in (0, 1, 2, 9, 30):
        ids = np.sort(rng.choice(50, n, replace=False)).astype(np.int32)
        known = [i for i in ids if model.seen[i]]
        want = model.bias + sum(model.weights[i] for i in known)
        for k, i in enumerate(known):
            for j in known[k + 1:]:
                want += sum(model.factors[i][f] * model.factors[j][f] for f in range(4))
        assert abs(model.margin(ids) - want) < 1e-9


def test_gradient_of_the_machine_is_numeric():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(12, n, replace=False)) for n in (0, 1, 5, 12, 3, 7)]
    y, weight = np.array([0, 1, 1, 0, 1, 0]), rng.random(6) + 0.5
    b, w, v, scale = 0.2, rng.normal(size=12), rng.normal(size=(12, 3)), rng.random(12)

    def plain(b, w, v):
        total = 0.0
        for r, c, k in zip(rows, y, weight):
            z = b + sum(w[i] * scale[i] for i in r)
            z += sum(v[i] @ v[j] * scale[i] * scale[j] for a, i in enumerate(r) for j in r[a + 1:])
            total += k * (np.log1p(np.exp(-z)) if c else np.log1p(np.exp(z)))
        return total / len(rows)

    loss, gb, gw, gv = toxicity.loss_and_gradient(b, w, v, scale, rows, y, weight)
    assert abs(loss - plain(b, w, v)) < 1e-12
    step = 1e-6
    assert abs(gb - (plain(b + step, w, v) - plain(b - step, w, v)) / (2 * step)) < 1e-7
    for i in range(12):
        d = np.zeros(12)
        d[i] = step
        assert abs(gw[i] - (plain(b, w + d, v) - plain(b, w - d, v)) / (2 * step)) < 1e-7
        for f in range(3):
            e = np.zeros((12, 3))
            e[i, f] = step
            assert abs(gv[i, f] - (plain(b, w, v + e) - plain(b, w, v - e)) / (2 * step)) < 1e-7


def test_pair_weight_is_learned():
    """Two terms that are harmless apart and toxic together."""
    rng = np.random.default_rng(1)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    x = [np.array([3] * int(p) + [9] * int(q) + [20 + i % 50], np.int32) for i, (p, q) in enumerate(zip(a, b))]
    y = (a & b).astype(int)
    model = toxicity.fit(x, y, buckets=128, epochs=20)
    assert (np.array([model.margin(r) > 0 for r in x]) == y).mean() == 1


def test_exclusive_or_is_learned(spark):
    """Two terms that say nothing alone; the pairs, counted in tasks, tell."""
    rng = np.random.default_rng(1)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    x = [np.unique(np.array([3] * int(p) + [9] * int(q) + (20 + rng.integers(0, 500, 30)).tolist(), np.int32)) for p, q in zip(a, b)]
    y = (a ^ b).astype(int)
    assert (toxicity.evidence(x, y, 1024)[[3, 9]] < toxicity.SOFT).all()
    excess = toxicity.pair_evidence(spark, x[:3000], y[:3000], 1024)
    assert np.flatnonzero(excess).tolist() == [3, 9]
    model = toxicity.fit(x[:3000], y[:3000], buckets=1024, epochs=20, pair_excess=excess)
    assert (np.array([model.margin(r) > 0 for r in x[3000:]]) == y[3000:]).mean() > 0.98


def test_rare_and_indifferent_terms_keep_a_weight():
    """No term of the sample is left out: one in 8 toxic texts and no clean one counts, one in a single text as well."""
    rng = np.random.default_rng(2)
    y = (np.arange(4000) % 4 == 0).astype(int)
    x = [np.unique(np.append(rng.integers(10, 200, 20), [[], [3]][c])).astype(np.int32) for c in y]
    toxic = np.flatnonzero(y)
    x = [np.unique(np.append(r, 5)).astype(np.int32) if i in set(toxic[:8].tolist()) else r for i, r in enumerate(x)]
    x = [np.setdiff1d(r, [3]).astype(np.int32) if i in set(toxic[:8].tolist()) else r for i, r in enumerate(x)]
    x[1] = np.append(x[1], 250).astype(np.int32)
    model = toxicity.fit(x, y, buckets=256)
    assert model.weights[5] > 0.1 and model.weights[3] > model.weights[5] and model.weights[250] < 0
    assert model.margin(np.array([5], np.int32)) > model.margin(np.array([], np.int32))


def test_paired_terms_against_a_plain_count(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_TERMS", 7)
    rng = np.random.default_rng(2)
    has = rng.random((600, 20)) < 0.4
    y = ((has[:, 2] & has[:, 11]) | (has[:, 5] ^ has[:, 17])).astype(int)
    least = 2 * np.log(20 * 19 / 2)

    def g(x, y):
        cells = [(x == i) & (y == j) for i in (0, 1) for j in (0, 1)]
        return 2 * sum(c.sum() * np.log(c.sum() * len(x) / ((x == i).sum() * (y == j).sum()))
                       for c, (i, j) in zip(cells, [(i, j) for i in (0, 1) for j in (0, 1)]) if c.any())

    want = np.zeros(32)
    for i in range(20):
        for j in range(20):
            if i != j:
                want[i] = max(want[i], min(g(has[has[:, i], j], y[has[:, i]]), g(has[has[:, j], i], y[has[:, j]])) - least)
    blocks = toxicity.PairBlocks([np.flatnonzero(r).astype(np.int32) for r in has], y, 32)
    got = np.zeros(32)
    assert blocks.pairs() == 6
    for nth in range(6):
        np.maximum.at(got, *blocks.excess(nth))
    np.testing.assert_allclose(got, want, atol=1e-6)
    assert (want[[2, 11, 5, 17]] > 0).all()
    single = [toxicity.evidence([np.array([0] if v else [], np.int32) for v in has[:, k]], y, 1)[0] for k in range(20)]
    np.testing.assert_allclose(single, [g(has[:, k], y) for k in range(20)], atol=1e-6)


def test_sample_is_bounded_in_terms_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TERMS", 3000)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels, **_: seen.append((len(rows), sum(map(len, rows)))) or 0)
    text = [(i, " ".join(f"w{(i * 31 + k) % 900}" for k in range(40)), int(i % 3 == 0)) for i in range(300)] + [(1, "again", 0)] * 500
    df = spark.createDataFrame(text, "doc_id long, text string, toxic int")
    toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert 10 < seen[0][0] < 240 and seen[0][1] <= 3000


def test_pair_loss_of_the_ranking_against_plain_loops():
    rng = np.random.default_rng(4)
    better, worse = (np.stack([rng.integers(0, 5, 40) + 5 * j for j in range(3)], 1) for _ in range(2))
    w = rng.normal(size=15)

    def plain(w):
        total = 0.0
        for x, z in zip(better, worse):
            gap = sum(w[i] for i in x) - sum(w[i] for i in z)
            total += -np.log(1 / (1 + np.exp(-gap)))
        return total / len(better)

    loss, g = quality.pair_loss(w, better, worse)
    assert abs(loss - plain(w)) < 1e-12
    for i in range(15):
        d = np.zeros(15)
        d[i] = 1e-6
        assert abs(g[i] - (plain(w + d) - plain(w - d)) / 2e-6) < 1e-8


@pytest.mark.parametrize("share", [0.1, 0.5, 0.85])
def test_accepted_quantile_has_the_fewest_errors_of_all_cuts(share):
    rng = np.random.default_rng(int(share * 100))
    labels = (rng.random(400) < 0.4).astype(int)
    rows = rng.normal(size=(400, 13)) + 0.4 * labels[:, None]
    model = quality.fit(rows, labels, share)
    scores = model.scores(rows)
    weight = np.where(labels == 1, share / labels.sum(), (1 - share) / (labels == 0).sum())

    def errors(accepted):
        return weight[accepted != (labels == 1)].sum()

    cuts = [errors(scores >= c) for c in [*np.unique(scores), 2.0]]
    assert abs(errors(scores >= quality.THRESHOLD) - min(cuts)) < 1e-9
    order = np.argsort(scores)  # scores rank as the linear sums of the bins do
    raw = sum(model.weights[j][np.searchsorted(model.edges[j], rows[:, j], side="right")] for j in range(13))
    assert (np.diff(raw[order]) >= -1e-9).all()


def test_hash_sample_is_bounded(spark):
    labels = spark.range(50_000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as toxic")
    docs = labels.selectExpr("doc_id", "'t' as text")
    n = {r["label"]: r["count"] for r in labelled.training_rows(docs, labels, "toxic", 2000).groupBy("label").count().collect()}
    assert 850 < n[0] < 1150 and 850 < n[1] < 1150
