"""Exact ranks and quantiles when half a group is one value or a whole group is nearly one."""

import numpy as np
import pytest

from quantgrid.operators import order_stats


@pytest.fixture
def tight(monkeypatch):
    monkeypatch.setattr(order_stats, "BUCKET_ROWS", 50)
    monkeypatch.setattr(order_stats, "HEAVY_ROWS", 50)
    monkeypatch.setattr(order_stats, "CUTS", 8)


def groups():
    rng = np.random.default_rng(3)
    near = 1 + rng.random(700) * 1e-6
    half = np.where(rng.random(700) < 0.5, 0.0, rng.normal(size=700))
    twice = np.concatenate([np.full(400, 7.0), 7 + rng.random(300) * 1e-9])
    return {0: near, 1: half, 2: twice, 3: rng.lognormal(size=40), 4: np.array([2.0])}


def test_quantiles(spark, tight):
    g = groups()
    df = spark.createDataFrame([(k, float(v), None if i % 3 else float(-v)) for k, x in g.items() for i, v in enumerate(x)], "d int, x double, y double")
    for r in order_stats.group_quantiles(df, ["d"], ["x", "y"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        for c, x in (("x", g[r["d"]]), ("y", -g[r["d"]][::3])):
            np.testing.assert_allclose([r[f"{c}_q{j}"] for j in range(5)], np.quantile(x, [0, 0.1, 0.5, 0.99, 1]), rtol=1e-13)


def test_ranks(spark, tight):
    g = groups()
    rows = [(k, i, float(v)) for k, x in g.items() for i, v in enumerate(x)] + [(k, -1 - i, None) for k in g for i in range(30)]
    df = spark.createDataFrame(rows, "d int, i int, x double")
    ranked = order_stats.average_rank(df, ["d"], "x")
    got = {(r["d"], r["i"]): (r["rank"], r["size"]) for r in ranked.collect()}
    assert len(got) == len(rows)
    for k, x in g.items():
        order = np.sort(x)
        for i, v in enumerate(x):
            want = (np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2
            assert got[k, i] == (want, len(x))
        assert got[k, -1] == (None, None)


def test_no_large_reducer(spark, tight):
    """Half of one date at 0: no reducer of the join back gets more than a few times the heavy limit."""
    df = spark.range(4000).selectExpr("1 as d", "id as i", "if(id % 2 = 0, 0D, cast(id as double)) as x")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = order_stats.average_rank(df, ["d"], "x").rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 1200


def test_quantile_histogram_combines(spark, monkeypatch):
    """20,000 different values of one group fall into few buckets, and the quantiles are still exact."""
    x = np.random.default_rng(8).lognormal(size=20_000)
    df = spark.createDataFrame([(0, float(v)) for v in x], "d int, x double")
    seen, real = [], order_stats.order_bucket
    monkeypatch.setattr(order_stats, "order_bucket", lambda c, *a: (seen.append(real(c, *a)), seen[-1])[1])
    got = order_stats.group_quantiles(df, ["d"], ["x"], [0.25, 0.5]).first()
    np.testing.assert_allclose([got["x_q0"], got["x_q1"]], np.quantile(x, [0.25, 0.5]), rtol=1e-13)
    assert df.select(df.x.alias("_x")).select(seen[0]).distinct().count() < 300
