"""Cross-sectional operators against NumPy, under skew, ties and without any broadcast."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import quantgrid.core as core
from grid import N, T, arrays, dense, frame, same
from quantgrid.operators import order_stats as O
from quantgrid.operators import xsection as X

warnings.simplefilter("ignore")


@pytest.fixture(scope="module")
def data(spark):
    x, y = arrays(1)
    ind = np.repeat(np.array([0, 0, 0, 1, 1, 1, 2, np.nan])[None, :], T, axis=0)
    df = frame(spark, x=x, y=y, g=ind).withColumn("industry", F.col("g").cast("int")).cache()
    return x, y, ind, df


@pytest.fixture(params=["broadcast", "shuffle"])
def path(request, monkeypatch):
    """Both ways of joining statistics back: hinted broadcast and plain shuffle join."""
    if request.param == "shuffle":
        monkeypatch.setattr(core, "BROADCAST_ROWS", -1)
    return request.param


def clip(a, lo, hi):
    return np.where(a > hi, hi, np.where(a < lo, lo, a))


def test_zscore(data, path):
    x, _, _, df = data
    sd = np.nanstd(x, axis=1, keepdims=True)
    want = (x - np.nanmean(x, axis=1, keepdims=True)) / np.where(sd < 1e-8, np.nan, sd)
    same(dense(X.cs_zscore(df, ["x"]), "x"), want)


@pytest.mark.parametrize("kind", ["mad", "sigma", "quantile"])
def test_winsor(data, path, kind):
    x, y, _, df = data
    got = X.winsor(df, ["x", "y"], kind, p=0.1, n=1.5)
    for name, a in (("x", x), ("y", y)):
        med = np.nanmedian(a, axis=1, keepdims=True)
        mad = np.nanmedian(np.abs(a - med), axis=1, keepdims=True)
        mu, sd = np.nanmean(a, axis=1, keepdims=True), np.nanstd(a, axis=1, keepdims=True)
        lo, hi = {"mad": (med - 1.5 * 1.4826 * mad, med + 1.5 * 1.4826 * mad), "sigma": (mu - 1.5 * sd, mu + 1.5 * sd),
                  "quantile": (np.nanquantile(a, 0.1, axis=1, keepdims=True), np.nanquantile(a, 0.9, axis=1, keepdims=True))}[kind]
        same(dense(got, name), clip(a, lo, hi))


def test_tail_mean_and_shrink(data):
    _, y, _, df = data
    lo, hi = np.nanquantile(y, 0.2, axis=1, keepdims=True), np.nanquantile(y, 0.8, axis=1, keepdims=True)
    lm = np.nanmean(np.where(y < lo, y, np.nan), axis=1, keepdims=True)
    hm = np.nanmean(np.where(y > hi, y, np.nan), axis=1, keepdims=True)
    same(dense(X.winsor_tail_mean(df, ["y"], 0.2), "y"), np.where(y < lo, lm, np.where(y > hi, hm, y)))
    want = np.where(y < lo, lo - (lo - y) * 0.5, np.where(y > hi, hi + (y - hi) * 0.5, y))
    same(dense(X.winsor_shrink(df, ["y"], 0.2), "y"), want)


def average_ranks(a):
    out = np.full(a.shape, np.nan)
    for t in range(a.shape[0]):
        for n in range(a.shape[1]):
            if not np.isnan(a[t, n]):
                out[t, n] = (a[t] < a[t, n]).sum() + ((a[t] == a[t, n]).sum() + 1) / 2
    return out


def test_rank(data, path):
    _, y, _, df = data
    n = (~np.isnan(y)).sum(axis=1, keepdims=True)
    got = dense(X.cs_rank(df, "y"), "cs_rank")
    same(got, (average_ranks(y) - 1) / np.maximum(n - 1, 1))
    assert np.nanmin(got) >= 0 and np.nanmax(got) <= 1


def test_neutralise_and_singleton(data, path):
    x, y, ind, df = data
    got = dense(X.neutralise(df, ["x"], "industry", "y"), "x")
    want = np.full((T, N), np.nan)
    for t in range(T):
        for g in range(3):
            ok = (ind[t] == g) & ~np.isnan(x[t]) & (y[t] > 0)
            if ok.any():
                a, s = x[t, ok], np.log(y[t, ok])
                m = (s.mean() * a.mean() - (s * a).mean()) / (s.mean() ** 2 - (s * s).mean() + 1e-6)
                r = a - m * s - (a.mean() - m * s.mean())
                want[t, ok] = (r - r.mean()) / (r.std() + 1e-6)
    same(got, want, 1e-6)
    assert np.nanmax(np.abs(got[:, 6])) < 1e-9      # the only name of its industry


def test_yeo_johnson_beats_neighbours(data):
    x, _, _, df = data
    lam = {r.date_idx: r.lam for r in X.yeo_johnson_lambda(df, "x").collect()}

    def llf(a, q):
        up, down = a >= 0, a < 0
        z = np.empty_like(a)
        z[up] = np.log1p(a[up]) if abs(q) < 1e-12 else ((a[up] + 1) ** q - 1) / q
        z[down] = -np.log1p(-a[down]) if abs(q - 2) < 1e-12 else -((1 - a[down]) ** (2 - q) - 1) / (2 - q)
        return -len(a) / 2 * np.log(z.var()) + (q - 1) * (np.sign(a) * np.log1p(np.abs(a))).sum()

    for t, q in lam.items():
        a = x[t][~np.isnan(x[t])]
        if -2 < q < 4:
            assert llf(a, q) >= max(llf(a, q - 0.02), llf(a, q + 0.02)) - 1e-9
    z = dense(X.yeo_johnson(df, "x"), "yeo")
    assert np.isnan(z[7]).all() and np.isnan(z[9]).all()    # no value, one value


def test_exponent_does_not_depend_on_the_start(spark):
    """Within 1e-6 of a fine plain search from either side, also far from the usual exponents."""
    rng = np.random.default_rng(5)
    groups = [rng.lognormal(1, 0.8, 60), 0.02 * rng.normal(size=80), rng.normal(3, 1, 40) ** 3]
    df = spark.createDataFrame([(g, float(v)) for g, a in enumerate(groups) for v in a], "date_idx int, x double")
    found = [{r.date_idx: r.lam for r in X.yeo_johnson_lambda(df, "x", start=s).collect()} for s in (1.0, -7.0)]

    def llf(a, q):
        y = np.where(a >= 0, np.expm1(q * np.log1p(np.abs(a))) / q, -np.expm1((2 - q) * np.log1p(np.abs(a))) / (2 - q))
        return -len(a) / 2 * np.log(y.var()) + (q - 1) * (np.sign(a) * np.log1p(np.abs(a))).sum()

    for g, a in enumerate(groups):
        assert abs(found[0][g] - found[1][g]) < 1e-6
        q, h = found[0][g], 1e-3  # the vertex of the parabola through three likelihoods around it
        low, mid, high = llf(a, q - h), llf(a, q), llf(a, q + h)
        assert mid > low and mid > high and abs(h * (high - low) / (2 * (2 * mid - high - low))) < 1e-5


def test_quantiles_on_extreme_values_and_hot_ties(spark):
    """One group holds a third of all rows, a third of those share one value, magnitudes span 1e-300 to 1e300."""
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.zeros(2000), rng.normal(size=2000), -np.exp(rng.normal(0, 80, 1000)), np.exp(rng.normal(0, 80, 1000))])
    rest = rng.normal(5, 1e-9, 12000)
    group = np.concatenate([np.zeros(6000, int), rng.integers(1, 9, 12000)])
    value = np.concatenate([hot, rest])
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(group, value)], "date_idx int, v double").repartition(8)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r[0]: list(r[1:]) for r in O.group_quantiles(df, ["date_idx"], ["v"], probs).collect()}
    for g in range(9):
        a = np.sort(value[group == g])
        pos = np.array(probs) * (len(a) - 1)
        lo, hi = np.floor(pos).astype(int), np.ceil(pos).astype(int)
        np.testing.assert_array_equal(got[g], a[lo] + (a[hi] - a[lo]) * (pos - lo))
    ranked = O.average_rank(df, ["date_idx"], "v").collect()
    assert len(ranked) == len(value)
    for r in ranked[::97]:
        a = value[group == r.date_idx]
        assert r.rank == (a < r.v).sum() + ((a == r.v).sum() + 1) / 2 and r["size"] == len(a)


def test_no_task_holds_the_hot_group(spark):
    """The plan never windows or collects by date: every exchange of rows is keyed by more than the date."""
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("date_idx"), F.rand(1).alias("v"))
    plan = O.average_rank(df, ["date_idx"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    by_date = [line for line in plan.splitlines() if "Exchange hashpartitioning(date_idx" in line and "," not in line.split("hashpartitioning(")[1].split(", 8)")[0]]
    assert len(by_date) <= 1      # only the bucket totals
