"""Mergeable moments, the models chosen from them, and components, against plain NumPy on all rows."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest

from quantgrid.operators import walkforward as W
from quantgrid.plans import load

FEATURES = [f"x{i}" for i in range(18)]


@pytest.fixture(scope="module")
def rows(spark):
    """8 years of month ends, 30 ticks, 18 correlated features with drift, a label, gaps."""
    rng = np.random.default_rng(4)
    days = [dt.date(2010 + m // 12, m % 12 + 1, 1) for m in range(96)]
    mix = rng.normal(size=(18, 18))
    out = []
    for t, day in enumerate(days):
        x = rng.normal(size=(30, 18)) @ mix + 50 + t
        y = x @ np.linspace(-0.2, 0.2, 18) + rng.normal(size=30)
        for n in range(30):
            out.append([day, f"{n:02d}", *x[n].tolist(), float(y[n])])
    df = pd.DataFrame(out, columns=["date", "tick", *FEATURES, "y"])
    df.loc[rng.random(len(df)) < 0.05, "x3"] = np.nan
    df.loc[rng.random(len(df)) < 0.05, "y"] = np.nan
    df.loc[df["date"] == days[40], "y"] = np.nan  # a date without complete rows
    values = [[None if isinstance(v, float) and np.isnan(v) else v for v in r] for r in df.itertuples(index=False, name=None)]
    schema = "date date, tick string, " + ", ".join(f"{c} double" for c in FEATURES) + ", y double"
    return df, spark.createDataFrame(values, schema).repartition(7).cache()


def years(spark):
    return W.walk_forward_windows(spark, "2010-01-01", "2017-12-31", 3, 2, 1, 1)


def unit(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def plain_models(df, windows, members, fraction, seed, penalties):
    """(window, member) -> (penalty, coef, intercept) by copying rows per window and fitting each on its own."""
    known = df.dropna()
    out = {}
    for w in sorted({r.window for r in windows}):
        part = {r.split: (r.start, r.end) for r in windows if r.window == w}
        train, valid = (known[(known["date"] >= part[s][0]) & (known["date"] <= part[s][1])] for s in ("train", "valid"))
        dates = df[(df["date"] >= part["valid"][0]) & (df["date"] <= part["valid"][1])]["date"].unique()
        for m in range(members):
            drawn = train if fraction >= 1 else train[[unit(t, d, m + seed) < fraction for t, d in zip(train["tick"], train["date"])]]
            x, y = drawn[FEATURES].to_numpy(), drawn["y"].to_numpy()
            cx, cy, best = x - x.mean(0), y - y.mean(), None
            for p in penalties:
                b = np.linalg.solve(cx.T @ cx / len(x) + p * np.eye(18), cx.T @ cy / len(x))
                daily = []
                for d in dates:
                    g = valid[valid["date"] == d]
                    f = g[FEATURES].to_numpy() @ b
                    daily.append(0.0 if not len(g) else np.cov(f, g["y"], bias=True)[0, 1] / (f.std() + 1e-6) / (g["y"].std() + 1e-6))
                score = round(float(np.mean(daily)), 9)
                if best is None or score > best[0]:
                    best = score, p, b, y.mean() - b @ x.mean(0)
            out[w, m] = best[1:]
    return out


@pytest.mark.parametrize("members, fraction", [(1, 1.0), (3, 0.7)])
def test_models_equal_separate_fits(spark, rows, members, fraction):
    df, frame = rows
    windows = years(spark)
    got = W.choose_models(frame, windows, FEATURES, "y", (0.0, 0.1, 50.0), members, fraction, 3).collect()
    want = plain_models(df, windows.collect(), members, fraction, 3, (0.0, 0.1, 50.0))
    assert {(r.window, r.member) for r in got} == set(want) and len(got) == 3 * members
    for r in got:
        penalty, b, a = want[r.window, r.member]
        assert r.penalty == penalty
        np.testing.assert_allclose([*r.coef, r.intercept], [*b, a], rtol=1e-7, atol=1e-7)


def test_bagged_prediction_is_the_mean_of_the_members(spark, rows):
    _, frame = rows
    args = frame, years(spark), FEATURES, "y"
    each = W.walk_forward_predict(*args, members=3, fraction=0.7, seed=1).toPandas().groupby(["window", "date", "tick"])["pred"].mean()
    bag = W.bagged_predict(*args, members=3, fraction=0.7, seed=1).toPandas().set_index(["window", "date", "tick"])["pred"]
    joined = pd.concat([each.rename("a"), bag.rename("b")], axis=1)
    assert len(bag) == len(each) and (joined["a"].isna() == joined["b"].isna()).all()
    np.testing.assert_allclose(joined["a"].dropna(), joined["b"].dropna(), rtol=1e-9)


def test_moments_of_far_values_and_many_states(spark, rows):
    """Values around 1e6 lose nothing; groups spread over tasks and batches."""
    df, frame = rows
    far = frame.selectExpr("date", "x1 + 1e6 as a", "x2 - 1e6 as b", "tick")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r.tick: r for r in W.moments(far, ["a", "b"], None, ["tick"]).collect()}
        whole = W.moments(far, ["a", "b"], None, []).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for tick, g in df.groupby("tick"):
        x = np.stack([g["x1"], g["x2"]])
        np.testing.assert_allclose(got[tick].cov, np.cov(x, bias=True)[np.triu_indices(2)], rtol=1e-8)
        assert got[tick].n == len(g)
    x = np.stack([df["x1"], df["x2"]])
    np.testing.assert_allclose(whole[0].cov, np.cov(x, bias=True)[np.triu_indices(2)], rtol=1e-8)
    assert W.moments(far.limit(0), ["a"], None, []).count() == 0


def test_rows_are_read_once_and_not_copied_per_window(spark, rows):
    """The fit has one scan of the rows, and no join or generator between it and the states."""
    _, frame = rows
    states = W.group_states(frame, [*FEATURES, "y"], ["date"], [frame["x0"] > 0, frame["x0"] < 9])
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and "Join" not in plan and "Generate" not in plan
    assert states.where("member = -1").agg({"n": "sum"}).first()[0] == len(rows[0].dropna())


def test_components_at_60_lags(spark):
    sf = "/root/testdata/sf0.01"
    from quantgrid.plans.fixtures import p2
    panel = p2(spark, sf).select("date_idx", "tick", "volume").toPandas().sort_values(["tick", "date_idx"])
    keys, x = [], []
    for tick, g in panel.groupby("tick"):
        v, at = g["volume"].to_numpy(float), g["date_idx"].to_numpy()
        for e in range(59, len(v)):
            if not np.isnan(v[e - 59:e + 1]).any():
                keys.append((int(at[e]), tick))
                x.append(v[e - 59:e + 1])
    x = np.array(x)
    _, vec = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(0)) @ vec[:, ::-1][:, :8]
    got = load().QUERIES["score_embeddings_wide"](spark, sf).toPandas()
    wide = got.pivot(index=["date_idx", "tick"], columns="dim", values="value").loc[keys].to_numpy()
    assert len(got) == 8 * len(keys) > 1000
    signs = np.sign((wide * want).sum(0))
    np.testing.assert_allclose(wide, want * signs, atol=2e-6)
