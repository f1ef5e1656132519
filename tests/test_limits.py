"""Behaviour that must not depend on size, era or duplicates."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantgrid.operators import order_stats, pit, rolling, xsection
from quantgrid.sources import axis


@pytest.mark.parametrize("halflife", [1, 6, 62])
def test_recency_weights_on_a_long_axis(spark, halflife):
    n, window = 40_000, 24
    rng = np.random.default_rng(halflife)
    x = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n))
    df = spark.createDataFrame([(1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "tick int, date_idx int, x double")
    got = df.select("date_idx", rolling.exp_weighted_mean("x", window, halflife).alias("m"),
                    rolling.exp_weighted_std("x", window, halflife).alias("s"),
                    rolling.exp_weighted_mean("x", window, halflife, full=True, skip=7).alias("k")).orderBy("date_idx").toPandas()
    w = 0.5 ** (np.arange(window)[::-1] / halflife)

    def frame(end):
        v = x[max(0, end - window + 1):end + 1]
        u = w[window - len(v):]
        ok = ~np.isnan(v)
        return v[ok], u[ok]

    for i in [*range(0, 60), *range(1700, 1800), *range(n - 100, n)]:
        v, u = frame(i)
        m = (v * u).sum() / u.sum()
        assert abs(got["m"][i] - m) < 1e-9
        assert abs(got["s"][i] - np.sqrt((u * (v - m) ** 2).sum() / u.sum())) < 1e-7
        if i >= window + 6:
            v, u = frame(i - 7)
            assert abs(got["k"][i] - (v * u).sum() / u.sum()) < 1e-9


def test_window_far_longer_than_the_half_life(spark):
    df = spark.range(6000).selectExpr("1 as tick", "cast(id as int) as date_idx", "if(id < 5 or id > 4990, cast(id as double), null) as x")
    got = dict(df.select("date_idx", rolling.exp_weighted_mean("x", 5000, 0.5).alias("m")).where("date_idx in (3, 5999)").collect())
    assert abs(got[3] - (3 + 2 / 4 + 1 / 16) / (1 + 1 / 4 + 1 / 16 + 1 / 64)) < 1e-9
    assert abs(got[5999] - (5999 - 1 / 3)) < 1e-6


@pytest.mark.parametrize("width", [12, 13])
def test_quantiles_of_any_era_and_width(spark, width):
    cols = [f"c{i}" for i in range(width)]
    rows = [(dt.date(y, 1, 1), *[float(i + k) for i in range(width)]) for y in (1930, 2050) for k in (0, 1)]
    df = spark.createDataFrame(rows, "date date, " + ", ".join(f"{c} double" for c in cols))
    got = {r["date"].year: r for r in order_stats.group_medians(df, ["date"], cols).collect()}
    assert all(got[y][f"c{i}_med"] == i + 0.5 for y in (1930, 2050) for i in range(width))


def test_long_calendar(spark):
    df = spark.range(50_000).selectExpr("date_add(date'1900-01-01', cast(id as int)) as date", "1 as tick", "cast(id as double) as x")
    assert axis.date_axis(df).agg(F.max("date_idx")).first()[0] == 49_999
    assert axis.densify(df.where("x % 2 = 0"), ["x"], days=axis.calendar(df)).count() == 50_000


@pytest.mark.parametrize("days", [(0, 0, 2), (0, 1, 1, 3)])
def test_duplicates_raise(spark, days):
    rows = [(1, dt.date(2020, 1, 1 + d), float(i)) for i, d in enumerate(days)]
    facts = spark.createDataFrame(rows, "tick int, date date, x double")
    with pytest.raises(Exception, match="two rows for tick"):
        axis.densify(facts, ["x"]).collect()
    grid = spark.createDataFrame([(1, dt.date(2020, 1, 9))], "tick int, date date")
    with pytest.raises(Exception, match="two events for"):
        pit.asof_last(grid, facts, ["x"]).collect()


def test_exponent_outside_the_first_grid(spark):
    rng = np.random.default_rng(1)
    rows = [(d, float(v)) for d, p in ((0, 9.0), (1, 1.0), (2, -5.0)) for v in
            (((1 + p * (2 + rng.normal(size=400) * 0.3)) ** (1 / p) - 1) if p > 0 else ((1 + p * (0.1 + rng.normal(size=400) * 0.01)) ** (1 / p) - 1))]
    df = spark.createDataFrame(rows, "date_idx int, x double")
    got = dict(xsection.yeo_johnson_lambda(df, "x").collect())

    def llf(x, lam):
        y = ((x + 1) ** lam - 1) / lam
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.log1p(x).sum()

    for d in (0, 1, 2):
        x = np.array([v for k, v in rows if k == d])
        grid = np.linspace(-40, 40, 80_001) + 1e-5
        best = grid[np.argmax([llf(x, g) for g in grid[::20]]) * 20]
        assert abs(got[d] - best) < 0.05
    assert got[0] > 4 and got[2] < -2


def test_residuals_are_plain(spark):
    rows = [(0, 1, 5.0, 2.0), (0, 1, 5.0, 2.0), (0, 1, 5.0, 2.0), (0, 2, 1e-11, 1.0), (0, 2, 3e-11, 2.0), (0, 2, 2e-11, 4.0)]
    df = spark.createDataFrame(rows, "date_idx int, industry int, x double, logmv double")
    got = [r["x"] for r in xsection.neutralise_event(df, ["x"]).orderBy("industry", "logmv").collect()]
    assert got[:3] == [0.0] * 3 and all(g != 0 for g in got[3:])
    z = xsection.cs_zscore_sample(df.where("industry = 2"), ["x"]).collect()
    assert abs(sum(r["x"] ** 2 for r in z) - 2) < 1e-9
