"""Linear-time windows against NumPy and against the sliding frames, and the frames in their plan."""

import re

import numpy as np
import pytest

from grid import N, T, arrays, dense, frame, same
from quantgrid.operators import rolling as R
from quantgrid.operators import scans as S
from test_rolling import apply, nancorr, slope, wmean, wstd


def beta(a, b):
    a, b = np.where(np.isnan(b), np.nan, a), np.where(np.isnan(a), np.nan, b)
    v = wmean(b * b, 3) - wmean(b, 3) ** 2
    return np.nan if np.isnan(a).all() or v <= 1e-9 else (wmean(a * b, 3) - wmean(a, 3) * wmean(b, 3)) / v


CASES = {
    "mean": (lambda w: S.mean("x", w), lambda w, x, y: apply(np.nanmean, w, x)),
    "mean_full": (lambda w: S.mean("x", w, full=True), lambda w, x, y: apply(np.nanmean, w, x, full=True)),
    "std": (lambda w: S.std("y", w), lambda w, x, y: apply(np.nanstd, w, y)),
    "std1": (lambda w: S.std("x", w, ddof=1), lambda w, x, y: apply(
        lambda a: np.nanstd(a, ddof=1) if (~np.isnan(a)).sum() > 1 else np.nan, w, x)),
    "top": (lambda w: S.top("x", w), lambda w, x, y: apply(np.nanmax, w, x)),
    "bottom": (lambda w: S.bottom("x", w), lambda w, x, y: apply(np.nanmin, w, x)),
    "past": (lambda w: S.retprod("x", w, future=False), lambda w, x, y: apply(lambda a: np.nanprod(1 + a) - 1, w, x)),
    "corr": (lambda w: S.corr("x", "y", w), lambda w, x, y: apply(nancorr, w, x, y, full=True)),
    "ewm": (lambda w: S.ew_mean("x", w, 3), lambda w, x, y: apply(lambda a: wmean(a, 3), w, x)),
    "ews": (lambda w: S.ew_std("y", w, 3, full=True), lambda w, x, y: apply(lambda a: wstd(a, 3), w, y, full=True)),
    "slope": (lambda w: S.slope_over_mean("y", w), lambda w, x, y: apply(slope, w, y, full=True)),
    "strict": (lambda w: S.sum_strict("y", w), lambda w, x, y: apply(np.sum, w, y, full=True)),
    "mean_strict": (lambda w: S.mean_strict("y", w), lambda w, x, y: apply(np.mean, w, y, full=True)),
    "nansum": (lambda w: S.nansum("y", w), lambda w, x, y: apply(np.nansum, w, y, full=True)),
    "range": (lambda w: S.cum_range("c", w), lambda w, x, y: apply(lambda a: a.max() - a.min(), w, np.nancumsum(x, 0), full=True)),
    "beta": (lambda w: S.beta("x", "y", w, 3), lambda w, x, y: apply(beta, w, x, y, full=True)),
}


@pytest.fixture(scope="module")
def data(spark):
    x, y = arrays()
    return x, y, frame(spark, x=x, y=y, c=np.nancumsum(x, 0)).cache()


@pytest.mark.parametrize("window", [2, 7, 20, 39, 40, 60])
def test_against_numpy(data, window):
    """All window functions of one length in one call; chunks of every position, one chunk only, and longer than history."""
    x, y, df = data
    got = S.with_windows(df, short=0, **{k: make(window) for k, (make, _) in CASES.items()}).cache()
    assert got.columns == df.columns + list(CASES)
    for k, (_, want) in CASES.items():
        w, g = want(window, x, y), dense(got, k)
        if k in ("ews", "beta"):  # raw second moments: rounding only where nothing varies
            ok = np.isfinite(w) & (np.abs(w) < 1e6)
            same(g[ok], w[ok], 1e-6)
        else:
            same(g, w, 1e-9)


@pytest.mark.parametrize("window, skip", [(5, 0), (7, 3), (11, 20)])
def test_skipped_and_future_frames_equal_sliding_ones(data, window, skip):
    x, _, df = data
    specs = dict(skipped=S.momentum("x", window, 4, skip), forward=S.retprod("x", window),
                 later=S.retprod_strict("x", window, shift=skip), around=S.retprod_strict("x", window, shift=-2))
    long = S.with_windows(df, short=0, **specs).cache()
    short = S.with_windows(df, short=100, **specs).cache()
    for k in specs:
        same(dense(long, k), dense(short, k), 1e-9)
    assert np.isfinite(dense(long, "forward")).any()


def test_residual_uses_the_closing_beta_and_several_lengths(data):
    _, _, df = data
    both = []
    for short in (0, 100):
        d = S.with_windows(df, short=short, b=S.beta("x", "y", 9, 4), m=S.mean("x", 13), t=S.top("y", 9))
        both.append(S.with_windows(d, short=short, v=S.residual_vol("x", "y", "b", 9, 4)))
    for k in ("b", "m", "t", "v"):
        same(dense(both[0], k), dense(both[1], k), 1e-7)


def test_rows_are_counted_not_dates(spark):
    """A tick that starts late, another that has gaps in its dates: frames are of rows."""
    rows = [(t, "a", float(t * t % 17)) for t in range(13, 60)] + [(t, "b", float(t % 7)) for t in range(0, 90, 3)]
    df = spark.createDataFrame(rows, "date_idx int, tick string, x double")
    got = S.with_windows(df, short=0, m=S.mean("x", 8, full=True), f=R_all("x"))
    want = df.withColumns({"m": R.rolling_mean("x", 8, full=True), "f": R.rolling_max("x", 6)})
    close = [(round(r.m, 9) if r.m is not None else None, r.f) for r in got.orderBy("tick", "date_idx").collect()]
    assert close == [(round(r.m, 9) if r.m is not None else None, r.f) for r in want.orderBy("tick", "date_idx").collect()]


def R_all(x):
    return S.top(x, 6)


def test_flat_windows_have_no_spread(spark):
    df = spark.createDataFrame([(t, "a", 0.1, float(t)) for t in range(50)], "date_idx int, tick string, x double, y double")
    got = S.with_windows(df, short=0, s=S.std("x", 7), c=S.corr("x", "y", 7)).collect()
    assert {r.s for r in got} == {0.0} and {r.c for r in got} == {None, 0.0}


def test_no_frame_of_the_window_length(data):
    """Every aggregate runs over a growing frame; partitions of the chunks need no exchange of their own."""
    _, _, df = data
    plan = S.with_windows(df.repartition("tick"), short=0, **{k: make(17) for k, (make, _) in CASES.items()})._jdf.queryExecution()
    text = plan.executedPlan().toString()
    frames = set(re.findall(r"specifiedwindowframe\(RowFrame, ([^,]+), ([^)]+)\)", text))
    growing = {f for f in frames if f[0] == "unboundedpreceding$()"}
    assert growing and all(a == b or a.lstrip("-").isdigit() and a == b for a, b in frames - growing)
    assert text.count("Exchange") == 1 and text.count("+- Sort") + text.count("Sort [") >= 2


def test_single_tick_of_any_length(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    df = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)], "date_idx int, tick string, x double")
    got = S.with_windows(df, short=0, m=S.mean("x", 400, full=True), s=S.std("x", 400, full=True)).orderBy("date_idx").toPandas()
    for t in (399, 400, 401, 799, 800, 899):
        same(np.array([got["m"][t], got["s"][t]]), np.array([x[t - 399:t + 1].mean(), x[t - 399:t + 1].std()]))
    assert got["m"][:399].isna().all()
