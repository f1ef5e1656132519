"""Rolling operators against direct windowed evaluation in NumPy."""

import warnings

import numpy as np
import pytest

from grid import N, T, arrays, dense, frame, same
from quantgrid.operators import rolling as R

warnings.simplefilter("ignore")


def windows(a, w, t):
    return a[max(0, t - w + 1):t + 1]


def apply(fn, w, *arrs, full=False):
    out = np.full((T, N), np.nan)
    for t in range(T):
        if full and t < w - 1:
            continue
        for n in range(N):
            out[t, n] = fn(*[windows(a, w, t)[:, n] for a in arrs])
    return out


def nancorr(a, b):
    if np.isnan(a).all() or np.isnan(b).all():
        return np.nan
    cov = np.nanmean((a - np.nanmean(a)) * (b - np.nanmean(b)))
    s = np.nanstd(a) * np.nanstd(b)
    return 0.0 if s == 0 else cov / s


def half_life(w, hl):
    return 2.0 ** (-np.arange(w - 1, -1, -1) / hl)


def wmean(a, hl):
    w = half_life(len(a), hl)[~np.isnan(a)]
    return np.nan if not len(w) else (w * a[~np.isnan(a)]).sum() / w.sum()


def wstd(a, hl):
    m = wmean(a, hl)
    return np.sqrt(wmean((a - m) ** 2, hl))


def slope(y):
    w = len(y)
    i = np.arange(1, w + 1) - (w + 1) / 2
    m = np.nanmean(y)
    ok = np.abs(m) > 1e-12 and (~np.isnan(y)).sum() >= 2
    return np.nansum(i * (y - m)) / (i ** 2).sum() / m if ok else np.nan


@pytest.fixture(scope="module")
def data(spark):
    x, y = arrays()
    return x, y, frame(spark, x=x, y=y).cache()


CASES = {
    "mean": (lambda: R.rolling_mean("x", 5), lambda x, y: apply(np.nanmean, 5, x)),
    "std1": (lambda: R.rolling_std("x", 5, ddof=1), lambda x, y: apply(
        lambda a: np.nanstd(a, ddof=1) if (~np.isnan(a)).sum() > 1 else np.nan, 5, x)),
    "max": (lambda: R.rolling_max("x", 4), lambda x, y: apply(np.nanmax, 4, x)),
    "past": (lambda: R.rolling_retprod("x", 4, future=False), lambda x, y: apply(lambda a: np.nanprod(1 + a) - 1, 4, x)),
    "corr": (lambda: R.rolling_corr("x", "y", 6), lambda x, y: apply(nancorr, 6, x, y, full=True)),
    "ewm": (lambda: R.exp_weighted_mean("x", 10, 3), lambda x, y: apply(lambda a: wmean(a, 3), 10, x)),
    "ews": (lambda: R.exp_weighted_std("y", 10, 3, full=True), lambda x, y: apply(lambda a: wstd(a, 3), 10, y, full=True)),
    "slope": (lambda: R.rolling_slope_over_mean("y", 12), lambda x, y: apply(slope, 12, y, full=True)),
    "strict": (lambda: R.rolling_sum_strict("y", 3), lambda x, y: apply(np.sum, 3, y, full=True)),
    "nansum": (lambda: R.rolling_nansum("y", 5), lambda x, y: apply(np.nansum, 5, y, full=True)),
    "up": (lambda: R.conditional_rolling_std("x", 8, 1), lambda x, y: apply(
        lambda a: np.nanstd(np.where(a > 0, a, np.nan)), 8, x)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_window(data, name):
    x, y, df = data
    col, want = CASES[name]
    same(dense(df.withColumn("o", col()), "o"), want(x, y), 1e-8)


def test_future_product_is_null_at_the_end(data):
    x, _, df = data
    got = dense(df.withColumn("o", R.rolling_retprod("x", 3)), "o")
    want = np.full((T, N), np.nan)
    for t in range(T - 2):
        want[t] = np.nanprod(1 + x[t:t + 3], axis=0) - 1
    same(got, want)


def test_beta_residual_and_range(spark, data):
    x, _, df = data
    m = np.nanmean(x, axis=1)
    m[np.isnan(m)] = 0.001
    mk = np.repeat(m[:, None], N, axis=1)
    d = frame(spark, x=x, m=mk).withColumn("b", R.rolling_beta("x", "m", 10, 4)).withColumn("c", R.running_log_return("x"))
    d = d.withColumn("v", R.residual_vol("x", "m", "b", 10, 4)).withColumn("g", R.cum_range("c", 10))

    def beta(a, b):
        b = np.where(np.isnan(a), np.nan, b)
        return (wmean(a * b, 4) - wmean(a, 4) * wmean(b, 4)) / (wmean(b * b, 4) - wmean(b, 4) ** 2)

    want = apply(lambda a, b: np.nan if np.isnan(a).all() else beta(a, b), 10, x, mk, full=True)
    got = dense(d, "b")
    ok = ~np.isnan(want) & (np.abs(want) < 1e6)
    same(got[ok], want[ok], 1e-6)
    res = np.full((T, N), np.nan)
    for t in range(9, T):
        for n in range(N):
            if not np.isnan(got[t, n]):
                res[t, n] = wstd(x[t - 9:t + 1, n] - got[t, n] * mk[t - 9:t + 1, n], 4)
    same(dense(d, "v"), res, 1e-6)

    def spread(a):
        c = np.cumsum(np.where(np.isnan(a) | (a <= -1), 0, np.log1p(np.where(a <= -1, 0, a))))
        return c.max() - c.min()

    same(dense(d, "g"), apply(spread, 10, x, full=True), 1e-8)


def test_pct_change_zero_base(data):
    _, y, df = data
    got = dense(df.withColumn("o", R.pct_change("y")), "o")
    assert got[5, 3] == 0.0 or np.isnan(y[5, 3])
    assert np.isnan(got[0]).all()


@pytest.mark.parametrize("name", sorted(CASES))
def test_no_look_ahead(data, name):
    _, _, df = data
    col = CASES[name][0]
    whole = dense(df.withColumn("o", col()), "o")[:25]
    cut = dense(df.where("date_idx < 25").withColumn("o", col()), "o")[:25]
    same(cut, whole)


def test_instance_normalise_matches_numpy(data):
    x, _, df = data
    rows = df.withColumn("a", R.value_array("x", 6)).where("a is not null").withColumn("o", R.instance_normalise("a")).collect()
    for r in rows:
        a = x[r.date_idx - 5:r.date_idx + 1, int(r.tick)]
        want = (a - np.nanmean(a)) / np.sqrt(np.nanvar(a) + 1e-5)
        same(np.array([np.nan if v is None else v for v in r.o]), want, 1e-7)
