"""A 40 x 8 panel with 15% NULLs, ties, zeros, an all-NULL date, an all-NULL tick and a constant column."""

import datetime as dt

import numpy as np

T, N = 40, 8


def arrays(seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 0.05, (T, N)), 3)
    y = np.round(rng.lognormal(2, 1, (T, N)), 2)
    for a in (x, y):
        a[rng.random((T, N)) < 0.15] = np.nan
    x[7, :] = np.nan            # all-NULL date
    x[:, 5] = np.nan            # all-NULL tick
    x[9, 1:] = np.nan           # one name on a date
    x[3, 2] = -1.0              # product of 1 + x hits zero
    y[4, 3] = 0.0               # zero base
    y[10, :] = 5.0              # constant column
    return x, y


def frame(spark, **cols):
    day = dt.date(2020, 1, 1)
    names = list(cols)
    rows = [(t, day + dt.timedelta(days=t), f"{n:03d}", *[None if np.isnan(cols[c][t, n]) else float(cols[c][t, n]) for c in names])
            for t in range(T) for n in range(N)]
    schema = "date_idx int, date date, tick string" + "".join(f", {c} double" for c in names)
    return spark.createDataFrame(rows, schema)


def dense(df, col):
    out = np.full((T, N), np.nan)
    for r in df.select("date_idx", "tick", col).collect():
        out[r[0], int(r[1])] = np.nan if r[2] is None else r[2]
    return out


def same(got, want, tol=1e-9):
    np.testing.assert_allclose(got, want, rtol=tol, atol=tol, equal_nan=True)
