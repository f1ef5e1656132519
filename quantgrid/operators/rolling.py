"""Window functions along the time axis of a tick (Column builders).

Every window counts rows of a dense panel.  A *partial* window shrinks at the
start of history; a *full* one is NULL until it holds ``window`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, let, tick_window
from quantgrid.functions.scalar import safe_div

BY = ("tick",)


def past(window: int, by: Sequence[str] = BY, skip: int = 0):
    """The frame of the last ``window`` rows, ending ``skip`` rows ago."""
    return tick_window(-(window + skip - 1), -skip, by)


def history(by: Sequence[str] = BY):
    return tick_window(None, 0, by)


def when_full(value: Column, window: int, by: Sequence[str] = BY) -> Column:
    return F.when(F.row_number().over(tick_window(by=by)) >= window, value)


def rolling_retprod(x: ColumnOrName, window: int, future: bool = True, by: Sequence[str] = BY) -> Column:
    """Compounded return over the next (this row first) or the last ``window`` rows."""
    x = as_col(x)
    if not future:
        return F.coalesce(F.product(1 + x).over(past(window, by)), F.lit(1.0)) - 1
    frame = tick_window(0, window - 1, by)
    value = F.coalesce(F.product(1 + x).over(frame), F.lit(1.0)) - 1
    return F.when(F.count(F.lit(1)).over(frame) == window, value)


def rolling_retprod_strict(x: ColumnOrName, window: int, shift: int = 0, by: Sequence[str] = BY) -> Column:
    """Compounded return of rows t+shift ... t+shift+window-1; NULL if any of them is."""
    x = as_col(x)
    frame = tick_window(shift, shift + window - 1, by)
    return F.when(F.count(x).over(frame) == window, F.product(1 + x).over(frame) - 1)


def rolling_mean(x: ColumnOrName, window: int, full: bool = False, by: Sequence[str] = BY) -> Column:
    value = F.avg(as_col(x)).over(past(window, by))
    return when_full(value, window, by) if full else value


def rolling_std(x: ColumnOrName, window: int, ddof: int = 0, full: bool = False, by: Sequence[str] = BY) -> Column:
    fn = F.stddev_pop if ddof == 0 else F.stddev_samp
    value = fn(as_col(x)).over(past(window, by))
    return when_full(value, window, by) if full else value


def rolling_max(x: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    return F.max(as_col(x)).over(past(window, by))


def rolling_min(x: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    return F.min(as_col(x)).over(past(window, by))


def rolling_corr(x: ColumnOrName, y: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    """Correlation whose means and deviations use each side's own rows, its covariance the joint rows."""
    x, y, w = as_col(x), as_col(y), past(window, by)
    both = x.isNotNull() & y.isNotNull()
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    cov = (F.avg(x * y).over(w) - mx * F.avg(F.when(both, y)).over(w)
           - my * F.avg(F.when(both, x)).over(w) + mx * my)
    scale = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
    return when_full(F.when(scale == 0, 0.0).otherwise(F.try_divide(cov, scale)), window, by)


def cumulative_ema(x: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    """Running weighted mean whose weights fall with the row ordinal: the oldest row counts most."""
    x = as_col(x)
    weight = F.pow(F.lit(1 - 2.0 / (window + 1.0)), F.col("date_idx"))
    den = F.sum(F.when(x.isNotNull(), weight)).over(history(by))
    return F.when(den >= 1e-8, F.try_divide(F.sum(x * weight).over(history(by)), den))


def recency_sums(terms: dict[str, Column], mask: Column, window: int, halflife: float, by: Sequence[str] = BY,
                 skip: int = 0) -> Column:
    """Struct of the terms' sums over the masked rows of the frame, a row weighted by 2^(-age / halflife).

    All sums of a row share one unknown factor, so use their ratios.  Weights count from the middle of a row's chunk of
    one frame length, so they neither overflow nor vanish on a long axis; a frame touches two chunks at most, and the
    older one fades by a whole chunk.  Rows older than 1,074 half-lives have weight 0 in double precision and are left
    out of the frame.
    """
    span = min(window, math.ceil(1074 * halflife))
    w = past(span, by, skip)
    row = F.col("date_idx")
    chunk = F.floor(row / span)
    weight = F.pow(F.lit(2.0), (row - chunk * span - span / 2.0) / F.lit(float(halflife)))
    even = F.pmod(chunk, F.lit(2)) == 0
    fade = 2.0 ** (-span / halflife)
    parts = {f"{name}{tag}": F.sum(F.when(mask & side, weight * x)).over(w)
             for name, x in terms.items() for tag, side in (("_even", even), ("_odd", ~even))}

    def both(v: Column) -> Column:
        out = []
        for name in terms:
            new = F.when(v["now_even"], v[f"{name}_even"]).otherwise(v[f"{name}_odd"])
            old = F.when(v["now_even"], v[f"{name}_odd"]).otherwise(v[f"{name}_even"])
            out.append(F.when(new.isNull(), old).otherwise(new + F.lit(fade) * F.coalesce(old, F.lit(0.0))).alias(name))
        return F.struct(*out)

    return let({"now_even": F.pmod(F.floor((row - skip) / span), F.lit(2)) == 0, **parts}, both)


def ema(x: ColumnOrName, window: int, span: int | None = None, by: Sequence[str] = BY) -> Column:
    """Textbook exponential mean: the newest of the last ``window`` rows counts most."""
    alpha = 2.0 / ((span or window) + 1.0)
    return exp_weighted_mean(x, window, -math.log(2) / math.log(1 - alpha), by=by)


def diff(x: ColumnOrName, periods: int = 1, by: Sequence[str] = BY) -> Column:
    x = as_col(x)
    return x - F.lag(x, periods).over(tick_window(by=by))


def pct_change(x: ColumnOrName, periods: int = 1, by: Sequence[str] = BY) -> Column:
    """Relative change; 0 where the base is 0, NULL where either side is."""
    x = as_col(x)
    base = F.lag(x, periods).over(tick_window(by=by))
    return F.when(x.isNotNull() & (base == 0), 0.0).otherwise(F.try_divide(x - base, base))


def lag_ratio(x: ColumnOrName, lag: int, by: Sequence[str] = BY) -> Column:
    x = as_col(x)
    base = F.lag(x, lag).over(tick_window(by=by))
    return safe_div(x - base, base)


def forward_shift(x: ColumnOrName, rows: int = 1, by: Sequence[str] = BY) -> Column:
    return F.lead(as_col(x), rows).over(tick_window(by=by))


def forward_fill(x: ColumnOrName, by: Sequence[str] = BY) -> Column:
    return F.last(as_col(x), ignorenulls=True).over(history(by))


def exp_weighted_mean(x: ColumnOrName, window: int, halflife: float, full: bool = False,
                      by: Sequence[str] = BY, skip: int = 0) -> Column:
    x = as_col(x)
    s = recency_sums({"x": x, "n": F.lit(1.0)}, x.isNotNull(), window, halflife, by, skip)
    value = let({"s": s}, lambda v: F.try_divide(v["s"]["x"], v["s"]["n"]))
    return when_full(value, window + skip, by) if full else value


def exp_weighted_std(x: ColumnOrName, window: int, halflife: float, full: bool = False,
                     by: Sequence[str] = BY) -> Column:
    x = as_col(x)
    sums = recency_sums({"n": F.lit(1.0), "x": x, "xx": x * x}, x.isNotNull(), window, halflife, by)

    def spread(v: Column) -> Column:
        mean = F.try_divide(v["s"]["x"], v["s"]["n"])
        return F.sqrt(_non_negative(F.try_divide(v["s"]["xx"], v["s"]["n"]) - mean * mean))

    value = let({"s": sums}, spread)
    return when_full(value, window, by) if full else value


def _non_negative(x: Column) -> Column:
    return F.when(x < 0, 0.0).otherwise(x)


def weighted_moments(x: ColumnOrName, y: ColumnOrName, window: int, halflife: float,
                     mask: Column | None = None, by: Sequence[str] = BY) -> Column:
    """Struct (n, mx, my, vx, vy, cov): recency-weighted means, variances and covariance over rows where both sides exist."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    if mask is not None:
        both = both & mask
    sums = recency_sums({"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}, both, window, halflife, by)

    def means(v: Column) -> Column:
        return F.struct(v["s"]["n"].alias("n"), *[F.try_divide(v["s"][k], v["s"]["n"]).alias(k) for k in ("x", "y", "xx", "yy", "xy")])

    return let({"m": let({"s": sums}, means)}, lambda v: F.struct(
        v["m"]["n"].alias("n"), v["m"]["x"].alias("mx"), v["m"]["y"].alias("my"), (v["m"]["xx"] - v["m"]["x"] * v["m"]["x"]).alias("vx"),
        (v["m"]["yy"] - v["m"]["y"] * v["m"]["y"]).alias("vy"), (v["m"]["xy"] - v["m"]["x"] * v["m"]["y"]).alias("cov")))


def rolling_beta(r: ColumnOrName, market: ColumnOrName, window: int, halflife: float,
                 by: Sequence[str] = BY) -> Column:
    """Weighted cov / var of the market; NULL without a joint row, 0 for a flat market."""
    m = weighted_moments(r, market, window, halflife, by=by)
    value = let({"m": m}, lambda v: F.when(v["m"]["vy"] <= 1e-18, 0.0).otherwise(F.try_divide(v["m"]["cov"], v["m"]["vy"])))
    return when_full(value, window, by)


def ew_momentum(excess: ColumnOrName, window: int, halflife: float, skip: int, by: Sequence[str] = BY) -> Column:
    """Weighted mean log return over ``window`` rows that end ``skip`` rows ago."""
    x = as_col(excess)
    return exp_weighted_mean(F.when(x > -1, F.log1p(x)), window, halflife, full=True, by=by, skip=skip)


def running_log_return(r: ColumnOrName, by: Sequence[str] = BY) -> Column:
    r = as_col(r)
    return F.sum(F.coalesce(F.when(r > -1, F.log1p(r)), F.lit(0.0))).over(history(by))


def cum_range(running: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    """Spread of the cumulative log return inside the window, from :func:`running_log_return`."""
    c, w = as_col(running), past(window, by)
    return when_full(F.max(c).over(w) - F.min(c).over(w), window, by)


def residual_vol(r: ColumnOrName, market: ColumnOrName, beta: ColumnOrName, window: int, halflife: float,
                 by: Sequence[str] = BY) -> Column:
    """Weighted deviation of r - beta * market with the window's closing beta."""
    m = weighted_moments(r, market, window, halflife, by=by)

    def spread(v: Column) -> Column:
        b, m = v["b"], v["m"]
        return F.sqrt(_non_negative(m["vx"] - 2 * b * m["cov"] + b * b * m["vy"]))

    return when_full(let({"b": as_col(beta), "m": m}, spread), window, by)


def rolling_slope_over_mean(y: ColumnOrName, window: int, eps: float = 1e-12, by: Sequence[str] = BY) -> Column:
    """Trend per row over mean level; the slope divides by the full window's index spread."""
    y, w = as_col(y), past(window, by)
    n = F.count(y).over(w)
    mean = F.avg(y).over(w)
    # Index inside the window, centred: i - (end - (W-1)/2).
    end = F.col("date_idx")
    centre = end - F.lit((window - 1) / 2.0)
    sum_iy = F.sum(F.col("date_idx") * y).over(w) - centre * F.sum(y).over(w)
    sum_i = F.sum(F.when(y.isNotNull(), F.col("date_idx"))).over(w) - centre * n
    spread = window * (window * window - 1) / 12.0
    slope = (sum_iy - mean * sum_i) / F.lit(spread)
    return when_full(F.when((n >= 2) & (F.abs(mean) > eps), F.try_divide(slope, mean)), window, by)


def rolling_sum_strict(x: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    x, w = as_col(x), past(window, by)
    return F.when(F.count(x).over(w) == window, F.sum(x).over(w))


def rolling_mean_strict(x: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    x, w = as_col(x), past(window, by)
    return F.when(F.count(x).over(w) == window, F.avg(x).over(w))


def rolling_nansum(x: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    return when_full(F.coalesce(F.sum(as_col(x)).over(past(window, by)), F.lit(0.0)), window, by)


def lagged_rolling_std(x: ColumnOrName, window: int, order: str, by: Sequence[str] = BY) -> Column:
    """Deviation (ddof 0) of the previous ``window`` reports, this one excluded."""
    return F.stddev_pop(as_col(x)).over(tick_window(-window, -1, by, order))


def conditional_rolling_std(x: ColumnOrName, window: int, sign: int, by: Sequence[str] = BY) -> Column:
    """Deviation over only the positive (sign=1) or negative (sign=-1) values."""
    x = as_col(x)
    return rolling_std(F.when(x * sign > 0, x), window, by=by)


def window_array(*fields: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    """Rows of the full window as an array of structs, oldest first; NULL fields are kept."""
    return when_full(F.collect_list(F.struct(*[as_col(f) for f in fields])).over(past(window, by)), window, by)


def value_array(x: ColumnOrName, window: int, by: Sequence[str] = BY) -> Column:
    boxed = window_array(as_col(x).alias("v"), window=window, by=by)
    return F.transform(boxed, lambda s: s["v"])


def series_standardize(values: ColumnOrName) -> Column:
    """Array of window values over its first value; a zero first value gives zeros."""
    a = as_col(values)
    return F.transform(a, lambda v: safe_div(v, F.get(a, F.lit(0))))


def instance_normalise(values: ColumnOrName, eps: float = 1e-5) -> Column:
    """Array minus its mean, over sqrt(population variance + eps); NULL entries are ignored."""
    a = as_col(values)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(a, start, lambda t, v: F.when(v.isNull(), t).otherwise(F.struct(
        (t["n"] + 1).alias("n"), (t["s"] + v).alias("s"), (t["q"] + v * v).alias("q"))))
    # One-element arrays bind the sums and then the moments once per row, not once per entry.
    moments = F.transform(F.array(sums), lambda t: F.struct(
        F.try_divide(t["s"], t["n"]).alias("m"),
        F.sqrt(_non_negative(F.try_divide(t["q"] - t["s"] * F.try_divide(t["s"], t["n"]), t["n"])) + eps).alias("d")))
    return F.transform(moments, lambda m: F.transform(a, lambda v: (v - m["m"]) / m["d"]))[0]
