"""Long windows along the time axis whose cost per row does not depend on their length.

A tick's rows are cut into chunks of one window length.  A frame then is the end of one chunk and the start of the next, so
two running aggregates that start anew with every chunk are enough: one forwards, one backwards.  Both are growing frames,
which Spark updates by one row at a time, where a sliding frame is aggregated anew for every row.  What is kept per stretch
(counts, means and central moments, extremes, products, weighted sums) can be merged, so nothing is ever subtracted.

    panel = with_windows(panel, beta=beta("xr", "xm", 242, 62), top=top("high", 242))

All windows of one call with the same length share their scans; scans share the partitioning on tick.  Windows of at most
``SHORT`` rows use the sliding frames of :mod:`quantgrid.operators.rolling`, which give the same values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, let
from quantgrid.operators import rolling as R

SHORT = 48
ROW, CHUNK, POS = "_row", "_chunk", "_pos"


@dataclass(frozen=True)
class Rolling:
    """A window function: what is aggregated over a stretch of rows, how two stretches merge, and the value."""

    frame: Column
    """The same function by sliding frames."""
    window: int
    state: dict[str, Column] | None
    merge: Callable[[Column, Column], dict[str, Column]]
    value: Callable[[Column], Column]
    end: int = 0
    """Last row of the frame, counted from the row itself."""
    full: bool = False
    """NULL unless the frame holds ``window`` rows."""


def with_windows(panel: DataFrame, by: Sequence[str] = R.BY, order: str = "date_idx", short: int = SHORT, **specs: Rolling) -> DataFrame:
    """panel + one column per window function; existing columns of these names are replaced."""
    framed = {k: s for k, s in specs.items() if s.window <= short or s.state is None}
    out = panel.withColumns({k: s.frame for k, s in framed.items()})
    for window in sorted({s.window for k, s in specs.items() if k not in framed}):
        out = _scan(out, {k: s for k, s in specs.items() if s.window == window and k not in framed}, window, by, order)
    return out


def _at(x: str, rows: int, w) -> Column:
    """The value of a column ``rows`` rows from here."""
    return F.col(x) if rows == 0 else F.lead(x, rows).over(w) if rows > 0 else F.lag(x, -rows).over(w)


def _scan(df: DataFrame, specs: dict[str, Rolling], window: int, by: Sequence[str], order: str) -> DataFrame:
    names = df.columns
    df = df.withColumn(ROW, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    df = df.withColumns({CHUNK: F.floor(F.col(ROW) / window), POS: F.pmod(ROW, F.lit(window))})
    for name, direction in (("_tail", F.desc(order)), ("_head", F.asc(order))):
        grow = Window.partitionBy(*by, CHUNK).orderBy(direction).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn(name, F.struct(*[F.struct(*[v.over(grow).alias(p) for p, v in s.state.items()]).alias(k) for k, s in specs.items()]))
    rows = Window.partitionBy(*by).orderBy(CHUNK, order)  # the order of the last scan
    ends = sorted({s.end for s in specs.values()})
    df = df.withColumns({f"_new{i}": _at("_head", e, rows) for i, e in enumerate(ends)}
                        | {f"_old{i}": _at("_tail", e - window + 1, rows) for i, e in enumerate(ends)})
    values = {}
    for k, s in specs.items():
        i = ends.index(s.end)
        last = F.col(ROW) + s.end
        older = F.when(F.pmod(last, F.lit(window)) != window - 1, F.col(f"_old{i}")[k])  # else one chunk is the whole frame

        def merged(v: Column, s: Rolling = s) -> Column:
            both = F.struct(*[c.alias(p) for p, c in s.merge(v["o"], v["n"]).items()])
            return F.when(v["o"].isNull(), v["n"]).when(v["n"].isNull(), v["o"]).otherwise(both)

        state = let({"o": older, "n": F.col(f"_new{i}")[k]}, merged)
        value = let({"s": state}, lambda v, s=s: s.value(v["s"]))
        exists = F.col(f"_new{i}").isNotNull()
        values[k] = F.when(exists & (last >= window - 1) if s.full else exists, value)
    return df.withColumns(values).select(*[c for c in names if c not in specs], *specs)


# --- states that merge ------------------------------------------------------------------------

def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _sums(*parts: str) -> Callable[[Column, Column], dict[str, Column]]:
    return lambda o, n: {p: _add(o[p], n[p]) for p in parts}


def _moments(x: Column, tag: str = "") -> dict[str, Column]:
    """Count, mean, sum of squared deviations (as variance), and extremes, which show an exactly flat stretch."""
    return {f"{tag}n": F.count(x), f"{tag}m": F.avg(x), f"{tag}v": F.var_pop(x), f"{tag}lo": F.min(x), f"{tag}hi": F.max(x)}


def _share(o: Column, n: Column, tag: str) -> Column:
    return F.try_divide(n[f"{tag}n"], o[f"{tag}n"] + n[f"{tag}n"])


def _merged_mean(o: Column, n: Column, tag: str, part: str) -> Column:
    a, b = o[f"{tag}{part}"], n[f"{tag}{part}"]
    return F.coalesce(a + (b - a) * _share(o, n, tag), a, b)


def _merged_product(o: Column, n: Column, tag: str, part: str, x: str, y: str) -> Column:
    """Mean product of deviations, from those of both stretches and the gap of their means."""
    w = _share(o, n, tag)
    gap = (n[f"{tag}{x}"] - o[f"{tag}{x}"]) * (n[f"{tag}{y}"] - o[f"{tag}{y}"])
    a, b = o[f"{tag}{part}"], n[f"{tag}{part}"]
    return F.coalesce(a * (1 - w) + b * w + gap * w * (1 - w), a, b)


def _merge_moments(o: Column, n: Column, tag: str = "") -> dict[str, Column]:
    return {f"{tag}n": o[f"{tag}n"] + n[f"{tag}n"], f"{tag}m": _merged_mean(o, n, tag, "m"), f"{tag}v": _merged_product(o, n, tag, "v", "m", "m"),
            f"{tag}lo": F.least(o[f"{tag}lo"], n[f"{tag}lo"]), f"{tag}hi": F.greatest(o[f"{tag}hi"], n[f"{tag}hi"])}


def _spread(s: Column, tag: str = "") -> Column:
    return F.when(s[f"{tag}lo"] == s[f"{tag}hi"], 0.0).otherwise(F.sqrt(s[f"{tag}v"]))


# --- window functions -------------------------------------------------------------------------

def mean(x: ColumnOrName, window: int, full: bool = False) -> Rolling:
    x = as_col(x)
    return Rolling(R.rolling_mean(x, window, full), window, {"n": F.count(x), "m": F.avg(x)},
                   lambda o, n: {"n": o["n"] + n["n"], "m": _merged_mean(o, n, "", "m")}, lambda s: s["m"], full=full)


def std(x: ColumnOrName, window: int, ddof: int = 0, full: bool = False) -> Rolling:
    x = as_col(x)

    def value(s: Column) -> Column:
        return _spread(s) if ddof == 0 else F.when(s["n"] > 1, _spread(s) * F.sqrt(s["n"] / (s["n"] - 1)))

    return Rolling(R.rolling_std(x, window, ddof, full), window, _moments(x), _merge_moments, value, full=full)


def top(x: ColumnOrName, window: int) -> Rolling:
    x = as_col(x)
    return Rolling(R.rolling_max(x, window), window, {"x": F.max(x)}, lambda o, n: {"x": F.greatest(o["x"], n["x"])}, lambda s: s["x"])


def bottom(x: ColumnOrName, window: int) -> Rolling:
    x = as_col(x)
    return Rolling(R.rolling_min(x, window), window, {"x": F.min(x)}, lambda o, n: {"x": F.least(o["x"], n["x"])}, lambda s: s["x"])


def _product(o: Column, n: Column) -> dict[str, Column]:
    return {"n": o["n"] + n["n"], "x": F.coalesce(o["x"] * n["x"], o["x"], n["x"])}


def retprod(x: ColumnOrName, window: int, future: bool = True) -> Rolling:
    """Compounded return over the next (this row first, full) or the last ``window`` rows."""
    x = as_col(x)
    return Rolling(R.rolling_retprod(x, window, future), window, {"n": F.count(x), "x": F.product(1 + x)}, _product,
                   lambda s: F.coalesce(s["x"], F.lit(1.0)) - 1, end=window - 1 if future else 0, full=future)


def retprod_strict(x: ColumnOrName, window: int, shift: int = 0) -> Rolling:
    """Compounded return of rows t+shift ... t+shift+window-1; NULL if any of them is."""
    x = as_col(x)
    return Rolling(R.rolling_retprod_strict(x, window, shift), window, {"n": F.count(x), "x": F.product(1 + x)}, _product,
                   lambda s: F.when(s["n"] == window, s["x"] - 1), end=shift + window - 1, full=True)


def corr(x: ColumnOrName, y: ColumnOrName, window: int) -> Rolling:
    """As :func:`quantgrid.operators.rolling.rolling_corr`: own means and deviations, joint covariance around them."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    state = _moments(x, "x") | _moments(y, "y") | {
        "bn": F.count(F.when(both, 1)), "bx": F.avg(F.when(both, x)), "by": F.avg(F.when(both, y)), "bc": F.covar_pop(x, y)}

    def merge(o: Column, n: Column) -> dict[str, Column]:
        return _merge_moments(o, n, "x") | _merge_moments(o, n, "y") | {
            "bn": o["bn"] + n["bn"], "bx": _merged_mean(o, n, "b", "x"), "by": _merged_mean(o, n, "b", "y"),
            "bc": _merged_product(o, n, "b", "c", "x", "y")}

    def value(s: Column) -> Column:
        cov = s["bc"] + (s["bx"] - s["xm"]) * (s["by"] - s["ym"])
        scale = _spread(s, "x") * _spread(s, "y")
        return F.when(scale == 0, 0.0).otherwise(F.try_divide(cov, scale))

    return Rolling(R.rolling_corr(x, y, window), window, state, merge, value, full=True)


def sum_strict(x: ColumnOrName, window: int) -> Rolling:
    x = as_col(x)
    return Rolling(R.rolling_sum_strict(x, window), window, {"n": F.count(x), "x": F.sum(x)}, _sums("n", "x"),
                   lambda s: F.when(s["n"] == window, s["x"]))


def mean_strict(x: ColumnOrName, window: int) -> Rolling:
    x = as_col(x)
    return Rolling(R.rolling_mean_strict(x, window), window, {"n": F.count(x), "x": F.sum(x)}, _sums("n", "x"),
                   lambda s: F.when(s["n"] == window, s["x"] / window))


def nansum(x: ColumnOrName, window: int) -> Rolling:
    x = as_col(x)
    return Rolling(R.rolling_nansum(x, window), window, {"x": F.sum(x)}, _sums("x"), lambda s: F.coalesce(s["x"], F.lit(0.0)), full=True)


def _weighted(frame: Column, terms: dict[str, Column], mask: Column, window: int, halflife: float, value: Callable[[Column], Column],
              skip: int = 0, full: bool = False) -> Rolling:
    """Sums weighted by 2^(-age / halflife), up to one factor a row: weights count from the middle of a chunk."""
    if window > 1074 * halflife:  # weights beyond double precision: the frame leaves such rows out
        return Rolling(frame, window, None, None, None, -skip, full)
    weight = F.pow(F.lit(2.0), (F.col(POS) - window / 2.0) / F.lit(float(halflife)))
    fade = F.lit(2.0 ** (-window / halflife))
    return Rolling(frame, window, {k: F.sum(F.when(mask, weight * v)) for k, v in terms.items()},
                   lambda o, n: {k: _add(fade * o[k], n[k]) for k in terms}, value, end=-skip, full=full)


def ew_mean(x: ColumnOrName, window: int, halflife: float, full: bool = False, skip: int = 0) -> Rolling:
    x = as_col(x)
    return _weighted(R.exp_weighted_mean(x, window, halflife, full, skip=skip), {"n": F.lit(1.0), "x": x}, x.isNotNull(), window, halflife,
                     lambda s: F.try_divide(s["x"], s["n"]), skip, full)


def ew_std(x: ColumnOrName, window: int, halflife: float, full: bool = False) -> Rolling:
    x = as_col(x)

    def value(s: Column) -> Column:
        m = F.try_divide(s["x"], s["n"])
        return F.sqrt(_non_negative(F.try_divide(s["xx"], s["n"]) - m * m))

    return _weighted(R.exp_weighted_std(x, window, halflife, full), {"n": F.lit(1.0), "x": x, "xx": x * x}, x.isNotNull(), window, halflife,
                     value, full=full)


def _non_negative(x: Column) -> Column:
    return F.when(x < 0, 0.0).otherwise(x)


def _pair(frame: Column, x: Column, y: Column, window: int, halflife: float, value: Callable[[dict[str, Column]], Column]) -> Rolling:
    terms = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}

    def of(s: Column) -> Column:
        m = {k: F.try_divide(s[k], s["n"]) for k in ("x", "y", "xx", "yy", "xy")}
        return value({"vx": m["xx"] - m["x"] * m["x"], "vy": m["yy"] - m["y"] * m["y"], "cov": m["xy"] - m["x"] * m["y"]})

    return _weighted(frame, terms, x.isNotNull() & y.isNotNull(), window, halflife, of, full=True)


def beta(r: ColumnOrName, market: ColumnOrName, window: int, halflife: float) -> Rolling:
    r, market = as_col(r), as_col(market)
    return _pair(R.rolling_beta(r, market, window, halflife), r, market, window, halflife,
                 lambda m: F.when(m["vy"] <= 1e-18, 0.0).otherwise(F.try_divide(m["cov"], m["vy"])))


def residual_vol(r: ColumnOrName, market: ColumnOrName, closing_beta: ColumnOrName, window: int, halflife: float) -> Rolling:
    r, market, b = as_col(r), as_col(market), as_col(closing_beta)
    return _pair(R.residual_vol(r, market, b, window, halflife), r, market, window, halflife,
                 lambda m: F.sqrt(_non_negative(m["vx"] - 2 * b * m["cov"] + b * b * m["vy"])))


def momentum(excess: ColumnOrName, window: int, halflife: float, skip: int) -> Rolling:
    """Weighted mean log return over ``window`` rows that end ``skip`` rows ago."""
    x = as_col(excess)
    return ew_mean(F.when(x > -1, F.log1p(x)), window, halflife, True, skip)


def cum_range(running: ColumnOrName, window: int) -> Rolling:
    c = as_col(running)
    return Rolling(R.cum_range(c, window), window, {"hi": F.max(c), "lo": F.min(c)},
                   lambda o, n: {"hi": F.greatest(o["hi"], n["hi"]), "lo": F.least(o["lo"], n["lo"])}, lambda s: s["hi"] - s["lo"], full=True)


def slope_over_mean(y: ColumnOrName, window: int, eps: float = 1e-12) -> Rolling:
    """Trend per row over mean level; the slope divides by the full window's index spread."""
    y = as_col(y)
    row = F.col(ROW).cast("double")
    state = {"n": F.count(y), "y": F.avg(y), "i": F.avg(F.when(y.isNotNull(), row)), "c": F.covar_pop(row, y)}
    spread = window * (window * window - 1) / 12.0

    def merge(o: Column, n: Column) -> dict[str, Column]:
        return {"n": o["n"] + n["n"], "y": _merged_mean(o, n, "", "y"), "i": _merged_mean(o, n, "", "i"),
                "c": _merged_product(o, n, "", "c", "i", "y")}

    def value(s: Column) -> Column:
        return F.when((s["n"] >= 2) & (F.abs(s["y"]) > eps), F.try_divide(s["c"] * s["n"] / spread, s["y"]))

    return Rolling(R.rolling_slope_over_mean(y, window, eps), window, state, merge, value, full=True)
