"""Cross-sectional transforms: DataFrame -> DataFrame, one group per date (or date and industry).

No transform shuffles the panel by date.  Group statistics are aggregated with
map-side combine, written once to the checkpoint folder, and joined back by
broadcast when their measured size allows (see :func:`quantgrid.core.attach`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrid.core import attach, small_side
from quantgrid.functions.scalar import clip, null_if_not_finite, yeo_johnson_derivatives, yeo_johnson_value
from quantgrid.operators import wide
from quantgrid.operators.order_stats import average_rank, group_medians, group_quantiles

DATE = ("date_idx",)
MAD_SCALE = 1.4826  # fixed value: normal consistency of the median absolute deviation
INDUSTRY_CODES = 31  # fixed value: industry codes run from 0 to 30


def _with(df: DataFrame, new: dict[str, Column], drop: Sequence[str]) -> DataFrame:
    return df.withColumns(new).drop(*drop)


def cs_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = DATE, ddof: int = 0) -> DataFrame:
    dev = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = [f(F.col(c)).alias(f"{c}_{tag}") for c in cols for f, tag in ((F.avg, "mu"), (dev, "sd"))]
    return df.groupBy(*by).agg(*aggs)


def cs_zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = DATE, suffix: str = "",
              flat: float | None = None, eps: float = 1e-8) -> DataFrame:
    """(x - mean) / population deviation; deviation below eps gives ``flat`` (default NULL)."""
    j = attach(df, cs_moments(df, cols, by), by)
    new = {}
    for c in cols:
        x, mu, sd = F.col(c), F.col(f"{c}_mu"), F.col(f"{c}_sd")
        z = F.when(sd >= eps, F.try_divide(x - mu, sd))
        new[c + suffix] = z if flat is None else F.when(x.isNotNull() & (sd < eps), F.lit(flat)).otherwise(z)
    return _with(j, new, [f"{c}_{t}" for c in cols for t in ("mu", "sd")])


def graph_feature_zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = DATE, suffix: str = "") -> DataFrame:
    """z-score whose deviation is taken as 1 when it is below 1e-8."""
    j = attach(df, cs_moments(df, cols, by), by)
    new = {}
    for c in cols:
        sd = F.col(f"{c}_sd")
        new[c + suffix] = (F.col(c) - F.col(f"{c}_mu")) / F.when(sd < 1e-8, 1.0).otherwise(sd)
    return _with(j, new, [f"{c}_{t}" for c in cols for t in ("mu", "sd")])


def cs_zscore_sample(df: DataFrame, cols: Sequence[str], by: Sequence[str] = DATE, suffix: str = "") -> DataFrame:
    """(x - mean) / sample deviation; 0 for the whole group when that is 0 or undefined."""
    if len(cols) > wide.MANY and not suffix:
        def work(x: np.ndarray, s: wide.Stats, _) -> np.ndarray:
            sd = np.where(s["n"] > 1, np.sqrt(s["m2"] / (s["n"] - 1)), np.nan)
            return np.where(np.isnan(sd) | (sd == 0), 0.0, (x - s["t"] / s["n"]) / sd)

        return wide.map_by_group(df, wide.group_moments(df, by, cols), by, cols, wide.moment_widths(cols), work)
    j = attach(df, cs_moments(df, cols, by, ddof=1), by)
    new = {}
    for c in cols:
        sd = F.col(f"{c}_sd")
        new[c + suffix] = (F.when(sd.isNull() | (sd == 0), 0.0)
                           .otherwise(F.try_divide(F.col(c) - F.col(f"{c}_mu"), sd)))
    return _with(j, new, [f"{c}_{t}" for c in cols for t in ("mu", "sd")])


def winsor(df: DataFrame, cols: Sequence[str], kind: str = "mad", p: float = 0.01, n: float = 3,
           by: Sequence[str] = DATE, suffix: str = "") -> DataFrame:
    """Clip at quantiles p and 1-p, at mean +- n deviations, or at median +- n scaled MADs."""
    if kind == "quantile":
        j = attach(df, group_quantiles(df, by, cols, [p, 1 - p]), by)
        bounds = {c: (F.col(f"{c}_q0"), F.col(f"{c}_q1")) for c in cols}
        used = [f"{c}_q{i}" for c in cols for i in (0, 1)]
    elif kind == "sigma":
        j = attach(df, cs_moments(df, cols, by), by)
        bounds = {c: (F.col(f"{c}_mu") - n * F.col(f"{c}_sd"), F.col(f"{c}_mu") + n * F.col(f"{c}_sd")) for c in cols}
        used = [f"{c}_{t}" for c in cols for t in ("mu", "sd")]
    elif kind == "mad" and len(cols) > wide.MANY and not suffix:
        many = {"mid": len(cols)}
        mid = small_side(wide.as_arrays(group_medians(df, by, cols), by, mid=[f"{c}_med" for c in cols]))
        gaps = wide.map_by_group(df.select(*by, *cols), mid, by, cols, many, lambda x, s, _: np.abs(x - s["mid"]))
        mads = wide.as_arrays(group_medians(gaps, by, cols), by, mad=[f"{c}_med" for c in cols])

        def work(x: np.ndarray, s: wide.Stats, _) -> np.ndarray:
            reach = n * MAD_SCALE * s["mad"]
            return np.where(np.isnan(x), x, np.fmin(np.fmax(x, s["mid"] - reach), s["mid"] + reach))

        return wide.map_by_group(df, mid.join(mads, list(by)), by, cols, many | {"mad": len(cols)}, work)
    elif kind == "mad":
        mid = attach(df, group_medians(df, by, cols), by)
        gaps = mid.select(*by, *[F.abs(F.col(c) - F.col(f"{c}_med")).alias(c) for c in cols])
        mads = group_medians(gaps, by, cols).select(*by, *[F.col(f"{c}_med").alias(f"{c}_mad") for c in cols])
        j = attach(mid, mads, by)
        bounds = {c: (F.col(f"{c}_med") - n * MAD_SCALE * F.col(f"{c}_mad"),
                      F.col(f"{c}_med") + n * MAD_SCALE * F.col(f"{c}_mad")) for c in cols}
        used = [f"{c}_{t}" for c in cols for t in ("med", "mad")]
    else:
        raise ValueError(f"unknown winsor kind {kind!r}")
    return _with(j, {c + suffix: clip(c, *bounds[c]) for c in cols}, used)


def winsor_tail_mean(df: DataFrame, cols: Sequence[str], p: float = 0.01, by: Sequence[str] = DATE,
                     suffix: str = "") -> DataFrame:
    """Values beyond the p and 1-p quantiles become the mean of their tail."""
    j = attach(df, group_quantiles(df, by, cols, [p, 1 - p]), by)
    low = {c: F.col(c) < F.col(f"{c}_q0") for c in cols}
    high = {c: F.col(c) > F.col(f"{c}_q1") for c in cols}
    tails = j.groupBy(*by).agg(*[F.avg(F.when(side[c], F.col(c))).alias(f"{c}_{tag}")
                                 for c in cols for side, tag in ((low, "lo"), (high, "hi"))])
    j = attach(j, tails, by)
    new = {c + suffix: F.when(low[c], F.col(f"{c}_lo")).when(high[c], F.col(f"{c}_hi")).otherwise(F.col(c))
           for c in cols}
    return _with(j, new, [f"{c}_{t}" for c in cols for t in ("q0", "q1", "lo", "hi")])


def winsor_shrink(df: DataFrame, cols: Sequence[str], p: float = 0.01, shrink: float = 0.5,
                  by: Sequence[str] = DATE, suffix: str = "") -> DataFrame:
    """Values beyond the p and 1-p quantiles move to ``shrink`` of their distance from the bound."""
    j = attach(df, group_quantiles(df, by, cols, [p, 1 - p]), by)
    new = {}
    for c in cols:
        x, lo, hi = F.col(c), F.col(f"{c}_q0"), F.col(f"{c}_q1")
        new[c + suffix] = F.when(x < lo, lo - (lo - x) * shrink).when(x > hi, hi + (x - hi) * shrink).otherwise(x)
    return _with(j, new, [f"{c}_{t}" for c in cols for t in ("q0", "q1")])


def robust_scale(df: DataFrame, cols: Sequence[str], by: Sequence[str] = DATE, suffix: str = "") -> DataFrame:
    """(x - median) / interquartile range; a zero range divides by 1."""
    j = attach(df, group_quantiles(df, by, cols, [0.25, 0.5, 0.75]), by)
    new = {}
    for c in cols:
        iqr = F.col(f"{c}_q2") - F.col(f"{c}_q0")
        new[c + suffix] = (F.col(c) - F.col(f"{c}_q1")) / F.when(iqr == 0, 1.0).otherwise(iqr)
    return _with(j, new, [f"{c}_q{i}" for c in cols for i in range(3)])


def cs_rank(df: DataFrame, col: str, by: Sequence[str] = DATE, out: str = "cs_rank", normalize: bool = True) -> DataFrame:
    """Average rank from 0, scaled to [0, 1] when ``normalize``."""
    j = average_rank(df, by, col, "_rank", "_size")
    rank = F.col("_rank") - 1
    if normalize:
        rank = rank / F.when(F.col("_size") > 1, F.col("_size") - 1).otherwise(1)
    return _with(j, {out: rank}, ["_rank", "_size"])


def _both_known(df: DataFrame, col: str, log_size: Column, group: str) -> Column:
    return F.col(col).isNotNull() & log_size.isNotNull() & F.col(group).between(0, INDUSTRY_CODES - 1)


def neutralise(df: DataFrame, cols: Sequence[str], group: str = "industry", size: str = "mv",
               by: Sequence[str] = DATE, suffix: str = "") -> DataFrame:
    """Residual of x on ln(size) inside date and industry, standardised there.

    slope = (mean_x mean_s - mean_xs) / (mean_s^2 - mean_ss + 1e-6), and the
    deviation of the residual is padded by 1e-6.  Only codes 0-30 take part.
    """
    keys = [*by, group]
    s = F.when(F.col(size) > 0, F.ln(F.col(size)))
    aggs, both = [], {}
    for c in cols:
        both[c] = _both_known(df, c, s, group)
        x, z = F.when(both[c], F.col(c)), F.when(both[c], s)
        aggs += [F.avg(x).alias(f"{c}_mx"), F.avg(z).alias(f"{c}_ms"),
                 F.avg(x * z).alias(f"{c}_mxs"), F.avg(z * z).alias(f"{c}_mss")]
    j = attach(df, df.groupBy(*keys).agg(*aggs).where(F.col(group).isNotNull()), keys)
    res = {}
    for c in cols:
        mx, ms = F.col(f"{c}_mx"), F.col(f"{c}_ms")
        slope = F.try_divide(mx * ms - F.col(f"{c}_mxs"), ms * ms - F.col(f"{c}_mss") + 1e-6)
        res[f"{c}_res"] = F.when(both[c], F.col(c) - slope * s - (mx - slope * ms))
    j = _with(j, res, [f"{c}_{t}" for c in cols for t in ("mx", "ms", "mxs", "mss")])
    names = list(res)
    j = attach(j, cs_moments(j, names, keys).where(F.col(group).isNotNull()), keys)
    new = {c + suffix: (F.col(f"{c}_res") - F.col(f"{c}_res_mu")) / (F.col(f"{c}_res_sd") + 1e-6) for c in cols}
    return _with(j, new, [n + t for n in names for t in ("", "_mu", "_sd")])


def neutralise_event(df: DataFrame, cols: Sequence[str], group: str = "industry", log_size: str = "logmv",
                     by: Sequence[str] = DATE, suffix: str = "") -> DataFrame:
    """Residual of x on log size inside date and industry.

    Mean and variance of log size use every row of the group, the covariance only
    rows with both sides (around those means); slope 0 when that variance is at most
    1e-12.  All moments are centred ones, so a flat group has none of their rounding.
    A line through the only two rows of a group leaves no degree of freedom: residual 0.
    """
    keys = [*by, group]
    if len(cols) > wide.MANY and not suffix:
        def work(x: np.ndarray, m: wide.Stats, s: np.ndarray) -> np.ndarray:
            var, mx, ms = m["m2s"] / m["ns"], m["t"] / m["n"], m["ts"] / m["ns"]
            cov = m["c"] / m["nb"] + (m["tb"] / m["nb"] - mx) * (m["us"] / m["nb"] - ms)
            beta = np.where(var > 1e-12, cov / var, 0.0)
            fitted = (var > 1e-12) & (m["ns"] == 2) & (m["n"] == 2) & (m["nb"] == 2)
            residual = x - mx - beta * (s - ms)
            return np.where(fitted & ~np.isnan(residual), 0.0, residual)

        return wide.map_by_group(df, wide.group_moments(df, keys, cols, log_size), keys, cols, wide.moment_widths(cols, True), work, log_size)
    s = F.col(log_size)
    aggs = [F.avg(s).alias("_ms"), F.var_pop(s).alias("_vs"), F.count(s).alias("_ns")]
    for c in cols:
        x, both = F.col(c), F.when(F.col(c).isNotNull(), s)
        aggs += [F.avg(x).alias(f"{c}_mx"), F.covar_pop(x, s).alias(f"{c}_mxs"),
                 F.avg(F.when(s.isNotNull(), x)).alias(f"{c}_mxb"), F.avg(both).alias(f"{c}_msb"),
                 F.count(x).alias(f"{c}_nx"), F.count(both).alias(f"{c}_nb")]
    j = attach(df, df.groupBy(*keys).agg(*aggs).where(F.col(group).isNotNull()), keys)
    new = {}
    for c in cols:
        mx, ms = F.col(f"{c}_mx"), F.col("_ms")
        cov = F.col(f"{c}_mxs") + (F.col(f"{c}_mxb") - mx) * (F.col(f"{c}_msb") - ms)
        beta = F.when(F.col("_vs") > 1e-12, cov / F.nullif(F.col("_vs"), F.lit(0.0))).otherwise(0.0)
        fitted = (F.col("_vs") > 1e-12) & (F.col("_ns") == 2) & (F.col(f"{c}_nx") == 2) & (F.col(f"{c}_nb") == 2)
        residual = F.col(c) - mx - beta * (s - ms)
        new[c + suffix] = F.when(fitted & residual.isNotNull(), 0.0).otherwise(residual)
    return _with(j, new, ["_ms", "_vs", "_ns"] + [f"{c}_{t}" for c in cols for t in ("mx", "mxs", "mxb", "msb", "nx", "nb")])


def fill_industry_median(df: DataFrame, cols: Sequence[str], group: str = "industry",
                         by: Sequence[str] = DATE) -> DataFrame:
    """NULL -> median of the date and industry; rows of unknown industry stay as they are."""
    keys = [*by, group]
    if len(cols) > wide.MANY:
        medians = wide.as_arrays(group_medians(df, keys, cols), keys, mid=[f"{c}_med" for c in cols])
        return wide.map_by_group(df, medians, keys, cols, {"mid": len(cols)}, lambda x, s, _: np.where(np.isnan(x), s["mid"], x))
    j = attach(df, group_medians(df, keys, cols), keys)
    return _with(j, {c: F.coalesce(F.col(c), F.col(f"{c}_med")) for c in cols}, [f"{c}_med" for c in cols])


def clean_feature(df: DataFrame, cols: Sequence[str], group: str = "industry", log_size: str = "logmv",
                  by: Sequence[str] = DATE, neutral: bool = True) -> DataFrame:
    """Industry fill, MAD clip, size neutralisation, sample z-score, for all features at once."""
    df = winsor(fill_industry_median(df, cols, group, by), cols, "mad", n=3, by=by)
    if neutral:
        df = neutralise_event(df, cols, group, log_size, by)
    return cs_zscore_sample(df, cols, by)


def cs_orthogonalise(df: DataFrame, y: str, x: str, by: Sequence[str] = DATE, out: str = "orth") -> DataFrame:
    """Residual of y on x per date (rows with both)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    stats = df.groupBy(*by).agg(F.regr_slope(ys, xs).alias("_b"), F.regr_intercept(ys, xs).alias("_a"))
    j = attach(df, stats, by)
    return _with(j, {out: F.col(y) - (F.col("_a") + F.col("_b") * F.col(x))}, ["_a", "_b"])


def yeo_johnson_slopes(df: DataFrame, x: str, lam: str, by: Sequence[str]) -> DataFrame:
    """by + first and second derivative of the log-likelihood in the exponent column ``lam``, NULL where it overflows or
    the transformed values do not vary."""
    y, y1, y2 = yeo_johnson_derivatives(x, lam)
    stats = df.select(*by, lam, F.col(x).alias("_x"), y.alias("_y"), y1.alias("_y1"), y2.alias("_y2")).groupBy(*by, lam).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("_y").alias("v"), F.covar_pop("_y", "_y1").alias("c1"), F.var_pop("_y1").alias("v1"),
        F.covar_pop("_y", "_y2").alias("c2"), F.sum(F.signum("_x") * F.log1p(F.abs("_x"))).alias("j"))
    lean = F.try_divide(F.col("c1"), F.col("v"))
    slope = F.col("j") - F.col("n") * lean
    curve = -F.col("n") * (F.try_divide(F.col("v1") + F.col("c2"), F.col("v")) - 2 * lean * lean)
    usable = (F.col("v") > 1e-300) & (F.col("v") < float("inf"))
    return stats.select(*by, lam, F.when(usable, null_if_not_finite(slope)).alias("slope"), F.when(usable, null_if_not_finite(curve)).alias("curve"))


def yeo_johnson_lambda(df: DataFrame, x: str, by: Sequence[str] = DATE, start: float = 1.0, tol: float = 1e-9,
                       limit: float = 1e6) -> DataFrame:
    """by + lam: maximum-likelihood exponent per group by safeguarded Newton steps from ``start``.

    A round is one aggregate: each row is transformed once, at its group's present exponent.  The sign of the slope keeps
    a bracket; a step that leaves it, or that goes uphill in curvature, becomes a bisection, or doubles the distance while
    one side is open.  A group is done when its error is about ``tol`` (relative above 1), so the result does not depend on
    where the search started.  Constant groups give no row; a likelihood that rises beyond ``limit`` gives the limit.
    """
    known = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"))
    varied = known.groupBy(*by).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx")).where("_mn < _mx")
    nothing = F.lit(None).cast("double")
    state = small_side(varied.select(*by, F.lit(float(start)).alias("lam"), nothing.alias("_lo"), nothing.alias("_hi")))
    done = None
    while True:
        at = yeo_johnson_slopes(known.join(state.select(*by, "lam"), list(by)), "_x", "lam", by).join(state.drop("lam"), list(by))
        # beyond the representable exponents the likelihood only falls
        rising = F.coalesce(F.col("slope") > 0, F.col("lam") < start)
        lo, hi = F.when(rising, F.col("lam")).otherwise(F.col("_lo")), F.when(rising, F.col("_hi")).otherwise(F.col("lam"))
        newton = F.when(F.col("curve") < 0, F.col("lam") - F.col("slope") / F.col("curve"))
        reach = 2 * F.greatest(F.abs(F.col("lam") - start), F.lit(1.0))
        safe = (F.coalesce(newton > lo, newton > F.col("lam") - reach) & F.coalesce(newton < hi, newton < F.col("lam") + reach))
        step = F.coalesce((lo + hi) / 2, F.when(rising, F.col("lam") + reach).otherwise(F.col("lam") - reach))
        after = F.when(F.col("slope") == 0, F.col("lam")).when(F.coalesce(safe, F.lit(False)), newton).otherwise(step)
        # a Newton step this small leaves about its square
        size = F.greatest(F.abs("lam"), F.lit(1.0))
        near = F.when(F.coalesce(safe, F.lit(False)), F.lit(tol ** 0.5 / 3)).otherwise(F.lit(tol)) * size
        moved = small_side(at.select(*by, "lam", lo.alias("_lo"), hi.alias("_hi"), after.alias("_to"), near.alias("_near"), (tol * size).alias("_tol")).withColumn(
            "_done", (F.abs(F.col("_to") - F.col("lam")) <= F.col("_near")) | F.coalesce(F.col("_hi") - F.col("_lo") <= F.col("_tol"), F.lit(False))
            | (F.abs("_to") >= limit)))
        ready = moved.where("_done").select(*by, F.least(F.greatest("_to", F.lit(-limit)), F.lit(limit)).alias("lam"))
        done = ready if done is None else done.unionByName(ready)
        if moved.where("not _done").isEmpty():
            return done
        state = moved.where("not _done").select(*by, F.col("_to").alias("lam"), "_lo", "_hi")


def yeo_johnson(df: DataFrame, col: str, by: Sequence[str] = DATE, out: str = "yeo", **search) -> DataFrame:
    """Power transform with the group's exponent, then population z-score; constant groups give NULL."""
    spread = df.groupBy(*by).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    lam = yeo_johnson_lambda(df, col, by, **search)
    stats = spread.join(lam, list(by)).where(F.col("_mx") > F.col("_mn")).select(*by, "lam")
    j = attach(df, stats, by).withColumn("_y", yeo_johnson_value(col, "lam"))
    return cs_zscore(j, ["_y"], by).withColumn(out, F.col("_y")).drop("_y", "lam")


def industry_agg(df: DataFrame, col: str, how: str, out: str, group: str = "industry",
                 by: Sequence[str] = DATE) -> DataFrame:
    """Statistic of the date and industry on every row: median, mean, std (ddof 1), sum or rank.

    ``rank`` is (K + 1 - average rank) / K, where K also counts rows without a value.
    """
    keys = [*by, group]
    known = df.where(F.col(group).between(0, INDUSTRY_CODES - 1))
    if how == "median":
        stats = group_medians(known, keys, [col]).withColumnRenamed(f"{col}_med", out)
    elif how == "rank":
        sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
        j = average_rank(attach(df, sizes, keys), keys, col, "_rank", "_size")
        return _with(j, {out: (F.col("_k") + 1 - F.col("_rank")) / F.col("_k")}, ["_k", "_rank", "_size"])
    else:
        fn = {"mean": F.avg, "std": F.stddev_samp, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}[how]
        stats = known.groupBy(*keys).agg(fn(col).alias(out))
    return attach(df, stats, keys)


def group_softmax(df: DataFrame, col: str, by: Sequence[str], out: str = "softmax") -> DataFrame:
    """exp(x - max) / (sum + 1e-12) inside each group."""
    e = attach(df, df.groupBy(*by).agg(F.max(col).alias("_top")), by).withColumn("_e", F.exp(F.col(col) - F.col("_top")))
    total = e.groupBy(*by).agg(F.sum("_e").alias("_sum"))
    return attach(e, total, by).withColumn(out, F.col("_e") / (F.col("_sum") + 1e-12)).drop("_top", "_e", "_sum")


def peer_stats(edges: DataFrame, label: DataFrame, y: str, by: Sequence[str] = DATE,
               eps: float = 1e-12) -> DataFrame:
    """Label against its peers: z-score over the peers' mean and deviation, and plain excess; NULL without peers."""
    peers = edges.join(label.select(*by, F.col("tick").alias("peer_tick"), F.col(y).alias("_py")),
                       [*by, "peer_tick"], "left")
    stats = peers.groupBy(*by, "tick").agg(F.avg("_py").alias("_m"), F.stddev_pop("_py").alias("_s"))
    gap = F.col(y) - F.col("_m")
    return (label.join(stats, [*by, "tick"], "left")
            .select(*by, "tick", F.when(F.col("_s") > eps, F.try_divide(gap, F.col("_s"))).alias("peer_zscore"),
                    gap.alias("peer_excess")))
