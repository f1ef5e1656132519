"""Signal evaluation: information coefficients, quantile groups, drawdown, errors.

Inputs are long (date_idx, tick, pred, label) rows.  Everything per date is an
aggregate with map-side combine; series functions run on the aggregated result,
which holds at most one row per date and group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, attach, small_side
from quantgrid.functions.scalar import null_if_not_finite
from quantgrid.operators.order_stats import average_rank

DATE = ("date_idx",)


def _pair(pred: ColumnOrName, label: ColumnOrName) -> tuple[Column, Column]:
    p, y = null_if_not_finite(pred), null_if_not_finite(label)
    return F.when(y.isNotNull(), p), F.when(p.isNotNull(), y)


def ic(df: DataFrame, pred: str = "pred", label: str = "label", by: Sequence[str] = DATE, out: str = "ic") -> DataFrame:
    """Pearson over complete pairs with both deviations padded by 1e-6; 0 when undefined."""
    a, b = _pair(pred, label)
    value = ((F.avg(a * b) - F.avg(a) * F.avg(b)) / (F.stddev_pop(a) + 1e-6) / (F.stddev_pop(b) + 1e-6))
    return df.groupBy(*by).agg(F.coalesce(null_if_not_finite(value), F.lit(0.0)).alias(out))


def rank_ic(df: DataFrame, pred: str = "pred", label: str = "label", by: Sequence[str] = DATE,
            out: str = "rank_ic", rerank: bool = False) -> DataFrame:
    """IC of average ranks, each side ranked over its own values unless ``rerank``."""
    a, b = _pair(pred, label) if rerank else (F.col(pred), F.col(label))
    both = df.select(*by, a.alias("_p"), b.alias("_y"))
    ranked = average_rank(average_rank(both, by, "_p", "_rp", "_np"), by, "_y", "_ry", "_ny")
    return ic(ranked, "_rp", "_ry", by, out)


def group_returns(df: DataFrame, pred: str = "pred", label: str = "label", groups: int = 10,
                  by: Sequence[str] = DATE, closed: bool = True) -> DataFrame:
    """(by, group, ret): mean label per rank group minus the mean over groups.

    Groups hold floor(max rank / groups) names and are numbered groups ... 1 from
    the lowest prediction.  ``closed`` puts a boundary rank into the lower group
    and the rest into the last; the open variant leaves boundary names out.
    """
    ranked = average_rank(df.select(*by, pred, label), by, pred, "_rank", "_n")
    top = ranked.groupBy(*by).agg(F.max("_rank").alias("_top"))
    j = ranked.where(F.col("_rank").isNotNull()).join(small_side(top), list(by))
    size = F.floor(F.col("_top") / groups)
    steps = F.try_divide(F.col("_rank"), size.cast("double"))
    if closed:
        idx = F.when(size == 0, groups - 1).otherwise(F.least(F.ceil(steps) - 1, F.lit(groups - 1)))
    else:
        idx = F.when((size > 0) & (steps != F.floor(steps)) & (steps < groups), F.floor(steps))
    mean = (j.withColumn("_i", idx).where(F.col("_i").isNotNull())
            .groupBy(*by, (F.lit(groups) - F.col("_i")).cast("int").alias("group")).agg(F.avg(label).alias("_r")))
    centre = F.avg("_r").over(Window.partitionBy(*by))
    return mean.select(*by, "group", (F.col("_r") - centre).alias("ret"))


def group_returns_cum(df: DataFrame, pred: str = "pred", label: str = "label", groups: int = 10,
                      closed: bool = False) -> DataFrame:
    """Open-boundary group returns, accumulated over dates per group."""
    g = group_returns(df, pred, label, groups, closed=closed)
    run = Window.partitionBy("group").orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("cum", F.when(F.col("ret").isNotNull(), F.sum("ret").over(run)))


def sharpe(series: DataFrame, ret: str = "ret", by: Sequence[str] = ("group",), periods: int = 242) -> DataFrame:
    value = F.try_divide(F.avg(ret), F.stddev_pop(ret)) * math.sqrt(periods)
    return series.groupBy(*by).agg(value.alias("sharpe"))


def max_drawdown(series: DataFrame, ret: str = "ret", by: Sequence[str] = ("group",)) -> DataFrame:
    """Lowest (cum - running max) / running max of summed returns; NULL while the maximum is not positive."""
    run = Window.partitionBy(*by).orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    cum = series.withColumn("_cum", F.sum(ret).over(run)).withColumn("_max", F.max("_cum").over(run))
    drop = F.when(F.col("_max") > 0, F.try_divide(F.col("_cum") - F.col("_max"), F.col("_max")))
    return cum.groupBy(*by).agg(F.min(drop).alias("max_drawdown"))


def ic_series(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """(date_idx, ic, rank_ic)."""
    return ic(df, pred, label).join(rank_ic(df, pred, label), "date_idx")


def ic_summary(series: DataFrame, cols: Sequence[str] = ("ic", "rank_ic")) -> DataFrame:
    return series.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def cum_ic(series: DataFrame, cols: Sequence[str] = ("ic", "rank_ic")) -> DataFrame:
    """(metric, date_idx, value, cum): running sums, one time series per metric."""
    long = series.unpivot("date_idx", list(cols), "metric", "value")
    run = Window.partitionBy("metric").orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("cum", F.sum("value").over(run))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 50) -> DataFrame:
    """(metric, bin, low, high, n): equal-width counts; the maximum falls into the last bin."""
    long = df.select(*cols).unpivot([], list(cols), "metric", "value").where(F.col("value").isNotNull())
    span = long.groupBy("metric").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = attach(long, span, ["metric"])
    lo = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    width = F.when(F.col("_lo") == F.col("_hi"), 1.0).otherwise(F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col("value") - lo) / width), F.lit(bins - 1))
    counted = j.groupBy("metric", lo.alias("_a"), width.alias("_w"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("metric", "bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("low"),
                          (F.col("_a") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")


def ensemble_mean(members: DataFrame, value: str = "pred", by: Sequence[str] = ("date_idx", "tick")) -> DataFrame:
    """Mean over the members that have a value, per cell."""
    return members.groupBy(*by).agg(F.avg(value).alias(value))


def huber(err: Column, delta: float) -> Column:
    a = F.abs(err)
    return F.when(a <= delta, 0.5 * err * err).otherwise(delta * (a - 0.5 * delta))


def pred_errors(df: DataFrame, pred: str = "pred", label: str = "label", delta: float = 1.0,
                by: Sequence[str] = DATE) -> DataFrame:
    err = null_if_not_finite(F.col(pred) - F.col(label))
    return df.groupBy(*by).agg(F.avg(err * err).alias("mse"), F.sqrt(F.avg(err * err)).alias("rmse"),
                               F.avg(huber(err, delta)).alias("huber"))


def ic_loss_metric(df: DataFrame, pred: str = "pred", label: str = "label", by: Sequence[str] = DATE,
                   eps: float = 1e-8) -> DataFrame:
    """1 - IC with sample deviations (``ic_loss``) and with padded population ones (``ic_loss_eps``)."""
    a, b = _pair(pred, label)
    n = F.count(a)
    cov = F.covar_pop(a, b)
    plain = 1 - F.try_divide(cov, F.stddev_samp(a) * F.stddev_samp(b))
    padded = F.when(n < 2, 1.0).otherwise(1 - F.try_divide(cov, F.stddev_pop(a) * F.stddev_pop(b) + eps))
    return df.groupBy(*by).agg(plain.alias("ic_loss"), padded.alias("ic_loss_eps"))
