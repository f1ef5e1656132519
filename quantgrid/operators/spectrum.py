"""Dominant periods of series by discrete Fourier transform."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import small_side


def amplitudes(panel: DataFrame, col: str, key: str = "tick") -> DataFrame:
    """(key, length, freq, amp): amplitude of frequency 0 ... T/2 of each tick's series, NULL read as 0.

    Every value meets its series' frequencies and adds to two sums per frequency; the rows of a tick are already
    together, so the sums need no further exchange.
    """
    tick = Window.partitionBy(key)
    rows = panel.select(key, F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias("_v"),
                        (F.row_number().over(tick.orderBy("date_idx")) - 1).alias("_t"), F.count(F.lit(1)).over(tick).alias("length"))
    each = rows.select(key, "length", "_v", "_t", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / 2).cast("int"))).alias("freq"))
    # The turn is reduced to one circle in integers, where the cosine is most exact.
    angle = F.lit(2 * math.pi) * F.pmod(F.col("freq").cast("long") * F.col("_t"), F.col("length")) / F.col("length")
    re, im = F.sum(F.col("_v") * F.cos(angle)), F.sum(F.col("_v") * F.sin(angle))
    return each.groupBy(key, "length", "freq").agg(F.sqrt(re * re + im * im).alias("amp"))


def dominant_periods(panel: DataFrame, col: str, k: int = 2, key: str = "tick") -> tuple[DataFrame, DataFrame]:
    """(top, per_series): the k strongest frequencies by mean amplitude with period T // f, and each series' amplitude there."""
    flat = amplitudes(panel, col, key).where(F.col("freq") > 0)
    mean = flat.groupBy("freq").agg(F.avg("amp").alias("mean_amp"), F.max("length").alias("_t"))
    top = (mean.orderBy(F.desc(F.round("mean_amp", 6)), "freq").limit(k)
           .select("freq", F.floor(F.col("_t") / F.col("freq")).alias("period"), "mean_amp"))
    top = small_side(top)
    return top, flat.join(top.select("freq", "period"), "freq").select(key, "freq", "period", "amp")
