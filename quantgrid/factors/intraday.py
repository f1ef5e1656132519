"""Features of minute bars; a bar row is keyed by (tick, date, minute_idx)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, stage
from quantgrid.functions.scalar import safe_div
from quantgrid.sources.axis import calendar

DAY = ("tick", "date")


def minute_returns(bars: DataFrame, cols: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*DAY).orderBy("minute_idx")
    return bars.withColumns({f"{c}_ret": F.try_divide(F.col(c), F.lag(c).over(w)) - 1 for c in cols})


def minute_zscore(bars: DataFrame, cols: Sequence[str], trim: tuple[int, int] = (1, 3)) -> DataFrame:
    """z-score over the day's bars, then the day's first and last bars cut off."""
    day = Window.partitionBy(*DAY)
    z = {f"{c}_z": F.try_divide(F.col(c) - F.avg(c).over(day), F.stddev_pop(c).over(day)) for c in cols}
    pos = F.row_number().over(day.orderBy("minute_idx"))
    return (bars.withColumns({**z, "_i": pos, "_n": F.count(F.lit(1)).over(day)})
            .where((F.col("_i") > trim[0]) & (F.col("_i") <= F.col("_n") - trim[1])).drop("_i", "_n"))


def minute_ratios(bars: DataFrame, daily: DataFrame, cols: Sequence[str] = ("close", "high", "low")) -> DataFrame:
    """Price over the daily panel's open; a zero open gives 0, an unknown one NULL."""
    return (bars.join(daily.select(*DAY, F.col("open").alias("_day_open")), list(DAY), "left")
            .withColumns({f"{c}_ratio": safe_div(c, "_day_open") for c in cols}).drop("_day_open"))


def limit_position(close: ColumnOrName, ceil: ColumnOrName, floor: ColumnOrName) -> Column:
    """Where the close sits between the price limits; 0.5 when they coincide."""
    c, hi, lo = as_col(close), as_col(ceil), as_col(floor)
    return F.when(hi == lo, 0.5).otherwise(F.try_divide(c - lo, hi - lo))


def intraday_rollup(bars: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [a for c in cols for a in (F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean"))]
    return bars.groupBy(*DAY).agg(*aggs)


def minute_volume_ratio(bars: DataFrame, col: str = "volume", mode: str = "day", days: int = 20) -> DataFrame:
    """Bar value over the day's mean bar, or over the mean daily sum of the last ``days`` traded dates."""
    if mode == "day":
        base = F.avg(col).over(Window.partitionBy(*DAY))
        return bars.withColumn(f"{col}_ratio", safe_div(col, base))
    daily = bars.groupBy(*DAY).agg(F.sum(col).alias("_sum"))
    mean = F.avg("_sum").over(Window.partitionBy("tick").orderBy("date").rowsBetween(1 - days, 0))
    return (bars.join(daily.select(*DAY, mean.alias("_base")), list(DAY))
            .withColumn(f"{col}_ratio", safe_div(col, "_base")).drop("_base"))


def minute_panel(bars: DataFrame, minutes: Column, cols: Sequence[str], ticks: DataFrame | None = None) -> DataFrame:
    """Every bar time for every tick that traded that day; absent bars are 0.

    ``minutes`` is an array of bar times.  A day's bars are laid into a map per
    (tick, date), at most one entry per bar time, so no grid join is needed.  With
    ``ticks`` every listed tick has rows on every date of the bars, NULL on the days it did not trade.
    """
    day = bars.groupBy(*DAY).agg(F.map_from_entries(F.collect_list(
        F.struct("minute_idx", F.struct(*cols)))).alias("_m"))
    if ticks is not None:
        days = stage(calendar(bars))
        listed = ticks.select("tick").distinct().select("tick", F.explode(days.scalar()).alias("date"))
        day = listed.join(day, list(DAY), "left")
    full = day.select(*DAY, "_m", F.explode(minutes).alias("minute_idx"))
    hit = F.try_element_at("_m", F.col("minute_idx"))
    value = {c: F.when(F.col("_m").isNotNull(), F.coalesce(hit[c], F.lit(0.0))) for c in cols}
    return full.select(*DAY, "minute_idx", *[v.alias(c) for c, v in value.items()])


def minute_mask(minute_fields: DataFrame, daily: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minute values set to NULL on days the tick has no daily close."""
    traded = daily.where(F.col("close").isNotNull()).select(*DAY, F.lit(True).alias("_t"))
    return (minute_fields.join(traded, list(DAY), "left")
            .withColumns({c: F.when(F.col("_t"), F.col(c)) for c in cols}).drop("_t"))


