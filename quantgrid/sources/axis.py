"""The shared axis: trading dates and ticks with their ordinals, and the dense grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import BROADCAST_ROWS, attach, stage, tick_window


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """One row holding the sorted distinct dates."""
    return df.agg(F.sort_array(F.collect_set(F.col(date))).alias("days"))


def date_axis(df: DataFrame, date: str = "date") -> DataFrame:
    """dates(date_idx, date): ordinal of every distinct date, without a global window."""
    return calendar(df, date).select(F.posexplode("days").alias("date_idx", "date"))


def tick_axis(df: DataFrame, tick: str = "tick") -> DataFrame:
    """ticks(tick, tick_idx): sorted ordinal of every tick, with no task seeing all ticks.

    Ticks are range partitioned and written with their range number, so that both
    uses below read the same ranges; counts per range give offsets, row numbers
    inside a range give the rest.
    """
    ticks = df.select(F.col(tick).alias("tick")).where(F.col("tick").isNotNull()).distinct()
    ranged = stage(ticks.repartitionByRange("tick").withColumn("_b", F.spark_partition_id()))
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("_m")).select("_b", before.alias("_off"))
    pos = F.row_number().over(Window.partitionBy("_b").orderBy("tick")) - 1
    return (attach(ranged.withColumn("_pos", pos), offsets, ["_b"])
            .select("tick", (F.col("_off") + F.col("_pos")).cast("int").alias("tick_idx")))


def densify(facts: DataFrame, fields: Sequence[str], ticks: DataFrame | None = None,
            days: DataFrame | None = None) -> DataFrame:
    """Dense panel (date_idx, date, tick, fields): one row per tick and calendar date.

    Each fact row fills the gap up to the tick's next fact, so the grid needs no
    cross join and a single exchange on tick; later windows over tick reuse it.
    A repeated (tick, date) raises, as every later window counts rows.  ``ticks`` adds ticks without facts,
    ``days`` (from :func:`calendar`) replaces the facts' own dates; facts off the
    calendar or off the ticks drop out.
    """
    days = stage(calendar(facts) if days is None else days)
    dates = days.select(F.posexplode("days").alias("date_idx", "date"))
    few = days.select(F.size("days")).first()[0] <= BROADCAST_ROWS
    on_axis = facts.select("tick", "date", *fields).join(F.broadcast(dates) if few else dates, "date")
    if ticks is not None:
        on_axis = ticks.select("tick").join(on_axis, "tick", "left")
    w = tick_window()
    last = F.size(days.scalar()) - 1
    start = F.when(F.lag("date_idx").over(w).isNull(), 0).otherwise(F.col("date_idx"))
    after = F.lead("date_idx").over(w)
    twice = F.raise_error(F.concat(F.lit("two rows for tick "), F.col("tick").cast("string"), F.lit(" on one date"))).cast("int")
    end = F.when(after == F.col("date_idx"), twice).otherwise(F.coalesce(after - 1, last))
    spans = on_axis.select("tick", *fields, F.col("date_idx").alias("_at"), start.alias("_s"), end.alias("_e"))
    cells = spans.select("tick", *fields, "_at", F.explode(F.sequence("_s", "_e")).alias("date_idx"))
    here = F.col("date_idx") == F.col("_at")
    return cells.select("date_idx", F.element_at(days.scalar(), F.col("date_idx") + 1).alias("date"), "tick",
                        *[F.when(here, F.col(f)).alias(f) for f in fields])


def _neighbours(days: DataFrame) -> DataFrame:
    """(date, prev, next) per trading date, built inside the one calendar row."""
    trio = F.transform("days", lambda d, i: F.struct(
        d.alias("date"), F.get("days", i - 1).alias("prev"), F.get("days", i + 1).alias("next")))
    return days.select(F.posexplode(trio).alias("date_idx", "t")).select("date_idx", "t.*")


def next_trading_day(days: DataFrame) -> DataFrame:
    """(date_idx, date, next_date): the following trading date, or the date itself at the end."""
    return _neighbours(days).select("date_idx", "date", F.coalesce("next", "date").alias("next_date"))


def day_map(days: DataFrame, target: str = "next") -> DataFrame:
    """Every calendar day -> the trading date on or after ("next") or on or before ("prev") it.

    Turns a calendar as-of join into a plain equi join.
    """
    here = F.col("date")
    if target == "next":
        lo = F.coalesce(F.date_add("prev", 1), here)
        span = F.sequence(lo, here)
    else:
        span = F.sequence(here, F.coalesce(F.date_sub("next", 1), here))
    return _neighbours(days).select(F.explode(span).alias("day"), "date_idx", F.col("date").alias("trade_date"))
