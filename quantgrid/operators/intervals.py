"""Reports as intervals of dates: one stored row per report, expanded only where a date is asked for.

A report holds from its date up to the tick's next one.  Every column is carried forward on its own before, so a row says
all that is known from then on; a panel of 62 features then costs one row per report instead of one per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import tick_window
from quantgrid.operators.pit import asof_last


def report_intervals(reports: DataFrame, cols: Sequence[str], at: str = "date_idx", together: bool = False) -> DataFrame:
    """(tick, from, to, cols): what holds from each report up to the day before ``to`` (NULL: still holds).

    ``reports`` has one row per (tick, at).  Columns are carried forward on their own, or as one record when ``together``.
    """
    history, order = tick_window(None, 0, order=at), tick_window(order=at)
    values = [F.col(c) if together else F.last(c, ignorenulls=True).over(history).alias(c) for c in cols]
    return reports.select("tick", F.col(at).alias("from"), F.lead(at).over(order).alias("to"), *values)


def traded_intervals(reports: DataFrame, traded: DataFrame, cols: Sequence[str], at: str = "date_idx") -> DataFrame:
    """As :func:`report_intervals`, where a report counts from the tick's first traded date on or after it.

    ``traded`` is (tick, at).  Of several reports before a traded date the last one counts, with the others' columns
    carried forward; a report that no traded date follows never counts.  This is the carried-forward event panel.
    """
    known = report_intervals(reports, cols, at).select("tick", F.col("from").alias(at), *cols)
    days = traded.select("tick", F.col(at), F.col(at).alias("_day"), F.lit(1).alias("_kind"))
    both = days.unionByName(known.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    back = tick_window(None, 0, order="_back")
    ahead = both.withColumn("_back", F.struct((-F.datediff(at, F.lit("1970-01-01"))) if dict(reports.dtypes)[at] == "date" else -F.col(at), -F.col("_kind")))
    moved = ahead.withColumn("_from", F.last("_day", ignorenulls=True).over(back)).where((F.col("_kind") == 0) & F.col("_from").isNotNull())
    last = moved.groupBy("tick", "_from").agg(*[F.max_by(c, at).alias(c) for c in cols])
    return last.select("tick", F.col("_from").alias("from"), F.lead("_from").over(tick_window(order="_from")).alias("to"), *cols)


def expand(intervals: DataFrame, cols: Sequence[str], first: int, last: int) -> DataFrame:
    """(tick, date_idx, cols) of the cells from date ``first`` to ``last``; intervals outside are not expanded."""
    start = F.greatest(F.col("from"), F.lit(first))
    end = F.least(F.coalesce(F.col("to") - 1, F.lit(last)), F.lit(last))
    met = intervals.where((F.col("from") <= last) & (F.col("to").isNull() | (F.col("to") > first)))
    return met.select("tick", F.explode(F.sequence(start, end)).alias("date_idx"), *cols)


def at_cells(cells: DataFrame, intervals: DataFrame, cols: Sequence[str], at: str = "date_idx") -> DataFrame:
    """cells + the columns that hold there: one window over the asked cells and the intervals' starts."""
    starts = intervals.select("tick", F.col("from").alias(at), *cols)
    return asof_last(cells, starts, cols, at, together=True)
