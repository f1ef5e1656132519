"""Point-in-time joins: nothing on a date may use what was published after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import small_side, stage, tick_window
from quantgrid.functions.scalar import zero_fill
from quantgrid.sources.axis import day_map


def dedupe_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key under an explicit order.

    The rank filter is pushed below the exchange as a per-task group limit, so a
    key with very many copies never travels whole.
    """
    sort = [F.col(o).desc() if keep == "last" else F.col(o).asc() for o in order]
    w = Window.partitionBy(*keys).orderBy(*sort)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def report_dedupe(reports: DataFrame, tick: str = "tick", publish: str = "date", report: str = "report_date",
                  order: Sequence[str] = ()) -> DataFrame:
    """Last report of each (tick, publish date), then the first publication of each (tick, report date)."""
    last = dedupe_keep(reports, [tick, publish], [report, *order], "last")
    return dedupe_keep(last, [tick, report], [publish, *order], "first")


def asof_forward_calendar(df: DataFrame, days: DataFrame, date: str = "date") -> DataFrame:
    """df + (date_idx, trade_date): first trading date on or after ``date``; later dates drop out."""
    days = stage(days)
    lookup = small_side(day_map(days, "next").withColumnRenamed("day", date))
    first = F.get(days.scalar(), F.lit(0))
    early = F.col(date) < first
    j = df.join(lookup, date, "left")
    return (j.withColumn("trade_date", F.coalesce("trade_date", F.when(early, first)))
             .withColumn("date_idx", F.coalesce("date_idx", F.when(early, 0)))
             .where(F.col("trade_date").isNotNull()))


def asof_last(grid: DataFrame, events: DataFrame, cols: Sequence[str], date: str = "date",
              tick: str = "tick", together: bool = False) -> DataFrame:
    """grid + the latest values of ``cols`` at or before each row's date.

    Events are unique per (tick, date) (see :func:`dedupe_keep`), which bounds a tick by the calendar; a repeated one raises.
    One union and one window over tick instead of a range join.  Columns fill
    separately, or as one record when ``together`` (then a NULL field stays NULL).
    """
    keep = [c for c in grid.columns if c not in (tick, date)]
    left = grid.select(tick, date, F.struct(*keep).alias("_g"), F.lit(1).alias("_kind"))
    right = events.select(tick, date, *cols, F.lit(0).alias("_kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(tick).orderBy(date, "_kind")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    again = (F.col("_kind") == 0) & (F.lag("_kind").over(order) == 0) & (F.lag(date).over(order) == F.col(date))
    twice = F.raise_error(F.concat(F.lit("two events for "), F.col(tick).cast("string"), F.lit(" on one date"))).cast("int")
    checked = F.when(again, twice).otherwise(F.col("_kind")).alias("_kind")
    if together:
        rec = F.last(F.when(F.col("_kind") == 0, F.struct(*cols)), ignorenulls=True).over(w)
        filled = both.select(tick, date, "_g", checked, rec.alias("_r")).where(F.col("_kind") == 1)
        return filled.select(tick, date, "_g.*", *[F.col("_r")[c].alias(c) for c in cols])
    filled = both.select(tick, date, "_g", checked, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])
    return filled.where(F.col("_kind") == 1).select(tick, date, "_g.*", *cols)


def asof_backward_valid(grid: DataFrame, history: DataFrame, code: str = "code") -> DataFrame:
    """grid + the class whose latest start is at or before the date, NULL once that class has ended.

    ``history`` is (tick, code, start_date, end_date); an expired latest class is
    not replaced by an older one.
    """
    starts = history.select("tick", F.col("start_date").alias("date"), code, F.col("end_date").alias("_end"))
    j = asof_last(grid, starts, [code, "_end"], together=True)
    alive = F.col("_end").isNull() | (F.col("date") < F.col("_end"))
    return j.withColumn(code, F.when(alive, F.col(code))).drop("_end")


def pit_ffill_align(grid: DataFrame, reports: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sparse reports on the trading grid, each column carried forward on its own from its publish date."""
    return asof_last(grid, reports, cols)


def index_membership_asof(weights: DataFrame, days: DataFrame) -> DataFrame:
    """(index, date, tick, weight): constituents of the latest snapshot at or before each date.

    A name missing from the newest snapshot is out.  Which snapshot serves which
    date is settled on (index, date), then constituents come by equi join.
    """
    days = stage(days)
    snaps = weights.groupBy("index").agg(F.sort_array(F.collect_set("date")).alias("_s"))
    spans = F.transform("_s", lambda d, i: F.struct(d.alias("snap"), F.get("_s", i + 1).alias("until")))
    serve = (snaps.select("index", F.explode(spans).alias("_t"), days.scalar().alias("_d"))
             .select("index", "_t.snap", F.explode(F.filter("_d", lambda d: (d >= F.col("_t.snap")) & (
                 F.col("_t.until").isNull() | (d < F.col("_t.until"))))).alias("date")))
    right = small_side(serve)
    return (weights.withColumnRenamed("date", "snap").join(right, ["index", "snap"])
            .select("index", "date", "tick", "weight"))


def yoy(reports: DataFrame, diff: Sequence[str], ratio: Sequence[str], report: str = "report_date",
        by: Sequence[str] = ("tick",)) -> DataFrame:
    """``<col>_yoy`` against the same tick's report one year earlier (ratio: a zero base gives NULL)."""
    cols = [*diff, *ratio]
    prior = reports.select(*by, F.col(report).alias("_lyr"), *[F.col(c).alias(f"_{c}") for c in cols])
    j = reports.withColumn("_lyr", F.add_months(report, -12)).join(prior, [*by, "_lyr"], "left")
    new = {f"{c}_yoy": F.col(c) - F.col(f"_{c}") for c in diff}
    new |= {f"{c}_yoy": F.try_divide(F.col(c), F.col(f"_{c}")) - 1 for c in ratio}
    return j.withColumns(new).drop("_lyr", *[f"_{c}" for c in cols])


def qoq(reports: DataFrame, diff: Sequence[str], ratio: Sequence[str], order: str = "report_date",
        by: Sequence[str] = ("tick",)) -> DataFrame:
    """``<col>_qoq``: change from the tick's previous report, absolute or relative (zero base -> NULL)."""
    w = Window.partitionBy(*by).orderBy(order)
    new = {f"{c}_qoq": F.col(c) - F.lag(c).over(w) for c in diff}
    new |= {f"{c}_qoq": F.try_divide(F.col(c), F.lag(c).over(w)) - 1 for c in ratio}
    return reports.withColumns(new)


def consensus_window_join(forecasts: DataFrame, reports: DataFrame, made: str = "made_date",
                          report: str = "report_date") -> DataFrame:
    """Forecasts of a report made strictly between the tick's previous publish date and its own.

    A tick's first report has no previous date and takes no forecast.
    """
    w = Window.partitionBy("tick").orderBy("date", report)
    spans = reports.select("tick", report, F.col("date").alias("publish_date"), F.lag("date").over(w).alias("_prev"))
    j = forecasts.join(spans, ["tick", report])
    return j.where((F.col(made) > F.col("_prev")) & (F.col(made) < F.col("publish_date"))).drop("_prev")


def latest_per_author(forecasts: DataFrame, keys: Sequence[str] = ("tick", "report_date", "author"),
                      order: Sequence[str] = ("made_date",)) -> DataFrame:
    """Newest forecast of each author."""
    return dedupe_keep(forecasts, keys, order, "last")


def consensus_median(forecasts: DataFrame, cols: Sequence[str],
                     keys: Sequence[str] = ("tick", "report_date")) -> DataFrame:
    """Exact median of each forecast per report; authors are unique per report (:func:`latest_per_author`)."""
    return forecasts.groupBy(*keys).agg(*[F.median(c).alias(c) for c in cols])


def merge_actual_forecast(events: DataFrame, other: DataFrame, cols: Sequence[str],
                          keys: Sequence[str] = ("tick", "report_date")) -> DataFrame:
    return events.join(other.select(*keys, *cols), list(keys), "left")


def pit_last_k(grid: DataFrame, events: DataFrame, features: Sequence[str], k: int = 8,
               include_today: bool = True, order: str = "event_id") -> DataFrame:
    """grid + the last k events effective by each row, oldest first and right-aligned.

    A k-row window gives every event the list that ends with it; a row then takes
    the list of its latest event.  Both steps are windows over tick, so there is
    no range join, no history per row beyond k events, and no grid join.  At most
    k events per tick and effective date enter (older ones of that date can never
    be seen), which bounds a tick by k times the calendar.

    Adds ``events`` (k structs, zero padded), ``event_mask`` and ``event_age`` (-1 pad).
    """
    same_day = Window.partitionBy("tick", "effective_idx").orderBy(F.desc(order))
    ev = events.select("tick", "effective_idx", order, *[zero_fill(f).alias(f) for f in features])
    ev = ev.withColumn("_rn", F.row_number().over(same_day)).where(F.col("_rn") <= k).drop("_rn")
    upto = Window.partitionBy("tick").orderBy("effective_idx", order).rowsBetween(1 - k, 0)
    item = F.struct(F.col("effective_idx").alias("at"), F.struct(*features).alias("x"))
    lists = ev.select("tick", F.col("effective_idx").alias("date_idx"), F.collect_list(item).over(upto).alias("_l"),
                      F.col(order).alias("_o"), F.lit(0 if include_today else 2).alias("_kind"))
    keep = [c for c in grid.columns if c not in ("tick", "date_idx")]
    rows = grid.select("tick", "date_idx", F.struct(F.lit(1).alias("_"), *keep).alias("_g"), F.lit(1).alias("_kind"))
    both = rows.unionByName(lists, allowMissingColumns=True)
    seen = Window.partitionBy("tick").orderBy("date_idx", "_kind", "_o").rowsBetween(Window.unboundedPreceding, 0)
    j = (both.withColumn("_l", F.last("_l", ignorenulls=True).over(seen)).where(F.col("_kind") == 1)
         .select("tick", "date_idx", *[F.col("_g")[c].alias(c) for c in keep], F.coalesce("_l", F.array().cast(
             lists.schema["_l"].dataType)).alias("_l")))
    empty = F.struct(*[F.lit(0.0).alias(f) for f in features])
    n, pad = F.size("_l"), F.lit(k) - F.size("_l")
    return j.withColumns({
        "events": F.concat(F.array_repeat(empty, pad), F.transform("_l", lambda e: e["x"])),
        "event_mask": F.concat(F.array_repeat(F.lit(0.0), pad), F.array_repeat(F.lit(1.0), n)),
        "event_age": F.concat(F.array_repeat(F.lit(-1), pad), F.transform("_l", lambda e: F.col("date_idx") - e["at"])),
    }).drop("_l")


def panel_gather(rows: DataFrame, panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Look up panel values at each row's (date_idx, tick)."""
    return rows.join(panel.select("date_idx", "tick", *cols), ["date_idx", "tick"], "left")


def double_ffill(panel: DataFrame, cols: Sequence[str], close: str = "close") -> DataFrame:
    """Carry forward, blank where untraded, carry forward again."""
    w = tick_window(None, 0)
    once = panel.withColumns({c: F.when(F.col(close).isNotNull(), F.last(c, ignorenulls=True).over(w)) for c in cols})
    return once.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
