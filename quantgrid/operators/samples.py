"""Model samples: lag windows, branches, universe rules and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, attach, tick_window
from quantgrid.functions.scalar import zero_fill
from quantgrid.operators.filters import all_null, select_universe
from quantgrid.operators.pit import pit_last_k
from quantgrid.operators.rolling import window_array

HASH_RANGE = 2 ** 32


def lag_windows(panel: DataFrame, fields: Sequence[str], lag: int, keep: Sequence[str] = ()) -> DataFrame:
    """(date_idx, tick, keep, seq): the last ``lag`` rows as array of structs, oldest first; short history is dropped."""
    seq = window_array(*fields, window=lag)
    return panel.select("date_idx", "tick", *keep, seq.alias("seq")).where(F.col("seq").isNotNull())


def chunk_span(lag: int) -> int:
    """Rows of a chunk: four windows, so that the overlap of lag - 1 rows adds less than a quarter."""
    return 4 * max(1, lag)


def chunk_series(panel: DataFrame, fields: Sequence[str], lag: int, keep: Sequence[str] = ()) -> DataFrame:
    """(tick, chunk, series): a tick's rows cut into chunks that begin with the last lag - 1 rows of the one before.

    This is what samples are stored as: every window of ``lag`` rows lies in one chunk, and a row is kept at most twice
    instead of ``lag`` times.  Entries hold date_idx, keep and fields in time order.  One exchange on tick.
    """
    span = chunk_span(lag)
    row = F.row_number().over(tick_window()) - 1
    rows = panel.select("tick", "date_idx", *keep, *fields).withColumn("_row", row)
    own = F.floor(F.col("_row") / span)
    last = F.floor((F.count(F.lit(1)).over(Window.partitionBy("tick")) - 1) / span)  # a tick has at most one row a date
    shared = (F.pmod("_row", F.lit(span)) > span - lag) & (own < F.col("_last"))
    placed = rows.withColumn("_last", last).withColumn("chunk", F.explode(F.when(
        shared, F.array(own, own + 1)).otherwise(F.array(own))))
    entry = F.struct("_row", "date_idx", *keep, *fields)
    return placed.groupBy("tick", "chunk").agg(F.sort_array(F.collect_list(entry)).alias("series"))


def cut_windows(chunks: DataFrame, fields: Sequence[str], lag: int, keep: Sequence[str] = (), where=None) -> DataFrame:
    """(date_idx, tick, keep, seq) of every full window of stored chunks.

    ``where`` is a condition on the entry that ends a window; windows that fail it are not cut.
    """
    ends = F.when(F.size("series") >= lag, F.sequence(F.lit(lag - 1), F.size("series") - 1)).otherwise(F.array().cast("array<int>"))
    if where is not None:
        ends = F.filter(ends, lambda p: where(F.get("series", p)))
    window = F.transform(ends, lambda p: F.struct(
        F.get("series", p)["date_idx"].alias("date_idx"), F.col("tick"), *[F.get("series", p)[c].alias(c) for c in keep],
        only(F.slice("series", p - lag + 2, F.lit(lag)), fields).alias("seq")))
    return chunks.select(F.inline(window))


def hash_unit(*parts: ColumnOrName) -> Column:
    """Uniform number in [0, 1) from the text of its arguments; the same on every engine and run."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(HASH_RANGE)


def minute_sequences(bars: DataFrame, fields: Sequence[str], trim: tuple[int, int] = (1, 3)) -> DataFrame:
    """(tick, date, minutes, minute_of_day): the day's bars in time order, trimmed; at most one entry per bar time."""
    rows = bars.groupBy("tick", "date").agg(
        F.sort_array(F.collect_list(F.struct("minute_idx", *fields))).alias("_b"))
    cut = F.slice("_b", trim[0] + 1, F.greatest(F.size("_b") - sum(trim), F.lit(0)))
    return rows.select("tick", "date", only(cut, fields).alias("minutes"), F.transform(cut, lambda b: b["minute_idx"]).alias("minute_of_day"))


def zero_filled(seq: ColumnOrName, fields: Sequence[str]) -> Column:
    return F.transform(as_col(seq), lambda s: F.struct(*[zero_fill(s[f]).alias(f) for f in fields]))


def only(seq: ColumnOrName, fields: Sequence[str]) -> Column:
    return F.transform(as_col(seq), lambda s: F.struct(*[s[f].alias(f) for f in fields]))


def dead(branches: dict[str, Sequence[str]]) -> Column:
    """True if at some step every feature of every branch is NULL.

    A branch shorter than the longest one counts as zeros beyond its end, so a
    step is dead only while all branches still have rows.
    """
    items = list(branches.items())
    if len(items) == 1:
        name, fields = items[0]
        return F.exists(name, all_null(fields))
    lengths = [F.coalesce(F.size(b), F.lit(0)) for b, _ in items]
    limit = lengths[0]
    for n in lengths[1:]:
        limit = F.least(limit, n)

    def silent(i: Column) -> Column:
        out = F.lit(True)
        for b, fields in items:
            out = out & all_null(fields)(F.get(b, i))
        return out

    return F.when(limit > 0, F.exists(F.sequence(F.lit(0), limit - 1), silent)).otherwise(False)


STAMPS = ("_month", "_day", "_weekday")


def stamped(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"_month": F.month("date"), "_day": F.dayofmonth("date"), "_weekday": F.weekday("date")})


def sample_chunks(panel: DataFrame, fields: Sequence[str], lag: int, label: str, pool: str | None = None) -> DataFrame:
    """Chunks to store for :func:`assemble_samples`."""
    return chunk_series(stamped(panel), [*fields, *STAMPS], lag, [c for c in ("date", label, "tradable", pool) if c])


def assemble_samples(panel: DataFrame, fields: Sequence[str], lag: int, label: str, mode: str = "universe",
                     minutes: tuple[DataFrame, Sequence[str]] | None = None,
                     events: tuple[DataFrame, Sequence[str], int] | None = None,
                     time_code: bool = False, null_filter_branches: Sequence[str] | None = None,
                     flatten: bool = False, fill: bool = True, chunks: DataFrame | None = None, **universe) -> DataFrame:
    """One row per (date_idx, tick): ``daily`` lag array, optional minute, time-code and event branches, label.

    ``minute_idx`` of the bars counts minutes after midnight; with ``time_code`` the minute branch gets
    ``minute_time_code`` (month, day, weekday, hour, minute) beside the daily ``time_code``.  A day without bars has
    an empty minute branch.

    ``panel`` is dense and carries date, tradable and the label.  Rows follow
    :func:`select_universe`; then samples with a dead step in the named branches
    drop out (all sequence branches by default, the daily one only when
    ``flatten``), and NULLs become 0 when ``fill``.  The daily window and the
    event window share the partitioning on tick.

    With ``chunks``, a stored :func:`sample_chunks` of the same panel, windows are cut from it and ``panel`` may be None.
    """
    pick = [c for c in ("date", label, "tradable", universe.get("pool")) if c]
    if chunks is None:
        df = lag_windows(stamped(panel), [*fields, *STAMPS], lag, keep=pick)
    else:
        valid = None if mode == "fix" else lambda e: e["tradable"] & e[label].isNotNull()
        df = cut_windows(chunks, [*fields, *STAMPS], lag, pick, valid)
    df = select_universe(df, mode, label, **universe)
    checked: dict[str, Sequence[str]] = {"daily": list(fields)}
    if minutes is not None:
        bars, minute_fields = minutes
        day = minute_sequences(bars, minute_fields)
        df = df.join(day, ["tick", "date"], "left").withColumns({c: F.coalesce(c, F.array().cast(day.schema[c].dataType))
                                                                for c in ("minutes", "minute_of_day")})
        checked["minutes"] = list(minute_fields)
    if events is not None:
        store, event_fields, k = events
        df = pit_last_k(df, store, event_fields, k)
    if time_code:
        df = df.withColumn("time_code", F.transform("seq", lambda s: F.struct(
            s["_month"].alias("month"), s["_day"].alias("day"), s["_weekday"].alias("weekday"))))
    if time_code and minutes is not None:
        df = df.withColumn("minute_time_code", F.transform("minute_of_day", lambda m: F.struct(
            F.month("date").alias("month"), F.dayofmonth("date").alias("day"), F.weekday("date").alias("weekday"),
            F.floor(m / 60).cast("int").alias("hour"), F.pmod(m, F.lit(60)).cast("int").alias("minute"))))
    df = df.withColumnRenamed("seq", "daily")
    names = ["daily"] if flatten else list(null_filter_branches or checked)
    df = df.where(~F.coalesce(dead({b: checked[b] for b in names}), F.lit(False)))
    for b, f in checked.items():
        df = df.withColumn(b, zero_filled(b, f) if fill else only(b, f))
    branches = list(checked) + [c for c in ("time_code", "minute_time_code", "events", "event_mask", "event_age") if c in df.columns]
    return df.select("date_idx", "date", "tick", *branches, F.col(label).alias("label"))


def collate(samples: DataFrame, batch_rows: int = 4096, fields: Sequence[str] = ("daily", "label")) -> DataFrame:
    """(date_idx, batch, tick list, one list per field): export batches of about ``batch_rows`` samples of one date.

    A date is hashed into as many batches as its size needs, so no batch grows with the universe.
    """
    sizes = samples.groupBy("date_idx").agg(F.ceil(F.count(F.lit(1)) / batch_rows).cast("int").alias("_nb"))
    j = attach(samples, sizes, ["date_idx"]).withColumn("batch", F.floor(hash_unit("tick") * F.col("_nb")).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("tick", *fields)))
    g = j.groupBy("date_idx", "batch").agg(rows.alias("_r"))
    return g.select("date_idx", "batch", F.col("_r.tick").alias("ticks"), *[F.col(f"_r.{f}").alias(f) for f in fields])
