"""Reading and writing panels: JDBC, parquet by year, one file per date, wide CSV, long alpha files."""

from __future__ import annotations

import io
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, attach, small_side, stage
from quantgrid.functions.scalar import code_suffix, null_if_not_finite
from quantgrid.sources.axis import tick_axis

CHUNK_TICKS = 256
"""Cells of a wide line that are laid out together."""


def scan_sql(spark: SparkSession, url: str, sql: str, partition_column: str | None = None,
             lower: str | None = None, upper: str | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """Run a query in a relational database; filters and columns push down into it."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", sql).load()
    return (reader.option("dbtable", f"({sql}) q").option("partitionColumn", partition_column)
            .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load())


def scan_sql_files(spark: SparkSession, sql: str, **paths: str) -> DataFrame:
    """The same query over parquet extracts instead of a database; ``{name}`` in the text names a table."""
    return spark.sql(sql, **{name: spark.read.parquet(path) for name, path in paths.items()})


def ingest_clean(df: DataFrame) -> DataFrame:
    """NaN and infinities of every double column become NULL, once."""
    return df.withColumns({f.name: null_if_not_finite(f.name) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def write_panel(panel: DataFrame, path: str, date: str = "date", mode: str = "overwrite") -> None:
    """One table with all fields, partitioned by year."""
    panel.withColumn("year", F.year(date)).write.mode(mode).partitionBy("year").parquet(path)


def write_panel_by_tick(panel: DataFrame, path: str, table: str, buckets: int, date: str = "date", order: str = "date_idx",
                        mode: str = "overwrite") -> None:
    """The panel as a bucketed table: year folders, a tick's rows of a year in one file, sorted by time.

    A scan of the table reports its distribution, so windows, densifying and joins on tick need no exchange; year
    folders are pruned as usual.  ``buckets`` bounds the tasks of such a scan: take about the panel's size over 256 MB.
    The layout is written beside the data for :func:`open_panel`.
    """
    yearly = panel.withColumn("year", F.year(date))
    (yearly.repartition(buckets, "tick").write.mode(mode).partitionBy("year").bucketBy(buckets, "tick").sortBy("tick", order)
     .option("path", path).saveAsTable(table))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in yearly.schema)
    layout = yearly.sparkSession.createDataFrame([(columns, buckets, order)], "columns string, buckets int, order string")
    layout.coalesce(1).write.mode("overwrite").json(f"{path}-layout")


def open_panel(spark: SparkSession, path: str, table: str) -> None:
    """Register a panel of :func:`write_panel_by_tick` in a session that did not write it."""
    layout = spark.read.json(f"{path}-layout").first()
    spark.sql(f"create table {table} ({layout['columns']}) using parquet partitioned by (year) "
              f"clustered by (tick) sorted by (tick, {layout['order']}) into {layout['buckets']} buckets location '{path}'")
    spark.sql(f"alter table {table} recover partitions")


def scan_panel(spark: SparkSession, path: str | None, fields: Sequence[str], start=None, end=None, table: str | None = None) -> DataFrame:
    """Chosen fields of a stored panel, by path or by table; a date range prunes the year folders as well."""
    df = spark.read.parquet(path) if table is None else spark.table(table)
    if start is not None:
        df = df.where((F.col("year") >= F.year(F.lit(start).cast("date"))) & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        df = df.where((F.col("year") <= F.year(F.lit(end).cast("date"))) & (F.col("date") <= F.lit(end).cast("date")))
    return df.select("date_idx", "date", "tick", *fields)


def scan_facts_by_tick(spark: SparkSession, table: str, fields: Sequence[str]) -> DataFrame:
    """(tick, date, fields) of a bucketed table, for :func:`quantgrid.sources.axis.densify` without an exchange."""
    return spark.table(table).select("tick", "date", *fields)


def write_daily_files(df: DataFrame, path: str, date: str = "date") -> None:
    """A folder per date; adaptive rebalancing gives a small date one file and splits a large one over tasks."""
    df.hint("rebalance", F.col(date)).write.mode("overwrite").partitionBy(date).parquet(path)


def footer_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of every parquet file under a path, from its footer; a file without a readable footer has none."""
    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["file"], pdf["content"]):
                try:
                    rows.append((name, pq.ParquetFile(io.BytesIO(content)).metadata.num_rows))
                except (pa.ArrowException, OSError):
                    continue
            yield pd.DataFrame(rows, columns=["file", "rows"])

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .option("ignoreMissingFiles", "true").load(path))
    return files.select(F.col("_metadata.file_path").alias("file"), "content").mapInPandas(run, "file string, rows long")


def scan_daily_files(spark: SparkSession, path: str, axis: DataFrame, schema: str, date: str = "date") -> DataFrame:
    """Rows of the per-date files for every axis date; a day with a missing or corrupt file is a day of NULLs.

    Of a file that is damaged behind its first rows the reader returns what came before, so the rows that were read are
    written and counted, and a day counts only if each of its files gave as many rows as its footer names.
    """
    files = (spark.read.schema(f"{schema}, {date} date").option("ignoreCorruptFiles", "true")
             .option("ignoreMissingFiles", "true").parquet(path))
    read = stage(files.withColumn("_file", F.col("_metadata.file_path")))
    got = read.groupBy("_file", date).agg(F.count(F.lit(1)).alias("_read"))
    whole = footer_rows(spark, path).withColumnRenamed("file", "_file")
    # the folder names the day, also of files that gave no row
    day = F.regexp_extract("_file", f"{date}=([^/]+)/", 1).cast("date")
    short = (whole.join(got.drop(date), "_file", "left").where(F.coalesce("_read", F.lit(0)) < F.col("rows"))
             .select(day.alias(date)).distinct())
    kept = read.drop("_file").join(small_side(short), date, "left_anti")
    return axis.select("date_idx", date).join(kept, date, "left")


def _wide_line(chunks: Column, count: int) -> Column:
    """One line from a map chunk -> cells; a chunk without a cell is empty."""
    blank = F.lit("," * (CHUNK_TICKS - 1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda c: F.coalesce(F.try_element_at(chunks, c), blank)), ",")


def export_wide_csv(df: DataFrame, path: str, value: str, date: str = "date", tick: str = "tick") -> None:
    """date x tick CSV: ``header`` holds the header line, ``lines`` one line per date, in date order over the files.

    Columns follow the tick axis.  A line is laid out in chunks of ``CHUNK_TICKS`` cells, each a group of its own, and
    joined per date, so there is no column per tick in any plan.  Empty cells are NULL; tick codes hold no comma.
    """
    axis = stage(tick_axis(df, tick).withColumnRenamed("tick", tick))
    count = -(-(axis.agg(F.coalesce(F.max("tick_idx") + 1, F.lit(1))).first()[0]) // CHUNK_TICKS)
    code = F.when(F.col(tick).cast("string").rlike('[,"\\r\\n]'), F.raise_error(F.lit("a tick code holds a comma, quote or line break"))
                  .cast("string")).otherwise(F.col(tick).cast("string"))
    place = [F.floor(F.col("tick_idx") / CHUNK_TICKS).cast("int").alias("_c"), F.pmod("tick_idx", F.lit(CHUNK_TICKS)).alias("_i")]

    def lines(cells: DataFrame, by: list[str]) -> DataFrame:
        at = F.map_from_entries(F.collect_list(F.struct("_i", "_v")))
        part = cells.groupBy(*by, "_c").agg(at.alias("_m")).select(*by, "_c", F.array_join(F.transform(
            F.sequence(F.lit(0), F.lit(CHUNK_TICKS - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(""))), ",").alias("_t"))
        return part.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_t"))).alias("_of")).select(*by, _wide_line(F.col("_of"), count).alias("_line"))

    header = lines(axis.select(*place, code.alias("_v")), [])
    header.select(F.concat(F.lit(date + ","), "_line").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/header")
    cells = attach(df.select(date, tick, F.col(value).cast("double").cast("string").alias("_v")), axis, [tick], "inner")
    body = lines(cells.where(F.col("_v").isNotNull()).select(date, *place, "_v"), [date])
    body = df.select(date).distinct().join(body, date, "left")
    empty = F.lit("," * (count * CHUNK_TICKS - 1))
    (body.orderBy(date).select(F.concat(F.col(date).cast("string"), F.lit(","), F.coalesce("_line", empty)).alias("value"))
     .write.mode("overwrite").text(f"{path}/lines"))


def read_wide_csv(spark: SparkSession, path: str, value: str, date: str = "date") -> DataFrame:
    """Long (date, tick, value) from :func:`export_wide_csv`; empty cells are NULL."""
    cells = lambda df: df.select(F.split("value", ",", -1).alias("_cells"))
    names = cells(spark.read.text(f"{path}/header")).select(F.posexplode("_cells").alias("_at", "tick")).where("_at > 0 and tick <> ''")
    long = (cells(spark.read.text(f"{path}/lines")).select(F.col("_cells")[0].alias(date), F.posexplode("_cells").alias("_at", "_v"))
            .where("_at > 0"))
    return attach(long, names, ["_at"], "inner").select(
        F.col(date).cast("date").alias(date), "tick", F.nullif("_v", F.lit("")).cast("double").alias(value))


def long_alpha(df: DataFrame, value: str, code: ColumnOrName = "tick", date: str = "date") -> DataFrame:
    """(trade_dt, stcode, Predict): non-NULL predictions with the exchange suffix on the code."""
    return (df.where(null_if_not_finite(value).isNotNull())
            .select(F.col(date).alias("trade_dt"), code_suffix(as_col(code)).alias("stcode"), F.col(value).alias("Predict")))


def export_long_alpha(df: DataFrame, path: str, value: str, code: ColumnOrName = "tick", date: str = "date") -> None:
    """One folder per date, its rows brought together before the write (large dates stay split)."""
    long_alpha(df, value, code, date).hint("rebalance", F.col("trade_dt")).write.mode("overwrite").partitionBy("trade_dt").parquet(path)


def event_metadata(events: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """One row of counts and dimensions of an event store."""
    return events.agg(
        F.count(F.lit(1)).alias("num_events"), F.lit(len(features)).cast("bigint").alias("event_dim"),
        F.count_distinct("tick").alias("num_ticks"), F.min("effective_idx").cast("bigint").alias("min_idx"),
        F.max("effective_idx").cast("bigint").alias("max_idx"), F.lit(k).cast("bigint").alias("max_events"))


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)
