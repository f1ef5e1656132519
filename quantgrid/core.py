"""Shared rules: key names, window specs, size-checked broadcasts, lineage cuts.

A panel is a long DataFrame keyed by (tick, date_idx).  Two facts decide every
plan here:

* rows per tick are bounded by the trading calendar, so windows partitioned by
  tick are always small;
* rows per date grow with the number of ticks, so nothing is ever windowed or
  collected per date.  Per-date work aggregates with map-side combine and joins
  the (calendar-sized) result back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 * 1024 * 1024
"""Ceilings for a hinted broadcast; a larger side is joined by shuffle."""

ColumnOrName = Column | str


def as_col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of named values that are computed once, however often it mentions them."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), lambda v: body(v)), 0)


def tick_window(start: int | None = None, end: int | None = None, by: Sequence[str] = ("tick",),
                order: str = "date_idx") -> WindowSpec:
    """Row frame along the time axis of one tick."""
    w = Window.partitionBy(*by).orderBy(order)
    if start is None and end is None:
        return w
    return w.rowsBetween(Window.unboundedPreceding if start is None else start,
                         Window.unboundedFollowing if end is None else end)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared directory for lineage cuts and stored intermediates.

    ``spark.checkpoint.dir`` where the cluster names one; otherwise a folder of this application under
    ``hadoop.tmp.dir`` on the default file system, which every executor sees and which goes when the session ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        conf = sc._jsc.hadoopConfiguration()
        path = sc._jvm.org.apache.hadoop.fs.Path(conf.get("hadoop.tmp.dir"), f"quantgrid-{sc.applicationId}")
        files = path.getFileSystem(conf)
        if files.getScheme() == "file" and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        files.mkdirs(path)
        files.deleteOnExit(path)
        current = files.makeQualified(path).toString()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared directory, removed when the session ends."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet to the shared directory and return a scan of it, so that later plans prune columns."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> int:
    width = {"boolean": 1, "integer": 4, "date": 4, "string": 40}
    return 16 + sum(width.get(f.dataType.typeName(), 8 if f.dataType.typeName() in
                              ("long", "double", "timestamp", "float") else 512) for f in df.schema)


def settle(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` to the reliable checkpoint folder and return it with its row count."""
    checkpoint_dir(df.sparkSession)
    seen = Observation()
    done = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint()
    return done, int(seen.get["n"])


def stage(df: DataFrame) -> DataFrame:
    """Store a derived panel once, as columns, before an operator that scans it several times."""
    return store(df)


def small_side(df: DataFrame) -> DataFrame:
    """Settle an aggregate and hint a broadcast only when its measured size allows it."""
    done, n = settle(df)
    fits = n <= BROADCAST_ROWS and n * _row_bytes(done) <= BROADCAST_BYTES
    return F.broadcast(done) if fits else done


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join group statistics back to the rows they describe.

    The statistics are settled first, so a chain of operators stays a chain of
    small joins on one scan instead of nesting every earlier step in each later one.
    """
    return df.join(small_side(stats), list(keys), how)
