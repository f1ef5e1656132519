"""Panels stored by tick, daily files with damage, and samples stored as overlapping chunks."""

import datetime as dt
import glob
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantgrid.operators import rolling as R
from quantgrid.operators import samples as SM
from quantgrid.operators import scans as S
from quantgrid.sources import axis
from quantgrid.sources import panel_io as IO


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    days = [dt.date(2019, 11, 1) + dt.timedelta(days=i) for i in range(120)]
    rng = np.random.default_rng(1)
    rows = [(i, d, f"t{n:02d}", float(rng.normal()), float(rng.normal())) for i, d in enumerate(days) for n in range(30)]
    panel = spark.createDataFrame(rows, "date_idx int, date date, tick string, x double, y double")
    path = str(tmp_path_factory.mktemp("panel") / "p")
    IO.write_panel_by_tick(panel, path, "panel_by_tick", 4)
    return panel, path


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_windows_on_a_stored_panel_have_no_exchange(spark, stored):
    panel, _ = stored
    scan = IO.scan_panel(spark, None, ["x", "y"], table="panel_by_tick")
    for build in (lambda df: df.withColumn("m", R.rolling_mean("x", 5)),
                  lambda df: S.with_windows(df, short=0, m=S.mean("x", 20), c=S.corr("x", "y", 20))):
        got = build(scan)
        assert "Exchange" not in plan(got) and "Exchange" in plan(build(panel))
        assert rows_of(got.select("tick", "date_idx", F.round("m", 9))) == rows_of(build(panel).select("tick", "date_idx", F.round("m", 9)))


def test_densify_from_a_stored_table_has_no_exchange_on_tick(spark, stored):
    panel, _ = stored
    days = axis.calendar(panel)
    grid = axis.densify(IO.scan_facts_by_tick(spark, "panel_by_tick", ["x"]).where("x > -0.5"), ["x"], days=days)
    got = grid.withColumn("m", R.rolling_mean("x", 5))
    assert "hashpartitioning(tick" not in plan(got) and "Window" in plan(got)
    want = axis.densify(panel.where("x > -0.5").select("tick", "date", "x"), ["x"], days=days).withColumn("m", R.rolling_mean("x", 5))
    assert rows_of(got) == rows_of(want)


def test_date_range_prunes_year_folders(spark, stored):
    panel, _ = stored
    got = IO.scan_panel(spark, None, ["x"], start="2020-01-10", table="panel_by_tick")
    assert "PartitionFilters: [isnotnull(year" in plan(got) and "2020" in plan(got).split("PartitionFilters")[1][:80]
    assert rows_of(got) == rows_of(panel.where("date >= date '2020-01-10'").select("date_idx", "date", "tick", "x"))


def test_layout_is_read_by_another_session(spark, stored):
    panel, path = stored
    other = spark.newSession()
    IO.open_panel(other, path, "opened_again")
    scan = IO.scan_panel(other, None, ["x"], table="opened_again")
    got = scan.withColumn("m", R.rolling_mean("x", 3))
    assert "Exchange" not in plan(got) and got.count() == panel.count()


def damaged(path, keep):
    """Spoil the pages of all row groups but the first ``keep``; the footer stays."""
    meta = pq.ParquetFile(path).metadata
    with open(path, "r+b") as f:
        for g in range(keep, meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                at = col.dictionary_page_offset or col.data_page_offset
                f.seek(at)
                f.write(b"\xff" * min(col.total_compressed_size, 64))
    crc = os.path.join(os.path.dirname(path), "." + os.path.basename(path) + ".crc")
    assert not os.path.exists(crc)


@pytest.mark.parametrize("keep", [0, 1])
def test_half_damaged_file_is_a_day_of_nulls(spark, tmp_path, keep):
    days = [dt.date(2020, 1, i) for i in range(1, 6)]
    for i, d in enumerate(days[:4]):
        folder = tmp_path / f"date={d}"
        folder.mkdir()
        table = pa.table({"tick": pa.array(range(4000), pa.int64()), "close": pa.array(np.random.default_rng(i).normal(size=4000))})
        pq.write_table(table, folder / "a.parquet", row_group_size=2000, use_dictionary=False)
        if i == 2:
            pq.write_table(table, folder / "b.parquet", row_group_size=1000, use_dictionary=False)
            damaged(str(folder / "b.parquet"), keep)
    (tmp_path / f"date={days[1]}" / "a.parquet").write_bytes(b"no parquet at all")
    grid = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "date_idx int, date date")
    got = IO.scan_daily_files(spark, str(tmp_path), grid, "tick long, close double")
    n = {r.date_idx: (r.n, r.known) for r in got.groupBy("date_idx").agg(F.count(F.lit(1)).alias("n"), F.count("tick").alias("known")).collect()}
    assert n == {0: (4000, 4000), 1: (1, 0), 2: (1, 0), 3: (4000, 4000), 4: (1, 0)}


@pytest.mark.parametrize("lag, dates", [(1, 5), (4, 3), (4, 16), (4, 17), (7, 100), (60, 300)])
def test_windows_cut_from_chunks_equal_sliding_ones(spark, lag, dates):
    rng = np.random.default_rng(lag)
    rows = [(i, f"t{n}", None if rng.random() < 0.1 else float(rng.normal()), float(i * n)) for n in range(5) for i in range(dates - n % 3)]
    panel = spark.createDataFrame(rows, "date_idx int, tick string, x double, y double")
    chunks = SM.chunk_series(panel, ["x"], lag, keep=["y"])
    fields = ["x"]
    got = SM.cut_windows(chunks, fields, lag, keep=["y"])
    want = SM.lag_windows(panel, fields, lag, keep=["y"])
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    some = SM.cut_windows(chunks, fields, lag, keep=["y"], where=lambda e: e["y"] > 20)
    assert rows_of(some) == rows_of(want.where("y > 20"))
    entries = chunks.agg(F.sum(F.size("series"))).first()[0]
    assert entries <= 1.25 * len(rows)


def test_stored_chunks_are_little_larger_than_the_panel(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, f"t{n}", *rng.normal(size=6).tolist()) for n in range(8) for i in range(1200)]
    names = [f"x{k}" for k in range(6)]
    panel = spark.createDataFrame(rows, "date_idx int, tick string, " + ", ".join(f"{c} double" for c in names))
    panel.repartition(2, "tick").write.parquet(str(tmp_path / "panel"))
    chunks = SM.chunk_series(panel, names, 60)
    assert plan(chunks).count("Exchange") == 1
    chunks.write.parquet(str(tmp_path / "chunks"))
    size = {k: sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / k / "*.parquet"))) for k in ("panel", "chunks")}
    assert size["chunks"] < 1.3 * size["panel"]
