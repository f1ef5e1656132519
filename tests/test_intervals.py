"""Interval-coded reports against the cell-by-cell operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantgrid.factors.events import event_panel
from quantgrid.operators import intervals as I
from quantgrid.operators import pit as P

T = 60


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    reports = [(f"t{n}", int(d), None if rng.random() < 0.3 else float(d), None if rng.random() < 0.5 else float(d * 10))
               for n in range(12) for d in np.sort(rng.choice(T, rng.integers(0, 9), replace=False))]
    cells = [(f"t{n}", d, None if rng.random() < 0.35 else 1.0) for n in range(12) for d in range(T)]
    return (spark.createDataFrame(reports, "tick string, date_idx int, x double, z double"),
            spark.createDataFrame(cells, "tick string, date_idx int, close double"))


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_stored_rows_are_one_per_report(data):
    reports, cells = data
    spans = I.report_intervals(reports, ["x", "z"])
    assert spans.count() == reports.count() < cells.count() / 10
    assert I.traded_intervals(reports, cells.where("close is not null").select("tick", "date_idx"), ["x", "z"]).count() <= reports.count()


@pytest.mark.parametrize("together", [False, True])
def test_carried_forward_reports(data, together):
    reports, cells = data
    spans = I.report_intervals(reports, ["x", "z"], together=together)
    want = P.asof_last(cells, reports, ["x", "z"], "date_idx", together=together).select("tick", "date_idx", "x", "z")
    assert rows_of(I.at_cells(cells, spans, ["x", "z"]).select("tick", "date_idx", "x", "z")) == rows_of(want)
    held = I.expand(spans, ["x", "z"], 0, T - 1)
    assert rows_of(cells.select("tick", "date_idx").join(held, ["tick", "date_idx"], "left")) == rows_of(want)


@pytest.mark.parametrize("first, last", [(0, T - 1), (17, 40), (59, 59), (3, 3)])
def test_event_panel_of_a_range_of_dates(data, first, last):
    reports, cells = data
    want = event_panel(cells, reports.withColumnRenamed("date_idx", "effective_idx"), ["x", "z"], ffill=True)
    want = want.where(F.col("date_idx").between(first, last)).select("tick", "date_idx", "x", "z")
    traded = cells.where("close is not null").select("tick", "date_idx")
    held = I.expand(I.traded_intervals(reports, traded, ["x", "z"]), ["x", "z"], first, last)
    grid = cells.where(F.col("date_idx").between(first, last)).select("tick", "date_idx")
    assert rows_of(grid.join(held, ["tick", "date_idx"], "left")) == rows_of(want)
    assert held.count() <= grid.count()


def test_empty_and_single_reports(spark, data):
    _, cells = data
    none = spark.createDataFrame([], "tick string, date_idx int, x double")
    assert I.expand(I.report_intervals(none, ["x"]), ["x"], 0, 9).count() == 0
    one = spark.createDataFrame([("a", 5, 1.0)], "tick string, date_idx int, x double")
    assert [tuple(r) for r in I.expand(I.report_intervals(one, ["x"]), ["x"], 3, 7).orderBy("date_idx").collect()] == [("a", 5, 1.0), ("a", 6, 1.0), ("a", 7, 1.0)]
