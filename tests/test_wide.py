"""Statistics of many columns in NumPy against the expressions for few columns."""

import datetime as dt

import numpy as np
import pytest

from quantgrid.operators import wide
from quantgrid.operators import xsection as X

COLS = [f"c{i}" for i in range(30)]


@pytest.fixture(scope="module")
def rows(spark):
    """Two months: large, flat and two-row groups, an unknown industry and month, unknown sizes and values, a column without any."""
    rng = np.random.default_rng(17)
    out = []
    for i in range(500):
        x = np.round(rng.normal(size=30) * 1000) / 1024
        x[rng.random(30) < 0.15] = np.nan
        industry = int(rng.integers(0, 3)) if i >= 4 else 3 + i // 2
        if industry == 2:
            x[:] = 1.0 / 3
        x[5] = np.nan
        size = None if i % 11 == 7 else 2.5 if industry == 1 else float(rng.normal())
        month = None if i % 97 == 50 else dt.date(2020, 1 + (i >= 4 and i % 2), 1)
        out.append((i, month, None if i % 50 == 20 else industry, size, *[None if np.isnan(v) else float(v) for v in x]))
    return spark.createDataFrame(out, "event_id long, month date, industry int, logmv double, " + ", ".join(f"{c} double" for c in COLS))


STEPS = {
    "fill": lambda d: X.fill_industry_median(d, COLS, by=["month"]),
    "mad": lambda d: X.winsor(d, COLS, "mad", n=1, by=["month"]),
    "neutralise": lambda d: X.neutralise_event(d, COLS, by=["month"]),
    "zscore": lambda d: X.cs_zscore_sample(d, COLS, by=["month"]),
    "clean": lambda d: X.clean_feature(d, COLS, by=["month"]),
}


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("held", [True, False])
def test_many_columns_as_few(rows, monkeypatch, step, held):
    monkeypatch.setattr(wide, "STATS_BYTES", wide.STATS_BYTES if held else 0)
    monkeypatch.setattr(wide, "HELD_ROWS", 60)
    got = STEPS[step](rows.repartition(3)).orderBy("event_id").toPandas()
    monkeypatch.setattr(wide, "MANY", 10 ** 9)
    want = STEPS[step](rows).orderBy("event_id").toPandas()
    assert list(got) == list(want) and got[["event_id", "month"]].equals(want[["event_id", "month"]])
    np.testing.assert_allclose(got[COLS].to_numpy(float), want[COLS].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_no_rows(rows):
    assert X.clean_feature(rows.where("event_id < 0"), COLS, by=["month"]).count() == 0


def test_no_operator_of_more_fields_than_are_compiled(rows):
    """Beyond 100 fields Spark compiles none: 30 columns with their six statistics each would be 210."""
    plan, most = [X.neutralise_event(rows, COLS, by=["month"])._jdf.queryExecution().optimizedPlan()], 0
    while plan:
        node = plan.pop()
        most = max(most, node.output().size())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    assert most <= 100
