"""Blocked pair work, last-K events and calendar joins against brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantgrid.operators import evaluate as E
from quantgrid.operators import filters as FL
from quantgrid.operators import logisticsum as LS
from quantgrid.operators import pairs as PR
from quantgrid.operators import pit as P
from quantgrid.operators import ranksum as RS
from quantgrid.operators import samples as S
from quantgrid.operators import walkforward as W
from quantgrid.sources import axis as A

D = dt.date


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 6))
    v[:30] = v[0]                       # a third of the date are copies of one vector
    v -= v.mean(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(0, i, v[i].tolist()) for i in range(90)] + [(1, i, v[i].tolist()) for i in range(4)],
                               "date_idx int, tick long, vec array<double>")
    return v, df


@pytest.mark.parametrize("block", [7, 40, 2048])
def test_top_k_is_exact_for_any_block_size(vectors, block):
    v, df = vectors
    got = PR.similar_top_k(df, 5, block_rows=block).collect()
    assert {r.date_idx for r in got} == {0}     # four ticks cannot have five peers
    sim = np.round(v @ v.T, 10)
    np.fill_diagonal(sim, -np.inf)
    for i in range(90):
        want = sorted(range(90), key=lambda j: (-sim[i, j], j))[:5]
        assert sorted(r.peer_tick for r in got if r.tick == i) == sorted(want)


@pytest.mark.parametrize("block", [40, 120])
@pytest.mark.parametrize("text", [False, True])
def test_top_k_skips_blocks_that_cannot_gain(spark, monkeypatch, block, text):
    """Sectors of similar vectors: the result is exact, and most pairs of blocks are never compared."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(8, 20))
    v = centre[np.arange(640) % 8] + 0.05 * rng.normal(size=(640, 20))
    v -= v.mean(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    names = [f"t{i:03d}" for i in range(640)] if text else list(range(640))
    df = spark.createDataFrame([(0, names[i], v[i].tolist()) for i in range(640)], f"date_idx int, tick {'string' if text else 'long'}, vec array<double>")
    seen, plain = [], PR.candidate_blocks
    monkeypatch.setattr(PR, "candidate_blocks", lambda stats, by: seen.append(plain(stats, by)) or seen[-1])
    got = {}
    for r in PR.similar_top_k(df, 6, block_rows=block).collect():
        got.setdefault(r.tick, []).append(r.peer_tick)
    sim = np.round(v @ v.T, 10)
    np.fill_diagonal(sim, -np.inf)
    for i in range(640):
        assert sorted(got[names[i]]) == sorted(names[j] for j in sorted(range(640), key=lambda j: (-sim[i, j], j))[:6])
    kept = [r.kept for r in seen[0].collect()]
    assert len(kept) >= 10 and sum(kept) <= 0.5 * len(kept)


@pytest.mark.parametrize("date_rows, found_rows, most", [(10 ** 6, 10 ** 6, 2), (10 ** 6, 300, 5), (64, 10 ** 6, 9)])
def test_top_k_without_a_copy_for_each_block(spark, monkeypatch, date_rows, found_rows, most):
    """Dates of 15 blocks: no row is copied for each block, whole dates and cut ones give the same, and ties go to the lower tick."""
    monkeypatch.setattr(PR, "DATE_ROWS", date_rows)
    monkeypatch.setattr(PR, "FOUND_ROWS", found_rows, raising=False)
    monkeypatch.setattr(PR, "TOP_TILE", (16, 48), raising=False)
    monkeypatch.setattr(PR, "TOP_FIRST", 8, raising=False)
    rng = np.random.default_rng(12)
    v = rng.normal(size=(2, 300, 8))
    v[1, :120] = v[1, 0]
    v -= v.mean(axis=2, keepdims=True)
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    df = spark.createDataFrame([(d, 1000 - t, v[d, t].tolist()) for d in range(2) for t in range(300)], "date_idx int, tick long, vec array<double>")
    dealt, real = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: ("vec" in self.columns and dealt.append(self.count()), real(self, *a))[1])
    got = {}
    for r in PR.similar_top_k(df, 5, block_rows=20).collect():
        got.setdefault((r.date_idx, r.tick), {})[r.peer_tick] = r.corr
    for d in range(2):
        sim = np.round(v[d] @ v[d].T, 10)
        np.fill_diagonal(sim, -np.inf)
        for t in range(300):
            assert got[d, 1000 - t] == pytest.approx({1000 - j: sim[t, j] for j in sorted(range(300), key=lambda j: (-sim[t, j], -j))[:5]})
    assert 600 <= max(dealt) <= 600 * most


@pytest.fixture(params=[64, 10 ** 6])
def graph(spark, monkeypatch, request):
    """A panel, its edges and values by NumPy, how many rows were dealt over tasks, and the most there may be."""
    monkeypatch.setattr(PR, "DATE_ROWS", request.param, raising=False)
    monkeypatch.setattr(PR, "TILE", (16, 48), raising=False)
    rng = np.random.default_rng(21)
    x, value = rng.normal(size=(6, 200)), rng.normal(size=200)
    x[:, 1] = x[:, 0]
    rows = [(d, t, float(x[d, t]), None if t % 7 == 0 else float(value[t])) for d in range(6) for t in range(200)]
    panel = spark.createDataFrame(rows, "date_idx int, tick long, x double, c double")
    dealt, real = [], type(panel).repartition
    monkeypatch.setattr(type(panel), "repartition", lambda self, *a: (dealt.append(self.count()), real(self, *a))[1])
    u = (x - x.mean(0)) / np.linalg.norm(x - x.mean(0), axis=0)
    w = np.round(u.T @ u, 10)
    np.fill_diagonal(w, 1.0)
    return panel, {(i, j): w[i, j] for i, j in zip(*np.nonzero(w > 0.6))}, value, dealt, 200 * (2 if request.param > 200 else 8)


def test_edges_without_a_copy_for_each_block(graph):
    panel, want, _, dealt, most = graph
    got = {(r.src, r.dst): r.w for r in PR.corr_graph_edges(panel, ["x"], 6, 0.6, block_rows=10).collect()}
    assert got == pytest.approx(want) and len(want) > 1000 and 200 <= max(dealt) <= most


def test_neighbour_sums_without_a_copy_for_each_block(graph):
    panel, want, value, dealt, most = graph
    sums = {r.tick: r.c_nb for r in PR.graph_aggregate(panel, ["x"], ["c"], 6, 0.6, block_rows=10).collect()}
    for t in range(200):
        assert sums[t] == pytest.approx(sum(w * value[j] for (i, j), w in want.items() if i == t and j % 7))
    assert 200 <= max(dealt) <= most


@pytest.mark.parametrize("slices, chunks", [(1, 1), (2, 1), (3, 4)])
def test_a_pair_of_a_date_is_multiplied_once(slices, chunks):
    """Over the tasks of a date, tiles hold every pair of its rows once and no row with itself."""
    rng = np.random.default_rng(4)
    x, s, c = rng.normal(size=(50, 3)), rng.integers(0, slices, 50), rng.integers(0, chunks, 50)
    seen = np.zeros((50, 50), int)
    for i in range(slices):
        for j in range(chunks):
            for mine, theirs, sim in PR._tiles(x, np.flatnonzero(s == i), np.flatnonzero(c == j), 2.0, (4, 7)):
                at = np.isfinite(sim)
                np.testing.assert_allclose(sim[at], 2 * (x[mine] @ x[theirs].T)[at])
                seen[np.ix_(mine, theirs)] += at
    assert (seen == np.triu(np.ones((50, 50), int), 1)).all()


@pytest.mark.parametrize("threshold", [0.3, -0.2])
def test_neighbour_sums_of_unknown_values(spark, threshold):
    """A tick has a sum if any of its neighbours' values is known, its own or one with weight 0 too."""
    rng = np.random.default_rng(9)
    x, value = rng.normal(size=(4, 40)), rng.normal(size=(2, 40))
    value[0, 4:], value[1, ::3] = np.nan, np.nan
    panel = spark.createDataFrame([(d, t, float(x[d, t]), *[None if np.isnan(v) else float(v) for v in value[:, t]]) for d in range(4) for t in range(40)],
                                  "date_idx int, tick long, x double, c double, e double")
    u = (x - x.mean(0)) / np.linalg.norm(x - x.mean(0), axis=0)
    w = np.round(u.T @ u, 10)
    np.fill_diagonal(w, 1.0)
    got = {r.tick: (r.c_nb, r.e_nb) for r in PR.graph_aggregate(panel, ["x"], ["c", "e"], 4, threshold).collect()}
    for t in range(40):
        near = w[t] > threshold
        for k in range(2):
            known = near & ~np.isnan(value[k])
            assert got[t][k] == (pytest.approx((w[t] * value[k])[known].sum()) if known.any() else None)
    assert any(v[0] is None for v in got.values()) or threshold < 0


@pytest.mark.parametrize("block", [5, 64])
def test_pair_losses(spark, block):
    rng = np.random.default_rng(6)
    p, y = rng.normal(size=30), np.round(rng.normal(size=30), 1)
    df = spark.createDataFrame([(0, i, float(p[i]), float(y[i])) for i in range(30)] + [(1, 0, 1.0, 1.0)],
                               "date_idx int, tick long, pred double, label double")
    dp, dy = p[:, None] - p, y[:, None] - y
    rank = np.logaddexp(0, -np.sign(dy) * dp)[dy != 0].mean()
    logistic = np.log(1 + np.exp(-np.tanh(dp) * np.tanh(dy))).mean()
    got = {r.date_idx: r.rank_loss for r in PR.pairwise_rank_loss(df, block_rows=block).collect()}
    assert got[0] == pytest.approx(rank) and got[1] == 0.0
    got = {r.date_idx: r.logistic_loss for r in PR.monotonic_logistic_loss(df, block_rows=block).collect()}
    assert got[0] == pytest.approx(logistic) and got[1] == pytest.approx(np.log(2))


@pytest.mark.parametrize("spread", [20.0, 1e18])
def test_logistic_sums_by_tiles(spark, monkeypatch, spread):
    """All pairs' mean: near and far values in either direction, equal and infinite ones, NaN, tiles as points and as grids."""
    rng = np.random.default_rng(31)
    want, rows = {}, []
    for d, n in ((0, 900), (1, 1), (2, 60)):
        p, y = rng.normal(size=n) * 3, rng.normal(size=n) * spread
        p[: n // 3] *= spread
        y[n // 2:] = np.round(y[n // 2:])
        if d == 2:
            p[:9], y[5:12] = [np.inf] * 4 + [-np.inf] * 3 + [np.nan] * 2, [np.inf] * 4 + [-np.inf] * 3
        rows += [(d, i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))]
        with np.errstate(invalid="ignore"):
            want[d] = np.nanmean(np.logaddexp(0, -np.tanh(p[:, None] - p) * np.tanh(y[:, None] - y)))
    df = spark.createDataFrame([*rows, (3, 0, float("nan"), 1.0), (4, 0, None, 1.0)], "date_idx int, tick long, pred double, label double")
    for direct in (10, 1024):
        monkeypatch.setattr(LS, "DIRECT", direct)
        got = {r.date_idx: r.logistic_loss for r in PR.monotonic_logistic_loss(df, block_rows=100).collect()}
        assert got.pop(3) is None and got == pytest.approx(want, abs=1e-11)


def test_logistic_loss_takes_linear_time(spark):
    """40,000 ticks of one date, 1.6 billion pairs: no matrix of pairs is made."""
    rng = np.random.default_rng(32)
    p, y = rng.normal(size=40_000), rng.normal(size=40_000)
    df = spark.createDataFrame(pd.DataFrame({"date_idx": 0, "tick": range(40_000), "pred": p, "label": y}))
    tiles = LS.Tile(np.zeros(0), np.zeros(0), LS.grid_weights(p, y), 40_000)
    some = rng.integers(0, 40_000, (2, 4_000_000))
    guess = np.logaddexp(0, -np.tanh(p[some[0]] - p[some[1]]) * np.tanh(y[some[0]] - y[some[1]])).mean()
    got = PR.monotonic_logistic_loss(df).first().logistic_loss
    assert got == pytest.approx(tiles.near(tiles, 0, 0) / 1.6e9, abs=1e-11) and got == pytest.approx(guess, abs=1e-3)


def rank_sum(p, y):
    higher = y[:, None] > y[None, :]
    return np.logaddexp(0.0, p[None, :] - p[:, None])[higher].sum(), int(higher.sum())


@pytest.mark.parametrize("spread", [0.3, 5.0, 300.0, 1e9])
def test_ordered_sums_by_nodes(spread, monkeypatch):
    """To 1e-9 of all pairs: near and far predictions, ties in labels and predictions, hot labels."""
    monkeypatch.setattr(RS, "RUN", 16)
    rng = np.random.default_rng(11)
    for n in (1, 2, 15, 16, 17, 300, 700):
        p = rng.normal(size=n) * spread
        p[: n // 4] = np.round(p[: n // 4])
        for y in (rng.normal(size=n), np.round(rng.normal(size=n)), np.zeros(n), np.where(np.arange(n) % 3 == 0, 1.0, rng.normal(size=n))):
            total, pairs = RS.ordered_sum(p, y)
            want, count = rank_sum(p, y)
            assert pairs == count and total == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block", [20, 100, 5000])
def test_rank_loss_of_large_dates(spark, monkeypatch, block):
    monkeypatch.setattr(RS, "RUN", 16)
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for d, n in ((0, 900), (1, 1), (2, 130)):
        p, y = rng.normal(size=n) * 3, np.where(rng.random(n) < 0.35, 0.5, np.round(rng.normal(size=n), 2))
        rows += [(d, i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))]
        total, pairs = rank_sum(p, y)
        want[d] = total / pairs if pairs else 0.0
    df = spark.createDataFrame(rows + [(0, 9000, None, 1.0), (0, 9001, 1.0, None)], "date_idx int, tick long, pred double, label double")
    got = {r.date_idx: r.rank_loss for r in PR.pairwise_rank_loss(df, block_rows=block).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], rel=1e-9) for d in want)


@pytest.mark.parametrize("today", [True, False])
@pytest.mark.parametrize("k", [1, 3])
def test_last_k_against_brute_force(spark, today, k):
    rng = np.random.default_rng(7)
    events = [(int(rng.integers(0, 5)), int(e), i, float(i)) for i, e in enumerate(np.sort(rng.integers(0, 20, 60)))]
    events += [(9, 4, 100 + i, float(100 + i)) for i in range(40)]      # many on one date of one tick
    grid = spark.createDataFrame([(t, d) for t in [0, 1, 2, 3, 4, 7, 9] for d in range(20)], "tick int, date_idx int")
    ev = spark.createDataFrame(events, "tick int, effective_idx int, event_id int, x double")
    rows = P.pit_last_k(grid, ev, ["x"], k, today).collect()
    assert len(rows) == 7 * 20
    for r in rows:
        past = [(e, i, x) for t, e, i, x in events if t == r.tick and (e <= r.date_idx if today else e < r.date_idx)]
        last = sorted(past)[-k:]
        pad = k - len(last)
        assert [e.x for e in r.events] == [0.0] * pad + [x for _, _, x in last]
        assert r.event_mask == [0.0] * pad + [1.0] * len(last)
        assert r.event_age == [-1] * pad + [r.date_idx - e for e, _, _ in last]


def test_forward_calendar_edges(spark):
    days = A.calendar(spark.createDataFrame([(D(2024, 1, d),) for d in (3, 4, 8)], "date date"))
    df = spark.createDataFrame([(i, D(2024, 1, d)) for i, d in enumerate((1, 3, 5, 8, 9))], "id int, date date")
    got = {r.id: (r.trade_date.day, r.date_idx) for r in P.asof_forward_calendar(df, days).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (8, 2), 3: (8, 2)}      # after the last date: dropped


def test_expired_class_has_no_successor(spark):
    hist = spark.createDataFrame([("a", "old", D(2024, 1, 1), None), ("a", "new", D(2024, 2, 1), D(2024, 3, 1))],
                                 "tick string, code string, start_date date, end_date date")
    grid = spark.createDataFrame([("a", D(2024, m, 15)) for m in (1, 2, 3)] + [("b", D(2024, 1, 15))], "tick string, date date")
    got = {(r.tick, r.date.month): r.code for r in P.asof_backward_valid(grid, hist).collect()}
    assert got == {("a", 1): "old", ("a", 2): "new", ("a", 3): None, ("b", 1): None}


def test_name_absent_from_newest_snapshot_is_out(spark):
    w = spark.createDataFrame([("i", "a", D(2024, 1, 1), 1.0), ("i", "b", D(2024, 1, 1), 2.0), ("i", "a", D(2024, 1, 3), 3.0)],
                              "index string, tick string, date date, weight double")
    days = A.calendar(spark.createDataFrame([(D(2024, 1, d),) for d in range(1, 6)], "date date"))
    got = {(r.date.day, r.tick): r.weight for r in P.index_membership_asof(w, days).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 2.0, (2, "a"): 1.0, (2, "b"): 2.0, (3, "a"): 3.0, (4, "a"): 3.0, (5, "a"): 3.0}


def test_consensus_window_is_strict_and_leap_year_yoy(spark):
    rep = spark.createDataFrame([("a", D(2023, 2, 28), D(2023, 4, 1), 1.0), ("a", D(2024, 2, 29), D(2024, 4, 1), 3.0)],
                                "tick string, report_date date, date date, v double")
    fc = spark.createDataFrame([("a", D(2024, 2, 29), D(2023, 4, 1)), ("a", D(2024, 2, 29), D(2023, 4, 2)),
                                ("a", D(2024, 2, 29), D(2024, 4, 1)), ("a", D(2023, 2, 28), D(2023, 1, 1))],
                               "tick string, report_date date, made_date date")
    assert [r.made_date for r in P.consensus_window_join(fc, rep).collect()] == [D(2023, 4, 2)]
    got = {r.report_date.year: r.v_yoy for r in P.yoy(rep, ["v"], []).collect()}
    assert got == {2023: None, 2024: 2.0}


def test_densify_and_axes(spark):
    facts = spark.createDataFrame([("b", D(2024, 1, 2), 1.0), ("b", D(2024, 1, 5), 2.0), ("a", D(2024, 1, 3), 3.0)],
                                  "tick string, date date, x double")
    ticks = spark.createDataFrame([("a",), ("b",), ("c",)], "tick string")
    rows = A.densify(facts, ["x"], ticks=ticks).collect()
    assert len(rows) == 9 and len({(r.tick, r.date_idx) for r in rows}) == 9
    assert {(r.tick, r.date.day): r.x for r in rows if r.x} == {("b", 2): 1.0, ("b", 5): 2.0, ("a", 3): 3.0}
    plan = A.densify(facts, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    many = spark.range(20000).select(F.format_string("%06d", (F.col("id") * 7919) % 1000003).alias("tick"))
    got = A.tick_axis(many).orderBy("tick").collect()
    assert [r.tick_idx for r in got] == list(range(20000))


def test_calendar_has_no_limit(spark):
    df = spark.range(45_000).selectExpr("date_add(date'1950-01-01', cast(id as int)) as date")
    assert A.date_axis(df).count() == 45_000


def test_group_returns_partition_and_boundaries(spark):
    df = spark.createDataFrame([(0, float(i), float(i)) for i in range(10)], "date_idx int, pred double, label double")
    closed = {r["group"]: r.ret for r in E.group_returns(df, groups=3).collect()}
    assert closed == {3: pytest.approx(1 - 4.166666666667), 2: pytest.approx(4 - 4.166666666667), 1: pytest.approx(7.5 - 4.166666666667)}
    opened = {r["group"]: r.ret for r in E.group_returns(df, groups=3, closed=False).collect()}
    assert opened == {3: pytest.approx(0.5 - 3.5), 2: pytest.approx(0.0), 1: pytest.approx(3.0)}


def test_sample_raises_when_too_few(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "date_idx int, tick int")
    assert FL.sample_per_date(df, 1).count() == 2
    with pytest.raises(Exception, match="fewer than 2"):
        FL.sample_per_date(df, 2).collect()


def test_universe_modes_reject_bad_config(spark):
    df = spark.createDataFrame([(0, 1, True, 1.0)], "date_idx int, tick int, tradable boolean, label double")
    for bad in (dict(mode="nope"), dict(mode="fix"), dict(mode="pool"), dict(mode="sample")):
        with pytest.raises(ValueError):
            FL.select_universe(df, **bad)


def test_dead_steps_across_branches(spark):
    schema = "a array<struct<x:double>>, b array<struct<y:double>>"
    rows = [([(None,), (1.0,)], [(2.0,), (3.0,)]), ([(None,), (1.0,)], [(None,), (3.0,)]), ([(1.0,), (None,)], [(1.0,)])]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(S.dead({"a": ["x"], "b": ["y"]})).collect()] == [False, True, False]


def test_windows_are_ordered_and_overlap_raises(spark):
    w = W.walk_forward_windows(spark, "2010-01-01", "2020-12-31", 7, 1, 1, 1).orderBy("window", "start").collect()
    assert len(w) == 9 and str(w[0]["start"]) == "2010-01-01" and str(w[-1]["end"]) == "2020-12-31"
    for a, b in zip(w[::3], w[1::3]):
        assert (b["start"] - a["end"]).days == 1
    two = W.walk_forward_windows(spark, "2010-01-01", "2016-12-31", 5, 0, 1, 1).collect()
    assert {r["split"] for r in two} == {"train", "test"} and len(two) == 4
    pred = spark.createDataFrame([(D(2024, 1, 1), 1, 1.0), (D(2024, 1, 1), 1, 2.0)], "date date, tick int, pred double")
    with pytest.raises(Exception, match="overlap"):
        W.concat_windows(pred).collect()


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(0, *map(float, r), float(v)) for r, v in zip(x, y)], "w int, a double, b double, c double, y double")
    fit = {r.penalty: r for r in W.fit_ridge(df, ["a", "b", "c"], "y", ["w"], [0.0, 1.0]).collect()}
    for pen in (0.0, 1.0):
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc / 200 + pen * np.eye(3), xc.T @ yc / 200)
        np.testing.assert_allclose(fit[pen].coef, want, rtol=1e-9)
        assert fit[pen].intercept == pytest.approx(y.mean() - want @ x.mean(0))
