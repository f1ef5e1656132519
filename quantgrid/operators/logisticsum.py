"""Sums of ln(1 + exp(-tanh(dp) tanh(dy))) over all ordered pairs of a group, in N instead of N^2 steps.

The kernel is smooth and depends on the two differences alone.  The plane of (p, y) is cut into square tiles of ``WIDTH``.
A point in a tile is told by its weights on a grid of step ``STEP``: Lagrange interpolation in ``POINTS`` by ``POINTS`` nodes
around it, exact to about 1e-12.  The sum between two tiles is then a convolution of their grids, done by FFT.  Beyond
``WIDTH`` tanh is its sign to 1e-13: tiles that are no neighbours in one direction need only the weights along the other, and
in both only the counts.  Small tiles are compared directly.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import attach, stage

WIDTH, STEP, POINTS = 16.0, 0.125, 14
GRID = int(WIDTH / STEP) + POINTS
DIRECT = 1024
"""Tiles of at most so many points are kept as points."""
_BARYCENTRIC = np.array([(-1.0) ** k * comb(POINTS - 1, k) for k in range(POINTS)])
LARGEST = float(np.finfo(np.float64).max)


def logistic(dp: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, -np.tanh(dp) * np.tanh(dy))


def _stencil(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First node and the weights of the nodes around places relative to the middle of their tile."""
    at = np.clip(x + WIDTH / 2, 0, WIDTH) / STEP + (POINTS // 2 - 1)
    first = np.minimum(np.floor(at).astype(np.int64) - (POINTS // 2 - 1), GRID - POINTS)
    gap = at[:, None] - (first[:, None] + np.arange(POINTS))
    hit = gap == 0
    w = _BARYCENTRIC / np.where(hit, 1.0, gap)
    w = np.where(hit.any(1, keepdims=True), hit, w)
    return first, w / w.sum(1, keepdims=True)


def line_weights(x: np.ndarray) -> np.ndarray:
    first, w = _stencil(x)
    return np.bincount((first[:, None] + np.arange(POINTS)).ravel(), w.ravel(), GRID)


def grid_weights(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(p nodes, y nodes) weights of points of one tile."""
    out = np.zeros(GRID * GRID)
    for i in range(0, len(p), 4096):
        (a, u), (b, v) = _stencil(p[i:i + 4096]), _stencil(y[i:i + 4096])
        place = ((a[:, None] + np.arange(POINTS))[:, :, None] * GRID + (b[:, None] + np.arange(POINTS))[:, None, :])
        out += np.bincount(place.ravel(), (u[:, :, None] * v[:, None, :]).ravel(), GRID * GRID)
    return out.reshape(GRID, GRID)


_BACK = np.arange(-(GRID - 1), GRID)


@cache
def _plane(i: int, j: int) -> np.ndarray:
    """Transform of the kernel from a tile to the one i, j further on."""
    out = np.zeros((2 * GRID, 2 * GRID))
    out[np.ix_(_BACK, _BACK)] = logistic((i * WIDTH + _BACK * STEP)[:, None], (j * WIDTH + _BACK * STEP)[None, :])
    return np.fft.rfft2(out)


@cache
def _line(i: int) -> np.ndarray:
    """Kernel from node a of a tile to node b of the one i further on, the other direction being far further on."""
    at = np.arange(GRID) * STEP
    return np.logaddexp(0.0, -np.tanh(i * WIDTH + at[None, :] - at[:, None]))


class Tile:
    """Points or grid weights of one tile, whichever there are."""

    def __init__(self, p: np.ndarray, y: np.ndarray, grid: np.ndarray | None, n: int) -> None:
        self.p, self.y, self.grid, self.n, self.wave = p, y, grid, n, None

    def transform(self) -> np.ndarray:
        if self.wave is None:
            self.wave = np.fft.rfft2(self.grid if self.grid is not None else grid_weights(self.p, self.y), (2 * GRID, 2 * GRID))
        return self.wave

    def near(self, other: Tile, i: int, j: int) -> float:
        """Sum over the pairs with a tile i further in p and j further in y."""
        if self.grid is None and other.grid is None and self.n * other.n <= DIRECT * DIRECT:
            dp, dy = other.p[None, :] - self.p[:, None] + i * WIDTH, other.y[None, :] - self.y[:, None] + j * WIDTH
            return float(logistic(dp, dy).sum())
        met = np.fft.irfft2(np.conj(self.transform()) * other.transform() * np.conj(_plane(i, j)), (2 * GRID, 2 * GRID))
        return float(met[0, 0])


def far_sum(tiles: pd.DataFrame) -> float:
    """Twice the sum over pairs of tiles two or more apart in p or y, from columns _ti, _tj, wp, wy; a tile may come in parts."""
    total = 0.0
    for first, second, line in (("_tj", "_ti", "wp"), ("_ti", "_tj", "wy")):
        # far along ``first``; near or far along ``second``, the latter counted in the first round only
        below: dict[float, np.ndarray] = {}
        waiting: list[tuple[float, pd.DataFrame]] = []
        for row, level in tiles.groupby(first, sort=True):
            while waiting and row - waiting[0][0] >= 2:
                for at, w in zip(*(waiting[0][1][c] for c in (second, line))):
                    below[at] = below[at] + w if at in below else w
                waiting.pop(0)
            waiting.append((row, level))
            if not below:
                continue
            keys = np.array(sorted(below))
            counts = np.concatenate([[0.0], np.cumsum([below[k].sum() for k in keys])])
            for at, w in zip(level[second], level[line]):
                lo, hi = np.searchsorted(keys, at - 1), np.searchsorted(keys, at + 1, "right")
                for k in keys[lo:hi]:
                    total += float(below[k] @ _line(int(at - k)) @ w)
                if line == "wp":
                    total += w.sum() * (counts[lo] * np.logaddexp(0.0, -1.0) + (counts[-1] - counts[hi]) * np.logaddexp(0.0, 1.0))
    return 2 * total


def _tile(parts: pd.DataFrame) -> Tile:
    grids = [g for g in parts["grid"] if g is not None]
    p, y = (np.concatenate([np.asarray(v, dtype=np.float64) for v in parts[c]]) for c in ("p", "y"))
    return Tile(p, y, np.sum(grids, axis=0).reshape(GRID, GRID) if grids else None, int(parts["n"].sum()))


AHEAD = [(1, -1), (0, 1), (1, 0), (1, 1)]
"""Half of a tile's neighbours; the other half meet it as theirs."""
STILL_I, STILL_J = ([k for k, step in enumerate(AHEAD, 1) if step[axis] == 0] for axis in (0, 1))
EXACT = float(1 << 53)
"""Up to this tile number there are tiles one apart; further out two doubles are one place or far from each other."""


def logistic_sums(df: DataFrame, by: str, p: str, y: str, block_rows: int) -> DataFrame:
    """by + _s, _c: the sum and number of ordered pairs, self pairs included, whose differences are numbers.

    A tile of more than ``DIRECT`` points is dealt in parts of about ``block_rows`` to tasks that return grid weights.
    Neighbouring tiles meet in a task each; a date meets as a whole only as one row per tile, with weights on two lines.
    """
    kind = dict(df.dtypes)[by]
    rows = df.select(by, F.col(p).cast("double").alias("_p"), F.col(y).cast("double").alias("_y")).where(F.col(by).isNotNull())
    known = rows.where(~F.isnan("_p") & ~F.isnan("_y"))
    # two infinite values of one sign have no difference; as the largest double they meet at 0, where the kernel is ln 2
    ends = F.struct(*[F.when(F.abs(c) == float("inf"), F.signum(c)).otherwise(0.0).alias(c) for c in ("_p", "_y")])
    alike = known.groupBy(by, ends.alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    lists = alike.groupBy(by).agg(F.sum("_n").alias("_all"), F.collect_list(F.struct("_e", "_n")).alias("_ends"))
    lost = F.aggregate("_ends", F.lit(0).cast("long"), lambda s, a: s + F.aggregate("_ends", F.lit(0).cast("long"), lambda t, b: t + F.when(
        ((a["_e"]["_p"] != 0) & (a["_e"]["_p"] == b["_e"]["_p"])) | ((a["_e"]["_y"] != 0) & (a["_e"]["_y"] == b["_e"]["_y"])),
        a["_n"] * b["_n"]).otherwise(F.lit(0).cast("long"))))
    counts = rows.select(by).distinct().join(lists.select(by, "_all", lost.alias("_lost")), by, "left")

    finite = known.select(by, *[F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)).alias(c) for c in ("_p", "_y")])
    placed = finite.withColumns({"_ti": F.rint(F.col("_p") / WIDTH), "_tj": F.rint(F.col("_y") / WIDTH)}).withColumns(
        {"_p": F.col("_p") - F.col("_ti") * WIDTH, "_y": F.col("_y") - F.col("_tj") * WIDTH})
    sizes = placed.groupBy(by, "_ti", "_tj").agg((F.count(F.lit(1)) > DIRECT).alias("_many"), F.ceil(F.count(F.lit(1)) / block_rows).alias("_deal"))
    dealt = attach(placed, sizes, [by, "_ti", "_tj"], "inner").withColumn("_part", F.when(F.col("_many"), F.pmod(F.xxhash64("_p", "_y"), F.col("_deal"))).otherwise(0))

    def compress(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["_p"].to_numpy(), pdf["_y"].to_numpy()
        many, none = bool(pdf["_many"].iloc[0]), np.zeros(0)
        return pd.DataFrame({by: pdf[by].iloc[:1], "_ti": pdf["_ti"].iloc[:1], "_tj": pdf["_tj"].iloc[:1], "n": [len(pdf)],
                             "p": [none if many else a], "y": [none if many else b], "grid": [grid_weights(a, b).ravel() if many else None],
                             "wp": [line_weights(a) if many else None], "wy": [line_weights(b) if many else None]})

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        met = {k: _tile(parts) for k, parts in pdf.groupby("_k")}
        if 0 not in met:
            return pd.DataFrame({by: pdf[by].iloc[:0], "_s": []})
        total = met[0].near(met[0], 0, 0) + sum(2 * met[0].near(met[k], *step) for k, step in enumerate(AHEAD, 1) if k in met)
        return pd.DataFrame({by: pdf[by].iloc[:1], "_s": [total]})

    def far(pdf: pd.DataFrame) -> pd.DataFrame:
        for points, line in (("p", "wp"), ("y", "wy")):
            pdf[line] = [line_weights(np.asarray(x)) if w is None else np.asarray(w) for x, w in zip(pdf[points], pdf[line])]
        return pd.DataFrame({by: pdf[by].iloc[:1], "_s": [far_sum(pdf)]})

    tiles = stage(dealt.select(by, "_ti", "_tj", "_part", "_many", "_p", "_y").groupBy(by, "_ti", "_tj", "_part").applyInPandas(
        compress, f"{by} {kind}, _ti double, _tj double, n long, p array<double>, y array<double>, grid array<double>, wp array<double>, wy array<double>"))
    beside = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("_ti") - i).alias("i"), (F.col("_tj") - j).alias("j"))
                                 for k, (i, j) in enumerate([(0, 0), *AHEAD])]))
    meets = tiles.withColumn("_m", beside).where(
        (F.col("_m.k") == 0) | ((F.abs("_ti") <= EXACT) | F.col("_m.k").isin(STILL_I)) & ((F.abs("_tj") <= EXACT) | F.col("_m.k").isin(STILL_J))).select(
        by, F.col("_m.i").alias("_gi"), F.col("_m.j").alias("_gj"), F.col("_m.k").alias("_k"), "n", "p", "y", "grid")
    sums = meets.groupBy(by, "_gi", "_gj").applyInPandas(near, f"{by} {kind}, _s double").unionByName(
        tiles.select(by, "_ti", "_tj", "p", "y", "wp", "wy").groupBy(by).applyInPandas(far, f"{by} {kind}, _s double"))
    found = counts.join(sums.groupBy(by).agg(F.sum("_s").alias("_s")), by, "left")
    return found.select(by, (F.col("_s") - F.col("_lost") * float(np.log(2))).alias("_s"), (F.col("_all") * F.col("_all") - F.col("_lost")).alias("_c"))
