"""Sums of softplus(p_j - p_i) over all pairs with y_i > y_j, in N log N instead of N^2 steps.

softplus is analytic up to i pi on either side of the real line, so on intervals of length 1 its interpolation in ``NODES``
Chebyshev points is exact to about (2 pi + sqrt(4 pi^2 + 1))^-NODES, below 1e-12.  A set of predictions is then told by its
weights on the nodes of the intervals it occupies, and the sum between two sets is the weights of one times a small matrix
times the weights of the other; it depends on the distance of two intervals only.  Beyond ``REACH`` intervals softplus is
0 or its argument, to double precision, and counts and sums do.

Rows are cut into blocks by the label, so that all pairs of two blocks have the same order, and a block passes on its own
sum and its weights.  A label that very many rows share is a block of its own, dealt over tasks: its own pairs are ties.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import attach

NODES, REACH = 12, 40
RUN = 256
"""Rows of a block that are compared directly."""
_AT = 0.5 - 0.5 * np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)  # Chebyshev points of [0, 1]
_BASIS = np.linalg.inv(np.cos(np.arange(NODES)[None, :] * np.arccos(np.clip(2 * _AT[:, None] - 1, -1, 1))))
_STEP = np.stack([np.logaddexp(0.0, d + _AT[None, :] - _AT[:, None]) for d in range(-REACH, REACH + 1)])
"""_STEP[d + REACH][a, b]: softplus from node a of an interval to node b of the interval d further up."""


def node_weights(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(intervals, weights): the occupied unit intervals in order and each one's weights on its nodes."""
    cell = np.floor(p)
    inside = np.cos(np.arange(NODES)[None, :] * np.arccos(np.clip(2 * (p - cell) - 1, -1, 1))[:, None]) @ _BASIS
    cells, place = np.unique(cell, return_inverse=True)
    out = np.zeros((len(cells), NODES))
    np.add.at(out, place, inside)
    return cells, out


def cross_sum(upper: tuple[np.ndarray, np.ndarray], lower: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of softplus(p_lower - p_upper) over all pairs of two sets given by their weights."""
    (ua, uw), (la, lw) = upper, lower
    total = 0.0
    first, last = np.searchsorted(la, ua - REACH), np.searchsorted(la, ua + REACH, "right")
    n, s = lw.sum(1), (lw * (la[:, None] + _AT)).sum(1)
    n_above, s_above = np.concatenate([np.cumsum(n[::-1])[::-1], [0]]), np.concatenate([np.cumsum(s[::-1])[::-1], [0]])
    for a, w, i, j in zip(ua, uw, first, last):
        if j > i:
            total += float(np.einsum("a,dab,db->", w, _STEP[(la[i:j] - a).astype(int) + REACH], lw[i:j]))
        total += float(w.sum() * s_above[j] - (w * (a + _AT)).sum() * n_above[j])
    return total


def _joined(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cells, place = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    out = np.zeros((len(cells), NODES))
    np.add.at(out, place, np.concatenate([x[1], y[1]]))
    return cells, out


NONE = (np.zeros(0), np.zeros((0, NODES)))


def ordered_sum(p: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """Sum over the pairs with y_i > y_j and their number: short runs directly, each run against all lower ones by nodes."""
    order = np.argsort(y, kind="stable")
    p, y = p[order], y[order]
    total, pairs, below, at = 0.0, 0, NONE, 0
    while at < len(p):
        end = int(np.searchsorted(y, y[min(at + RUN, len(p)) - 1], "right"))  # ties stay in one run
        q, z = p[at:end], y[at:end]
        for i in range(0, len(q), RUN) if z[0] != z[-1] else ():
            higher = z[i:i + RUN, None] > z[None, :]
            total += float(np.logaddexp(0.0, q[None, :] - q[i:i + RUN, None])[higher].sum())
            pairs += int(higher.sum())
        w = node_weights(q)
        total += cross_sum(w, below)
        pairs += (end - at) * at
        below, at = _joined(below, w), end
    return total, pairs


def rank_sums(df: DataFrame, by: str, p: str, y: str, block_rows: int) -> DataFrame:
    """by + _s, _c: the sum and number of pairs with y_i > y_j, for every ``by`` value.

    A date's rows meet in blocks of about ``block_rows`` by label quantiles, whole dates only as weights: one row per block
    and interval.
    """
    kind = dict(df.dtypes)[by]
    rows = df.select(by, F.col(p).cast("double").alias("_p"), F.col(y).cast("double").alias("_y"))
    share = F.array(*[F.lit(i / 256) for i in range(1, 256)])
    cuts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_y", share, F.lit(2000)).alias("_q"))
    used = F.least(F.ceil(F.col("_n") / block_rows), F.lit(256)).cast("int")
    picked = F.array_distinct(F.transform(F.sequence(F.lit(1), used - 1), lambda i: F.get("_q", F.floor(i * 256 / used).cast("int") - 1)))
    cuts = cuts.select(by, F.when(used > 1, picked).otherwise(F.array().cast("array<double>")).alias("_cuts"))
    # even blocks lie between cuts, odd ones hold exactly a cut's value, so a hot label is alone
    placed = attach(rows, cuts, [by], "inner").withColumn("_blk", F.size(F.filter("_cuts", lambda c: c < F.col("_y")))
                                                         + F.size(F.filter("_cuts", lambda c: c <= F.col("_y"))))
    sizes = placed.groupBy(by, "_blk").agg(F.when(F.col("_blk") % 2 == 1, F.ceil(F.count(F.lit(1)) / block_rows)).otherwise(1).cast("int").alias("_deal"))
    dealt = attach(placed, sizes, [by, "_blk"], "inner").withColumn("_part", F.pmod(F.xxhash64("_p"), F.col("_deal")))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        q, z = pdf["_p"].to_numpy(), pdf["_y"].to_numpy()
        total, pairs = ordered_sum(q, z)
        cells, weights = node_weights(q)
        out = pd.DataFrame({by: pdf[by].iloc[0], "_blk": pdf["_blk"].iloc[0], "_cell": cells, "_w": list(weights.tolist()), "_s": 0.0, "_c": 0})
        out.loc[0, ["_s", "_c"]] = total, pairs
        return out.astype({"_c": "int64"})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        total, pairs, below = float(pdf["_s"].sum()), int(pdf["_c"].sum()), NONE
        for _, block in pdf.sort_values("_blk", kind="stable").groupby("_blk", sort=True):
            w = _joined((block["_cell"].to_numpy(), np.stack(block["_w"])), NONE)
            total += cross_sum(w, below)
            pairs += round(float(w[1].sum()) * float(below[1].sum()))
            below = _joined(below, w)
        return pd.DataFrame({by: pdf[by].iloc[:1], "_s": [total], "_c": [pairs]})

    parts = dealt.select(by, "_blk", "_part", "_p", "_y").groupBy(by, "_blk", "_part").applyInPandas(
        inside, f"{by} {kind}, _blk int, _cell double, _w array<double>, _s double, _c long")
    return parts.groupBy(by).applyInPandas(across, f"{by} {kind}, _s double, _c long")
