"""Approximate nearest neighbours by learned partitions.

A bounded hash sample is joined into an exact neighbour graph; the graph is cut into balanced parts by recursive
bisection; a small network learns each sampled vector's distribution over parts (of itself and its neighbours).  Every
row is indexed under its most probable part.  A query goes to its most probable parts until their probability passes
``reach``: the least that finds ``TARGET_RECALL`` of the exact neighbours, in the whole table, of up to ``ASKED_ROWS`` rows
that were kept out of the sample (one linear pass).  Candidates of the visited parts are ranked by the exact inner product in double precision.  The rows of every part are counted before
queries are routed: a query goes on to its next parts until those it visits hold k rows besides itself, or to all parts.

Parts are cut into blocks of bounded size by a hash of the id, queries too, so a part or a vector that holds a third
of all rows is many tasks; each returns at most k rows a query.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids or
vectors whose length is not the most common one; repeated rows and rows of one id count once (smallest vector); ties
go to the smaller id; every query has min(k, other rows) results, from all parts if need be; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import store

SAMPLE_ROWS = 8_192
"""Vectors the partition is learned on (in expectation of a hash sample); every row is indexed."""
ROWS_PER_PART, MAX_PARTS = 512, 128
GRAPH_NEIGHBOURS = 10
HIDDEN, EPOCHS, BATCH, RATE = 128, 40, 256, 3e-3
TARGET_RECALL = 0.95
ASKED_ROWS = 256
REACHES = (0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 0.9999, 1.0)
BLOCK_ROWS, QUERY_ROWS = 8_192, 1_024


@dataclass
class Router:
    """Small classifier: vector -> probability of each part."""
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    reach: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def visits(self, p: np.ndarray, rows: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """Mask of the parts each row visits: by falling probability until ``reach`` is passed and, with the ``rows`` of
        each part given, ``least`` rows are held."""
        order = np.argsort(-p, 1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
        more = (before < self.reach) | (self.reach >= 1)
        if rows is not None:
            more |= np.cumsum(rows[order], 1) - rows[order] < least
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, more, 1)
        return out


def exact_neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest inner products of each row with the others."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at:at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at:at + 512] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def bisect(nodes: np.ndarray, neighbours: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Side (bool) of each node: an even cut of the neighbour graph with few edges across.

    A few power iterations order the nodes along the graph's slowest mode; the median cuts; then pairs of nodes that
    together lower the cut change sides.
    """
    n = len(nodes)
    local = np.full(len(neighbours), -1)
    local[nodes] = np.arange(n)
    near = local[neighbours[nodes]]
    a, b = np.nonzero(near >= 0)
    src, dst = np.concatenate([a, near[a, b]]), np.concatenate([near[a, b], a])
    degree = np.maximum(np.bincount(src, minlength=n), 1)
    v = rng.normal(size=n)
    for _ in range(60):
        v = 0.5 * v + 0.5 * np.bincount(src, v[dst], n) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2:]] = True
    for _ in range(10):
        across = np.bincount(src, side[dst] != side[src], n)
        gain = 2 * across - np.bincount(src, minlength=n)
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 20))
        good = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not good:
            break
        new = side.copy()
        new[left[:good]], new[right[:good]] = True, False
        if (new[src] != new[dst]).sum() >= (side[src] != side[dst]).sum():
            break
        side = new
    return side


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = 11) -> np.ndarray:
    """Part of each node; parts is a power of two and sizes differ by at most one a level."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(neighbours), np.int64)
    width = 1
    while width < parts:
        part *= 2
        for p in range(0, 2 * width, 2):
            nodes = np.flatnonzero(part == p)
            if len(nodes) > 1:
                part[nodes[bisect(nodes, neighbours, rng)]] += 1
        width *= 2
    return part


def train_router(x: np.ndarray, target: np.ndarray, seed: int = 12) -> Router:
    """Cross entropy against each row's distribution over parts (Adam)."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    scale = float(np.sqrt(d) / (np.sqrt((x * x).sum(1).mean()) + 1e-12))
    x = x * scale
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            i = order[at:at + BATCH]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[i]) / len(i)
            back = (g @ w[2].T) * (h > 0)
            step += 1
            for k, gr in enumerate((x[i].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(scale, *w, reach=1.0)


def learn(x: np.ndarray, parts: int) -> Router:
    """Router of a sample: graph, balanced cut, classifier; every part is in reach until :func:`calibrated`."""
    near = exact_neighbours(x, min(GRAPH_NEIGHBOURS, len(x) - 1))
    part = balanced_parts(near, parts)
    target = np.zeros((len(x), parts))
    for column in (np.arange(len(x)), *near.T):
        target[np.arange(len(x)), part[column]] += 1
    return train_router(x, target / target.sum(1, keepdims=True))


def parts_of_nearest(indexed: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """For each asked row the parts of its k nearest among all rows; a task keeps k of its rows for each."""
    shared = indexed.sparkSession.sparkContext.broadcast((ids, x))  # ASKED_ROWS vectors

    def run(frames):
        ids, x = shared.value
        score, part = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64)
        for pdf in frames:
            if not len(pdf):
                continue
            s = x @ np.stack(pdf["embedding"]).astype(np.float64).T
            s[ids[:, None] == pdf["vec_id"].to_numpy()[None, :]] = -np.inf
            s, p = np.concatenate([score, s], 1), np.concatenate([part, np.tile(pdf["part"].to_numpy(), (len(x), 1))], 1)
            top = np.argpartition(-s, k - 1, 1)[:, :k]
            score, part = np.take_along_axis(s, top, 1), np.take_along_axis(p, top, 1)
        asked, at = np.nonzero(np.isfinite(score))
        yield pd.DataFrame({"asked": asked, "part": part[asked, at], "score": score[asked, at]})

    found = indexed.select("vec_id", "embedding", "part").mapInPandas(run, "asked long, part int, score double")
    best = Window.partitionBy("asked").orderBy(F.desc("score"))
    got = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("asked", "part").toPandas()
    return [got["part"][got["asked"] == i].to_numpy() for i in range(len(x))]


def calibrated(router: Router, x: np.ndarray, wanted: list[np.ndarray], held: np.ndarray, k: int) -> Router:
    """The router with the least reach that finds TARGET_RECALL of the wanted neighbours."""
    p = router.probabilities(x)
    for reach in REACHES:
        router.reach = reach
        seen = router.visits(p, held, k + 1)
        hits = [seen[i][w].mean() for i, w in enumerate(wanted) if len(w)]
        if not hits or np.mean(hits) >= TARGET_RECALL:
            break
    return router


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id, embedding: one row per id, of the most common length."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = table.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0))
    length = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("embedding") == (length["d"] if length else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def index(vectors: DataFrame, router: Router | None) -> DataFrame:
    """vectors + part: every row under its most probable part."""
    if router is None:
        return vectors.withColumn("part", F.lit(0))
    shared = vectors.sparkSession.sparkContext.broadcast(router)  # at most HIDDEN x (dimension + MAX_PARTS) numbers

    def run(frames):
        for pdf in frames:
            if len(pdf):
                pdf["part"] = shared.value.probabilities(np.stack(pdf["embedding"]).astype(np.float64)).argmax(1).astype(np.int32)
                yield pdf

    return vectors.mapInPandas(run, f"vec_id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, part int")


def part_rows(indexed: DataFrame) -> dict[int, int]:
    return {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}


def route(queries: DataFrame, router: Router | None, rows: dict[int, int], k: int) -> DataFrame:
    """queries + visit: the parts each query visits, with at least k + 1 rows (or all), as the query itself may be one."""
    if router is None:
        return queries.withColumn("visit", F.array(F.lit(0)))
    shared = queries.sparkSession.sparkContext.broadcast(router)
    held = np.array([rows.get(p, 0) for p in range(len(router.b2))])

    def run(frames):
        for pdf in frames:
            if len(pdf):
                seen = shared.value.visits(shared.value.probabilities(np.stack(pdf["embedding"]).astype(np.float64)), held, k + 1)
                pdf["visit"] = [np.flatnonzero(r).astype(np.int32) for r in seen]
                yield pdf

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInPandas(run, f"vec_id long, embedding {kind}, visit array<int>")


def top_k(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, allowed: np.ndarray | None = None) -> pd.DataFrame:
    """query_id, vec_id, score of the k nearest candidates (all, if fewer) other than the query itself.

    A fast product preselects with room for rounding; scores are then summed in one fixed order, so equal vectors tie.
    ``allowed`` masks the candidates of each query.
    """
    out = []
    for at in range(0, len(q), 256):
        s = q[at:at + 256] @ c.T
        s[qid[at:at + 256, None] == cid[None, :]] = -np.inf
        if allowed is not None:
            s[~allowed[at:at + 256]] = -np.inf
        kth = np.partition(s, len(cid) - k, 1)[:, len(cid) - k] if len(cid) > k else np.full(len(s), -np.inf)
        for i, row in enumerate(s):
            few = np.flatnonzero((row >= kth[i] - 1e-9 * (1 + abs(kth[i]))) & (row > -np.inf)) if kth[i] > -np.inf else np.flatnonzero(row > -np.inf)
            exact = (c[few] * q[at + i]).sum(1)
            best = np.lexsort((cid[few], -exact))[:k]
            out.append((np.full(len(best), qid[at + i]), cid[few[best]], exact[best]))
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))


def shards_of(rows: dict[int, int]) -> dict[int, int]:
    """Shard of each part: neighbouring parts together while they fit a block, a larger part alone."""
    out, shard, held = {}, -1, BLOCK_ROWS
    for p in sorted(rows):
        if held + rows[p] > BLOCK_ROWS:
            shard, held = shard + 1, 0
        out[p], held = shard, held + rows[p]
    return out


def search(indexed: DataFrame, routed: DataFrame, rows: dict[int, int], k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of the visited parts.

    Parts that fit one block share a task, which ranks a query's visited parts together, so a query yields k rows per
    shard and not per part.
    """
    shard = shards_of(rows)
    spark = indexed.sparkSession
    places = F.broadcast(spark.createDataFrame([(p, s) for p, s in shard.items()], "part int, shard int"))  # MAX_PARTS rows at most
    size: dict[int, int] = {}
    for p, n in rows.items():
        size[shard[p]] = size.get(shard[p], 0) + n
    visits = (routed.select("vec_id", F.explode("visit").alias("part")).join(places, "part").select("vec_id", "shard").distinct())
    asked = {r["shard"]: r["n"] for r in visits.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = F.broadcast(spark.createDataFrame(
        [(s, -(-n // BLOCK_ROWS), max(1, -(-asked.get(s, 0) // QUERY_ROWS))) for s, n in size.items()], "shard int, blocks int, groups int"))
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (indexed.join(places, "part").join(cuts, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
            .withColumn("group", cells("groups")).select("shard", "block", "group", "part", "vec_id", "embedding"))
    own = F.array_distinct(F.transform("visit", lambda p: F.get(F.lit([shard.get(p, -1) for p in range(max(shard, default=0) + 1)]), p)))
    right = (routed.select("vec_id", "embedding", "visit", F.explode(own).alias("shard")).join(cuts, "shard")
             .withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), "groups").cast("int"))
             .withColumn("block", cells("blocks")).select("shard", "block", "group", F.col("vec_id").alias("query_id"), "embedding", "visit"))

    def run(key, c, q):
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        part = c["part"].to_numpy()
        seen = np.zeros((len(q), max(int(part.max()), max(int(v.max()) for v in q["visit"])) + 1), bool)
        for i, v in enumerate(q["visit"]):
            seen[i, v] = True
        return top_k(q["query_id"].to_numpy(), np.stack(q["embedding"]).astype(np.float64),
                     c["vec_id"].to_numpy(), np.stack(c["embedding"]).astype(np.float64), k, seen[:, part])

    found = left.groupBy("shard", "block", "group").cogroup(right.groupBy("shard", "block", "group")).applyInPandas(
        run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, queries, k: int = 20, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``table`` that ``queries`` (a condition on vec_id) picks."""
    vectors = store(usable_vectors(table))
    n = vectors.count()
    parts, router = max(4, 1 << int(np.log2(max(1, min(MAX_PARTS, n // ROWS_PER_PART))))), None
    if n > parts:
        few = vectors.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(min(ASKED_ROWS, max(1, n // 8))).toPandas()
        share = min(1.0, sample_rows / n)
        drawn = vectors.where((F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
                              & ~F.col("vec_id").isin(few["vec_id"].tolist()))
        sample = drawn.toPandas().sort_values("vec_id")
        router = learn(np.stack(sample["embedding"]).astype(np.float64), parts)
    indexed = store(index(vectors, router))
    rows = part_rows(indexed)
    if router is not None:
        x = np.stack(few["embedding"]).astype(np.float64)
        held = np.array([rows.get(p, 0) for p in range(parts)])
        router = calibrated(router, x, parts_of_nearest(indexed, few["vec_id"].to_numpy(), x, k), held, k)
    routed = store(route(vectors.where(queries), router, rows, k))
    return search(indexed, routed, rows, k)
