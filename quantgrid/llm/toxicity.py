"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed words and word starts.  The score adds a weight per term and, for every pair of terms,
the product of their factors, so a pair such as an insult with a group mention can weigh more than its parts.

All terms of the sample take part.  A term's value in a text is its scale, (g / (g + ``SOFT``))^2 with its evidence g, so
that the common regularisation binds a rare or indifferent term the more.  Evidence is the larger of the term's G statistic
against the label and of what the term's best pair has beyond chance: pairs say what terms alone do not, as in an exclusive
or.  Pairs are counted in tasks, block by block, on at most ``PAIR_ROWS`` rows of the sample.

Bounds: the sample has at most about ``SAMPLE_ROWS`` rows and ``SAMPLE_TERMS`` terms, both in hash order of the ids.

Defined cases: null and empty texts get the bias alone; without usable labels of both classes every text gets the
smoothed share of label 1; repeated rows are scored each; whole texts are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.core import store
from quantgrid.llm.labelled import SAMPLE_ROWS, TermIds, held_out, training_rows

BUCKETS = 1 << 18
STARTS = (4, 5, 6, 7)
FACTORS = 4
EPOCHS = 4
BATCH = 256
SOFT = 12.0
SAMPLE_TERMS = 12_000_000
PAIR_ROWS = 3_000
BLOCK_TERMS = 512
RATE, FACTOR_RATE, DECAY = 0.1, 0.02, 1e-3


@dataclass
class FactorizationMachine:
    """Weights and factors are those of a term's presence: its scale is multiplied in."""

    bias: float
    weights: np.ndarray  # (buckets,)
    factors: np.ndarray  # (buckets, FACTORS)
    seen: np.ndarray     # (buckets,) bool: terms of the sample

    def margin(self, ids: np.ndarray) -> float:
        ids = ids[self.seen[ids]]
        if not len(ids):
            return self.bias
        v = self.factors[ids]
        total = v.sum(0)
        return float(self.bias + self.weights[ids].sum() + 0.5 * ((total * total).sum() - (v * v).sum()))


def _nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def presence(rows: list[np.ndarray], buckets: int) -> np.ndarray:
    """Number of rows that hold each bucket; a few rows at a time, as counting widens their terms."""
    out = np.zeros(buckets, np.int64)
    for at in range(0, len(rows), 512):
        out += np.bincount(np.concatenate(rows[at:at + 512]), minlength=buckets)
    return out


def evidence(rows: list[np.ndarray], labels: np.ndarray, buckets: int) -> np.ndarray:
    """G statistic of each bucket's presence against the label."""
    held = [presence([r for r, y in zip(rows, labels) if y == c], buckets).astype(float) for c in (0, 1)]
    n = [float((labels == c).sum()) for c in (0, 1)]
    both, total = held[0] + held[1], n[0] + n[1]
    cells = sum(_nlogn(held[c]) + _nlogn(n[c] - held[c]) for c in (0, 1))
    g = 2 * (cells - _nlogn(both) - _nlogn(total - both) - sum(_nlogn(np.array(m)) for m in n) + _nlogn(np.array(total)))
    return np.maximum(g, 0.0)


class PairBlocks:
    """What pairs of terms say about the label beyond either term, block of terms by block of terms.

    For a pair, the G statistic of one term against the label is taken among the documents with the other, both ways; the
    smaller counts as far as it passes 2 ln(number of pairs), which less than one pair is expected to do by chance.  G is at
    most 2 ln 2 times the documents looked at, so terms in fewer documents than that allows cannot pass and are not paired.
    """

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, buckets: int):
        held = presence(rows, buckets)
        m = max(2, int((held > 0).sum()))
        self.least = 2 * np.log(max(2, m * (m - 1) / 2))
        self.terms = np.flatnonzero(held >= self.least / (2 * np.log(2)))
        place = np.full(buckets, -1, np.int32)
        place[self.terms] = np.arange(len(self.terms))
        term = [place[r] for r in rows]
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t in term])
        term = np.concatenate([*term, np.zeros(0, np.int32)])
        doc, term = doc[term >= 0], term[term >= 0]
        order = np.argsort(term, kind="stable")
        self.term, self.doc = term[order], doc[order]
        self.labels = labels
        self.size = [int((labels == c).sum()) for c in (0, 1)]
        self.blocks = -(-len(self.terms) // BLOCK_TERMS)

    def pairs(self) -> int:
        return self.blocks * (self.blocks + 1) // 2

    def _block(self, i: int) -> list[np.ndarray]:
        """Presence of the block's terms in the documents of each class."""
        a, b = np.searchsorted(self.term, [i * BLOCK_TERMS, (i + 1) * BLOCK_TERMS])
        doc, term = self.doc[a:b], self.term[a:b] - i * BLOCK_TERMS
        row = np.where(self.labels == 1, np.cumsum(self.labels == 1), np.cumsum(self.labels == 0)) - 1
        out = []
        for c in (0, 1):
            x = np.zeros((self.size[c], min(BLOCK_TERMS, len(self.terms) - i * BLOCK_TERMS)), np.float32)
            mine = self.labels[doc] == c
            x[row[doc[mine]], term[mine]] = 1
            out.append(x)
        return out

    def excess(self, nth: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, best excess) of the terms of the nth pair of blocks."""
        j = int((np.sqrt(8 * nth + 1) - 1) / 2)
        j += (j + 1) * (j + 2) // 2 <= nth
        i = nth - j * (j + 1) // 2
        left = self._block(i)
        right = left if i == j else self._block(j)
        nlogn = _nlogn(np.arange(len(self.labels) + 1).astype(float))
        both = [(x.T @ y).astype(np.int64) for x, y in zip(left, right)]
        together = nlogn[both[0]] + nlogn[both[1]] - nlogn[both[0] + both[1]]
        best = np.full(both[0].shape, np.inf)
        for n in ([x.sum(0).astype(np.int64)[:, None] for x in left], [x.sum(0).astype(np.int64)[None, :] for x in right]):
            apart = [n[c] - both[c] for c in (0, 1)]
            g = 2 * (together + nlogn[apart[0]] + nlogn[apart[1]] - nlogn[apart[0] + apart[1]]
                     - nlogn[n[0]] - nlogn[n[1]] + nlogn[n[0] + n[1]])
            np.minimum(best, g, out=best)
        best = np.maximum(best - self.least, 0.0)
        first, second = self.terms[i * BLOCK_TERMS:(i + 1) * BLOCK_TERMS], self.terms[j * BLOCK_TERMS:(j + 1) * BLOCK_TERMS]
        return np.concatenate([first, second]), np.concatenate([best.max(1), best.max(0)])


def pair_evidence(spark: SparkSession, rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Best pair excess of every bucket; the blocks of terms are paired in tasks."""
    blocks = PairBlocks(rows, labels, buckets)
    out = np.zeros(buckets)
    if not blocks.blocks:
        return out
    shared = spark.sparkContext.broadcast(blocks)  # 8 bytes per term of at most PAIR_ROWS rows

    def run(frames):
        best: dict[int, float] = {}
        for pdf in frames:
            for nth in pdf["id"].tolist():
                for bucket, x in zip(*(a.tolist() for a in shared.value.excess(nth))):
                    if x > best.get(bucket, 0.0):
                        best[bucket] = x
        yield pd.DataFrame({"bucket": np.array(list(best), np.int64), "excess": np.array(list(best.values()), float)})

    tasks = min(blocks.pairs(), 4 * spark.sparkContext.defaultParallelism)
    found = spark.range(0, blocks.pairs(), 1, tasks).mapInPandas(run, "bucket long, excess double").toPandas()
    np.maximum.at(out, found["bucket"].to_numpy(np.int64), found["excess"].to_numpy(float))
    return out


def loss_and_gradient(b: float, w: np.ndarray, v: np.ndarray, scale: np.ndarray, rows: list[np.ndarray], labels: np.ndarray,
                      weight: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Weighted mean logistic loss of the rows and its gradient in bias, weights and factors, linear in the rows' terms."""
    sizes = np.array([len(r) for r in rows])
    ids = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    doc, at = np.repeat(np.arange(len(rows)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    x = scale[ids]

    def per_row(a: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)])
        return sums[at[1:]] - sums[at[:-1]]

    vx = v[ids] * x[:, None]
    total, square = per_row(vx), per_row((vx * vx).sum(1))
    z = np.clip(b + per_row(w[ids] * x) + 0.5 * ((total * total).sum(1) - square), -30, 30)
    loss = float((weight * (np.logaddexp(0, z) - labels * z)).sum() / len(rows))
    g = (1 / (1 + np.exp(-z)) - labels) * weight / len(rows)
    gx = g[doc] * x
    gv = np.stack([np.bincount(ids, gx * (total[doc, f] - vx[:, f]), len(w)) for f in range(v.shape[1])], 1)
    return loss, float(g.sum()), np.bincount(ids, gx, len(w)), gv


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, factors: int = FACTORS,
        epochs: int = EPOCHS, seed: int = 5, pair_excess: np.ndarray | None = None) -> FactorizationMachine:
    """Logistic loss, AdaGrad over mini-batches of documents, classes weighted alike."""
    rng = np.random.default_rng(seed)
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n0 or not n1:
        none = np.zeros(buckets)
        return FactorizationMachine(float(np.log((n1 + 0.5) / (n0 + 0.5))), none, np.zeros((buckets, factors)), none > 0)
    held = np.flatnonzero(presence(rows, buckets))
    place = np.zeros(buckets, np.int32)
    place[held] = np.arange(len(held))
    rows = [place[r] for r in rows]
    g = evidence(rows, labels, len(held))
    if pair_excess is not None:
        g = np.maximum(g, pair_excess[held])
    scale = (g / (g + SOFT)) ** 2
    b, w, v = 0.0, np.zeros(len(held)), rng.normal(0, 0.05, (len(held), factors))
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0) * len(labels)
    hw, hv, hb = np.full_like(w, 1e-8), np.full_like(v, 1e-8), 1e-8
    batch = min(BATCH, max(16, len(rows) // 40))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            _, gb, gw, gv = loss_and_gradient(b, w, v, scale, [rows[i] for i in some], labels[some], weight[some])
            gw += DECAY * w
            gv += DECAY * v
            hw += gw * gw
            hv += gv * gv
            hb += gb * gb
            w -= RATE * gw / np.sqrt(hw)
            v -= FACTOR_RATE * gv / np.sqrt(hv)
            b -= RATE * gb / np.sqrt(hb)
    out = FactorizationMachine(b, np.zeros(buckets), np.zeros((buckets, factors)), np.zeros(buckets, bool))
    out.weights[held], out.factors[held], out.seen[held] = w * scale, v * scale[:, None], True
    return out


def hashed_terms(docs: DataFrame, keep: str, buckets: int = BUCKETS, starts: tuple[int, ...] = STARTS) -> DataFrame:
    """``keep`` columns plus ``terms``: the distinct buckets as packed 32-bit integers."""
    def run(frames):
        terms = TermIds(buckets, starts)
        for pdf in frames:
            packed = [terms.of_text(t or "").tobytes() for t in pdf.pop("text")]
            yield pdf.assign(terms=packed)

    names = [c.split()[0] for c in keep.split(", ")]
    return docs.select(*names, "text").mapInPandas(run, keep + ", terms binary")


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", bound: int = SAMPLE_ROWS) -> FactorizationMachine:
    sample = training_rows(docs, labels.select("doc_id", F.col(target).cast("int").alias(target)), target, bound)
    terms = store(hashed_terms(sample, "doc_id long, label int"))
    sizes = terms.select("doc_id", F.length("terms").alias("bytes")).toPandas()  # at most about ``bound`` narrow rows
    order = sizes.assign(h=[zlib.crc32(str(i).encode()) for i in sizes["doc_id"]]).sort_values(["h", "doc_id"])
    fitting = order[order["bytes"].cumsum() <= 4 * SAMPLE_TERMS]
    if len(fitting) < len(order):
        terms = terms.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) <= int(fitting["h"].max()))
    got = terms.select("doc_id", "label", "terms").toArrow()  # at most 4 * SAMPLE_TERMS bytes
    order, label = np.argsort(got["doc_id"].to_numpy(), kind="stable"), got["label"].to_numpy().astype(np.int64)
    packed = got["terms"].to_pylist()
    rows, label = [np.frombuffer(packed[i], np.int32) for i in order], label[order]
    del got, packed
    if len(set(label.tolist())) < 2:
        return fit(rows, label)
    few = np.sort(np.random.default_rng(3).permutation(len(rows))[:PAIR_ROWS])
    excess = pair_evidence(docs.sparkSession, [rows[i] for i in few], label[few])
    return fit(rows, label, pair_excess=excess)


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5, buckets: int = BUCKETS,
          starts: tuple[int, ...] = STARTS, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs + score (0 to 1) and predicted (1 if score >= threshold) under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x (1 + factors)

    def run(frames):
        terms = TermIds(buckets, starts, shared.value.seen)
        for texts in frames:
            z = np.array([shared.value.margin(terms.of_text(t or "")) for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    run.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scorer = F.pandas_udf(run, "double")
    return docs.withColumn(names[0], scorer(F.col("text"))).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic."""
    names = ("_toxic_score", "_toxic")
    return score(docs, train(docs, labels), names=names).where(F.col(names[1]) == 0).select(*docs.columns)
