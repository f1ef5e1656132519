"""Quality by Bradley-Terry ranking: pairs (better, worse) teach a score, a score quantile separates accepted texts.

The chance that i beats j is the logistic of s(i) - s(j) with s linear in binned text statistics, so the loss of a
pair depends on the difference of the two feature rows only.  Pairs join sampled documents of label 1 with sampled
documents of label 0.  The accepted share is the score quantile with the fewest errors in the sample, classes weighted
by their share of all labels; scores are shifted so that this quantile lies at ``threshold``.

Defined cases: null and empty texts have all statistics 0 and a score like any other; without labels of both classes
every text gets the smoothed share of label 1; repeated rows are scored each; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.llm.labelled import SAMPLE_ROWS, held_out, training_rows

THRESHOLD = 0.3
BINS = 16
PAIRS_PER_ROW = 6
STEPS, DECAY = 300, 1e-3

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 128)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_MARK = ~(_LETTER | _DIGIT | _SPACE)
_RARE = np.isin(_BYTES, [ord(c) for c in "#$%&*|<>{}~^=_\\@"])
_CLASSES = np.stack([_LETTER, _UPPER, _DIGIT, _SPACE, _MARK, _RARE, _BYTES == ord("!")]).astype(np.float64)


def statistics(text: str) -> list[float]:
    """Shape of one whole text; every entry is finite."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words, lines = text.split(), text.split("\n")
    letter, upper, digit, space, mark, rare, shout = (_CLASSES @ np.bincount(data, minlength=256)).tolist()
    n, k = max(1, len(data)), max(1, len(words))
    distinct = len(set(words))
    return [np.log1p(n), letter / n, upper / max(1.0, letter), digit / n, space / n, mark / n, rare / k, shout / k,
            (n - space) / k, distinct / k, np.log1p(distinct) / np.log1p(k), len(set(lines)) / len(lines), k / len(lines)]


@dataclass
class Ranker:
    edges: np.ndarray    # (statistics, BINS - 1)
    weights: np.ndarray  # (statistics, BINS)
    shift: float
    scale: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        raw = sum(self.weights[j][np.searchsorted(self.edges[j], rows[:, j], side="right")] for j in range(len(self.edges)))
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw - self.shift) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def pair_loss(w: np.ndarray, better: np.ndarray, worse: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of pairs, given as rows of active bins, and its gradient: only differences of the rows count."""
    n, d = better.shape
    z = np.clip(w[better].sum(1) - w[worse].sum(1), -30, 30)
    p = 1 / (1 + np.exp(z))  # chance given to the wrong order
    g = -(np.bincount(better.ravel(), np.repeat(p, d), len(w)) - np.bincount(worse.ravel(), np.repeat(p, d), len(w))) / n
    return float(np.logaddexp(0, -z).mean()), g


def fit(rows: np.ndarray, labels: np.ndarray, share: float, seed: int = 7) -> Ranker:
    """Gradient descent (Adam) on the pairs' logistic loss; ``share`` is label 1's share of all labels."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    d = rows.shape[1] if len(rows) else len(statistics(""))
    edges = np.stack([np.quantile(rows[:, j], np.arange(1, BINS) / BINS) if len(rows) else np.zeros(BINS - 1) for j in range(d)])
    if not len(good) or not len(bad):
        smooth = (len(good) + 0.5) / (len(good) + len(bad) + 1)
        return Ranker(edges, np.zeros((d, BINS)), -np.log(smooth / (1 - smooth)) + np.log(THRESHOLD / (1 - THRESHOLD)), 1.0)
    at = np.stack([np.searchsorted(edges[j], rows[:, j], side="right") + j * BINS for j in range(d)], 1)
    rng = np.random.default_rng(seed)
    n = PAIRS_PER_ROW * max(len(good), len(bad))
    better, worse = at[rng.choice(good, n)], at[rng.choice(bad, n)]
    w, m, v = np.zeros(d * BINS), np.zeros(d * BINS), np.zeros(d * BINS)
    for step in range(1, STEPS + 1):
        g = pair_loss(w, better, worse)[1] + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    s = w[at].sum(1)
    weight = np.where(labels == 1, share / len(good), (1 - share) / len(bad))
    order = np.argsort(s, kind="stable")
    # Rejecting the lowest i documents costs label 1 among them and label 0 among the others; ties stay together.
    cost = np.concatenate([[0.0], np.cumsum(np.where(labels[order] == 1, weight[order], -weight[order]))])
    split = np.concatenate([[True], np.diff(s[order]) > 1e-9, [True]])
    best = np.flatnonzero(split & (cost <= cost[split].min() + 1e-12))
    i = int(best[len(best) // 2])
    below = s[order[i - 1]] if i else s[order[0]] - 2.0
    above = s[order[i]] if i < len(s) else s[order[-1]] + 2.0
    return Ranker(edges, w.reshape(d, BINS), float((below + above) / 2), 1.0)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = SAMPLE_ROWS) -> Ranker:
    labels = labels.select("doc_id", F.col(target).cast("int").alias(target))
    share = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(target)).first()[0]

    def measure(frames):
        for pdf in frames:
            yield pdf[["doc_id", "label"]].assign(stats=[statistics(t or "") for t in pdf["text"]])

    got = (training_rows(docs, labels, target, bound).select("doc_id", "label", "text")
           .mapInPandas(measure, "doc_id long, label int, stats array<double>").toPandas().sort_values("doc_id"))
    rows = np.array(got["stats"].tolist()).reshape(len(got), len(statistics("")))
    return fit(rows, got["label"].to_numpy(), 0.5 if share is None else float(share))


def score(docs: DataFrame, model: Ranker, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs + score (0 to 1) and predicted (1 if score >= THRESHOLD) under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(frames):
        for texts in frames:
            yield pd.Series(shared.value.scores(np.array([statistics(t or "") for t in texts])))

    run.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scorer = F.pandas_udf(run, "double")
    return docs.withColumn(names[0], scorer(F.col("text"))).withColumn(names[1], (F.col(names[0]) >= THRESHOLD).cast("int"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted to be of low quality."""
    names = ("_quality_score", "_good")
    return score(docs, train(docs, labels), names=names).where(F.col(names[1]) == 1).select(*docs.columns)
