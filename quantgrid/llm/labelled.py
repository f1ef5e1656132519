"""Bounded labelled samples for the classifiers, held-out marks and hashed terms."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 12_000
"""Labelled documents a classifier is fitted on, half of each class at most (in expectation of a hash sample)."""
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, label, text of a hash sample of the labelled documents that are not held out.

    Only labels are counted; the sampled ids are at most about ``bound`` and meet the documents by a broadcast join.
    Null labels and ids do not count; a document labelled both ways is left out, one of several rows counts once, by its
    smallest text, so that the sample is bounded whatever repeats.
    """
    known = (labels.where(F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min(target).alias("label"), F.max(target).alias("_max")).where("label = _max").drop("_max"))
    counts = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, bound / 2 / n))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < share * (1 << 20))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


class TermIds:
    """Hash buckets of a text's words and word starts; each distinct word is hashed once while remembered."""

    KEPT = 200_000

    def __init__(self, buckets: int, starts: tuple[int, ...], only: np.ndarray | None = None):
        """``only``: a mask of the buckets that are of interest; others are left out at once."""
        self.buckets, self.starts = buckets, starts
        self.only = None if only is None else set(np.flatnonzero(only).tolist())
        self.find = re.compile(r"\w+").findall
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, w: str) -> tuple[int, ...]:
        terms = [w] + ["^" + w[:k] for k in self.starts if len(w) > k]
        ids = [zlib.crc32(t.encode()) % self.buckets for t in terms]
        return tuple(ids if self.only is None else [i for i in ids if i in self.only])

    def of_text(self, text: str) -> np.ndarray:
        """Distinct buckets of a text, ascending."""
        known, out = self.known, []
        if len(known) > self.KEPT:
            known.clear()
        for w in set(self.find(text.lower())):
            ids = known.get(w)
            if ids is None:
                ids = self.of_word(w)
                if len(w) <= 64:
                    known[w] = ids
            if ids:
                out.extend(ids)
        return np.unique(np.array(out, np.int32))
