"""Document fingerprints from closed syncmers: anchors that depend on nothing but their own k characters.

A k-mer is an anchor when the smallest of its inner s-mers (by hash) is its first or its last.  Anchors of a text are
therefore found again wherever the same k characters stand, and can be matched by position.  A fingerprint keeps every
anchor (each hash at its first position), so it grows with its text.  Hashes have 32 bits: two texts of n anchors each
share about n^2 / 2^32 hashes by chance.

Written out, a fingerprint is two base64 fields joined by a point, in text order: 4 bytes of hash for each anchor, then
its distance from the anchor before in 1, 2 or 4 bytes, whichever holds the largest (``parse`` reads it again).

The likeness of two fingerprints: anchors in both are matched; the longest run of matches in the same order is kept;
the share J of these in all anchors of both together becomes 2J / (1 + J), the shared part of two texts of equal length.

Neighbours (next smaller id) come from one range exchange: each range also gets the first row of the next one.

Defined cases: a null text is empty; texts without an anchor are one anchor, the hash of the whole text (empty: no
anchor); two empty fingerprints are alike (1); equal ids are ordered by text; null ids come last; a single row is its
own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, S = 12, 4
OUT_CHARS = 1 << 23
"""Characters of fingerprints after which rows are handed on."""
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial value of every window of ``width`` codes."""
    n = len(codes) - width + 1
    out = codes[:n].copy()
    for i in range(1, width):
        out = out * _FACTOR + codes[i:i + n]
    return out


def anchors(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the closed syncmers of a sequence of code points."""
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = _scramble(_rolling(codes, s))
    w = k - s + 1
    least, width = inner, 1
    while width < w:  # minimum over w inner positions, doubling the width
        step = min(width, w - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    at = np.flatnonzero((inner[:len(least)] == least) | (inner[w - 1:] == least))
    return at, _scramble(_rolling(codes, k)[at])


def fingerprint(text: str) -> np.ndarray:
    """hash << 32 | position of every distinct anchor, ascending."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        at, h = anchors(codes)
    if not len(at):
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
        return np.array([int.from_bytes(whole, "little") << 32], np.uint64)
    mark = np.sort(h & ~_LOW | at.astype(np.uint64))
    h = mark >> _HALF
    return mark[np.concatenate([[True], h[1:] != h[:-1]])]


def render(mark: np.ndarray) -> str:
    """Hashes and distances in text order as base64; empty for an empty text."""
    if not len(mark):
        return ""
    turned = np.sort(mark << _HALF | mark >> _HALF)
    gaps = np.diff(turned >> _HALF, prepend=np.uint64(0))
    width = next(w for w in (1, 2, 4) if int(gaps.max()) < 1 << 8 * w)
    return ".".join(base64.b64encode(x.tobytes()).decode() for x in ((turned & _LOW).astype("<u4"), gaps.astype(f"<u{width}")))


def parse(written: str) -> np.ndarray:
    """The fingerprint that ``render`` wrote."""
    if not written:
        return np.zeros(0, np.uint64)
    hashes, gaps = map(base64.b64decode, written.split("."))
    h = np.frombuffer(hashes, "<u4").astype(np.uint64)
    at = np.cumsum(np.frombuffer(gaps, f"<u{len(gaps) // len(h)}"), dtype=np.uint64)
    return np.sort(h << _HALF | at)


def longest_rise(at: np.ndarray) -> int:
    """Length of the longest rising subsequence."""
    if (at[1:] > at[:-1]).all():
        return len(at)
    tails: list[int] = []
    for p in at.tolist():
        if not tails or p > tails[-1]:
            tails.append(p)
        else:
            tails[bisect_left(tails, p)] = p
    return len(tails)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0 if not len(a) and not len(b) else 0.0
    left, right = a >> _HALF, b >> _HALF
    i = np.minimum(np.searchsorted(left, right), len(left) - 1)
    both = left[i] == right
    pairs = np.sort(a[i[both]] << _HALF | b[both] & _LOW)
    j = longest_rise(pairs & _LOW) / (len(a) + len(b) - len(pairs))
    return 2 * j / (1 + j)


def with_next(docs: DataFrame, width: int | None = None) -> DataFrame:
    """doc_id, text, part, own: rows dealt into id ranges, each range followed by the first row of the next.

    Ids alone are scanned to draw the ranges and to find each range's largest id (one row per range on the driver).
    """
    spark = docs.sparkSession
    width = width or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    bounds = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [i / width for i in range(1, width)], 0.2 / width))) if width > 1 else []
    edges = F.lit([int(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # Part 0 has the largest ids; null ids come after every other.
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(
        F.size(F.filter(edges, lambda b: b >= F.col("doc_id"))))
    heads = {int(r["part"]): r["top"] for r in ids.withColumn("part", part).groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(heads) or [0]
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the range that ends where p begins; the last one before the first
    previous = F.get(F.lit([before.get(p, -1) for p in range(order[-1] + 1)]), F.col("part"))
    top = F.get(F.array(*[F.lit(heads.get(p)).cast("bigint") for p in range(order[-1] + 1)]), F.col("part"))
    own = F.struct(F.col("part").alias("part"), F.lit(True).alias("own"))
    also = F.struct(previous.alias("part"), F.lit(False).alias("own"))
    copies = F.when(F.col("doc_id").isNull() | (F.col("doc_id") == top), F.array(own, also)).otherwise(F.array(own))
    return (docs.select("doc_id", "text").withColumn("part", part).select("doc_id", "text", F.inline(copies))
            .repartitionById(order[-1] + 1, F.col("part"))
            .sortWithinPartitions("part", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text"))


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def edited_prints(docs: DataFrame, width: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit: the last third replaced by as much of the next document's start."""
    def emit(row, after):
        doc, text, mark = row
        n = len(text)
        third = n // 3
        edited = text[:n - third] + after[1][:third]
        new = mark if edited == text else fingerprint(edited)
        return (doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), render(mark), render(new),
                likeness(mark, new), likeness(mark, after[2]))

    def run(frames):
        waiting, ended, out, held = None, False, [], 0
        for pdf in frames:
            for doc, text, own in zip(pdf["doc_id"], pdf["text"], pdf["own"]):
                if ended:
                    break  # further copies of the next range's rows
                text = text or ""
                row = (None if pd.isna(doc) else int(doc), text, fingerprint(text))
                if waiting is not None:
                    out.append(emit(waiting, row))
                    held += len(out[-1][3]) + len(out[-1][4])
                waiting, ended = (row, False) if own else (None, True)
                if len(out) >= 256 or held >= OUT_CHARS:
                    yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = [c.split()[0] for c in OUT.split(", ")]
    return with_next(docs, width).select("doc_id", "text", "own").mapInPandas(run, OUT)
