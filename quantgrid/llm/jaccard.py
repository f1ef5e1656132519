"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Two texts are linked when their sets of five-word shingles have a Jaccard similarity of ``THRESHOLD`` or more.  Words
are what white space separates.  A text of one to four words is one shingle; texts without words have none and are
linked to nothing.

1. Equal texts become one representative (smallest id) with a count; only representatives go on.
2. Each representative has ``HASHES`` MinHash values in ``BANDS`` bands.  Representatives that agree in a band are
   joined by a star to the band bucket's smallest id, never pair by pair, and stars merge into candidate groups:
   every pair that agrees in some band lies within one group.
3. A group is cut into chunks of bounded text; a task gets two chunks and looks at the pairs between them.
   MinHash values are compared ``STEP`` at a time.  With a uniform prior the similarity after m of n agreements has a
   Beta posterior; a pair is dropped once P(similarity >= THRESHOLD) < ``TOLERANCE``.  The rest are verified exactly on
   the shingle sets.  A task returns link counts and a spanning forest of its links, not the pairs.
4. Counts add up to each text's number of links; the forests' edges give the classes.

A pair at the threshold is missed by the bands with probability below 1e-5 and dropped wrongly with at most
HASHES / STEP * TOLERANCE; both fall steeply above it.

Defined cases: a null text is empty; equal texts, also empty ones, are copies of each other: each counts the others as
links and shares their class; repeated rows are copies; null ids are kept and never represent others unless all ids of
the text are null; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrid.core import store

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
STEP, TOLERANCE = 20, 1e-9
CHUNK_CHARS = 4_000_000
CHUNK_DOCS = 512
"""A task compares two chunks of at most about this much text and this many documents."""
_SEED = np.random.default_rng(20)
_MULTIPLY = (_SEED.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_ADD = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64)[:, None]


class Shingles:
    """64-bit hashes of a text's distinct five-word shingles; each distinct word is hashed once while remembered."""

    KEPT = 300_000

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def of(self, text: str) -> np.ndarray:
        known, parts = self.known, text.split()
        if not parts:
            return np.zeros(0, np.uint64)
        if len(known) > self.KEPT:
            known.clear()
        values = []
        for w in parts:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(w) <= 64:
                    known[w] = h
            values.append(h)
        x = np.array(values, np.uint64)
        n = max(1, len(x) - self.words + 1)
        with np.errstate(over="ignore"):
            out = np.zeros(n, np.uint64)
            for i in range(min(self.words, len(x))):
                out = (out ^ x[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return np.unique(out)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits; large sets are taken in blocks."""
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            h = (shingles[None, at:at + 4096] * _MULTIPLY + _ADD) >> np.uint64(32)
            np.minimum(out, h.min(1).astype(np.uint32), out=out)
    return out


@functools.cache
def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values: the fewest agreements with P(similarity >= threshold) >= tolerance.

    With a uniform prior P(s >= t | m of n) is P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 2):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def node_of(key: Column) -> Column:
    """64-bit name of a text; n texts share one by chance n^2 / 2^65 times."""
    return F.xxhash64(key)


def representatives(docs: DataFrame) -> DataFrame:
    """text_key, node, rep, copies, chars: one row per distinct text."""
    return (docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.length("text").alias("chars"))
            .groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                     F.coalesce(F.max("chars"), F.lit(0)).alias("chars"))
            .withColumn("node", node_of(F.col("text_key"))))


def band_keys(docs: DataFrame) -> DataFrame:
    """node, band, bucket of every distinct text with words: a bucket is the hash of a band's values.

    Copies that one task meets again are skipped (within a bounded memory); others only repeat a row.
    """
    def run(frames):
        make, seen = Shingles(), set()
        bands = np.arange(BANDS, dtype=np.int16)
        for pdf in frames:
            nodes, keys = [], []
            for node, text in zip(pdf["node"].tolist(), pdf["text"]):
                if node in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                sh = make.of(text or "")
                if len(sh):
                    sig = minhash(sh).reshape(BANDS, ROWS).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        key = np.zeros(BANDS, np.uint64)
                        for r in range(ROWS):
                            key = (key ^ sig[:, r]) * np.uint64(0xD6E8FEB86659FD93)
                            key ^= key >> np.uint64(32)
                    nodes.append(node)
                    keys.append(key.astype(np.int64))
            if nodes:
                yield pd.DataFrame({"node": np.repeat(np.array(nodes, np.int64), BANDS), "band": np.tile(bands, len(nodes)),
                                    "bucket": np.concatenate(keys)})

    named = docs.select(node_of(text_key(F.col("text"))).alias("node"), "text")
    return named.mapInPandas(run, "node long, band short, bucket long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: one node of each connected component for all of its nodes.

    Each round renames every node to the smallest node around it (aggregated before the shuffle) and keeps the edges
    whose ends still differ, so a star is gone after one round and edges only become fewer.  Nodes are hashes, so a
    long chain falls by a constant share a round.  Every round's edges are a written table.
    """
    pairs = store(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    roots = None
    while True:
        ends = pairs.select(F.col("a").alias("node"), "b").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("b")))
        label = store(ends.groupBy("node").agg(F.least("node", F.min("b")).alias("label")))
        if roots is None:
            roots = label.withColumnRenamed("label", "root")
        else:
            roots = roots.join(label.withColumnRenamed("node", "root"), "root", "left").select(
                "node", F.coalesce("label", "root").alias("root"))
        renamed = pairs.join(label.withColumnRenamed("node", "a").withColumnRenamed("label", "la"), "a").join(
            label.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b")
        pairs = store(renamed.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a <> b").distinct())
        if pairs.isEmpty():
            return roots


def candidate_groups(docs: DataFrame) -> DataFrame:
    """node, root of texts that share a band with another one."""
    keys = store(band_keys(docs))
    low = (keys.groupBy("band", "bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
           .where("low <> high").drop("high"))
    stars = keys.join(low, ["band", "bucket"]).where("node <> low").select("node", "low").distinct()
    return components(stars, "node", "low")


def chunked(members: DataFrame) -> DataFrame:
    """members + chunk, chunks: a group's texts dealt to chunks of bounded size."""
    load = F.greatest(F.sum("chars") / CHUNK_CHARS, F.count(F.lit(1)) / CHUNK_DOCS)
    sizes = members.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(load)).cast("int").alias("chunks"))
    return members.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def chunk_pairs(texts: DataFrame) -> DataFrame:
    """root, i, j, chunk, node, copies, text: every text once per pair (i <= j) of chunks that has its chunk."""
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    return (texts.select("root", "node", "copies", "text", "chunk", other)
            .select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "copies", "text"))


def _union_forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join something new, in order."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
            if len(out) == n - 1:
                break
    return out


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of positions with similarity >= THRESHOLD, x from left and y from right (or x before y in left)."""
    sig = np.stack([minhash(s) for s in sets])
    need = fewest_matches()
    num, den = 4, 5  # THRESHOLD as a fraction: 5 * common >= 4 * union
    assert num / den == THRESHOLD
    found_x, found_y = [], []
    sizes = np.array([len(s) for s in sets])
    for at in range(0, len(left), 64):
        rows = left[at:at + 64]
        cols = left if right is None else right
        x, y = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
        ok = (x < y) if right is None else np.ones(len(x), bool)
        lo, hi = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
        ok &= den * lo >= num * hi  # no overlap can reach the threshold otherwise
        x, y = x[ok], y[ok]
        match = np.zeros(len(x), np.int32)
        for n in range(STEP, HASHES + 1, STEP):
            match += (sig[x, n - STEP:n] == sig[y, n - STEP:n]).sum(1, dtype=np.int32)
            stay = match >= need[n]
            x, y, match = x[stay], y[stay], match[stay]
            if not len(x):
                break
        found_x.append(x)
        found_y.append(y)
    x, y = np.concatenate(found_x), np.concatenate(found_y)
    if not len(x):
        return x, y
    common = _common(sets, x, y)
    good = den * common >= num * (sizes[x] + sizes[y] - common)
    return x[good], y[good]


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact number of shared shingles of each pair.

    Shingles held by one document cannot be shared; the others become columns of a bit matrix, whose rows are
    compared a block of pairs at a time.
    """
    used = np.unique(np.concatenate([x, y]))
    lengths = np.array([len(sets[i]) for i in used])
    every = np.concatenate([sets[i] for i in used])
    value, back, count = np.unique(every, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[back]
    row = np.repeat(np.arange(len(used)), lengths)
    keep = column >= 0
    width = int((count > 1).sum())
    place = np.zeros(int(used.max()) + 1, np.int64)
    place[used] = np.arange(len(used))
    px, py = place[x], place[y]
    out = np.zeros(len(x), np.int64)
    order = np.argsort(column[keep], kind="stable")
    col, rows = column[keep][order], row[keep][order]
    block = min(max(64, min(1 << 15, (32 << 20) // max(1, len(used))) // 64 * 64), -(-width // 64) * 64)
    for at in range(0, width, block):
        lo, hi = np.searchsorted(col, [at, at + block])
        bits = np.zeros((len(used), block), np.uint8)
        bits[rows[lo:hi], col[lo:hi] - at] = 1
        words = np.packbits(bits, axis=1).view(np.uint64)
        filled = np.flatnonzero(words.any(1))
        mask = np.zeros(len(used), bool)
        mask[filled] = True
        live = np.flatnonzero(mask[px] & mask[py])
        step = max(1, (8 << 20) // words.shape[1] // 8)
        for k in range(0, len(live), step):
            p = live[k:k + step]
            out[p] += np.bitwise_count(words[px[p]] & words[py[p]]).sum(1, dtype=np.int64)
    return out


LINKS = "node long, other long, links long"


def verify(blocks: DataFrame) -> DataFrame:
    """node, other, links: per task and node its number of links (other null), and forest edges (links null)."""
    def run(key, pdf):
        pdf = pdf.drop_duplicates(["node", "chunk"]).sort_values("node", ignore_index=True)
        make = Shingles()
        sets = [make.of(t or "") for t in pdf["text"]]
        node, copies, chunk = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["chunk"].to_numpy()
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        if i == j:
            x, y = linked_pairs(sets, np.arange(len(sets)), None)
        else:
            left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            x, y = linked_pairs(sets, left, right) if len(left) and len(right) else (np.zeros(0, np.int64),) * 2
        links = np.bincount(x, copies[y], len(node)) + np.bincount(y, copies[x], len(node))
        some = np.flatnonzero(links > 0)
        forest = _union_forest(len(node), x, y)
        return pd.DataFrame({
            "node": [*node[some], *(node[a] for a, _ in forest)],
            "other": pd.array([None] * len(some) + [int(node[b]) for _, b in forest], "Int64"),
            "links": pd.array([*links[some].astype(np.int64)] + [None] * len(forest), "Int64")})

    return blocks.groupBy("root", "i", "j").applyInPandas(run, LINKS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, rep, class_key, class_id, n_links of every row.

    rep is the smallest id with the same text, class_id the smallest of the linked class, class_key the class's own
    name (ids may repeat), n_links the number of other rows with similarity >= THRESHOLD, copies included.
    """
    reps = store(representatives(docs))
    groups = store(candidate_groups(docs))
    members = chunked(groups.join(reps.select("node", "rep", "copies", "chars"), "node"))
    placed = members.select(F.col("node").alias("_n"), F.col("rep").alias("_r"), "root", "copies", "chunk", "chunks")
    named = docs.select("doc_id", "text", node_of(text_key(F.col("text"))).alias("node"))
    texts = named.join(placed, F.expr("doc_id <=> _r and node = _n"))
    found = store(verify(chunk_pairs(texts)))
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("near"))
    named_reps = (reps.join(components(edges), "node", "left").join(links, "node", "left")
                  .withColumn("class_key", F.coalesce("root", "node")))
    classes = named_reps.groupBy("class_key").agg(F.min("rep").alias("class_id"))
    by_text = named_reps.join(classes, "class_key").select(
        "text_key", "rep", "class_key", "class_id", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key")).join(by_text, "text_key").select(
        "doc_id", "text_key", "rep", "class_key", "class_id", "n_links")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row (smallest id) of each class of linked texts."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    keep = near_duplicates(docs).groupBy("class_key").agg(first).select(F.col("first.doc_id").alias("_d"), F.col("first.text_key").alias("_t"))
    named = docs.withColumn("_text_key", text_key(F.col("text")))
    return (named.join(store(keep), F.expr("doc_id <=> _d and _text_key = _t"), "left_semi")
            .dropDuplicates(["doc_id", "_text_key"]).drop("_text_key"))
