"""SimHash near-duplicates: deletion-variant signatures, an equality join on them, verification, components.

A text's fingerprint has a bit set where more than half of the hashes of its four-word shingles have it.  Texts are linked
when their fingerprints differ in at most ``DISTANCE`` bits.

1. Rows with equal fingerprints are one node.
2. The 64 bits are cut into DISTANCE // 2 + 1 segments: at least one of them differs in at most one bit.  Two segments
   that differ in at most one bit agree once the right bit is a wildcard, so a fingerprint is indexed under every
   (segment, wildcard): 64 keys whatever the distance.
3. Fingerprints are dealt and sorted by key.  A task scans the runs of equal keys and verifies the distance of the members
   on all bits.  Of a pair that meets under several keys only the first counts; a run of more than ``SMALL`` members gives
   a spanning forest of its links instead of its pairs.  Runs beyond ``RUN`` members pass through unread and are compared in
   pairs of chunks, each its own task.
4. The links' connected components give every row the smallest id that it reaches.

Defined cases: a null text has no words; texts without words have fingerprint zero and are linked like any other; fewer
than four words are one shingle; repeated rows are rows; a null id represents a component only if all of its ids are
null; very long texts are hashed in slices; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import store
from quantgrid.llm.jaccard import components
from quantgrid.llm.skew import hot_join
from quantgrid.llm.words import slices

WORDS = 4
DISTANCE = 4
SEED = 42
SMALL = 32
RUN = 1 << 14
_LOWER = bytes(0x20 if 0x09 <= c <= 0x0D else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def hashes(text: str | None) -> list[np.ndarray]:
    """XXH64 of the shingles, repeats included, in one array per slice of the text."""
    out, few, digest = [], b"", xxhash.xxh64_intdigest
    for _, piece in slices((text or "").encode().translate(_LOWER), WORDS - 1):
        joined = b" ".join(piece.split())
        if not joined:
            continue
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        if len(ends) >= WORDS:
            out.append(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1:])], np.uint64))
        else:
            few = joined  # with its context, all words so far if these are fewer than WORDS
    return out or ([np.array([digest(few, SEED)], np.uint64)] if few else [])


def fingerprint(text: str | None) -> int:
    """The 64 majority bits, as a signed integer."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes(text):
        for at in range(0, len(h), 1 << 15):
            bits = np.unpackbits(h[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every row."""
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t) for t in pdf["text"]], np.int64)})

    # ids as text in between, so that pandas keeps integers beside a null
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def segments(distance: int = DISTANCE) -> list[int]:
    """Masks of the segments."""
    cuts = np.linspace(0, 64, distance // 2 + 2).round().astype(int).tolist()
    return [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """key, fp: every fingerprint under its 64 one-wildcard segment variants; the wildcard is in a key's low 6 bits."""
    masks = [next(_signed(m & ~(1 << bit)) for m in segments(distance) if m >> bit & 1) for bit in range(64)]
    kept = F.transform(F.array(*map(F.lit, masks)), lambda m, bit: F.xxhash64(bit, m.bitwiseAND(F.col("fp"))).bitwiseAND(-64).bitwiseOR(bit))
    return nodes.select(F.explode(kept).alias("key"), "fp")


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints: each is asked once for those not reached yet."""
    rest, a, b = fps, [], []
    while len(rest):
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            node = open_.pop()
            near = np.bitwise_count(rest ^ node) <= distance
            if near.any():
                hit = rest[near]
                a.append(np.full(len(hit), node))
                b.append(hit)
                open_.extend(hit)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _first_key(diff: np.ndarray, bit: np.ndarray, distance: int) -> np.ndarray:
    """Whether the key with this wildcard is the first under which a pair with these differing bits meets."""
    out = np.zeros(len(diff), bool)
    earlier = np.ones(len(diff), bool)
    for m in segments(distance):
        here = diff & np.uint64(m)
        n = np.bitwise_count(here)
        lowest = (m & -m).bit_length() - 1
        out |= earlier & (n == 0) & (bit == lowest)
        out |= earlier & (n == 1) & (here == np.uint64(1) << bit.astype(np.uint64))
        earlier &= n > 1
    return out


def _run_links(key: np.ndarray, fp: np.ndarray, distance: int):
    """Links among rows sorted by key, runs of equal keys complete."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[starts, len(key)])
    for at, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
        yield forest(np.unique(fp[at:at + n]), distance)
    few = np.repeat((size > 1) & (size <= SMALL), size)
    key, fp = key[few], fp[few]
    for d in range(1, SMALL):
        pair = np.flatnonzero(key[d:] == key[:-d])
        if not len(pair):
            break
        a, b = fp[pair], fp[pair + d]
        diff = a ^ b
        good = (np.bitwise_count(diff) <= distance) & (diff != 0)
        good[good] = _first_key(diff[good], key[pair][good] & 63, distance)
        yield a[good], b[good]


def links(keyed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b, key: linked fingerprints (key null), and members of runs beyond RUN with their key (b null)."""
    def rows(a, b, key):
        return pd.DataFrame({"a": a.view(np.int64), "b": pd.array(b, "Int64"), "key": pd.array(key, "Int64")})

    def run(frames):
        key, fp, long_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for pdf in itertools.chain(frames, [None]):
            if pdf is not None:
                more, its = pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
                if long_key is not None:
                    n = int(np.searchsorted(more, long_key, "right"))
                    yield rows(its[:n], [None] * n, more[:n])
                    more, its = more[n:], its[n:]
                    long_key = None if len(more) else long_key
                key, fp = np.concatenate([key, more]), np.concatenate([fp, its])
                done = int(np.searchsorted(key, key[-1])) if len(key) else 0
            else:
                done = len(key)
            pairs = list(_run_links(key[:done], fp[:done], distance))
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs))
                if len(a):
                    yield rows(a, b.view(np.int64), [None] * len(a))
            key, fp = key[done:], fp[done:]
            if len(key) > RUN:
                yield rows(fp, [None] * len(fp), key)
                long_key, key, fp = int(key[0]), key[:0], fp[:0]

    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long, key long")


def long_run_links(members: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b of links within the runs of (key, a): two chunks of at most about RUN / 2 members meet in a task."""
    def run(pdf):
        a, b = forest(np.unique(pdf["a"].to_numpy().view(np.uint64)), distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sizes = members.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / (RUN / 2)), F.lit(2)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")
    placed = members.join(sizes, "key").withColumn("chunk", chunk)
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk")))
    pairs = placed.select("key", "a", "chunk", other.alias("other")).select(
        "key", "a", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return pairs.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = store(fingerprints(docs))
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = store(links(variants(nodes, distance), distance))
    edges = found.where("key is null").select("a", "b")
    members = found.where("key is not null").select("key", "a")
    if not members.isEmpty():
        edges = edges.unionByName(long_run_links(members, distance))
    # a 64-bit hash of a 64-bit number is a bijection; hashed names let chains of links contract fast
    roots = components(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    named = store(nodes.withColumn("node", F.xxhash64("fp")).join(roots, "node", "left").select(
        "fp", "low", F.coalesce("root", "node").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    facts = store(hot_join(named.select("fp", "component"), lowest, "component").select("fp", "component_id"))
    return hot_join(rows, facts, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
