"""Byte-level BPE by two tiers: a minimal perfect hash for known pre-tokens, a heap over linked bytes for the rest.

Ids equal those of the reference library for the same ranks and pattern: every pattern match is encoded on its own, a
match that is a vocabulary entry is that entry, any other merges its adjacent parts lowest rank first, leftmost first.

Defined cases: a null text is empty and has no ids; every row is encoded, repeated rows alike; very long matches cost
O(n log n); special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

CACHE_UNITS = 300_000
"""Encoded units kept per Python worker in each of two generations; a bound on memory, never on results."""
_ODD_SPACE = re.compile("  |[\x1c-\x1f]")


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token and id per line)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(i) for _, i in pairs))
    for token, i in pairs:
        tokens[int(i)] = base64.b64decode(token)
    return tokens


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: level by level, keys alone in their slot take it.

    ``slots(keys)`` is a bijection of the built keys onto 0..n-1; a foreign key gets -1 or any slot.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        self.levels: list[np.ndarray] = []
        rest, placed, seed = np.asarray(keys, np.uint64), 0, 1
        while len(rest):
            size = max(1, int(gamma * len(rest)))
            at = (_mix(rest, seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            table = np.full(size, -1, np.int32)
            taken = np.sort(at[alone])
            table[taken] = placed + np.arange(len(taken), dtype=np.int32)
            self.levels.append(table)
            placed, rest, seed = placed + len(taken), rest[~alone], seed + 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        for seed, table in enumerate(self.levels, 1):
            if not len(open_):
                break
            got = table[(_mix(keys[open_], seed) % np.uint64(len(table))).astype(np.int64)]
            out[open_] = got
            open_ = open_[got < 0]
        return out


def merge_bytes(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of candidate merges over a doubly linked list of its bytes."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here
    prev = list(range(-1, n - 1))
    get = rank.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, j = pop(heap)
        m = end[i]
        if m <= 0 or m >= n or end[m] != j:  # a part has changed since
            continue
        end[i], end[m] = j, 0
        if j < n:
            prev[j] = i
            if (r := get(piece[i:end[j]])) is not None:
                push(heap, (r, i, end[j]))
        if (p := prev[i]) >= 0 and (r := get(piece[p:j])) is not None:
            push(heap, (r, p, j))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i:end[i]]])
        i = end[i]
    return out


class ByteEncoder:
    def __init__(self, path: str, pattern: str):
        import regex

        self.tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(self.tokens) if t}
        ids = np.array(list(self.rank.values()), np.int64)
        keys = np.array([xxhash.xxh64_intdigest(t) for t in self.rank], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two vocabulary entries share a 64-bit key")
        self.hash = PerfectHash(keys)
        self.id_of_slot = np.zeros(len(ids), np.int64)
        self.id_of_slot[self.hash.slots(keys)] = ids
        self.matches = regex.compile(pattern).findall
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.units: list[dict[str, bytes]] = [{}, {}]
        self.pieces: list[dict[str, bytes]] = [{}, {}]

    def whole_words(self, pieces: list[bytes]) -> list[int]:
        """Vocabulary id of each piece, -1 where it is no entry: the first tier."""
        if not pieces:
            return []
        slot = self.hash.slots(np.array([xxhash.xxh64_intdigest(p) for p in pieces], np.uint64))
        ids = np.where(slot >= 0, self.id_of_slot[slot], -1).tolist()
        return [i if i >= 0 and self.tokens[i] == p else -1 for p, i in zip(pieces, ids)]

    def _learn(self, units: set[str]) -> None:
        """Encode units that are not remembered, all their new pre-tokens at once."""
        parts = {u: self.matches(u) for u in units}
        seen, old = self.pieces
        fresh = []
        for p in {p for found in parts.values() for p in found}:
            if p not in seen:
                if p in old:
                    seen[p] = old[p]
                else:
                    fresh.append(p)
        raw = [p.encode("utf-8") for p in fresh]
        for p, b, i in zip(fresh, raw, self.whole_words(raw)):
            seen[p] = np.array([i] if i >= 0 else merge_bytes(b, self.rank), "<u4").tobytes()
        for u, found in parts.items():
            self.units[0][u] = b"".join([seen[p] for p in found])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.  Units (a space and what follows up to the next) are encoded apart, as no match crosses them."""
        for name in ("units", "pieces"):
            cache = getattr(self, name)
            if len(cache[0]) > CACHE_UNITS:
                cache[:] = [{}, cache[0]]
        rows = []
        for text in texts:
            if _ODD_SPACE.search(text):
                rows.append(self.matches(text))  # runs of spaces: units would cut a match, pre-tokens do not
            else:
                first, *rest = text.split(" ")
                rows.append([first, *[" " + u for u in rest]] if rest else [first])
        seen, old = self.units
        new: set[str] = set()
        for row in rows:
            for u in row:
                if u not in seen:
                    if u in old:
                        seen[u] = old[u]
                    else:
                        new.add(u)
        self._learn(new)
        out = [np.frombuffer(b"".join(map(seen.__getitem__, row)), "<u4") for row in rows]
        for cache in (self.units, self.pieces):
            for u in [u for u in new if len(u) > 256]:
                cache[0].pop(u, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def encoder(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(path, pattern)


def _batches(pdf: pd.DataFrame, chars: int = 1 << 20):
    """Row positions in runs of about ``chars`` characters."""
    run, size = [], 0
    for i, text in enumerate(pdf["text"]):
        run.append(i)
        size += len(text or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_ids(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids: the token ids of every text."""
    def run(frames):
        enc = encoder(ranks, pattern)
        for pdf in frames:
            texts, docs_ = pdf["text"].tolist(), pdf["doc_id"]
            for at in _batches(pdf):
                ids = enc.encode_batch([texts[i] or "" for i in at])
                yield pd.DataFrame({"doc_id": docs_.iloc[at].astype("Int64"), "ids": [x.astype(np.int32) for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids."""
    def run(frames):
        enc = encoder(ranks, pattern)
        decimal = enc.decimal.__getitem__
        for pdf in frames:
            texts, docs_ = pdf["text"].tolist(), pdf["doc_id"]
            for at in _batches(pdf):
                rows = []
                for ids in enc.encode_batch([texts[i] or "" for i in at]):
                    ids = ids.tolist()
                    rows.append((len(ids), hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest(),
                                 hashlib.sha256(enc.decode(ids)).hexdigest()))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                out.insert(0, "doc_id", docs_.iloc[at].astype("Int64").to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
