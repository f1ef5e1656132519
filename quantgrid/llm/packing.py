"""Sequence packing: dominance reduction fixes provably best small sets, best-fit packs the rest.

A document's token ids are followed by one end id and cut into pieces of at most ``capacity`` tokens.  Only the
histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) is planned on the driver:

* *Reduction* (after Martello and Toth): for a length w with room r = capacity - w, a set {w, ...} of up to three
  pieces is fixed for good when it dominates every feasible set with w: nothing else fits; a piece fills r exactly;
  only one more piece fits and the largest is taken; or two more fit at most and no other pair beats the taken one
  position by position.
* The remaining counts are packed best-fit in decreasing length.

The plan says which ranks of a length go to which sequences.  Pieces get their rank per (length, salt) with the salts'
offsets added, so a length that many pieces share is never ordered in one task.

Defined cases: a null text counts as empty; an empty text is the end id alone; repeated rows are packed each; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import store

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 300_000
"""Words and chunks kept per Python worker in each of two generations; a bound on memory, never on results."""
ROWS_PER_RANK_GROUP = 500
"""Least rows of a salted group; groups of a length grow with the root of its count, as does their number."""

_ODD = re.compile("[\x1c-\x1f\u0130\u0180-\u200f\u2028-\U0010ffff]")


class WordEncoder:
    """Ids of whole texts by a lower-casing word tokenizer, as little-endian 32-bit integers.

    White space separates words for good in this tokenizer, so a text is the concatenation of its chunks and a chunk
    the concatenation of its words; each distinct word goes through the library's model once while it is remembered.
    Texts with characters outside Latin scripts (or special-token brackets) take the library's whole pipeline.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.chunks: list[dict[str, bytes]] = [{}, {}]
        self.known: list[dict[str, bytes]] = [{}, {}]

    @staticmethod
    def _keep(cache: list[dict[str, bytes]], key: str, value: bytes) -> bytes:
        if len(cache[0]) >= CACHE_WORDS:
            cache[:] = [{}, cache[0]]
        cache[0][key] = value
        return value

    def _word(self, w: str) -> bytes:
        found = self.known[0].get(w)
        if found is not None:
            return found
        found = self.known[1].get(w)
        if found is None:
            shown = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letter)
            found = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return self._keep(self.known, w, found) if len(w) <= 64 else found

    def _chunk(self, c: str) -> bytes:
        found = self.chunks[1].get(c)
        if found is None:
            found = self._word(c) if c.isalpha() and c.isascii() else b"".join([self._word(w) for w in self.words(c)])
        return self._keep(self.chunks, c, found) if len(c) <= 64 else found

    def encode(self, text: str) -> bytes:
        if "<|" in text or _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts, chunk = text.lower().split(), self._chunk
        get = self.chunks[0].get
        out = []
        for c in parts:
            b = get(c)
            if b is None:
                b = chunk(c)
                get = self.chunks[0].get
            out.append(b)
        return b"".join(out)


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token pieces."""
    def cut(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = enc.encode(text or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


def reduce_lengths(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fix dominating sets; removes them from ``counts`` and returns [(lengths with uses, number of sequences)]."""
    sizes = sorted(n for n, c in counts.items() if c > 0)
    fixed = []

    def largest(room: int, used: list[int]) -> int | None:
        """Largest remaining length that fits beside the used ones."""
        i = bisect_left(sizes, room + 1) - 1
        while i >= 0 and counts[sizes[i]] - used.count(sizes[i]) <= 0:
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest(k: int, used: list[int], above: int = 0) -> list[int]:
        """The k smallest remaining lengths over ``above``, with repeats."""
        out, i = [], bisect_left(sizes, above + 1)
        while i < len(sizes) and len(out) < k:
            out += [sizes[i]] * min(k - len(out), max(0, counts[sizes[i]] - used.count(sizes[i])))
            i += 1
        return out

    for w in sizes[::-1]:
        while counts[w] > 0:
            room, chosen = capacity - w, None
            a = largest(room, [w])
            low = smallest(3, [w])
            if a is None:
                chosen = [w]
            elif a == room or len(low) < 2 or low[0] + low[1] > room:
                chosen = [w, a]
            elif len(low) < 3 or sum(low) > room:
                b = largest(room - a, [w, a])
                floor = smallest(2, [w], b or 0)
                if len(floor) < 2 or sum(floor) > room:
                    chosen = [w, a] + ([b] if b else [])
            if chosen is None:
                break
            uses = {n: chosen.count(n) for n in chosen}
            times = min(counts[n] // u for n, u in uses.items())
            for n, u in uses.items():
                counts[n] -= u * times
            fixed.append((list(uses.items()), times))
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on a histogram: equal sequences are handled together."""
    rooms: list[int] = []
    groups: dict[int, list[list]] = {}  # room left -> [pattern, number]
    done: list[tuple[list[tuple[int, int]], int]] = []

    def put(room: int, pattern: list[tuple[int, int]], number: int) -> None:
        if number:
            if room == 0:
                done.append((pattern, number))
                return
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append([pattern, number])

    for w in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left = counts[w]
        while left:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, number = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
                bounded = True
            else:
                room, pattern, number, bounded = capacity, [], left, False
            fit = room // w
            full = min(number, left // fit)
            put(room - fit * w, [*pattern, (w, fit)], full)
            left -= full * fit
            rest = number - full
            if rest and left and left < fit:
                put(room - left * w, [*pattern, (w, left)], 1)
                rest, left = rest - 1, 0
            if bounded:
                put(room, pattern, rest)
    return done + [(p, n) for room in groups.values() for p, n in room]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """length, first, until, sequence, uses, offset: ranks [first, until) of a length go to ``sequence`` and on."""
    left = dict(counts)
    patterns = reduce_lengths(left, capacity) + best_fit(left, capacity)
    used: dict[int, int] = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for pattern, number in patterns:
        offset = 0
        for w, uses in pattern:
            rows.append((w, used[w], used[w] + uses * number, sequence, uses, offset))
            used[w] += uses * number
            offset += w * uses
        sequence += number
    if used != dict(counts):
        raise AssertionError("the plan must place every piece")
    return pd.DataFrame(rows, columns=["length", "first", "until", "sequence", "uses", "offset"])


def rank_in_length(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """pieces + rank (from 0) among the pieces of the same length, ordered in salted groups."""
    spark = pieces.sparkSession
    salts = spark.createDataFrame([(n, -(-c // max(ROWS_PER_RANK_GROUP, math.isqrt(c)))) for n, c in counts.items()], "length long, salts long")
    salted = (pieces.join(F.broadcast(salts), "length")  # at most one row per length up to the capacity
              .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt")
    offsets = sizes.select("length", "salt", (F.sum("n").over(before) - F.col("n")).alias("ahead"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (salted.withColumn("nth", F.row_number().over(inside)).join(offsets, ["length", "salt"])
            .withColumn("rank", F.col("ahead") + F.col("nth") - 1).drop("salt", "nth", "ahead"))


PLACED = PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset; every sequence holds at most ``capacity`` tokens."""
    pieces = store(cut_pieces(docs, tokenizer, capacity, end_id))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(counts, capacity).sort_values(["length", "first"])
    steps = {int(n): (g["first"].to_numpy(), g["sequence"].to_numpy(), g["uses"].to_numpy(), g["offset"].to_numpy())
             for n, g in plan.groupby("length")}
    shared = docs.sparkSession.sparkContext.broadcast(steps)  # bounded by the capacity, not by the corpus

    def place(batches):
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for n, at in pdf.groupby("length").indices.items():
                first, seq, uses, off = shared.value[int(n)]
                rank = pdf["rank"].to_numpy()[at]
                i = np.searchsorted(first, rank, side="right") - 1
                sequence[at] = seq[i] + (rank - first[i]) // uses[i]
                offset[at] = off[i] + (rank - first[i]) % uses[i] * int(n)
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)[
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return rank_in_length(pieces, counts).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, PLACED)
