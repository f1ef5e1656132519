"""Importance resampling towards a target by hashed n-grams: an Aho-Corasick dictionary whose hits carry CRC and length.

Words are maximal runs of digits, A-Z (lower-cased) and anything beyond ASCII.  Features are the runs of one to three
consecutive words joined by one space; a feature's bucket is its CRC-32 modulo ``BUCKETS``.

* *Dictionary*: distinct words, each bounded by a delimiter on both sides, with the payload (CRC, length).
  A worker learns the words that it meets repeatedly, up to ``DICTIONARY_WORDS``, then starts anew; words that it does
  not hold get their payload from their bytes, so the dictionary's content changes no result.
* *Scan*: the automaton runs over about ``BATCH_BYTES`` of delimited text and emits payloads in text order.
* *Composition*: the CRC of "a b" follows from those of "a " and "b" and the length of "b" (a linear shift over GF(2),
  tabulated), so no n-gram is ever put together as a string.

The corpus and the target are scanned once for their bucket counts (one row per task and bucket), then the corpus once
more for every document's sum of gains, which are written.  Ranks come from one range sort of these narrow rows and the
partitions' sizes.

Defined cases: a null text has no words; a null id is the empty text in the hash and comes after other ids in ties; equal
(score, id) keep any order; every row counts and is returned, repeated rows alike; very long texts are taken in slices
that repeat two words; an empty table gives no rows, an empty target gains from smoothing alone.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import store
from quantgrid.llm.words import slices

ORDER = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
BATCH_BYTES = 1 << 20
DICTIONARY_WORDS = 20_000
LONGEST = 64
"""Longer words are not learned."""

_WORD = bytes(c for c in range(256) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)
_NORMAL = bytes(c if c in _WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def normal(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and every delimiter a space."""
    return (text or "").encode().translate(_NORMAL)


def _combine(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@functools.cache
def _doubling(k: int) -> np.ndarray:
    """(4, 256) tables of the shift by 2**k bytes: what a CRC becomes when that many bytes follow."""
    basis = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    if k == 0:
        step = basis[0].copy()
        for _ in range(8):
            step = np.where(step & 1, np.uint32(0xEDB88320) ^ step >> np.uint32(1), step >> np.uint32(1))
        return step[basis & np.uint32(255)] ^ basis >> np.uint32(8)
    half = _doubling(k - 1)
    return _combine(half, _combine(half, basis))


def shift_tables(n: int) -> np.ndarray:
    out = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = _combine(_doubling(k), out)
    return out


@functools.cache
def _short_shifts() -> np.ndarray:
    return np.stack([shift_tables(n) for n in range(LONGEST + 1)])


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC as if n more bytes of zero register followed, so that crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    tables, short = _short_shifts(), np.minimum(n, LONGEST)
    out = (tables[short, 0, crc & 255] ^ tables[short, 1, crc >> 8 & 255] ^ tables[short, 2, crc >> 16 & 255] ^ tables[short, 3, crc >> 24])
    for size in np.unique(n[n > LONGEST]):
        mine = n == size
        out[mine] = _combine(shift_tables(int(size)), crc[mine])
    return out


def _after_space(crc: np.ndarray) -> np.ndarray:
    """CRC of each string with a space appended."""
    c = ~crc
    return ~(_doubling(0)[0][(c ^ np.uint32(0x20)) & np.uint32(255)] ^ c >> np.uint32(8))


def _crc_of(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of each stretch of at most LONGEST bytes: one byte of all of them a step, longest first."""
    order = np.argsort(-length, kind="stable")
    at, left, step = start[order], -length[order], _doubling(0)[0]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(-left[0]) if len(left) else 0):
        m = int(np.searchsorted(left, -j))  # stretches longer than j
        c[:m] = step[(c[:m] ^ text[at[:m] + j]) & np.uint32(255)] ^ c[:m] >> np.uint32(8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~c
    return out


class Dictionary:
    """Delimiter-bounded words in an automaton, each with its CRC and length."""

    def __init__(self, words: int = DICTIONARY_WORDS):
        self.words = words
        self._restart()

    def _restart(self) -> None:
        self.automaton, self.size, self.news = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0, {}
        self.crc, self.length = np.zeros(self.words, np.uint32), np.zeros(self.words, np.int64)

    def learn(self, news: dict[bytes, int]) -> None:
        """Note words with their CRC; they enter the automaton once they are many enough to be worth a new one."""
        self.news |= news
        if len(self.news) < max(256, self.size // 8):
            return
        if self.size + len(self.news) > self.words:
            fresh = dict(itertools.islice(self.news.items(), self.words))
            self._restart()
            self.news = fresh
        for at, (word, crc) in enumerate(self.news.items(), self.size):
            self.automaton.add_word(f" {word.decode('latin-1')} ", at)
            self.crc[at], self.length[at] = crc, len(word)
        self.automaton.make_automaton()
        self.size, self.news = self.size + len(self.news), {}

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(crc, length, end) of every word of a text that starts and ends with a delimiter.

        Words that the dictionary misses get their payload from their bytes; those that it misses twice here it learns.
        """
        raw = np.frombuffer(text, np.uint8)
        inside = raw > 0x20
        start, end = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        crc, length = np.zeros(len(end), np.uint32), np.zeros(len(end), np.int64)
        if self.size:
            hits = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            at, word = np.searchsorted(end, hits[:, 0]), hits[:, 1]
            crc[at], length[at] = self.crc[word], self.length[word]
        missed = np.flatnonzero(length == 0)
        length[missed] = end[missed] - start[missed]
        for i in missed[length[missed] > LONGEST].tolist():
            crc[i] = zlib.crc32(text[start[i]:end[i]])
        missed = missed[length[missed] <= LONGEST]
        crc[missed] = _crc_of(raw, start[missed], length[missed])
        _, first, seen = np.unique(crc[missed], return_index=True, return_counts=True)
        self.learn({text[start[i]:end[i]]: int(crc[i]) for i in missed[first[seen > 1]].tolist()})
        return crc, length, end


@functools.cache
def _dictionary() -> Dictionary:
    return Dictionary()  # one per Python worker, kept from task to task


def _batches(texts) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, context, slice) of about BATCH_BYTES."""
    run, size = [], 0
    for row, text in enumerate(texts):
        for context, piece in slices(normal(text), ORDER - 1, BATCH_BYTES):
            run.append((row, context, piece))
            size += len(piece)
            if size >= BATCH_BYTES:
                yield run
                run, size = [], 0
    if run:
        yield run


def features(texts, dictionary: Dictionary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per batch: (row, bucket, length in words) of every feature of the texts."""
    for batch in _batches(texts):
        ends = np.cumsum([len(p) + 3 for _, _, p in batch])
        crc, length, end = dictionary.payloads(b" " + b" \n ".join(p for _, _, p in batch) + b" ")
        piece = np.searchsorted(ends, end)
        row = np.array([r for r, _, _ in batch])[piece]
        nth = np.arange(len(end)) - np.searchsorted(piece, np.arange(len(batch)))[piece]
        new = nth >= np.array([c for _, c, _ in batch])[piece]
        value = crc
        for words in range(1, ORDER + 1):
            if words > 1:
                value = shifted(_after_space(value[:-1]), length[words - 1:]) ^ crc[words - 1:]
            own = new[words - 1:] & (nth[words - 1:] >= words - 1)
            yield row[words - 1:][own], value[own] % np.uint32(BUCKETS), np.full(int(own.sum()), words)
            if len(value) < 2:
                break


def bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, n: occurrences of all features of all texts."""
    def run(frames):
        total = np.zeros(BUCKETS, np.int64)
        for pdf in frames:
            for _, bucket, _ in features(pdf["text"], _dictionary()):
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})

    return docs.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of its counts s, t and their sums S, T."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _vector(counts: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(frames):
        for pdf in frames:
            words, count, weight = (np.zeros(len(pdf), np.int64) for _ in range(3))
            for row, bucket, size in features(pdf["text"], _dictionary()):
                words += np.bincount(row[size == 1], minlength=len(pdf))
                count += np.bincount(row, minlength=len(pdf))
                weight += np.bincount(row, shared.value[bucket], len(pdf)).astype(np.int64)  # below 2**53: exact
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": words, "n_features": count, "weight": weight})

    # ids as text in between, so that pandas keeps integers beside a null
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, "doc_id string, n_words long, n_features long, weight long").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank counts the drawn from the highest score, else null.

    ``target`` has a column text.  Of the rows with at least ``min_words`` words, ``percent`` of a hundred are drawn (rounded
    down): the highest sums of weight and a Gumbel variate that seed and id fix, which draws without replacement in
    proportion to exp(weight / 1000).
    """
    gain = gains(_vector(bucket_counts(docs)), _vector(bucket_counts(target)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    scored = store(weights(docs, gain)).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    # the input position as last key: no value is too frequent for a range; the position within the sorted table is in the
    # low 33 bits of the increasing id, its partition above
    ordered = scored.withColumn("_at", F.monotonically_increasing_id()).orderBy(
        F.when(F.col("n_words") >= min_words, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "_at")
    table = store(ordered.drop("_at").withColumn("_id", F.monotonically_increasing_id()))
    part, eligible = F.shiftright("_id", 33), F.count_if(F.col("n_words") >= min_words)
    sizes = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), eligible.alias("eligible"))
    drawn = F.floor(F.sum("eligible").over(Window.partitionBy()) * percent / 100)
    before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")  # one row per partition of the sort
    offsets = sizes.select("_part", before.alias("_before"), drawn.alias("_drawn"))
    rank = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return table.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= F.col("_drawn"), rank).alias("rank"))
