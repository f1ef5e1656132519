"""Spelling variant grouping by permuterm rotations.

Words are the runs of letters of all texts, each run with a fixed chance of 1 in ``NOISE`` short of one letter (a
deterministic noise that a hash of document and run decides), with at least ``MIN_LETTERS`` code points and ``MIN_SEEN``
occurrences.  Two words are near when one inserted, deleted or replaced code point turns one into the other.

* All rotations of word + "$" are formed.  In the sorted rotations, a word's own rotation "b$a" is followed by the
  rotations "b$ac" of the words a + c + b, and those of equal length differ from each other in c alone.  So a rotation
  without its last code point is the prefix range in which a word meets its replacements at that place and the word
  without it.
* Rows (prefix, what it leaves out, word) are dealt and sorted by prefix and each range is scanned.  The "$" fixes the
  place, so a range holds at most one whole rotation and one row per letter that may be left out: at most 91 rows,
  whatever the corpus.  A doubled letter can be left out at either place; only the first counts for indels.
* Every member takes the number and the best of its neighbours in the range; no pairs are stored.
* Forms are followed to their roots by pointer doubling; occurrences at least double from form to form.

Words are numbered in code-point order, so ties need no strings.  Prefixes of more than ``LONG`` code points are named by a
polynomial hash modulo 2**127 - 1 of random base, so that very long words cost their length and not its square.

Defined cases: a null text has no words; a null id is the empty text in the hash; repeated rows count again; an empty table
gives no rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import store

NOISE = 97
MIN_LETTERS = 5
MIN_SEEN = 3
LONG = 64
KEPT_WORDS, KEPT_CHARS = 200_000, 8_000_000
"""Words a task counts before it passes its counts on; a bound on memory, never on results."""
WHOLE, AGAIN, FIRST = 0, 1, 2
"""A row is a whole rotation, or leaves out a letter that equals the one before it, or any other letter."""
_RUNS = re.compile("[a-zÀ-ÿ]+")
_PRIME = 2**127 - 1
_BASE = 0x5A8F_31C6_0B7D_E942_13F5_78AC_96E0_4D2B


def noisy(doc: str | None, run: str, start: int | None = None) -> str:
    """The run, or the run without one code point where NOISE divides the CRC of "doc:run"."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc or ''}:".encode()) if start is None else start)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words with at least MIN_LETTERS code points and MIN_SEEN occurrences."""
    def run(frames):
        total, chars = Counter(), 0
        for pdf in frames:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                body = (text or "").encode().lower().decode()  # bytes lower A-Z only
                start = zlib.crc32(f"{doc or ''}:".encode())
                for r, n in Counter(m.group() for m in _RUNS.finditer(body)).items():
                    word = noisy(doc, r, start)
                    if len(word) >= MIN_LETTERS:
                        if word not in total:
                            chars += len(word)
                        total[word] += n
                if len(total) > KEPT_WORDS or chars > KEPT_CHARS:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total, chars = Counter(), 0
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    # ids as text, so that pandas keeps integers beside a null
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = named.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_SEEN)


def rotations(word: str) -> Iterator[tuple[str, int]]:
    """(prefix, kind): rotations of word + "$" without their last code point, and whole ones."""
    turned, n = f"{word}${word}", len(word)  # every rotation is a stretch of this
    if n >= LONG:
        power = list(itertools.accumulate(range(n + 1), lambda p, _: p * _BASE % _PRIME, initial=1))
        sums = list(itertools.accumulate(map(ord, turned), lambda s, c: (s * _BASE + c) % _PRIME, initial=0))

    def stretch(at: int, size: int) -> str:
        if size <= LONG:
            return turned[at:at + size]
        return f"{size}#{(sums[at + size] - sums[at] * power[size]) % _PRIME:x}"

    for i in range(n):
        yield stretch(i + 1, n), AGAIN if i and word[i] == word[i - 1] else FIRST
    for i in range(n + 1):
        yield stretch(i, n + 1), WHOLE


def prefix_rows(words: DataFrame) -> DataFrame:
    """prefix, kind, wid, n of every word (wid, word, n)."""
    def run(frames):
        for pdf in frames:
            prefix, kind, wid, seen = [], [], [], []
            for i, word, n in zip(pdf["wid"].tolist(), pdf["word"], pdf["n"].tolist()):
                for p, k in rotations(word):
                    prefix.append(p)
                    kind.append(k)
                wid += [i] * (len(prefix) - len(wid))
                seen += [n] * (len(prefix) - len(seen))
                if len(prefix) > 50_000:
                    yield pd.DataFrame({"prefix": prefix, "kind": kind, "wid": wid, "n": seen})
                    prefix, kind, wid, seen = [], [], [], []
            yield pd.DataFrame({"prefix": prefix, "kind": kind, "wid": wid, "n": seen})

    return words.select("wid", "word", "n").mapInPandas(run, "prefix string, kind byte, wid long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """wid, n_near, best (n, and -wid so that the smallest word wins ties) of the words that have near ones."""
    ranges = prefix_rows(words).groupBy("prefix").agg(F.collect_list(F.struct("kind", "n", "wid")).alias("range")).where(F.size("range") > 1)

    def near(y):
        both_leave_out = (F.col("x.kind") != WHOLE) & (y["kind"] != WHOLE) & (y["wid"] != F.col("x.wid"))
        indel = F.least(F.col("x.kind"), y["kind"]).eqNullSafe(WHOLE) & F.greatest(F.col("x.kind"), y["kind"]).eqNullSafe(FIRST)
        return both_leave_out | indel

    met = ranges.select(F.explode("range").alias("x"), "range").select("x.wid", F.transform(
        F.filter("range", near), lambda y: F.struct(y["n"].alias("n"), (-y["wid"]).alias("back"))).alias("near"))
    return (met.where(F.size("near") > 0).groupBy("wid")
            .agg(F.sum(F.size("near")).alias("n_near"), F.max(F.array_max("near")).alias("best")))


def follow(forms: DataFrame) -> DataFrame:
    """wid, root: the last of the forms (wid, form) after each other."""
    ways = store(forms.select("wid", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("wid").alias("root"), F.col("root").alias("_next"))
        longer = store(ways.join(ahead, "root", "left").select("wid", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        ways = longer.select("wid", "root")
        if longer.where("_moved").isEmpty():
            return ways


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    form is the near word with most occurrences (ties: first in code-point order) if it has at least twice the word's
    own, root the last word on following forms.
    """
    words = store(word_counts(docs).orderBy("word").withColumn("wid", F.monotonically_increasing_id()))
    best = store(words.join(neighbours(words), "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= 2 * F.col("n"), F.struct(F.col("best.n").alias("n"), (-F.col("best.back")).alias("wid"))).alias("form")))
    formed = best.where("form is not null").select("wid", F.col("form.wid").alias("form"), F.col("form.n").alias("form_n"))
    name = words.select(F.col("wid").alias("_w"), "word")
    named = (formed.join(follow(formed), "wid")
             .join(name.withColumnRenamed("word", "form_word"), F.col("form") == F.col("_w")).drop("_w")
             .join(name.withColumnRenamed("word", "root_word"), F.col("root") == F.col("_w")).drop("_w")
             .select("wid", F.col("form_word").alias("_form"), F.col("root_word").alias("_root"), "form_n"))
    return best.drop("form").join(named, "wid", "left").select(
        "word", F.col("_form").alias("form"), F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
