"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join.

Listed canonical URLs are ``host/path`` strings.  A rule fits its host, every subdomain and every path that
starts with its own; the longest fitting rule wins (equal lengths: the longer host, then ``block``).

A URL has one candidate string per *shape* (number of host labels, path length) that occurs in the list.  The
filter is tested inside the scan, before any shuffle; the few candidates that pass meet the list in an exact equi
join, which removes the filter's false positives.  DataFrame functions only.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no rule; repeated page rows are
each judged; an empty list gives every page the default verdict; null and repeated rules count once; columns of the
inputs other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 8
"""64-bit words of a block; every key sets one bit in each word of its one block."""
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 32 * 1024 * 1024
"""Size bound of the filter that goes to every task; a longer list only makes it pass more false positives."""
LIST_BROADCAST_BYTES = 64 * 1024 * 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; the host's A-Z are lowered."""
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule, verdict, rule_labels, rule_path, rule_host) of a list with columns rule and verdict."""
    host = F.regexp_extract("rule", "^[^/]*", 0)
    return (rules.where("rule is not null and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
            .select("rule", "verdict", F.size(F.split(host, r"\.")).alias("rule_labels"),
                    (F.length("rule") - F.length(host)).alias("rule_path"), F.length(host).alias("rule_host")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int") * BLOCK_WORDS


def _bit(key: Column, word: int) -> Column:
    at = F.shiftright(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def build_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row, column ``bits``: the words of all blocks in order."""
    words = F.array(*[F.struct((_block(F.col(key), blocks) + w).alias("at"), _bit(F.col(key), w).alias("bit"))
                      for w in range(BLOCK_WORDS)])
    filled = keys.select(F.inline(words)).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    empty = keys.sparkSession.range(blocks * BLOCK_WORDS).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("bigint").alias("bits"))
    dense = empty.unionByName(filled).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("bits"))


def maybe_listed(key: Column, words: Column) -> Column:
    """Blocked Bloom test on the words of the key's block: false only for keys that are not in the list."""
    hit = F.lit(True)
    for w in range(BLOCK_WORDS):
        bit = _bit(key, w)
        hit = hit & (F.get(words, w).bitwiseAND(bit) == bit)
    return hit


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys + url, host, path, rule, verdict: one row per row of ``pages``."""
    listed = rule_table(rules)
    n = listed.count()
    blocks = max(1, min(-(-n * BITS_PER_KEY // (64 * BLOCK_WORDS)), MAX_FILTER_BYTES // (8 * BLOCK_WORDS)))
    bits = build_filter(listed, "rule", blocks).scalar()
    shapes = listed.agg(F.collect_set(F.struct("rule_labels", "rule_path")).alias("shapes")).scalar()

    host, path = url_parts(F.col("url"))
    row = [*keys, "url", "host", "path"]
    urls = (pages.select(*keys, "url", host.alias("host"), path.alias("path"))
            .withColumn("labels", F.split("host", r"\.")).withColumn("shapes", shapes))
    fits = F.filter("shapes", lambda s: (s["rule_labels"] <= F.size("labels")) & (s["rule_path"] <= F.length("path")))
    candidates = F.transform(fits, lambda s: F.concat(
        F.array_join(F.slice("labels", -s["rule_labels"], s["rule_labels"]), "."), F.substring("path", F.lit(1), s["rule_path"])))
    # Rows of one page stay in their task, so this aggregate combines before the shuffle: one row per page crosses it.
    tested = (urls.select(*row, F.posexplode_outer(candidates).alias("nth", "key"))
              .withColumn("words", F.slice(bits, _block(F.col("key"), blocks) + 1, BLOCK_WORDS))
              .groupBy(*row).agg(F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("copies"),
                                 F.collect_set(F.when(maybe_listed(F.col("key"), F.col("words")), F.col("key"))).alias("possible")))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    clean = (tested.where(F.size("possible") == 0)
             .select(*row, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), copy).drop("copy"))
    right = F.broadcast(listed) if n * 256 <= LIST_BROADCAST_BYTES else listed
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("rule").alias("l"), "rule_host", "verdict", "rule")))
    hits = (tested.where(F.size("possible") > 0).select(*row, "copies", F.explode("possible").alias("rule"))
            .join(right, "rule", "left")
            .groupBy(*row, "copies").agg(best.alias("best"))
            .select(*row, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), copy).drop("copy"))
    return clean.unionByName(hits)
