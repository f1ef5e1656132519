"""Exact quantiles and average ranks of groups that may not fit in one task.

Values are first counted per (group, bucket), where a bucket is a fixed monotone
function of the value, so the counts combine map-side and one group is spread
over many tasks.  Running totals of the bucket counts then say in which bucket a
quantile lies, or how many values precede a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, small_side, store

BUCKETS_PER_DOUBLING = 8192
COARSE = 16
"""Buckets per doubling of a quantile's histogram: so few that a task's rows combine, and a bucket still holds a small share."""
NULL_SPREAD = 1024
BUCKET_ROWS = 100_000
"""A bucket that holds more is cut further before its values are ordered in one task."""
HEAVY_ROWS = 50_000
"""Rows of one value that share a reducer when ranks are joined back."""
CUTS = 1024
_BEYOND = 1100 * BUCKETS_PER_DOUBLING  # more than any exponent of a double


def order_bucket(x: ColumnOrName, per_doubling: int = BUCKETS_PER_DOUBLING) -> Column:
    """Bucket number that never decreases with x: log-spaced on both sides of zero."""
    x = as_col(x)
    mag = F.floor(F.log2(F.abs(F.nullif(x, F.lit(0.0)))) * per_doubling) + _BEYOND
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, mag).otherwise(-mag)


def group_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str],
                    probs: Sequence[float]) -> DataFrame:
    """by + ``<col>_q<j>``: linearly interpolated quantiles of the non-NULL values.

    Two scans and no shuffle of the rows: a bucket histogram finds the buckets
    that hold the wanted positions, and only values in those are counted exactly.
    A wanted bucket with more than ``BUCKET_ROWS`` rows is first cut linearly, again
    and again, into intervals that hold fewer, so near-equal values never meet in one task.
    """
    by = list(by)
    known = df
    for k in by:
        known = known.where(F.col(k).isNotNull())
    long = (known.select(*by, F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_f", "_x"))
            .where(F.col("_x").isNotNull())
            .withColumn("_b", order_bucket("_x", COARSE)))
    extent = [F.count(F.lit(1)).alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]

    def positions(p: float) -> tuple[Column, Column, Column]:
        pos = (F.col("_n") - 1) * F.lit(float(p))
        return pos, F.floor(pos), F.ceil(pos)

    def wanted(hist: DataFrame) -> DataFrame:
        hit = F.lit(False)
        for p in probs:
            for k in positions(p)[1:]:
                hit = hit | ((k >= F.col("_end") - F.col("_m")) & (k < F.col("_end")))
        return hist.where(hit).select(*by, "_f", "_b", (F.col("_end") - F.col("_m")).alias("_off"), "_n", "_m", "_lo", "_hi")

    group = Window.partitionBy(*by, "_f")
    hist = (long.groupBy(*by, "_f", "_b").agg(*extent)
            .withColumn("_end", F.sum("_m").over(group.orderBy("_b")))
            .withColumn("_n", F.sum("_m").over(group)))
    near = small_side(wanted(hist))
    large = (F.col("_m") > BUCKET_ROWS) & (F.col("_lo") < F.col("_hi"))
    while not near.where(large).isEmpty():
        share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        part = (long.join(near.where(large).withColumnRenamed("_m", "_all"), [*by, "_f", "_b"])
                .where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
                .withColumn("_cut", F.least(F.floor(share * CUTS), F.lit(CUTS - 1))).withColumnRenamed("_lo", "_from").drop("_hi"))
        inner = Window.partitionBy(*by, "_f", "_b", "_from").orderBy("_cut")
        cut = (part.groupBy(*by, "_f", "_b", "_from", "_off", "_n", "_cut").agg(*extent)
               .withColumn("_end", F.col("_off") + F.sum("_m").over(inner)))
        near = small_side(near.where(~large).unionByName(wanted(cut)))

    inside = Window.partitionBy(*by, "_f", "_b", "_lo").orderBy("_x")
    exact = (long.join(near.drop("_m"), [*by, "_f", "_b"]).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
             .groupBy(*by, "_f", "_b", "_x", "_off", "_n", "_lo").agg(F.count(F.lit(1)).alias("_m"))
             .withColumn("_end", F.col("_off") + F.sum("_m").over(inside)))
    ends = []
    for j, p in enumerate(probs):
        for side, k in zip(("lo", "hi"), positions(p)[1:]):
            hit = (k >= F.col("_end") - F.col("_m")) & (k < F.col("_end"))
            ends.append(F.max(F.when(hit, F.col("_x"))).alias(f"_{side}{j}"))
    each = exact.groupBy(*by, "_f").agg(F.max("_n").alias("_n"), *ends)
    values = []
    for j, p in enumerate(probs):
        pos, lo, hi = positions(p)[0], F.col(f"_lo{j}"), F.col(f"_hi{j}")
        values.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(f"q{j}"))
    table = (each.select(*by, "_f", F.struct(*values).alias("_q")).groupBy(*by)
             .agg(F.map_from_entries(F.collect_list(F.struct("_f", "_q"))).alias("_of")))
    at = {i: F.try_element_at("_of", F.lit(i)) for i in range(len(cols))}
    return table.select(*by, *[at[i][f"q{j}"].alias(f"{c}_q{j}") for i, c in enumerate(cols) for j in range(len(probs))])


def group_medians(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    q = group_quantiles(df, by, cols, [0.5])
    return q.select(*by, *[F.col(f"{c}_q0").alias(f"{c}_med") for c in cols])


def average_rank(df: DataFrame, by: Sequence[str], x: str, rank: str = "rank", size: str = "size") -> DataFrame:
    """df + average rank (1 = smallest) of x among the group's non-NULL values, and their number.

    Ties collapse to one row per value before anything is ordered; ordering then
    happens inside (group, bucket) and the bucket totals supply the offset.  A bucket of more
    than ``BUCKET_ROWS`` values is cut linearly into as many more.  Rows of a value that more than
    ``HEAVY_ROWS`` rows hold are dealt over salts, each with its copy of the value's one rank row.
    """
    by = list(by)
    values = store(df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_m"))
                   .withColumn("_b", order_bucket("_x")))
    wide = small_side(values.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_d"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
                      .where((F.col("_d") > BUCKET_ROWS) & (F.col("_lo") < F.col("_hi"))))
    if wide.isEmpty():
        cut = values.withColumn("_c", F.lit(0).cast("long"))
    else:
        cuts = F.ceil(F.col("_d") / BUCKET_ROWS) * 4
        share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        cut = (values.join(wide, [*by, "_b"], "left")
               .withColumn("_c", F.coalesce(F.least(F.floor(share * cuts), cuts - 1), F.lit(0))).drop("_d", "_lo", "_hi"))
    group = Window.partitionBy(*by)
    offsets = (cut.groupBy(*by, "_b", "_c").agg(F.sum("_m").alias("_s"))
               .select(*by, "_b", "_c",
                       (F.sum("_s").over(group.orderBy("_b", "_c")) - F.col("_s")).alias("_off"),
                       F.sum("_s").over(group).alias(size)))
    inside = Window.partitionBy(*by, "_b", "_c").orderBy("_x")
    ranked = (cut.join(offsets, [*by, "_b", "_c"])
              .withColumn("_end", F.col("_off") + F.sum("_m").over(inside))
              .select(*by, F.col("_x").alias(x), (F.col("_end") - (F.col("_m") - 1) / 2.0).alias(rank), size,
                      F.ceil(F.col("_m") / HEAVY_ROWS).alias("_salts")))
    # Rows without a value match nothing; a hashed extra key keeps them off one reducer, and heavy values too.
    scalars = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    spread = F.xxhash64(*scalars)
    heavy = values.where(F.col("_m") > HEAVY_ROWS)
    if heavy.isEmpty():
        dealt, salts = df, F.lit(1).cast("long")
    else:
        dealt = df.join(small_side(heavy.select(*by, F.col("_x").alias(x), F.ceil(F.col("_m") / HEAVY_ROWS).alias("_salts"))), [*by, x], "left")
        salts = F.coalesce("_salts", F.lit(1).cast("long"))
    dealt = dealt.withColumn("_s", F.when(F.col(x).isNull(), F.pmod(spread, F.lit(NULL_SPREAD))).otherwise(F.pmod(spread, salts))).drop("_salts")
    keyed = ranked.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    return dealt.join(keyed, [*by, x, "_s"], "left").drop("_s")
