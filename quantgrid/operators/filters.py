"""Row filters, recodes and the tradable and universe rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, attach, small_side, tick_window
from quantgrid.operators.pit import asof_last

SHARES = 64


def range_filter(df: DataFrame, start=None, end=None, date: str = "date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start))
    return df if end is None else df.where(F.col(date) <= F.lit(end))


def in_filter(df: DataFrame, **allowed: Sequence) -> DataFrame:
    for c, values in allowed.items():
        df = df.where(F.col(c).isin(list(values)))
    return df


def semi_filter(df: DataFrame, axis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are on the axis."""
    return df.join(axis.select(*keys), list(keys), "left_semi")


def null_filter(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def project_scale_cast(df: DataFrame, keys: Sequence[str], scales: dict[str, float]) -> DataFrame:
    """Keys plus columns divided by their unit, as doubles."""
    return df.select(*keys, *[(F.col(c).cast("double") / F.lit(float(s))).alias(c) for c, s in scales.items()])


def value_map(df: DataFrame, col: str, table: dict, out: str, keep_unmapped: bool = False) -> DataFrame:
    """Recode by a literal table (its size is the caller's code, not the data's)."""
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    new = F.try_element_at(m, F.col(col))
    return df.withColumn(out, F.coalesce(new, F.col(col)) if keep_unmapped else new)


def split_category(df: DataFrame, col: str, retired: str, successors: dict[str, str], default: str,
                   out: str, tick: str = "tick") -> DataFrame:
    """Replace a retired class by the successor the tick ever belonged to, else by a default.

    ``successors`` maps a class the tick may have held to its replacement, first match wins.
    """
    flags = df.groupBy(tick).agg(*[F.max(F.col(col) == c).alias(f"_f{i}") for i, c in enumerate(successors)])
    choice = F.lit(default)
    for i, new in reversed(list(enumerate(successors.values()))):
        choice = F.when(F.col(f"_f{i}"), F.lit(new)).otherwise(choice)
    j = df.join(flags, tick, "left").withColumn(out, F.when(F.col(col) == retired, choice).otherwise(F.col(col)))
    return j.drop(*[f"_f{i}" for i in range(len(successors))])


def adjust_price(panel: DataFrame, factors: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<col>_adj``: price or volume times the factor in force, 1 before the first one."""
    j = asof_last(panel, factors.select("tick", F.col("ex_date").alias("date"), "factor"), ["factor"])
    f = F.coalesce("factor", F.lit(1.0))
    return j.withColumns({f"{c}_adj": F.col(c) * f for c in cols}).drop("factor")


def tradable_flag(panel: DataFrame, status: DataFrame, listing: DataFrame, min_listed_days: int = 242) -> DataFrame:
    """panel + tradable.

    Not tradable: ST, listed under ``min_listed_days`` calendar days, suspended
    today, or without volume or at a price limit today or on the next row.  A
    missing status row means suspended and no volume but no limit hit; an unknown
    list date means new.  ``status`` is (tick, date, is_st, is_suspend, hit_ceil,
    hit_floor, volume), unique per (tick, date).
    """
    s = status.select("tick", "date", "is_st", "is_suspend", "hit_ceil", "hit_floor", F.col("volume").alias("_vol"))
    j = panel.join(s, ["tick", "date"], "left").join(listing.select("tick", "list_date"), "tick", "left")
    blocked = ((F.coalesce("_vol", F.lit(0.0)) == 0) | F.coalesce("hit_ceil", F.lit(False))
               | F.coalesce("hit_floor", F.lit(False)))
    fresh = F.coalesce(F.datediff("date", "list_date") < min_listed_days, F.lit(True))
    j = j.withColumn("_blocked", blocked)
    bad = (F.coalesce("is_st", F.lit(False)) | F.coalesce("is_suspend", F.lit(True)) | fresh | F.col("_blocked")
           | F.coalesce(F.lead("_blocked").over(tick_window()), F.col("_blocked")))
    return (j.withColumn("tradable", ~bad)
            .drop("is_st", "is_suspend", "hit_ceil", "hit_floor", "_vol", "list_date", "_blocked"))


def sample_per_date(df: DataFrame, n: int, seed: int = 0, by: str = "date_idx", key: str = "tick",
                    strict: bool = True) -> DataFrame:
    """Exactly n ticks per date in the order of a seeded hash; ``strict`` raises where there are fewer.

    Rows are first ranked inside hashed shares of a date, so that only n rows of each share meet in the date's task.
    """
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(by).cast("string"), F.lit(str(seed))))
    hashed = df.withColumn("_h", order).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(SHARES)))
    near = hashed.withColumn("_rn", F.row_number().over(Window.partitionBy(by, "_part").orderBy("_h", key))).where(F.col("_rn") <= n)
    w = Window.partitionBy(by).orderBy("_h", key)
    picked = near.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_h", "_part")
    if not strict:
        return picked
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    enough = F.when(F.col("_n") >= n, True).otherwise(F.raise_error(F.lit(f"fewer than {n} valid ticks on a date")))
    return attach(picked, sizes, [by]).where(enough).drop("_n")


MODES = ("universe", "pool", "fix", "sample")


def select_universe(panel: DataFrame, mode: str = "universe", label: ColumnOrName = "label",
                    tradable: ColumnOrName = "tradable", pool: str | None = None, fix: Sequence | None = None,
                    n: int | None = None, seed: int = 0) -> DataFrame:
    """Rows to train on.  Valid = tradable with a label; ``fix`` takes its ticks regardless."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; use one of {MODES}")
    if mode == "fix":
        if not fix:
            raise ValueError("mode 'fix' needs ticks")
        return panel.where(F.col("tick").isin(list(fix)))
    valid = panel.where(as_col(tradable) & as_col(label).isNotNull())
    if mode == "pool":
        if pool is None:
            raise ValueError("mode 'pool' needs a pool column")
        return valid.where(F.col(pool))
    if mode == "sample":
        if n is None:
            raise ValueError("mode 'sample' needs n")
        return sample_per_date(valid, n, seed)
    return valid


def all_null(fields: Sequence[str]) -> "callable":
    return lambda s: _every([s[f].isNull() for f in fields])


def any_null(fields: Sequence[str]) -> "callable":
    return lambda s: ~_every([s[f].isNotNull() for f in fields])


def _every(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def drop_dead_sequences(samples: DataFrame, fields: Sequence[str], seq: str = "seq") -> DataFrame:
    """Drop a sample if at any step every feature is NULL."""
    return samples.where(~F.exists(seq, all_null(fields)))


def drop_any_null_sequences(samples: DataFrame, fields: Sequence[str], seq: str = "seq",
                            label: str | None = None) -> DataFrame:
    """Drop a sample with any NULL in its window or a NULL label."""
    ok = samples.where(~F.exists(seq, any_null(fields)))
    return ok if label is None else ok.where(F.col(label).isNotNull())


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All copies of rows whose key occurs more than once.

    Keys are counted with map-side combine and only the repeated ones join back: by broadcast when their measured
    size allows, else by a join whose skewed side Spark splits.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).drop("_c")
    return df.join(small_side(repeated), list(keys), "left_semi")
