"""Walk-forward windows, splits, and a linear model fitted for all windows in one pass.

The fit needs only counts, means and centred products.  One scan of the rows gives these per date and ensemble member;
the states of dates merge into those of periods and of windows by the pairwise formula, so no row is copied per window or
member, and validation ICs follow from the dates' states too.  The k x k systems are solved on one row per window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.core import settle, small_side, store
from quantgrid.operators.rolling import value_array
from quantgrid.operators.samples import hash_unit

SPLITS = ("train", "valid", "test")


def walk_forward_windows(spark: SparkSession, start: str, end: str, train_len: int = 8, valid_len: int = 2,
                         test_len: int = 1, rolling_gap: int = 1) -> DataFrame:
    """(window, split, start, end): year ranges rolled by ``rolling_gap`` until the test range passes ``end``.

    ``valid_len=0`` gives the two-part variant.
    """
    years = train_len + valid_len + test_len
    first = F.to_date(F.lit(start))
    starts = F.sequence(F.lit(0), F.greatest(F.floor(F.months_between(F.lit(end).cast("date"), first) / 12)
                                             .cast("int"), F.lit(0)), F.lit(rolling_gap))
    w = (spark.range(1).select(F.posexplode(starts).alias("window", "_y"))
         .withColumn("_s", F.add_months(first, F.col("_y") * 12)))
    w = w.where(F.date_sub(F.add_months("_s", years * 12), 1) <= F.lit(end).cast("date"))
    parts, at = [], 0
    for name, n in zip(SPLITS, (train_len, valid_len, test_len)):
        if n:
            parts.append(F.struct(F.lit(name).alias("split"), F.add_months("_s", at * 12).alias("start"),
                                  F.date_sub(F.add_months("_s", (at + n) * 12), 1).alias("end")))
        at += n
    return w.select("window", F.inline(F.array(*parts)))


def assign_split(rows: DataFrame, windows: DataFrame, date: str = "date") -> DataFrame:
    """rows + (window, split); a row appears once per window that covers its date.

    Ranges expand to days, which are bounded by windows x calendar, so the join is an equi join.
    """
    days = windows.select("window", "split", F.explode(F.sequence("start", "end")).alias(date))
    return rows.join(small_side(days), date)


def concat_windows(predictions: DataFrame, keys: Sequence[str] = ("date", "tick")) -> DataFrame:
    """Test predictions of all windows as one table; a cell predicted twice raises."""
    one = predictions.groupBy(*keys).agg(F.first("pred").alias("pred"), F.count(F.lit(1)).alias("_n"))
    single = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("test windows overlap")))
    return one.where(single).drop("_n")


class States:
    """Counts, means and centred products (upper triangles) of several groups, merged by the pairwise formula."""

    def __init__(self, width: int):
        self.i, self.j = np.triu_indices(width)
        self.of: dict[object, tuple[int, np.ndarray, np.ndarray]] = {}

    def merge(self, key, n: int, mean: np.ndarray, prod: np.ndarray) -> None:
        if key in self.of:
            n0, mean0, prod0 = self.of[key]
            if n and n0:
                gap, w = mean - mean0, n / (n0 + n)
                mean, prod = mean0 + w * gap, prod0 + prod + n0 * w * gap[self.i] * gap[self.j]
            elif n0:
                mean, prod = mean0, prod0
            n += n0
        self.of[key] = n, mean, prod

    def add(self, codes: np.ndarray, keys: Sequence, x: np.ndarray) -> None:
        """Rows of x, whose group is keys[code]."""
        for at in range(0, len(x), 4096):  # bounds the products of rows
            part, order = codes[at:at + 4096], np.argsort(codes[at:at + 4096], kind="stable")
            y, part = x[at:at + 4096][order], part[order]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            n = np.diff(np.r_[starts, len(part)])
            mean = np.add.reduceat(y, starts) / n[:, None]
            y = y - np.repeat(mean, n, 0)
            prod = np.add.reduceat(y[:, self.i] * y[:, self.j], starts)
            for g, code in enumerate(part[starts].tolist()):
                self.merge(keys[code], int(n[g]), mean[g], prod[g])

    def frame(self) -> pd.DataFrame:
        rows = [(k, n, mean.tolist(), prod.tolist()) for k, (n, mean, prod) in self.of.items()]
        return pd.DataFrame(rows, columns=["_k", "n", "mean", "prod"])


STATE = "_k string, n long, mean array<double>, prod array<double>"


def merged(states: DataFrame, width: int) -> DataFrame:
    """One state per _k."""
    def run(batches):
        total = States(width)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                total.merge(row[0], int(row[1]), np.asarray(row[2], float), np.asarray(row[3], float))
        yield total.frame()

    return states.select("_k", "n", "mean", "prod").repartition("_k").mapInPandas(run, STATE)


def _key(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(b).alias(b) for b in by])) if by else F.lit("{}")


def group_states(rows: DataFrame, names: Sequence[str], by: Sequence[str], members: Sequence[Column] = ()) -> DataFrame:
    """by + member, n, mean, prod: moments of the rows where every name is known, in one scan without a shuffle of rows.

    ``members`` are conditions; member i holds the rows that meet the i-th, member -1 all rows.  A group whose rows all
    miss a name has n = 0.  A task holds one state per group and member that it meets.
    """
    by, width, teams = list(by), len(names), len(members)
    tall = rows.select(_key(by).alias("_k"), F.array(*members).alias("_in"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])

    def run(batches):
        total = States(width)
        for pdf in batches:
            codes, keys = pd.factorize(pdf["_k"])
            x = pdf[[f"_v{i}" for i in range(width)]].to_numpy(float)
            known = ~np.isnan(x).any(1)
            for k in keys:
                if (k, -1) not in total.of:
                    total.of[k, -1] = 0, np.zeros(width), np.zeros(len(total.i))
            if known.any():
                total.add(codes[known], [(k, -1) for k in keys], x[known])
                if teams:
                    drawn = np.stack(pdf["_in"].to_list()).astype(bool)
                    for m in range(teams):
                        mine = known & drawn[:, m]
                        if mine.any():
                            total.add(codes[mine], [(k, m) for k in keys], x[mine])
        out = total.frame()
        yield out.assign(_k=[f"{m} {k}" for k, m in out["_k"]])

    states = merged(tall.mapInPandas(run, STATE), width)
    named = states.select(F.substring_index("_k", " ", 1).cast("int").alias("member"),
                          F.expr("substr(_k, instr(_k, ' ') + 1)").alias("_k"), "n", "mean", "prod")
    types = dict(rows.select(*by).dtypes)
    key = F.from_json("_k", ", ".join(f"`{b}` {types[b]}" for b in by)) if by else None
    return named.select(*[key[b].alias(b) for b in by], "member", "n", "mean", "prod")


def moments(rows: DataFrame, features: Sequence[str], label: str | None, by: Sequence[str]) -> DataFrame:
    """by + n, feature means and the flattened covariance (upper triangle, label last when given); groups with rows only."""
    names = [*features, *([label] if label else [])]
    states = group_states(rows, names, by).where("n > 0")
    return states.select(*by, "n", "mean", F.transform("prod", lambda p: p / F.col("n")).alias("cov"))


def periods(windows: DataFrame) -> DataFrame:
    """One row: the sorted days at which a split of some window starts or has ended."""
    ends = windows.select(F.explode(F.array("start", F.date_add("end", 1))).alias("day"))
    return ends.agg(F.sort_array(F.collect_set("day")).alias("days"))


def over_windows(states: DataFrame, windows: DataFrame, width: int, date: str = "date") -> DataFrame:
    """(window, split, member, n, mean, prod) from states per date and member.

    Dates merge into the periods between window borders, periods into windows: a state is copied once per window that
    its period lies in, rows never.
    """
    days = settle(periods(windows))[0].scalar()
    start = F.array_max(F.filter("_days", lambda d: d <= F.col(date)))
    placed = states.withColumn("_days", days).withColumn("_p", start).where("_p is not null")
    by_period = merged(placed.withColumn("_k", F.concat_ws(" ", "member", "_p")), width).select(
        F.substring_index("_k", " ", 1).cast("int").alias("member"), F.substring_index("_k", " ", -1).cast("date").alias("_p"), "n", "mean", "prod")
    inside = F.filter("_days", lambda d: (d >= F.col("start")) & (d <= F.col("end")))
    parts = small_side(windows.withColumn("_days", days).select("window", "split", F.explode(inside).alias("_p")))
    whole = merged(by_period.join(parts, "_p").withColumn("_k", F.concat_ws(" ", "window", "split", "member")), width)
    part = F.split("_k", " ")
    return whole.select(part[0].cast(windows.schema["window"].dataType).alias("window"), part[1].alias("split"),
                        part[2].cast("int").alias("member"), "n", "mean", "prod")


def _square(flat: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((m, m))
    out[np.triu_indices(m)] = flat
    return out + np.triu(out, 1).T


def solve_ridge(stats: DataFrame, width: int, by: Sequence[str], penalties: Sequence[float]) -> DataFrame:
    """by + (penalty, coef, intercept) from n, mean, cov with the label last."""
    types, k = dict(stats.dtypes), width - 1
    schema = ", ".join(f"{b} {types[b]}" for b in by) + ", penalty double, coef array<double>, intercept double"

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                cov, mean = _square(np.asarray(row.cov), k + 1), np.asarray(row.mean)
                for penalty in penalties:
                    a = cov[:k, :k] + penalty * np.eye(k)
                    coef = np.linalg.lstsq(a, cov[:k, k], rcond=None)[0]
                    out.append([*[getattr(row, b) for b in by], penalty, coef.tolist(), float(mean[k] - coef @ mean[:k])])
            yield pd.DataFrame(out, columns=[*by, "penalty", "coef", "intercept"])

    return stats.mapInPandas(solve, schema)


def fit_ridge(train: DataFrame, features: Sequence[str], label: str, by: Sequence[str],
              penalties: Sequence[float]) -> DataFrame:
    """by + (penalty, coef, intercept): ridge on the centred moments for every group and penalty."""
    return solve_ridge(moments(train, features, label, by), len(features) + 1, by, penalties)


def linear_score(features: Sequence[str]) -> Column:
    """Prediction of a joined (coef, intercept); NULL if a feature is."""
    out = F.col("intercept")
    for i, f in enumerate(features):
        out = out + F.col("coef")[i] * F.col(f)
    return out


def linear_ics(valid: DataFrame, models: DataFrame, width: int) -> DataFrame:
    """(window, member, penalty, ic): mean daily IC of linear predictions, from the states of a window's valid dates.

    A date's IC has both deviations padded by 1e-6 and is 0 without complete rows, as in :func:`evaluate.ic`.
    """
    k = width - 1

    def run(key, days, fitted):
        if not len(days) or not len(fitted):
            return pd.DataFrame({"window": [], "member": [], "penalty": [], "ic": []})
        b = np.stack(fitted["coef"].to_list())
        n = np.maximum(days["n"].to_numpy(), 1)
        total = np.zeros(len(b))
        for i, flat in enumerate(days["prod"]):  # at most one row per date of the calendar
            c = _square(np.asarray(flat, float), width) / n[i]
            spread = np.sqrt(np.maximum(((b @ c[:k, :k]) * b).sum(1), 0))
            total += (b @ c[:k, k]) / (spread + 1e-6) / (np.sqrt(c[k, k]) + 1e-6)
        return fitted[["window", "member", "penalty"]].assign(ic=total / len(days))

    schema = f"window {models.schema['window'].dataType.simpleString()}, member int, penalty double, ic double"
    return valid.groupBy("window").cogroup(models.groupBy("window")).applyInPandas(run, schema)


def choose_models(rows: DataFrame, windows: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float],
                  members: int = 1, fraction: float = 1.0, seed: int = 0, date: str = "date") -> DataFrame:
    """(window, member, penalty, coef, intercept): the penalty of the best mean valid IC, ties to the smaller one.

    One scan of the rows.
    """
    width = len(features) + 1
    drawn = [hash_unit("tick", date, F.lit(m) + seed) < fraction for m in range(members)] if fraction < 1 else []
    states = store(group_states(rows, [*features, label], [date], drawn))
    whole = over_windows(states.where("n > 0"), windows.where("split = 'train'"), width, date)
    if drawn:
        train = whole.where("member >= 0")
    else:
        train = whole.where("member = -1").withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    stats = train.select("window", "member", "n", "mean", F.transform("prod", lambda p: p / F.col("n")).alias("cov"))
    models = small_side(solve_ridge(stats, width, ["window", "member"], penalties))
    valid = assign_split(states.where("member = -1").drop("member"), windows.where("split = 'valid'"), date)
    score = small_side(linear_ics(valid, models, width).withColumn("ic", F.round("ic", 9)))
    best = score.groupBy("window", "member").agg(F.max_by("penalty", F.struct("ic", -F.col("penalty"))).alias("penalty"))
    return small_side(models.join(small_side(best), ["window", "member", "penalty"]))


def walk_forward_predict(rows: DataFrame, windows: DataFrame, features: Sequence[str], label: str,
                         penalties: Sequence[float] = (0.0, 0.1, 1.0, 10.0), members: int = 1,
                         fraction: float = 1.0, seed: int = 0, date: str = "date") -> DataFrame:
    """(window, member, date, tick, penalty, pred): per window fit on train, pick the penalty by mean valid IC, predict test.

    With ``members`` > 1 each member trains on its own hashed share of the rows.
    """
    chosen = choose_models(rows, windows, features, label, penalties, members, fraction, seed, date)
    test = assign_split(rows, windows.where("split = 'test'"), date).join(chosen, "window")
    return test.select("window", "member", date, "tick", "penalty", linear_score(features).alias("pred"))


def bagged_predict(rows: DataFrame, windows: DataFrame, features: Sequence[str], label: str, members: int = 5,
                   fraction: float = 0.8, seed: int = 0, penalties: Sequence[float] = (0.0, 0.1, 1.0, 10.0),
                   date: str = "date") -> DataFrame:
    """(window, date, tick, pred): mean over members trained on seeded row samples.

    The mean of linear models is the model of mean coefficients, so a test row is read once.
    """
    chosen = choose_models(rows, windows, features, label, penalties, members, fraction, seed, date)
    mean = [F.avg(F.col("coef")[i]) for i in range(len(features))]
    team = small_side(chosen.groupBy("window").agg(F.array(*mean).alias("coef"), F.avg("intercept").alias("intercept")))
    test = assign_split(rows, windows.where("split = 'test'"), date).join(team, "window")
    return test.select("window", date, "tick", linear_score(features).alias("pred"))


def score_embeddings(panel: DataFrame, col: str, lag: int, dims: int, keep: Sequence[str] = ()) -> DataFrame:
    """(date_idx, tick, dim, value): principal components of the lag array of a column.

    The lag x lag covariance is one aggregate; its eigenvectors (largest loading
    positive) come back as a one-row table and the projection stays in the JVM.
    """
    a = panel.select("date_idx", "tick", *keep, value_array(col, lag).alias("_a"))
    a = a.where(F.col("_a").isNotNull() & F.forall("_a", lambda v: v.isNotNull()))
    names = [f"_x{i}" for i in range(lag)]
    wide = a.select("date_idx", "tick", *keep, *[F.col("_a")[i].alias(n) for i, n in enumerate(names)])

    def axes(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.n:
                    _, vec = np.linalg.eigh(_square(np.asarray(row.cov), lag))
                    for i in range(dims):
                        v = vec[:, -1 - i]
                        v = v * np.sign(v[np.argmax(np.round(np.abs(v), 9))])
                        yield pd.DataFrame({"dim": [i], "mean": [list(row.mean)], "load": [v.tolist()]})

    basis = moments(wide, names, None, []).mapInPandas(axes, "dim int, mean array<double>, load array<double>")
    table = basis.agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "load"))).alias("_t"))
    j = wide.withColumn("_t", table.scalar()).select("date_idx", "tick", *keep, *names, F.inline("_t"))
    value = F.lit(0.0)
    for i, n in enumerate(names):
        value = value + (F.col(n) - F.col("mean")[i]) * F.col("load")[i]
    return j.select("date_idx", "tick", *keep, "dim", value.alias("value"))
