"""The query registry: each entry is a Spark query and, where SQL can say it, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rnd(x: ColumnOrName, dp: int = 6) -> Column:
    """Half-up rounding by floor, the same arithmetic as :func:`sql_rnd`."""
    scale = float(10 ** dp)
    return F.floor(as_col(x) * scale + 0.5).cast("double") / scale


def sql_rnd(x: str, dp: int = 6) -> str:
    scale = f"{10 ** dp}::double"
    return f"floor(({x})*{scale}+0.5)/{scale}"


def show(df: DataFrame, keys: list[str], dp: int = 6, **cols: ColumnOrName) -> DataFrame:
    """Keys as they are, ordinals as bigint, every value rounded."""
    types = dict(df.dtypes)
    picked = [F.col(k).cast("bigint").alias(k) if types[k] == "int" else F.col(k) for k in keys]
    return df.select(*picked, *[rnd(c, dp).alias(n) for n, c in cols.items()])


def sql_cols(dp: int = 6, **cols: str) -> str:
    return ", ".join(f"{sql_rnd(e, dp)} as {n}" for n, e in cols.items())
