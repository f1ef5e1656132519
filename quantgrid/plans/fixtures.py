"""Panels, events and groups mapped from the given tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.core import tick_window
from quantgrid.operators.rolling import pct_change
from quantgrid.sources.axis import calendar, densify

OHLCV = ["open", "high", "low", "close", "volume", "amount"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(x: str):
    """Exact sum of a money column: integer cents, so the order of addition cannot matter."""
    return F.sum(F.floor(F.col(x) * 100 + 0.5)) / 100.0


# --- P1: daily bars of users ------------------------------------------------------------------

def p1_bars(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("tick"), F.to_date("ts").alias("date"),
                                          "event_id", "value")
    return e.groupBy("tick", "date").agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        cents("value").alias("amount"))


def p1_days(spark: SparkSession, sf: str) -> DataFrame:
    return calendar(table(spark, sf, "events").select(F.to_date("ts").alias("date")))


def p1(spark: SparkSession, sf: str) -> DataFrame:
    """Dense daily panel with r, the one-row change of close."""
    grid = densify(p1_bars(spark, sf), OHLCV, days=p1_days(spark, sf))
    return grid.withColumn("r", pct_change("close"))


def _grid_sql(n: str) -> str:
    f = ", ".join("f." + c for c in OHLCV)
    return f"""
{n}_days as (select date, row_number() over (order by date) - 1 as date_idx from (select distinct date from {n}_bars)),
{n}_ticks as (select distinct tick from {n}_bars),
{n}_grid as (select d.date_idx, d.date, t.tick, {f} from {n}_days d cross join {n}_ticks t
  left join {n}_bars f on f.date = d.date and f.tick = t.tick),
{n}_lag as (select *, lag(close) over (partition by tick order by date_idx) as prev_close from {n}_grid),
{n} as (select * exclude (prev_close), case when close is not null and prev_close = 0 then 0.0
  else (close - prev_close) / nullif(prev_close, 0) end as r from {n}_lag)"""


P1 = """with p1_bars as (select user_id as tick, cast(ts as date) as date, arg_min(value, event_id) as open,
  max(value) as high, min(value) as low, arg_max(value, event_id) as close, count(*)::double as volume,
  sum(cast(floor(value * 100 + 0.5) as bigint)) / 100.0::double as amount from events group by 1, 2),""" + _grid_sql("p1")


# --- P2: monthly bars of suppliers, with nation as industry and region as sector ---------------

def p2_bars(spark: SparkSession, sf: str) -> DataFrame:
    """open and close are the volume-weighted prices of the two halves of the month."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    late = F.dayofmonth("l_shipdate") > 15
    paid = F.floor(F.col("l_extendedprice") * 100 + 0.5)

    def vwap(keep):
        return F.sum(F.when(keep, paid)) / 100.0 / F.sum(F.when(keep, F.col("l_quantity")))

    whole = vwap(F.lit(True))
    return (li.groupBy(F.col("l_suppkey").alias("tick"), F.trunc(F.to_date("l_shipdate"), "month").alias("date"))
            .agg(F.coalesce(vwap(~late), whole).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.coalesce(vwap(late), whole).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
                 cents("l_extendedprice").alias("amount")))


def p2_days(spark: SparkSession, sf: str) -> DataFrame:
    return calendar(table(spark, sf, "lineitem").select(F.trunc(F.to_date("l_shipdate"), "month").alias("date")))


def p2(spark: SparkSession, sf: str) -> DataFrame:
    """Dense monthly panel with r and mv, a capitalisation stand-in: amount over the last 12 rows."""
    grid = densify(p2_bars(spark, sf), OHLCV, days=p2_days(spark, sf))
    return grid.withColumn("r", pct_change("close")).withColumn("mv", F.sum("amount").over(tick_window(-11, 0)))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"),
                                               F.col("n_regionkey").alias("sector"))
    return (table(spark, sf, "supplier").join(nation, "s_nationkey")
            .select(F.col("s_suppkey").alias("tick"), F.col("s_nationkey").alias("industry"), "sector"))


def p2g(spark: SparkSession, sf: str) -> DataFrame:
    return p2(spark, sf).join(p2_groups(spark, sf), "tick", "left")


def _vwap(keep: str) -> str:
    return (f"sum(case when {keep} then cast(floor(l_extendedprice * 100 + 0.5) as bigint) end) / 100.0::double "
            f"/ sum(case when {keep} then l_quantity end)")


P2 = f"""with p2_bars as (select l_suppkey as tick, cast(date_trunc('month', l_shipdate) as date) as date,
  coalesce({_vwap("day(l_shipdate) <= 15")}, {_vwap("true")}) as open, max(l_extendedprice / l_quantity) as high,
  min(l_extendedprice / l_quantity) as low, coalesce({_vwap("day(l_shipdate) > 15")}, {_vwap("true")}) as close,
  count(*)::double as volume, sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) / 100.0::double as amount
  from lineitem group by 1, 2),""" + _grid_sql("p2").replace("\np2 as (", "\np2_base as (") + """,
p2 as (select *, sum(amount) over (partition by tick order by date_idx rows between 11 preceding and current row) as mv
  from p2_base),
p2g as (select p2.*, s_nationkey as industry, n_regionkey as sector from p2 left join supplier on s_suppkey = tick
  left join nation on n_nationkey = s_nationkey)"""


# --- P3: hour bars of users --------------------------------------------------------------------

def p3_bars(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("tick"), F.to_date("ts").alias("date"),
                                          F.hour("ts").alias("minute_idx"), "event_id", "value")
    return e.groupBy("tick", "date", "minute_idx").agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        cents("value").alias("amount"))


P3_BARS = """p3_bars as (select user_id as tick, cast(ts as date) as date, hour(ts) as minute_idx,
  arg_min(value, event_id) as open, max(value) as high, min(value) as low, arg_max(value, event_id) as close,
  count(*)::double as volume, sum(cast(floor(value * 100 + 0.5) as bigint)) / 100.0::double as amount
  from events group by 1, 2, 3)"""
P3 = "with " + P3_BARS


# --- E1: one report per customer and order date ------------------------------------------------

def orders_raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("tick"), F.to_date("o_orderdate").alias("date"),
        F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("value"))


def e1(spark: SparkSession, sf: str) -> DataFrame:
    """Newest order per customer and date."""
    return (orders_raw(spark, sf).groupBy("tick", "date")
            .agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id")))


def e1_days(spark: SparkSession, sf: str) -> DataFrame:
    """Trading calendar: weekdays with an order, so weekend reports must move forward."""
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return calendar(d.where(F.weekday("date") < 5))


E1 = """with e1 as (select o_custkey as tick, cast(o_orderdate as date) as date, arg_max(o_totalprice, o_orderkey) as value,
  max(o_orderkey) as event_id from orders group by 1, 2),
e1_days as (select date, row_number() over (order by date) - 1 as date_idx
  from (select distinct cast(o_orderdate as date) as date from orders) where isodow(date) < 6)"""
