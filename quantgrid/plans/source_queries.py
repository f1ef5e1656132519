"""Sources, sinks, filters, set operations, scalar and calendar functions (S, F, U, C, O rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantgrid.core import scratch, stage
from quantgrid.functions import scalar as SC
from quantgrid.functions import timecode as TC
from quantgrid.operators import filters as FL
from quantgrid.operators import scans as S
from quantgrid.operators.scans import with_windows
from quantgrid.plans.fixtures import E1, P1, P2, e1, e1_days, p1, p1_bars, p1_days, p2, p2_bars, p2_days, table
from quantgrid.plans.pit_queries import month_events
from quantgrid.plans.registry import query, rnd, show, sql_cols
from quantgrid.sources import panel_io as IO
from quantgrid.sources.axis import date_axis, densify, tick_axis

KEYS = ["date_idx", "tick"]


def big(c: str):
    return F.col(c).cast("bigint").alias(c)


def folder(spark) -> str:
    """A fresh folder next to the checkpoints, where every executor can read and write."""
    return scratch(spark, "out")


# --- sources and sinks ------------------------------------------------------------------------------

SCAN = """select s.s_name, n.n_name, l.l_shipdate, l.l_extendedprice, l.l_quantity from {lineitem} l
left join {supplier} s on l.l_suppkey = s.s_suppkey left join {nation} n on s.s_nationkey = n.n_nationkey
where l.l_shipdate between timestamp '1996-01-01' and timestamp '1998-12-31' and n.n_regionkey in (0, 1) and l.l_returnflag = 'A'"""
query("scan_sql", SCAN.replace("{", "").replace("}", ""))(
    lambda s, d: IO.scan_sql_files(s, SCAN, **{t: f"{d}/{t}.parquet" for t in ("lineitem", "supplier", "nation")}))

query("date_axis", "select row_number() over (order by date) - 1 as date_idx, date from (select distinct cast(ts as date) as date from events)")(
    lambda s, d: date_axis(table(s, d, "events").select(F.to_date("ts").alias("date"))).select(big("date_idx"), "date"))
query("tick_axis", "select row_number() over (order by tick) - 1 as tick_idx, tick from (select distinct o_custkey as tick from orders)")(
    lambda s, d: tick_axis(table(s, d, "orders"), "o_custkey").select(big("tick_idx"), "tick"))
query("tick_axis_text", "select row_number() over (order by tick) - 1 as tick_idx, tick from (select distinct c_name as tick from customer)")(
    lambda s, d: tick_axis(table(s, d, "customer"), "c_name").select(big("tick_idx"), "tick"))


@query("scan_panel", f"{P2} select date_idx, date, tick, close, volume from p2 where date >= date '1997-03-01'")
def scan_panel(s, d):
    path = folder(s)
    IO.write_panel(p2(s, d), path)
    return IO.scan_panel(s, path, ["close", "volume"], start="1997-03-01").withColumn("date_idx", F.col("date_idx").cast("bigint"))


@query("write_panel", f"{P2} select year(date) as year, count(*) as cells, count(close) as traded from p2 group by 1")
def write_panel(s, d):
    path = folder(s)
    IO.write_panel(p2(s, d), path)
    back = s.read.parquet(path)
    return back.groupBy(F.col("year").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("cells"), F.count("close").alias("traded"))


@query("windows_on_stored_panel", f"""{P2} select date_idx, tick, {sql_cols(
    m="case when date_idx >= 4 then avg(close) over (partition by tick order by date_idx rows between 4 preceding and current row) end",
    top="max(high) over (partition by tick order by date_idx rows between 59 preceding and current row)")} from p2""")
def windows_on_stored_panel(s, d):
    """Facts stored by tick, made dense and windowed without an exchange on tick."""
    name = f"bars_{uuid.uuid4().hex}"
    IO.write_panel_by_tick(p2_bars(s, d), folder(s), name, 4, order="date")
    grid = densify(IO.scan_facts_by_tick(s, name, ["high", "close"]), ["high", "close"], days=p2_days(s, d))
    return show(with_windows(grid, m=S.mean("close", 5, full=True), top=S.top("high", 60)), KEYS, m="m", top="top")


@query("scan_daily_files", f"""{P1} select a.date_idx, a.date, b.tick, b.close from p1_days a
left join (select * from p1_bars where dayofweek(date) <> 0) b on b.date = a.date""")
def scan_daily_files(s, d):
    """Sunday files are absent, so their axis dates come back as NULL rows."""
    path = folder(s)
    IO.write_daily_files(p1_bars(s, d).where(F.weekday("date") != 6).select("tick", "close", "date"), path)
    axis = p1_days(s, d).select(F.posexplode("days").alias("date_idx", "date"))
    return IO.scan_daily_files(s, path, axis, "tick long, close double").select(big("date_idx"), "date", "tick", "close")


@query("export_wide_csv", f"{P2} select date, tick::varchar as tick, close from p2")
def export_wide_csv(s, d):
    path = folder(s)
    IO.export_wide_csv(stage(p2(s, d).select("date", "tick", "close")), path, "close")
    return IO.read_wide_csv(s, path, "close")


@query("export_long_alpha", f"""{P1} select date as trade_dt, lpad(tick::varchar, 6, case when tick % 2 = 0 then '0' else '6' end) ||
  case when tick % 2 = 0 then '.SZ' else '.SH' end as stcode, r as "Predict" from p1 where r is not null""")
def export_long_alpha(s, d):
    path = folder(s)
    code = F.lpad(F.col("tick").cast("string"), 6, F.when(F.col("tick") % 2 == 0, F.lit("0")).otherwise(F.lit("6")))
    IO.export_long_alpha(p1(s, d).withColumn("code", code), path, "r", "code")
    return s.read.parquet(path).select(F.col("trade_dt").cast("date").alias("trade_dt"), "stcode", "Predict")


@query("event_metadata", f"""{E1}, m as (select date, row_number() over (order by date) - 1 as i from (select distinct cast(date_trunc('month', date) as date) as date from e1)),
ev as (select e1.tick, m.i from e1 join m on m.date = cast(date_trunc('month', e1.date) + interval 1 month as date))
select count(*) as num_events, 1::bigint as event_dim, count(distinct tick) as num_ticks, min(i) as min_idx, max(i) as max_idx, 8::bigint as max_events from ev""")
def event_metadata(s, d):
    path = folder(s)
    IO.write_metadata(IO.event_metadata(month_events(s, d), ["value"], 8), path)
    names = ["num_events", "event_dim", "num_ticks", "min_idx", "max_idx", "max_events"]
    return s.read.schema(", ".join(f"{n} bigint" for n in names)).json(path).select(*names)


# --- filters and projections ------------------------------------------------------------------------

query("range_filter", f"{P1} select date_idx, tick, close from p1 where date between date '2024-01-05' and date '2024-01-20'")(
    lambda s, d: FL.range_filter(p1(s, d), "2024-01-05", "2024-01-20").select(big("date_idx"), "tick", "close"))
query("in_filter", "select l_orderkey, l_linenumber, l_partkey, l_returnflag from lineitem where l_returnflag in ('A', 'R') and l_linestatus in ('F')")(
    lambda s, d: FL.in_filter(table(s, d, "lineitem"), l_returnflag=["A", "R"], l_linestatus=["F"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"))
query("semi_filter", f"{E1} select tick, date, event_id from e1 where date in (select date from e1_days)")(
    lambda s, d: FL.semi_filter(e1(s, d), e1_days(s, d).select(F.explode("days").alias("date")), ["date"]).select("tick", "date", "event_id"))
query("null_filter", f"{P1} select date_idx, tick, close from p1 where close is not null and r is not null")(
    lambda s, d: FL.null_filter(p1(s, d), ["close", "r"]).select(big("date_idx"), "tick", "close"))
query("project_scale_cast", "select l_orderkey, l_linenumber, l_partkey, l_quantity / 10 as l_quantity, l_extendedprice / 10000 as l_extendedprice, l_discount / 100 as l_discount from lineitem")(
    lambda s, d: FL.project_scale_cast(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"],
                                       {"l_quantity": 10, "l_extendedprice": 10000, "l_discount": 100}))
query("coalesce_default", f"{P1} select date_idx, tick, coalesce(volume, 0) as volume from p1")(
    lambda s, d: p1(s, d).select(big("date_idx"), "tick", SC.coalesce_default("volume", 0.0).alias("volume")))
query("value_map", """select o_orderkey, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 end::bigint as code,
  case o_orderpriority when '1-URGENT' then 'TOP' when '2-HIGH' then 'TOP' else o_orderpriority end as merged from orders""")(
    lambda s, d: FL.value_map(FL.value_map(table(s, d, "orders"), "o_orderpriority", {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}, "code"),
                              "o_orderpriority", {"1-URGENT": "TOP", "2-HIGH": "TOP"}, "merged", keep_unmapped=True)
    .select("o_orderkey", big("code"), "merged"))
query("split_category", """with f as (select o_custkey, max(o_orderpriority = '1-URGENT') as a, max(o_orderpriority = '2-HIGH') as b from orders group by 1)
select o_orderkey, case when o_orderpriority = '5-LOW' then case when a then 'X' when b then 'Y' else 'Z' end else o_orderpriority end as kind
from orders join f using (o_custkey)""")(
    lambda s, d: FL.split_category(table(s, d, "orders"), "o_orderpriority", "5-LOW", {"1-URGENT": "X", "2-HIGH": "Y"}, "Z", "kind",
                                   "o_custkey").select("o_orderkey", "kind"))
query("mask_untraded", f"{P1} select date_idx, tick, case when close is not null then coalesce(volume, 0) + 1 end as volume from p1")(
    lambda s, d: p1(s, d).select(big("date_idx"), "tick", SC.mask_untraded(F.coalesce("volume", F.lit(0.0)) + 1).alias("volume")))

FACTOR = f"""{P2}, fa as (select tick, date, 1 + volume / 100 as factor from p2_bars where volume >= 9),
u as (select tick, date, date_idx, close, volume, null as factor, 1 as k from p2 union all select tick, date, null, null, null, factor, 0 from fa),
w as (select *, last_value(factor ignore nulls) over (partition by tick order by date, k rows between unbounded preceding and current row) as f from u)"""
query("adjust_price", f"{FACTOR} select date_idx, tick, {sql_cols(close_adj='close * coalesce(f, 1)', volume_adj='volume * coalesce(f, 1)')} from w where k = 1")(
    lambda s, d: show(FL.adjust_price(p2(s, d), p2_bars(s, d).where("volume >= 9").select(
        "tick", F.col("date").alias("ex_date"), (1 + F.col("volume") / 100).alias("factor")), ["close", "volume"]),
        KEYS, close_adj="close_adj", volume_adj="volume_adj"))

# --- set operations and sorting ---------------------------------------------------------------------

query("union_all", "select o_orderkey as id, o_totalprice as amount from orders where o_orderstatus = 'F' union all select o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT'")(
    lambda s, d: (lambda o: o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
                  .unionByName(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("id"))))(
        table(s, d, "orders")))
query("calendar_union", "select cast(o_orderdate as date) as date from orders union select cast(l_shipdate as date) from lineitem")(
    lambda s, d: table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).union(
        table(s, d, "lineitem").select(F.to_date("l_shipdate"))).distinct())
query("sort_multi", "select o_custkey as tick, o_orderpriority as kind, o_totalprice as value, o_orderkey as id from orders order by 1, 2, 3 desc, 4")(
    lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("tick"), F.col("o_orderpriority").alias("kind"),
                                              F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))
    .orderBy("tick", "kind", F.desc("value"), "id"))

# --- scalar functions -------------------------------------------------------------------------------

query("safe_div", f"{P1} select date_idx, tick, {sql_cols(a='case when coalesce(volume, 0) - 1 = 0 then 0 else amount / nullif(coalesce(volume, 0) - 1, 0) end', b='close / nullif(open - close, 0)')} from p1")(
    lambda s, d: show(p1(s, d), KEYS, a=SC.safe_div("amount", F.coalesce("volume", F.lit(0.0)) - 1),
                      b=SC.ratio_null_zero("close", F.col("open") - F.col("close"))))
query("softplus", f"{P1} select date_idx, tick, {sql_cols(s='case when r > 0 then r + ln(1 + exp(-r)) else ln(1 + exp(r)) end')} from p1")(
    lambda s, d: show(p1(s, d), KEYS, s=SC.softplus("r")))
query("quarter_end", "select distinct o_orderkey, last_day(make_date(year(o_orderdate)::bigint, quarter(o_orderdate)::bigint * 3, 1::bigint)) as quarter_end from orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", SC.quarter_end(F.year("o_orderdate"), F.quarter("o_orderdate")).alias("quarter_end")))


@query("split_explode_names", """with n as (select p_partkey, unnest(string_split(regexp_replace(replace(p_name, ' ', '、'), '[、，]', ',', 'g'), ',')) as name from part),
ids as (select name, row_number() over (order by name) - 1 as name_id from (select distinct name from n)) select p_partkey, name, name_id from n join ids using (name)""")
def split_explode_names(s, d):
    """Delimited author lists to one row per name with a code from the sorted name axis."""
    lists = table(s, d, "part").select("p_partkey", F.translate("p_name", " ", "、").alias("names"))
    rows = lists.select("p_partkey", F.explode(F.split(F.regexp_replace("names", "[、，]", ","), ",")).alias("name"))
    ids = tick_axis(rows, "name").select(F.col("tick").alias("name"), F.col("tick_idx").cast("bigint").alias("name_id"))
    return rows.join(ids, "name").select("p_partkey", "name", "name_id")


query("code_suffix", "select s_suppkey, lpad(s_suppkey::varchar, 3, '6') as code, lpad(s_suppkey::varchar, 3, '6') || case when left(lpad(s_suppkey::varchar, 3, '6'), 1) in ('0', '3') then '.SZ' else '.SH' end as full_code from supplier")(
    lambda s, d: table(s, d, "supplier").withColumn("code", F.lpad(F.col("s_suppkey").cast("string"), 3, "6")).select(
        "s_suppkey", "code", SC.code_suffix("code").alias("full_code")))

TS = "select event_id, ts from events"


def on_events(name: str, sql: dict, cols, integer: bool):
    values = ", ".join(f"({e})::bigint as {n}" for n, e in sql.items()) if integer else sql_cols(**sql)
    def run(s, d):
        df = table(s, d, "events")
        if integer:
            return df.select("event_id", *[c.cast("bigint").alias(n) for n, c in cols().items()])
        return df.select("event_id", *[rnd(c).alias(n) for n, c in cols().items()])
    query(name, f"select event_id, {values} from events")(run)


on_events("time_code_daily", dict(month="month(ts)", day="day(ts)", weekday="isodow(ts) - 1"), lambda: TC.daily_time_code("ts"), True)
on_events("temporal_index", dict(month="month(ts)", day="day(ts)", weekday="isodow(ts)", hour="hour(ts)", minute="minute(ts)"),
          lambda: TC.temporal_index("ts"), True)
on_events("cyclic_time_features",
          dict(second_of_minute="second(ts) / 59.0::double - 0.5", minute_of_hour="minute(ts) / 59.0::double - 0.5",
               hour_of_day="hour(ts) / 23.0::double - 0.5", day_of_week="(isodow(ts) - 1) / 6.0::double - 0.5",
               day_of_month="(day(ts) - 1) / 30.0::double - 0.5", day_of_year="(dayofyear(ts) - 1) / 365.0::double - 0.5",
               week_of_year="(weekofyear(ts) - 1) / 52.0::double - 0.5", month_of_year="(month(ts) - 1) / 11.0::double - 0.5"),
          lambda: {**TC.cyclic_time_features("ts", "s"), **TC.cyclic_time_features("ts", "w"), **TC.cyclic_time_features("ts", "m")}, False)
on_events("time2vec",
          dict(t2v_month="(month(ts) - 1) / 11.0::double", t2v_day="(day(ts) - 1) / 30.0::double", t2v_hour="hour(ts) / 23.0::double",
               t2v_minute="minute(ts) / 59.0::double", t2v_second="second(ts) / 59.0::double", t2v_weekday="(isodow(ts) - 1) / 6.0::double",
               t2v_iso_week="weekofyear(ts) / 52.0::double", t2v_week_day="isodow(ts) / 7.0::double", t2v_year_offset="(year(ts) - 2020) / 10.0::double"),
          lambda: {**TC.time2vec("ts", "s"), **TC.time2vec("ts", "w"), **TC.time2vec("ts", "a")}, False)

@query("time_code_minute", """with dd as (select distinct cast(o_orderdate as date) as date from orders),
mm as (select unnest(range(570, 691)) as m union all select unnest(range(781, 901))),
k as (select m, row_number() over (order by m) as i, count(*) over () as n from mm)
select date, (i - 2)::bigint as bar, month(date) as month, day(date) as day, isodow(date) - 1 as weekday, m // 60 as hour, m % 60 as minute
from dd, k where i > 1 and i <= n - 3""")
def time_code_minute(s, d):
    days = table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    bars = days.select("date", F.posexplode(TC.minute_axis()).alias("bar", "m"))
    parts = {**TC.daily_time_code("date"), "hour": F.floor(F.col("m") / 60), "minute": F.col("m") % 60}
    return bars.select("date", big("bar"), *[c.cast("bigint").alias(n) for n, c in parts.items()])


query("date_format_parse", "select o_orderkey, strftime(o_orderdate, '%Y%m%d') as ymd, cast(strptime(strftime(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d') as date) as parsed, cast(cast(o_orderdate as date) as varchar) as iso from orders")(
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("ymd"),
        F.to_date(F.date_format("o_orderdate", "yyyy/MM/dd"), "yyyy/MM/dd").alias("parsed"),
        F.to_date("o_orderdate").cast("string").alias("iso")))
query("nan_to_null", "select vec_id, i::bigint as i, case when x = 0 then null else floor(ln(abs(x)) * 10000.0::double + 0.5) / 10000.0::double end as x from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings)")(
    lambda s, d: IO.ingest_clean(table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", big("i"), F.when(F.col("x") == 0, F.lit(float("-inf"))).otherwise(F.ln(F.abs(F.col("x").cast("double")))).alias("x")))
    .select("vec_id", "i", rnd("x", 4).alias("x")))
