"""Point-in-time joins, deduplication and event features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import stage
from quantgrid.factors import events as EV
from quantgrid.functions.scalar import event_age_bucket, event_age_decay_inputs
from quantgrid.operators import filters as FL
from quantgrid.operators import intervals as I
from quantgrid.operators import pit as P
from quantgrid.operators import xsection as X
from quantgrid.plans.fixtures import E1, P1, P2, e1, e1_days, orders_raw, p1, p2_days, table
from quantgrid.plans.registry import query, rnd, show, sql_cols
from quantgrid.plans.xsection_queries import _clean_sql
from quantgrid.sources.axis import calendar, densify, next_trading_day

# --- month grid over customers, the "trading" axis of the report queries --------------------------


def month_days(s, d) -> DataFrame:
    """Calendar of month starts in which an order was placed."""
    return calendar(table(s, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("date")))


def month_grid(s, d) -> DataFrame:
    """(date_idx, date, tick): customers x month starts; an order counts from the next month start on."""
    facts = e1(s, d).select("tick", F.trunc("date", "month").alias("date")).distinct()
    return densify(facts, [], days=month_days(s, d))


MONTHS = f"""{E1}, m_days as (select date, row_number() over (order by date) - 1 as date_idx
  from (select distinct cast(date_trunc('month', date) as date) as date from e1)),
m_ticks as (select distinct tick from e1), grid as (select * from m_days cross join m_ticks)"""

query("densify_grid", f"{P1} select date_idx, date, tick, close, volume from p1")(
    lambda s, d: p1(s, d).select(F.col("date_idx").cast("bigint").alias("date_idx"), "date", "tick", "close", "volume"))

# --- A1-A5 ----------------------------------------------------------------------------------------

REPORTS = f"""{E1}, rep0 as (select tick, date, value, event_id, last_day(make_date(year(date)::bigint, quarter(date)::bigint * 3, 1::bigint)) as report_date
  from e1),
reports as (select * exclude (rn) from (select *, row_number() over (partition by tick, report_date order by date, event_id) as rn
  from rep0) where rn = 1)"""


def reports(s, d) -> DataFrame:
    """First order of a customer in a quarter, published on its date, as the report of that quarter."""
    raw = orders_raw(s, d).withColumn("report_date", F.last_day(F.make_date(F.year("date"), F.quarter("date") * 3, F.lit(1))))
    return P.report_dedupe(raw, order=["event_id"])


query("dedupe_keep", f"{REPORTS} select tick, report_date, date, event_id, value from reports")(
    lambda s, d: reports(s, d).select("tick", "report_date", "date", "event_id", "value"))

FORECASTS = f"""{REPORTS}, fc as (select o_custkey as tick, last_day(make_date(year(o_orderdate)::bigint, quarter(o_orderdate)::bigint * 3, 1::bigint)) as report_date,
  l_suppkey as author, cast(l_shipdate as date) as made_date, l_extendedprice as f_value, l_quantity as f_qty
  from lineitem join orders on l_orderkey = o_orderkey),
newest as (select * exclude (rn) from (select *, row_number() over (partition by tick, report_date, author
  order by made_date desc, f_value desc, f_qty desc) as rn from fc) where rn = 1),
spans as (select tick, report_date, date as publish_date, lag(date) over (partition by tick order by date, report_date) as prev
  from reports),
inside as (select n.*, publish_date from newest n join spans using (tick, report_date)
  where made_date > prev and made_date < publish_date),
consensus as (select tick, report_date, median(f_value) as f_value, median(f_qty) as f_qty from inside group by 1, 2)"""


def forecasts(s, d) -> DataFrame:
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("tick"), F.to_date("o_orderdate").alias("od"))
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        "tick", F.last_day(F.make_date(F.year("od"), F.quarter("od") * 3, F.lit(1))).alias("report_date"),
        F.col("l_suppkey").alias("author"), F.to_date("l_shipdate").alias("made_date"),
        F.col("l_extendedprice").alias("f_value"), F.col("l_quantity").alias("f_qty"))


def newest_forecasts(s, d) -> DataFrame:
    return P.latest_per_author(forecasts(s, d), order=("made_date", "f_value", "f_qty"))


query("group_first", f"{FORECASTS} select tick, report_date, author, made_date, f_value, f_qty from newest")(
    lambda s, d: newest_forecasts(s, d).select("tick", "report_date", "author", "made_date", "f_value", "f_qty"))
query("consensus_window_join", f"{FORECASTS} select tick, report_date, author, made_date, f_value, publish_date from inside")(
    lambda s, d: P.consensus_window_join(newest_forecasts(s, d), reports(s, d)).select(
        "tick", "report_date", "author", "made_date", "f_value", "publish_date"))


def consensus(s, d) -> DataFrame:
    return P.consensus_median(P.consensus_window_join(newest_forecasts(s, d), reports(s, d)), ["f_value", "f_qty"])


query("consensus_median", f"{FORECASTS} select tick, report_date, {sql_cols(f_value='f_value', f_qty='f_qty')} from consensus")(
    lambda s, d: show(consensus(s, d), ["tick", "report_date"], f_value="f_value", f_qty="f_qty"))

query("duplicate_report", """with o as (select o_custkey as tick, cast(o_orderdate as date) as date, o_orderkey as event_id from orders)
select tick, date, event_id from o where (tick, date) in (select (tick, date) from o group by tick, date having count(*) > 1)""")(
    lambda s, d: FL.duplicate_report(orders_raw(s, d), ["tick", "date"]).select("tick", "date", "event_id"))

query("distinct_rows", "select distinct o_custkey as tick, o_orderpriority as kind from orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("tick"), F.col("o_orderpriority").alias("kind")).distinct())

# --- J1-J11, J15 ----------------------------------------------------------------------------------

query("left_equi", """select o_orderkey, c_custkey as tick, n_name from orders left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey""")(
    lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    .join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    .select("o_orderkey", F.col("c_custkey").alias("tick"), "n_name"))

HISTORY = f"""{MONTHS}, hist as (select tick, date as start_date, arg_max(code, event_id) as code, max(end_date) as end_date from (
  select o_custkey as tick, cast(o_orderdate as date) as date, o_orderkey as event_id, o_orderpriority as code,
  case when o_orderstatus = 'F' then cast(o_orderdate as date) + 200 end as end_date from orders)
  group by 1, 2),
latest as (select g.date_idx, g.date, g.tick, arg_max(h.start_date, h.start_date) as st
  from grid g join hist h on h.tick = g.tick and h.start_date <= g.date group by 1, 2, 3)"""


def class_history(s, d) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("tick"), F.to_date("o_orderdate").alias("start_date"),
                                     "o_orderkey", F.col("o_orderpriority").alias("code"), "o_orderstatus")
    end = F.when(F.col("o_orderstatus") == "F", F.date_add("start_date", 200))
    return o.groupBy("tick", "start_date").agg(F.max_by("code", "o_orderkey").alias("code"), F.max(end).alias("end_date"))


query("asof_backward_valid", f"""{HISTORY} select g.date_idx, g.tick, case when h.end_date is null or g.date < h.end_date then h.code end as code
from grid g left join latest a on a.tick = g.tick and a.date = g.date left join hist h on h.tick = a.tick and h.start_date = a.st""")(
    lambda s, d: P.asof_backward_valid(month_grid(s, d), class_history(s, d)).select(
        F.col("date_idx").cast("bigint").alias("date_idx"), "tick", "code"))

FORWARD = f"""{E1}, nxt as (select day, min(t.date) as trade_date, min(t.date_idx) as date_idx
  from (select distinct date as day from e1) x join e1_days t on t.date >= x.day group by 1)"""
query("asof_forward_calendar", f"""{FORWARD} select tick, event_id, e1.date, trade_date, date_idx
from e1 join nxt on e1.date = nxt.day""")(
    lambda s, d: P.asof_forward_calendar(e1(s, d), e1_days(s, d)).select(
        "tick", "event_id", "date", "trade_date", F.col("date_idx").cast("bigint").alias("date_idx")))

FFILL = f"""{MONTHS}, ev as (select tick, date, value, case when value > 250000 then value end as rare from e1),
u as (select tick, date, null as date_idx, value, rare, 0 as kind from ev union all
  select tick, date, date_idx, null, null, 1 from grid),
f as (select *, last_value(value ignore nulls) over w as fv, last_value(rare ignore nulls) over w as fr from u
  window w as (partition by tick order by date, kind rows between unbounded preceding and current row))"""
query("pit_ffill_align", f"{FFILL} select date_idx, tick, fv as value, fr as rare from f where kind = 1")(
    lambda s, d: P.pit_ffill_align(month_grid(s, d), e1(s, d).withColumn(
        "rare", F.when(F.col("value") > 250000, F.col("value"))), ["value", "rare"]).select(
        F.col("date_idx").cast("bigint").alias("date_idx"), "tick", "value", "rare"))

M1 = f"""{P2}, m1 as (select r_name as idx, l_suppkey as tick, cast(date_trunc('quarter', l_shipdate) as date) as date,
  sum(l_quantity) as weight from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey
  join region on r_regionkey = n_regionkey group by 1, 2, 3),
snap as (select idx, d.date, max(m.date) as snap from (select distinct idx, date from m1) m join p2_days d on m.date <= d.date group by 1, 2)"""


def membership(s, d) -> DataFrame:
    li = table(s, d, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    who = (table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name"))
    return (li.join(who, li.l_suppkey == who.s_suppkey)
            .groupBy(F.col("r_name").alias("index"), F.col("l_suppkey").alias("tick"),
                     F.trunc(F.to_date("l_shipdate"), "quarter").alias("date"))
            .agg(F.sum("l_quantity").alias("weight")))


query("index_membership_asof", f"""{M1} select m1.idx as "index", snap.date, m1.tick, m1.weight
from snap join m1 on m1.idx = snap.idx and m1.date = snap.snap""")(
    lambda s, d: P.index_membership_asof(membership(s, d), p2_days(s, d)).select("index", "date", "tick", "weight"))

YOY = """yy as (select a.*, a.value - b.value as d, a.value / nullif(b.value, 0) - 1 as q from reports a
  left join reports b on b.tick = a.tick and b.report_date = last_day(a.report_date - interval 1 year))"""
query("yoy_self_join", f"{REPORTS}, {YOY} select tick, report_date, {sql_cols(d='d', q='q')} from yy")(
    lambda s, d: show(P.yoy(reports(s, d).withColumn("v2", F.col("value")), ["value"], ["v2"]), ["tick", "report_date"],
                      d="value_yoy", q="v2_yoy"))

LASTK = f"""{MONTHS}, ev as (select e1.tick, m.date_idx as eff, event_id, value,
  row_number() over (partition by e1.tick order by m.date_idx, event_id) as pos from e1
  join m_days m on m.date = cast(date_trunc('month', e1.date) + interval 1 month as date)),
cu as (select tick, eff, max(pos) as n from ev group by 1, 2),
gn as (select g.date_idx, g.tick, coalesce(cu.n, 0) as n from grid g asof left join cu on cu.tick = g.tick and g.date_idx {{op}} cu.eff)
select gn.date_idx, gn.tick, """ + ", ".join(
    f"coalesce(e{i}.value, 0) as value_{i}, (case when e{i}.pos is null then 0 else 1 end)::double as mask_{i}, "
    f"coalesce(gn.date_idx - e{i}.eff, -1) as age_{i}" for i in (1, 2, 3)) + " from gn " + " ".join(
    f"left join ev e{i} on e{i}.tick = gn.tick and e{i}.pos = gn.n - {3 - i}" for i in (1, 2, 3))


def month_events(s, d) -> DataFrame:
    """Orders effective from the month start after them."""
    days = stage(month_days(s, d)).select(F.posexplode("days").alias("effective_idx", "eff_date"))
    ev = e1(s, d).withColumn("eff_date", F.add_months(F.trunc("date", "month"), 1))
    return ev.join(F.broadcast(days), "eff_date").select("tick", "effective_idx", "event_id", "value")


def _last_k(s, d, today):
    out = P.pit_last_k(month_grid(s, d), month_events(s, d), ["value"], k=3, include_today=today)
    slots = [c for i in (1, 2, 3) for c in (
        F.col("events.value")[i - 1].alias(f"value_{i}"), F.col("event_mask")[i - 1].alias(f"mask_{i}"),
        F.col("event_age")[i - 1].cast("bigint").alias(f"age_{i}"))]
    return out.select(F.col("date_idx").cast("bigint").alias("date_idx"), "tick", *slots)


query("pit_last_k", LASTK.replace("{op}", ">="))(lambda s, d: _last_k(s, d, True))
query("pit_last_k_before_today", LASTK.replace("{op}", ">"))(lambda s, d: _last_k(s, d, False))

@query("panel_gather", f"""{FORWARD} select e.tick, e.event_id, p.amount from e1 e left join
  (select o_custkey as tick, date_trunc('month', o_orderdate) as m, sum(cast(floor(o_totalprice * 100 + 0.5) as bigint)) / 100.0::double as amount
   from orders group by 1, 2) p on p.tick = e.tick and p.m = date_trunc('month', e.date)""")
def panel_gather(s, d):
    days = stage(month_days(s, d))
    dates = days.select(F.posexplode("days").alias("date_idx", "m"))
    bars = orders_raw(s, d).groupBy("tick", F.trunc("date", "month").alias("date")).agg(
        (F.sum(F.floor(F.col("value") * 100 + 0.5)) / 100.0).alias("amount"))
    panel = densify(bars, ["amount"], days=days)
    rows = e1(s, d).withColumn("m", F.trunc("date", "month")).join(F.broadcast(dates), "m")
    return P.panel_gather(rows, panel, ["amount"]).select("tick", "event_id", "amount")


MERGED = f"""{FORECASTS}, merged as (select r.*, c.f_value, c.f_qty from reports r left join consensus c using (tick, report_date))"""
query("merge_actual_forecast", f"{MERGED} select tick, report_date, value, {sql_cols(f_value='f_value')} from merged")(
    lambda s, d: P.merge_actual_forecast(reports(s, d), consensus(s, d), ["f_value", "f_qty"]).select(
        "tick", "report_date", "value", rnd("f_value").alias("f_value")))

query("next_trading_day", f"""{E1} select date_idx, date, coalesce(lead(date) over (order by date), date) as next_date from e1_days""")(
    lambda s, d: next_trading_day(e1_days(s, d)).select(F.col("date_idx").cast("bigint").alias("date_idx"), "date", "next_date"))

# --- K31-K35 --------------------------------------------------------------------------------------

PREV12 = "over (partition by tick order by report_date rows between 12 preceding and 1 preceding)"
SUE = f"""{MERGED}, s as (select *, value - f_value as ue, stddev_pop(value) {PREV12} as sd from merged)"""
query("sue", f"{SUE} select tick, report_date, {sql_cols(ue='ue', sue='ue / nullif(sd, 0)')} from s")(
    lambda s, d: show(EV.sue(P.merge_actual_forecast(reports(s, d), consensus(s, d), ["f_value"]).withColumnRenamed(
        "f_value", "forecast_value"), ["value"]), ["tick", "report_date"], ue="value_ue", sue="value_sue"))

FEATURES = ["value", "value_yoy", "qty_yoy", "value_qoq", "qty_qoq", "value_sue"]


def feature_reports(s, d) -> DataFrame:
    """Reports with a quantity, a consensus, an effective month, the customer's region as industry and log size."""
    qty = (table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.sum("l_quantity").alias("qty")))
    cust = (table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("tick"), F.col("n_regionkey").alias("industry")))
    r = reports(s, d).join(qty, "event_id", "left").join(cust, "tick", "left")
    r = P.merge_actual_forecast(r, consensus(s, d), ["f_value"]).withColumnRenamed("f_value", "forecast_value")
    eff = F.add_months(F.trunc("date", "month"), 1)
    return r.withColumns({"month": eff, "logmv": F.ln(F.col("value"))})


FEATURE_SQL = f"""{MERGED}, q as (select l_orderkey as event_id, sum(l_quantity) as qty from lineitem group by 1),
fr as (select m.*, q.qty, n_regionkey as industry, value as mv,
  cast(date_trunc('month', m.date) + interval 1 month as date) as date_idx from merged m
  left join q using (event_id) left join customer on c_custkey = m.tick left join nation on n_nationkey = c_nationkey),
fs as (select a.*, a.value - b.value as value_yoy, a.qty / nullif(b.qty, 0) - 1 as qty_yoy,
  a.value - lag(a.value) over w as value_qoq, a.qty / nullif(lag(a.qty) over w, 0) - 1 as qty_qoq,
  (a.value - a.f_value) / nullif(stddev_pop(a.value) over (partition by a.tick order by a.report_date rows between 12 preceding and 1 preceding), 0) as value_sue
  from fr a left join fr b on b.tick = a.tick and b.report_date = last_day(a.report_date - interval 1 year)
  window w as (partition by a.tick order by a.report_date))"""


def feature_set(s, d) -> DataFrame:
    return EV.event_feature_set(feature_reports(s, d), ["value"], ["value"], ["qty"], ["value"])[0]


query("event_feature_set", f"{FEATURE_SQL} select tick, report_date, {sql_cols(**{f: f for f in FEATURES})} from fs")(
    lambda s, d: show(feature_set(s, d), ["tick", "report_date"], **{f: f for f in FEATURES}))

query("event_feature_clean", f"""{FEATURE_SQL}, fs2 as (select date_idx, event_id as tick, industry, mv, value_yoy, qty_qoq from fs),
{_clean_sql("value_yoy", 1, "fs2", True)}, {_clean_sql("qty_qoq", 2, "fs2", True)}
select tick as event_id, {sql_cols(4, value_yoy="z1.z", qty_qoq="z2.z")} from z1 join z2 using (date_idx, tick)""")(
    lambda s, d: show(X.clean_feature(stage(feature_set(s, d).select("event_id", "month", "industry", "logmv", "value_yoy", "qty_qoq")),
                                      ["value_yoy", "qty_qoq"], by=["month"]), ["event_id"], 4,
                      value_yoy="value_yoy", qty_qoq="qty_qoq"))

# The full set of 62: 22 levels, 17 year-on-year and 17 quarter-on-quarter changes, 6 surprises, all through the cleaning.
LEVELS = [f"l{i}" for i in range(22)]
WIDE = [*LEVELS, *[f"l{i}_yoy" for i in range(17)], *[f"l{i}_qoq" for i in range(17)], *[f"l{i}_sue" for i in range(6)]]


def _level_sql(i: int, x: str = "value") -> str:
    return f"(floor({x} * 100 + 0.5)::bigint * {2 * i + 3} % 10007)::double + {i + 1}"


def _level(i: int, x: str = "value"):
    return F.pmod(F.floor(F.col(x) * 100 + 0.5) * (2 * i + 3), F.lit(10007)).cast("double") + (i + 1)


def wide_reports(s, d) -> DataFrame:
    r = feature_reports(s, d)
    return r.select("tick", "report_date", "event_id", "month", "industry", "logmv", *[_level(i).alias(f"l{i}") for i in range(22)],
                    *[_level(i, "forecast_value").alias(f"forecast_l{i}") for i in range(6)])


PRIOR = "over (partition by a.tick order by a.report_date rows between 12 preceding and 1 preceding)"
WIDE_SQL = f"""{MERGED}, fr as (select m.*, n_regionkey as industry, value as mv,
  cast(date_trunc('month', m.date) + interval 1 month as date) as date_idx, {", ".join(f"{_level_sql(i)} as l{i}" for i in range(22))},
  {", ".join(f"{_level_sql(i, 'f_value')} as f{i}" for i in range(6))}
  from merged m left join customer on c_custkey = m.tick left join nation on n_nationkey = c_nationkey),
ws as (select a.date_idx, a.event_id as tick, a.industry, a.mv, {", ".join(f"a.l{i}" for i in range(22))},
  {", ".join(f"a.l{i} - b.l{i} as l{i}_yoy, a.l{i} - lag(a.l{i}) over w as l{i}_qoq" for i in range(14))},
  {", ".join(f"a.l{i} / nullif(b.l{i}, 0) - 1 as l{i}_yoy, a.l{i} / nullif(lag(a.l{i}) over w, 0) - 1 as l{i}_qoq" for i in range(14, 17))},
  {", ".join(f"(a.l{i} - a.f{i}) / nullif(stddev_pop(a.l{i}) {PRIOR}, 0) as l{i}_sue" for i in range(6))}
  from fr a left join fr b on b.tick = a.tick and b.report_date = last_day(a.report_date - interval 1 year)
  window w as (partition by a.tick order by a.report_date)),
wq as (select date_idx, tick, industry, mv, {", ".join(f"floor({c} * 1024 + 0.5) / 1024.0::double as {c}" for c in WIDE)} from ws)"""


@query("event_feature_clean_wide", WIDE_SQL + ",".join(["", *[_clean_sql(c, i, "wq", True) for i, c in enumerate(WIDE)]]) + f"""
select tick as event_id, {sql_cols(4, **{c: f"z{i}.z" for i, c in enumerate(WIDE)})}
from z0 {" ".join(f"join z{i} using (date_idx, tick)" for i in range(1, 62))}""")
def event_feature_clean_wide(s, d):
    df, names = EV.event_feature_set(wide_reports(s, d), LEVELS, LEVELS[:14], LEVELS[14:17], LEVELS[:6])
    assert names == WIDE
    # Dyadic values add up exactly, so a flat group is flat on both sides.
    exact = [(F.floor(F.col(c) * 1024 + 0.5) / 1024.0).alias(c) for c in names]
    panel = stage(df.select("event_id", "month", "industry", "logmv", *exact))
    return show(X.clean_feature(panel, names, by=["month"]), ["event_id"], 4, **{c: c for c in names})


W = "over (partition by tick order by date_idx rows between unbounded preceding and current row)"
EPANEL = f"""{MONTHS}, ev as (select e1.tick, m.date_idx, arg_max(value, event_id) as x from e1
  join m_days m on m.date = cast(date_trunc('month', e1.date) + interval 1 month as date) group by 1, 2),
tr as (select distinct tick, cast(date_trunc('month', date) as date) as date, 1.0 as close from e1),
pn as (select g.date_idx, g.tick, ev.x, tr.close from grid g left join ev using (tick, date_idx) left join tr using (tick, date)),
o1 as (select *, case when close is not null then last_value(x ignore nulls) {W} end as m from pn)"""


def event_panel_query(s, d):
    ev = month_events(s, d).groupBy("tick", "effective_idx").agg(F.max_by("value", "event_id").alias("x"))
    traded = e1(s, d).select("tick", F.trunc("date", "month").alias("date")).distinct().withColumn("close", F.lit(1.0))
    grid = densify(traded, ["close"], days=month_days(s, d))
    raw = EV.event_panel(grid, ev.withColumn("filled", F.col("x")), ["x", "filled"])
    return P.double_ffill(raw, ["filled"]).select(F.col("date_idx").cast("bigint").alias("date_idx"), "tick", "x", "filled")


query("event_panel", f"{EPANEL} select date_idx, tick, x, last_value(m ignore nulls) {W} as filled from o1")(event_panel_query)

@query("event_panel_intervals", f"""{EPANEL}, o2 as (select date_idx, tick, last_value(m ignore nulls) {W} as filled from o1)
select date_idx, tick, filled from o2 where date_idx >= 60 and filled is not null""")
def event_panel_intervals(s, d):
    """The carried-forward panel from the sixtieth month on, expanded from one stored row per report."""
    dates = month_days(s, d).select(F.posexplode("days").alias("date_idx", "date"))
    traded = e1(s, d).select("tick", F.trunc("date", "month").alias("date")).distinct().join(F.broadcast(dates), "date").select("tick", "date_idx")
    ev = month_events(s, d).groupBy("tick", F.col("effective_idx").alias("date_idx")).agg(F.max_by("value", "event_id").alias("filled"))
    spans = stage(I.traded_intervals(ev, traded, ["filled"]))
    last = dates.agg(F.max("date_idx")).first()[0]
    return I.expand(spans, ["filled"], 60, last).select(F.col("date_idx").cast("bigint").alias("date_idx"), "tick", "filled")


AGES = f"""{MONTHS}, ag as (select g.date_idx, g.tick, coalesce(g.date_idx - max(m.date_idx), -1) as age from grid g
  left join (e1 join m_days m on m.date = cast(date_trunc('month', e1.date) + interval 1 month as date))
  on e1.tick = g.tick and m.date_idx <= g.date_idx group by 1, 2)"""


def ages(s, d) -> DataFrame:
    ev = month_events(s, d).groupBy("tick", F.col("effective_idx").alias("date_idx")).agg(F.lit(1).alias("_one"))
    j = month_grid(s, d).join(ev, ["tick", "date_idx"], "left")
    last = P.tick_window(None, 0)
    at = F.last(F.when(F.col("_one").isNotNull(), F.col("date_idx")), ignorenulls=True).over(last)
    return j.select("date_idx", "tick", F.coalesce(F.col("date_idx") - at, F.lit(-1)).alias("age"))


query("event_age_bucket", f"""{AGES} select date_idx, tick, age, (case when age < 0 then 0 when age <= 1 then 1 when age <= 5 then 2
  when age <= 10 then 3 when age <= 20 then 4 when age <= 40 then 5 when age <= 60 then 6 else 7 end)::bigint as bucket from ag""")(
    lambda s, d: ages(s, d).select(F.col("date_idx").cast("bigint").alias("date_idx"), "tick",
                                   F.col("age").cast("bigint").alias("age"), event_age_bucket("age").cast("bigint").alias("bucket")))


def decay_inputs(s, d):
    norm, log_age = event_age_decay_inputs("age")
    return show(ages(s, d), ["date_idx", "tick"], age_norm=norm, log_age=log_age)


query("event_age_decay_inputs", f"""{AGES} select date_idx, tick, {sql_cols(
    age_norm="least(greatest(age, 0) / 60.0::double, 5)", log_age="ln(1 + greatest(age, 0)) / ln(61)")} from ag""")(decay_inputs)
