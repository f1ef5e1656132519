"""Factor library (K1-K28, K30 lives with the cross-section) over the monthly supplier panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import stage
from quantgrid.factors import industry as IND
from quantgrid.factors import intraday as MIN
from quantgrid.factors import price as PX
from quantgrid.factors import style as ST
from quantgrid.operators import rolling as R
from quantgrid.plans.fixtures import P1, P2, P3, P3_BARS, p1, p2, p2g, p3_bars, table
from quantgrid.plans.registry import query, show, sql_cols
from quantgrid.plans.rolling_queries import (
    ALL, BETA, COV, KEYS, MOM, ORD, SLOPE, VM, VR, W12, W24, corr_sql, ewm_sql, frame, lag_ratio_sql, over_p2, pct_sql)
from quantgrid.plans.xsection_queries import D, DI, mad_sql, rank_sql

W6, W10, W3 = frame(-5), frame(-9), frame(-2)


def on_p2(name: str, sql_values: dict, dp: int = 6, **values):
    over_p2(name, sql_values, dp, **values)


# --- style factors ----------------------------------------------------------------------------

RATES = """rates as (select cast(o_orderdate as date) as date, (avg(o_totalprice - floor(o_totalprice)))::double as y from orders
  where isodow(o_orderdate) < 6 and o_orderstatus = 'F' group by 1),
ax as (select distinct cast(o_orderdate as date) as date from orders)"""


@query("risk_free_daily", f"""with {RATES}, j as (select ax.date, pow(1 + rates.y, 1 / 242.0::double) - 1 as rf from ax left join rates using (date))
select date, {sql_cols(rf="last_value(rf ignore nulls) over (order by date rows between unbounded preceding and current row)")} from j""")
def risk_free(s, d):
    o = table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderstatus", "o_totalprice")
    rates = (o.where((F.weekday("date") < 5) & (F.col("o_orderstatus") == "F")).groupBy("date")
             .agg(F.avg(F.col("o_totalprice") - F.floor("o_totalprice")).alias("y")))
    axis = o.groupBy("date").agg(F.lit(0).alias("date_idx"))
    return show(ST.align_rate(axis, rates, "y"), ["date"], rf="rf")


RF = "pow(1.03::double, 1 / 242.0::double) - 1"
EXCESS = f"""{P2}, mk as (select date_idx, sum(mv * r) / sum(mv) - ({RF}) as rm from p2 group by 1),
p2m as (select p2.* exclude (r), r - ({RF}) as r, rm from p2 left join mk using (date_idx))"""


def excess(s, d) -> DataFrame:
    return ST.with_excess(p2(s, d), ST.risk_free_daily(F.lit(0.03)))


query("beta", f"{EXCESS} select date_idx, tick, {sql_cols(beta=BETA)} from p2m")(
    lambda s, d: show(ST.beta(excess(s, d), 24, 6), KEYS, beta="beta"))
query("momentum", f"{EXCESS} select date_idx, tick, {sql_cols(momentum=f'case when date_idx >= 26 then {MOM} end')} from p2m")(
    lambda s, d: show(ST.momentum(excess(s, d), 24, 12, 3), KEYS, momentum="momentum"))
on_p2("size", dict(size="case when mv > 0 then ln(mv) end"), size=lambda: ST.size())

query("nonlinear_size", f"""{P2}, z as (select *, (ln(mv) - avg(ln(mv)) {D}) / nullif(stddev_pop(ln(mv)) {D}, 0) as z from p2),
c as (select *, z * z * z as z3 from z), b as (select date_idx, regr_slope(z3, z) as b, regr_intercept(z3, z) as a from c group by 1)
select date_idx, tick, {sql_cols(5, nonlinear_size="z3 - (a + b * z)")} from c left join b using (date_idx)""")(
    lambda s, d: show(ST.nonlinear_size(stage(p2(s, d))), KEYS, 5, nonlinear_size="nonlinear_size"))

D6, DS6 = ewm_sql("r", 4.0, W24), ewm_sql("r*r", 4.0, W24)
query("residual_volatility", f"""{EXCESS}, b as (select *, {BETA} as beta, {COV} as cov, {VM} as vm, {VR} as vr,
  {DS6} - {D6} * {D6} as dv, sum(coalesce(case when r > -1 then ln(1 + r) end, 0)) {ALL} as c from p2m),
v as (select *, vr - 2 * beta * cov + beta * beta * vm as hv, max(c) {W24} - min(c) {W24} as cr from b)
select date_idx, tick, {sql_cols(v="case when date_idx >= 23 then 0.74 * sqrt(case when dv < 0 then 0 else dv end) + 0.16 * cr + 0.10 * sqrt(case when hv < 0 then 0 else hv end) end")}
from v""")(
    lambda s, d: show(ST.residual_volatility(excess(s, d), 24, 4, 6), KEYS, v="residual_volatility"))

on_p2("book_to_price", dict(bp=f"sum(volume) {ALL} / nullif(mv, 0)"), dp=9,
      bp=lambda: ST.book_to_price(F.sum("volume").over(R.history())))

query("liquidity", f"""{P2}, s as (select *, case when count(volume) {W3} = 3 and sum(volume) {W3} > 0 then ln(sum(volume) {W3}) end as m from p2),
q as (select *, case when count(m) {W3} = 3 then avg(m) {W3} end as q, case when count(m) {W6} = 6 then avg(m) {W6} end as y from s)
select date_idx, tick, {sql_cols(liq="0.35 * m + 0.35 * case when q > 0 then ln(q) end + 0.30 * case when y > 0 then ln(y) end")} from q""")(
    lambda s, d: show(ST.liquidity(p2(s, d), "volume", 3, 3, 6), KEYS, liq="liquidity"))

DIVIDEND = "case when volume >= 3 then volume * 100 end"
EY = (f"0.68 * amount / nullif(mv, 0) + 0.21 * (case when date_idx >= 11 then coalesce(sum({DIVIDEND}) {W12}, 0) end) / nullif(close, 0)"
      f" + 0.11 * (sum(amount) {W6}) / nullif(mv, 0)")
query("earnings_yield", f"{P2} select date_idx, tick, {sql_cols(ey=EY)} from p2")(
    lambda s, d: show(ST.earnings_yield(p2(s, d), "amount", F.when(F.col("volume") >= 3, F.col("volume") * 100),
                                        F.sum("amount").over(R.past(6)), window=12), KEYS, ey="earnings_yield"))

SLOPE_V = SLOPE.replace("amount", "volume")
GROWTH = f"0.18 * (r) + 0.11 * (close / (open + 1e-8) - 1) + 0.24 * ({SLOPE_V}) + 0.47 * ({SLOPE})"
query("growth", f"{P2} select date_idx, tick, {sql_cols(g=GROWTH)} from p2")(
    lambda s, d: show(ST.growth(p2(s, d), "r", "close", "open", "volume", "amount", 24), KEYS, g="growth"))

on_p2("leverage",
      dict(lev="0.38 * (mv + volume + amount) / nullif(mv, 0) + 0.35 * amount / nullif(high, 0) + 0.27 * (close + amount) / nullif(close - volume, 0)"),
      lev=lambda: ST.leverage("mv", "volume", "amount", "amount", "high", "close"))

query("style_factor_postprocess", f"""{P2}, x as (select *, case when mv > 0 then ln(mv) end as x from p2),
m as (select date_idx, median(x) as med from x group by 1),
mm as (select x.date_idx, any_value(med) as med, median(abs(x - med)) as mad from x join m using (date_idx) group by 1),
w as (select x.*, {mad_sql("x")} as w from x join mm using (date_idx))
select date_idx, tick, {sql_cols(size=f"case when stddev_pop(w) {D} >= 1e-8 then (w - avg(w) {D}) / stddev_pop(w) {D} end")} from w""")(
    lambda s, d: show(ST.style_factor_postprocess(stage(p2(s, d).withColumn("size", ST.size())), ["size"]), KEYS, size="size"))

# --- price and volume ---------------------------------------------------------------------------

Z = "case when stddev_pop({c}) {D} >= 1e-8 then (({c}) - avg({c}) {D}) / stddev_pop({c}) {D} end"
INPUTS = ["open", "high", "low", "close", "lv", "volume"]


def _ratio(a: str, b: str) -> str:
    return f"case when {b} = 0 then 0 else {a} / nullif({b}, 0) end"


def _clip_cte(c: str) -> str:
    return (f"{c}_m as (select date_idx, median({c}_pct) as med from x group by 1), {c}_d as (select x.date_idx, any_value(med) as med_{c}, "
            f"median(abs({c}_pct - med)) as mad_{c} from x join {c}_m using (date_idx) group by 1)")


query("daily_model_inputs", f"""{P1}, l as (select *, case when volume > 0 then ln(volume) end as lv from p1),
x as (select *, {", ".join(f"{pct_sql(c, 1)} as {c}_pct" for c in INPUTS)} from l), {", ".join(_clip_cte(c) for c in INPUTS)}
select date_idx, tick, {sql_cols(**{f"{c}_z": Z.format(c=c, D=D) for c in INPUTS},
    **{f"{c}_pct": mad_sql(f"{c}_pct").replace("med", f"med_{c}").replace("mad", f"mad_{c}") for c in INPUTS},
    close_to_open="case when open = 0 then 0 else close / nullif(open, 0) end - 1",
    high_to_open="case when open = 0 then 0 else high / nullif(open, 0) end - 1",
    low_to_open="case when open = 0 then 0 else low / nullif(open, 0) end - 1",
    high_to_close="case when close = 0 then 0 else high / nullif(close, 0) end - 1",
    low_to_close="case when close = 0 then 0 else low / nullif(close, 0) end - 1",
    high_to_low="case when low = 0 then 0 else high / nullif(low, 0) end - 1")}
from x {" ".join(f"join {c}_d using (date_idx)" for c in INPUTS)}""".replace("/ stddev_pop", "/ stddev_pop"))(
    lambda s, d: show(PX.daily_model_inputs(stage(p1(s, d)), "volume", "volume")[0], KEYS,
                      **{f"{c}_z": f"{c.replace('lv', 'log_volume')}_z" for c in INPUTS},
                      **{f"{c}_pct": f"{c.replace('lv', 'log_volume')}_pct" for c in INPUTS},
                      **{c: c for c in ("close_to_open", "high_to_open", "low_to_open", "high_to_close", "low_to_close", "high_to_low")}))

RATIO_SQL = {
    "close_to_open": "case when open = 0 then 0 else close / nullif(open, 0) end",
    "close_to_high": "case when high = 0 then 0 else close / nullif(high, 0) end",
    "close_to_low": "case when low = 0 then 0 else close / nullif(low, 0) end",
    "high_to_low": "case when low = 0 then 0 else high / nullif(low, 0) end",
    "high_to_open": "case when open = 0 then 0 else high / nullif(open, 0) end",
    "low_to_open": "case when open = 0 then 0 else low / nullif(open, 0) end",
}
on_p2("ratio_features", RATIO_SQL, **{n: (lambda n=n: PX.ratio_features()[n]) for n in RATIO_SQL})


def ret_sql(n: int) -> str:
    return f"(close / nullif(lag(close, {n}) {ORD}, 0) - 1)"


on_p2("cum_return", dict(r3=ret_sql(3), r12=ret_sql(12)), r3=lambda: PX.cum_return("close", 3), r12=lambda: PX.cum_return("close", 12))
on_p2("momentum_diff", dict(m=f"{ret_sql(12)} - {ret_sql(3)}"), m=lambda: PX.momentum_diff("close", 12, 3))
on_p2("return_vol", dict(v6=f"stddev_pop(r) {W6}", v24=f"stddev_pop(r) {W24}"),
      v6=lambda: PX.return_vol("r", 6), v24=lambda: PX.return_vol("r", 24))
on_p2("turnover_cv", dict(cv=f"case when avg(volume) {W10} = 0 then 0 else stddev_pop(volume) {W10} / nullif(avg(volume) {W10}, 0) end"),
      cv=lambda: PX.turnover_cv("volume", 10))
on_p2("log_turnover", dict(lt=f"case when avg(volume) {W10} >= 1e-8 then ln(avg(volume) {W10}) end"),
      lt=lambda: PX.log_turnover("volume", 10))
on_p2("updown_vol", dict(up=f"stddev_pop(case when r > 0 then r end) {W12}", down=f"stddev_pop(case when r < 0 then r end) {W12}"),
      up=lambda: PX.updown_vol("r", 12)["up_vol"], down=lambda: PX.updown_vol("r", 12)["down_vol"])
on_p2("price_volume_corr", dict(rv=corr_sql("r", "volume", W12, 11), cv=corr_sql("close", "volume", W12, 11)), dp=5,
      rv=lambda: PX.price_volume_corr("r", "volume", 12), cv=lambda: PX.price_volume_corr("close", "volume", 12))
on_p2("avg_amount", dict(a=f"avg(amount) {W12}"), dp=4, a=lambda: PX.avg_amount("amount", 12))
on_p2("amount_vol", dict(a=f"stddev_pop(amount) {W12}"), dp=4, a=lambda: PX.amount_vol("amount", 12))
ILL = f"avg(case when amount = 0 then 0 else abs(r) / nullif(amount, 0) end) {W12}"
on_p2("illiquidity", dict(i=f"case when {ILL} >= 1e-12 then ln({ILL}) end"), i=lambda: PX.illiquidity("r", "amount", 12))
on_p2("money_flow", dict(f="sign(r) * amount"), dp=2, f=lambda: PX.money_flow("r", "amount"))
on_p2("turnover_change", dict(t=lag_ratio_sql("volume", 5)), t=lambda: PX.turnover_change("volume", 5))
on_p2("revenue_yoy", dict(y=f"amount / nullif(lag(amount, 12) {ORD}, 0) - 1"), y=lambda: PX.revenue_yoy("amount", 12))

# --- industry relative ----------------------------------------------------------------------------


@query("industry_relative", f"""{P2}, k as (select *, {rank_sql("r", "date_idx, industry")} as rk, count(*) {DI} as k, median(close) {DI} as mc,
  median(open) {DI} as mo, avg(volume) {DI} as av, avg(r) {DI} as ar, stddev_samp(r) {DI} as sr, coalesce(sum(amount) {DI}, 0) as sa from p2g)
select date_idx, tick, {sql_cols(pe_gap="close - mc", pb_gap="case when mo = 0 then 0 else open / nullif(mo, 0) end - 1",
    roe_rank="(k + 1 - rk) / k", debt_gap="case when av = 0 then 0 else abs(volume - av) / nullif(av, 0) end",
    revenue_z="case when sr = 0 then 0 else (r - ar) / nullif(sr, 0) end", cash_share="case when sa = 0 then 0 else amount / nullif(sa, 0) end")} from k""")
def industry_relative(s, d):
    df = IND.industry_relative(stage(p2g(s, d)), "close", "open", "r", "volume", "r", "amount")
    names = ["pe_gap", "pb_gap", "roe_rank", "debt_gap", "revenue_z", "cash_share"]
    return show(df, KEYS, **{n: n for n in names})


query("industry_corr", f"""{P2}, i as (select *, avg(r) {DI} as ir from p2g)
select date_idx, tick, {sql_cols(5, c=corr_sql("r", "ir", W12, 11))} from i""")(
    lambda s, d: show(IND.industry_corr(stage(p2g(s, d)), "r", 12), KEYS, 5, c="industry_corr"))

# --- intraday -------------------------------------------------------------------------------------

BAR = ["date", "tick", "minute_idx"]
DAY = "over (partition by tick, date)"
query("intraday_rollup", f"{P3} select date, tick, {sql_cols(s='sum(volume)', m='avg(volume)')} from p3_bars group by 1, 2")(
    lambda s, d: show(MIN.intraday_rollup(p3_bars(s, d), ["volume"]), ["date", "tick"], s="volume_sum", m="volume_mean"))

OPEN = f"first_value(open) over (partition by tick, date order by minute_idx)"
query("minute_ratios", f"""{P1}, {P3_BARS}, o as (select b.*, p1.open as o from p3_bars b left join p1 on p1.tick = b.tick and p1.date = b.date) select date, tick, minute_idx::bigint as minute_idx, {sql_cols(
    close_ratio=_ratio("close", "o"), high_ratio=_ratio("high", "o"), low_ratio=_ratio("low", "o"))} from o""")(
    lambda s, d: show(MIN.minute_ratios(p3_bars(s, d), p1(s, d)), BAR, close_ratio="close_ratio", high_ratio="high_ratio", low_ratio="low_ratio"))

query("limit_position", f"""{P3} select date, tick, minute_idx::bigint as minute_idx, {sql_cols(
    p="case when high = low then 0.5 else (close - low) / nullif(high - low, 0) end")} from p3_bars""")(
    lambda s, d: show(p3_bars(s, d), BAR, p=MIN.limit_position("close", "high", "low")))

query("minute_volume_ratio", f"""{P3}, t as (select date, tick, sum(volume) as sv from p3_bars group by 1, 2),
b as (select date, tick, avg(sv) over (partition by tick order by date rows between 4 preceding and current row) as base from t)
select date, tick, minute_idx::bigint as minute_idx, {sql_cols(day=f"volume / avg(volume) {DAY}", rolling="volume / base")}
from p3_bars join b using (date, tick)""")(
    lambda s, d: show(MIN.minute_volume_ratio(MIN.minute_volume_ratio(p3_bars(s, d)).withColumnRenamed("volume_ratio", "day"),
                                              mode="rolling", days=5), BAR, day="day", rolling="volume_ratio"))

query("minute_pivot_fill", f"""{P3}, tk as (select distinct user_id as tick from events), dt as (select distinct date from p3_bars),
d as (select distinct date, tick, true as traded from p3_bars),
g as (select date, tick, traded, m.minute_idx from dt cross join tk left join d using (date, tick) cross join (select unnest(range(24)) as minute_idx) m)
select date, tick, minute_idx::bigint as minute_idx, case when traded then coalesce(volume, 0) end as volume, case when traded then coalesce(close, 0) end as close
from g left join p3_bars using (date, tick, minute_idx)""")(
    lambda s, d: MIN.minute_panel(p3_bars(s, d), F.sequence(F.lit(0), F.lit(23)), ["volume", "close"],
                                  table(s, d, "events").select(F.col("user_id").alias("tick")))
    .withColumn("minute_idx", F.col("minute_idx").cast("bigint")))

query("mask_untraded_minutes", f"""{P3}, {P1[5:]} select b.date, b.tick, minute_idx::bigint as minute_idx,
  case when p1.close > 50 then b.volume end as volume from p3_bars b left join p1 on p1.date = b.date and p1.tick = b.tick""")(
    lambda s, d: MIN.minute_mask(p3_bars(s, d), p1(s, d).withColumn("close", F.when(F.col("close") > 50, F.col("close"))), ["volume"])
    .select("date", "tick", F.col("minute_idx").cast("bigint").alias("minute_idx"), "volume"))
