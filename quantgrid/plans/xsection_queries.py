"""Per-date transforms (X1-X16) and market or industry aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgrid.core import stage
from quantgrid.factors.style import market_return
from quantgrid.operators import xsection as X
from quantgrid.plans.fixtures import P1, P2, p1, p2, p2g
from quantgrid.plans.registry import query, rnd, show, sql_cols

KEYS = ["date_idx", "tick"]
D = "over (partition by date_idx)"
DI = "over (partition by date_idx, industry)"

query("cs_zscore", f"""{P1} select date_idx, tick, {sql_cols(
    z=f"case when stddev_pop(close) {D} >= 1e-8 then (close - avg(close) {D}) / stddev_pop(close) {D} end",
    zv=f"case when stddev_pop(volume) {D} >= 1e-8 then (volume - avg(volume) {D}) / stddev_pop(volume) {D} end")} from p1""")(
    lambda s, d: show(X.cs_zscore(p1(s, d), ["close", "volume"], suffix="_z"), KEYS, z="close_z", zv="volume_z"))

query("cs_zscore_sample", f"""{P2} select date_idx, tick, {sql_cols(
    z=f"case when stddev_samp(amount) {DI} is null or stddev_samp(amount) {DI} = 0 then 0 "
      f"else (amount - avg(amount) {DI}) / stddev_samp(amount) {DI} end")} from p2g""")(
    lambda s, d: show(X.cs_zscore_sample(p2g(s, d), ["amount"], ["date_idx", "industry"], "_z"), KEYS, z="amount_z"))


def clip_sql(x: str, lo: str, hi: str) -> str:
    return f"case when {x} > {hi} then {hi} when {x} < {lo} then {lo} else {x} end"


query("winsor_quantile", f"""{P1}, q as (select date_idx, quantile_cont(close, 0.05) as lo,
  quantile_cont(close, 0.95::double) as hi from p1 group by 1)
select date_idx, tick, {sql_cols(w=clip_sql("close", "lo", "hi"))} from p1 join q using (date_idx)""")(
    lambda s, d: show(X.winsor(stage(p1(s, d)), ["close"], "quantile", p=0.05), KEYS, w="close"))

query("winsor_sigma", f"""{P1}, q as (select date_idx, avg(close) - 1.5 * stddev_pop(close) as lo,
  avg(close) + 1.5 * stddev_pop(close) as hi from p1 group by 1)
select date_idx, tick, {sql_cols(w=clip_sql("close", "lo", "hi"))} from p1 join q using (date_idx)""")(
    lambda s, d: show(X.winsor(p1(s, d), ["close"], "sigma", n=1.5), KEYS, w="close"))

MAD = """m as (select date_idx, median({x}) as med from {t} group by 1),
mm as (select {t}.date_idx, any_value(med) as med, median(abs({x} - med)) as mad from {t} join m using (date_idx) group by 1)"""


def mad_sql(x: str, n: float = 3) -> str:
    return clip_sql(x, f"(med - {n} * 1.4826::double * mad)", f"(med + {n} * 1.4826::double * mad)")


query("winsor_mad", f"""{P1}, {MAD.format(x="amount", t="p1")}
select date_idx, tick, {sql_cols(w=mad_sql("amount"))} from p1 join mm using (date_idx)""")(
    lambda s, d: show(X.winsor(stage(p1(s, d)), ["amount"], "mad", n=3), KEYS, w="amount"))

TAILS = """q as (select date_idx, quantile_cont(close, 0.1::double) as lo, quantile_cont(close, 0.9::double) as hi
  from p1 group by 1)"""
query("winsor_tail_mean", f"""{P1}, {TAILS}, t as (select p1.date_idx, avg(case when close < lo then close end) as lm,
  avg(case when close > hi then close end) as hm from p1 join q using (date_idx) group by 1)
select date_idx, tick, {sql_cols(w="case when close < lo then lm when close > hi then hm else close end")}
from p1 join q using (date_idx) join t using (date_idx)""")(
    lambda s, d: show(X.winsor_tail_mean(stage(p1(s, d)), ["close"], 0.1), KEYS, w="close"))

query("winsor_shrink", f"""{P1}, {TAILS} select date_idx, tick, {sql_cols(
    w="case when close < lo then lo - (lo - close) * 0.5 when close > hi then hi + (close - hi) * 0.5 else close end")}
from p1 join q using (date_idx)""")(
    lambda s, d: show(X.winsor_shrink(stage(p1(s, d)), ["close"], 0.1), KEYS, w="close"))

query("robust_scale", f"""{P1}, q as (select date_idx, median(close) as m,
  quantile_cont(close, 0.75) - quantile_cont(close, 0.25) as iqr from p1 group by 1)
select date_idx, tick, {sql_cols(z="(close - m) / case when iqr = 0 then 1 else iqr end")} from p1 join q using (date_idx)""")(
    lambda s, d: show(X.robust_scale(stage(p1(s, d)), ["close"]), KEYS, z="close"))


def rank_sql(x: str, by: str = "date_idx") -> str:
    """Average rank among non-NULL values."""
    part = f"partition by {by}, {x} is null"
    return (f"case when {x} is not null then rank() over ({part} order by {x}) "
            f"+ (count(*) over (partition by {by}, {x}) - 1) / 2.0::double end")


query("cs_rank", f"""{P1}, k as (select *, {rank_sql("volume")} as rk, count(volume) {D} as n from p1)
select date_idx, tick, {sql_cols(scaled="(rk - 1) / case when n > 1 then n - 1 else 1 end", raw="rk - 1")} from k""")(
    lambda s, d: show(X.cs_rank(stage(p1(s, d)), "volume", out="scaled").transform(
        lambda x: X.cs_rank(x, "volume", out="raw", normalize=False)), KEYS, scaled="scaled", raw="raw"))


def yj_sql(x: str, lam: str) -> str:
    return (f"case when {x} >= 0 then case when abs({lam}) < 1e-12 then ln({x} + 1) else (pow({x} + 1, {lam}) - 1) / {lam} end "
            f"when {x} < 0 then case when abs(2 - {lam}) < 1e-12 then -ln(1 - {x}) else -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) end end")


def yj_search(name: str, source: str, low: str, high: str) -> str:
    """Best exponent per date by bisection on the sign of the likelihood's slope; 70 halvings, constant dates left out."""
    y = yj_sql("x", "lam")
    y1 = (f"case when x >= 0 then (pow(x + 1, lam) * ln(x + 1) - {y}) / lam "
          f"else (pow(1 - x, 2 - lam) * ln(1 - x) + {y}) / (2 - lam) end")
    return f"""
{name}_s as (select date_idx, {low}::double as lo, {high}::double as hi, 1 as k from {source} group by 1 having max(x) > min(x)
  union all select date_idx, case when up then lam else lo end, case when up then hi else lam end, k + 1 from (
    select date_idx, lo, hi, lam, k, sum(sign(x) * ln(1 + abs(x))) > count(*) * covar_pop(y, y1) / var_pop(y) as up from (
      select date_idx, lo, hi, lam, k, x, {y} as y, {y1} as y1
      from (select *, (lo + hi) / 2 as lam from {name}_s where k <= 70) join {source} using (date_idx)) group by all)),
{name} as (select date_idx, (lo + hi) / 2 as lam from {name}_s where k = 71)"""


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


YEO = f"""{recursive(P1)}, x as (select date_idx, ln(close) as x from p1 where close > 0), {yj_search("l2", "x", "-13.3", "11.9")}"""


def _log_close(s, d):
    return stage(p1(s, d)).withColumn("x", F.when(F.col("close") > 0, F.ln("close")))


query("yeo_johnson_lambda", f"{YEO} select date_idx, {sql_cols(lam='lam')} from l2")(
    lambda s, d: show(X.yeo_johnson_lambda(_log_close(s, d), "x"), ["date_idx"], lam="lam"))

query("yeo_johnson", f"""{YEO}, y as (select date_idx, tick, {yj_sql('ln(close)', 'lam')} as y from p1 left join l2 using (date_idx))
select date_idx, tick, {sql_cols(yeo=f"(y - avg(y) {D}) / stddev_pop(y) {D}")} from y""")(
    lambda s, d: show(X.yeo_johnson(_log_close(s, d), "x"), KEYS, yeo="yeo"))

query("neutralise_ind_size", f"""{P2}, b as (select *, ln(mv) as s,
  case when amount is not null and mv > 0 then amount / 1000 end as x from p2g),
k as (select *, case when x is not null then s end as z from b),
m as (select *, (avg(x) {DI} * avg(z) {DI} - avg(x * z) {DI}) / (avg(z) {DI} * avg(z) {DI} - avg(z * z) {DI} + 1e-6) as slope,
  avg(x) {DI} as mx, avg(z) {DI} as ms from k),
e as (select *, x - slope * z - (mx - slope * ms) as res from m)
select date_idx, tick, {sql_cols(4, n=f"(res - avg(res) {DI}) / (stddev_pop(res) {DI} + 1e-6)")} from e""")(
    lambda s, d: show(X.neutralise(stage(p2g(s, d)).withColumn("x", F.col("amount") / 1000), ["x"]), KEYS, 4, n="x"))

query("neutralise_event", f"""{P2}, b as (select *, ln(mv) as s from p2g),
m as (select *, avg(close) {DI} as mx, avg(s) {DI} as ms, var_pop(s) {DI} as vs,
  count(s) {DI} = 2 and count(close) {DI} = 2 and count(close + s) {DI} = 2 as two from b),
c as (select *, avg((close - mx) * (s - ms)) {DI} as cov from m),
e as (select *, case when close + s is not null and two and vs > 1e-12 then 0
  else close - mx - case when vs > 1e-12 then cov / vs else 0 end * (s - ms) end as res from c)
select date_idx, tick, {sql_cols(4, n="res")} from e""")(
    lambda s, d: show(X.neutralise_event(p2g(s, d).withColumn("logmv", X.F.ln("mv")), ["close"]), KEYS, 4, n="close"))

query("fill_industry_median", f"""{P2}, m as (select date_idx, industry, median(close) as med from p2g group by 1, 2)
select date_idx, tick, {sql_cols(c="coalesce(close, med)")} from p2g left join m using (date_idx, industry)""")(
    lambda s, d: show(X.fill_industry_median(stage(p2g(s, d)), ["close"]), KEYS, c="close"))


def _clean_sql(x: str, n: int, source: str, neutral: bool) -> str:
    """One feature through fill, clip, neutralise, z-score; stages are numbered CTEs."""
    fit = "case when y is not null and s is not null and two and vs > 1e-12 then 0 else y - mx - case when vs > 1e-12 then cov / vs else 0 end * (s - ms) end"
    res = fit if neutral else "y"
    return f"""
f{n} as (select *, coalesce({x}, median({x}) {DI}) as f from {source}),
fm{n} as (select *, median(f) {D} as med from f{n}),
fd{n} as (select *, median(abs(f - med)) {D} as mad from fm{n}),
w{n} as (select *, {mad_sql("f")} as y, ln(mv) as s from fd{n}),
n{n} as (select *, avg(y) {DI} as mx, avg(s) {DI} as ms, var_pop(s) {DI} as vs,
  count(s) {DI} = 2 and count(y) {DI} = 2 and count(y + s) {DI} = 2 as two from w{n}),
c{n} as (select *, avg((y - mx) * (s - ms)) {DI} as cov from n{n}),
r{n} as (select date_idx, tick, {res} as r from c{n}),
z{n} as (select date_idx, tick, case when stddev_samp(r) {D} is null or stddev_samp(r) {D} = 0 then 0
  else (r - avg(r) {D}) / stddev_samp(r) {D} end as z from r{n})"""


query("clean_feature", f"""{P2}, {_clean_sql("close", 1, "p2g", True)}, {_clean_sql("volume", 2, "p2g", True)}
select date_idx, tick, {sql_cols(close_clean="z1.z", volume_clean="z2.z")} from z1 join z2 using (date_idx, tick)""")(
    lambda s, d: show(X.clean_feature(stage(p2g(s, d)).withColumn("logmv", F.ln("mv")), ["close", "volume"]), KEYS,
                      close_clean="close", volume_clean="volume"))

query("clean_feature_plain", f"""{P2}, {_clean_sql("close", 1, "p2g", False)}
select date_idx, tick, {sql_cols(close_clean="z")} from z1""")(
    lambda s, d: show(X.clean_feature(stage(p2g(s, d)), ["close"], neutral=False), KEYS, close_clean="close"))

query("cs_orthogonalise", f"""{P1}, z as (select *, (close - avg(close) {D}) / nullif(stddev_pop(close) {D}, 0) as z from p1),
c as (select *, z * z * z as z3 from z),
b as (select date_idx, regr_slope(z3, z) as b, regr_intercept(z3, z) as a from c group by 1)
select date_idx, tick, {sql_cols(orth="z3 - (a + b * z)")} from c left join b using (date_idx)""")(
    lambda s, d: show(X.cs_orthogonalise(X.cs_zscore(p1(s, d), ["close"]).withColumn("z3", F.pow("close", F.lit(3.0))),
                                         "z3", "close"), KEYS, orth="orth"))

query("graph_feature_zscore", f"""{P1} select date_idx, tick, {sql_cols(
    z=f"(amount - avg(amount) {D}) / case when stddev_pop(amount) {D} < 1e-8 then 1 else stddev_pop(amount) {D} end")} from p1""")(
    lambda s, d: show(X.graph_feature_zscore(p1(s, d), ["amount"]), KEYS, z="amount"))

query("group_softmax", f"""{P2}, m as (select *, close / 10000 - max(close / 10000) over (partition by date_idx, sector) as e
  from p2g where close is not null)
select date_idx, tick, {sql_cols(w="exp(e) / (sum(exp(e)) over (partition by date_idx, sector) + 1e-12)")} from m""")(
    lambda s, d: show(X.group_softmax(p2g(s, d).where("close is not null").withColumn("x", F.col("close") / 10000), "x",
                                      ["date_idx", "sector"]), KEYS, w="softmax"))

query("market_return", f"{P2} select date_idx, {sql_cols(rm='sum(mv * r) / sum(mv)')} from p2 group by 1")(
    lambda s, d: show(market_return(p2(s, d)), ["date_idx"], rm="market"))


def _industry_all(s, d):
    df = stage(p2g(s, d))
    for how in ("median", "mean", "std", "sum", "rank"):
        df = X.industry_agg(df, "close", how, "i_" + how)
    return show(df, KEYS, 6, **{"i_" + h: "i_" + h for h in ("median", "mean", "std", "sum", "rank")})


query("industry_agg", f"""{P2}, k as (select *, {rank_sql("close", "date_idx, industry")} as rk, count(*) {DI} as k,
  median(close) {DI} as med from p2g)
select date_idx, tick, {sql_cols(6, i_median="med", i_mean=f"avg(close) {DI}", i_std=f"stddev_samp(close) {DI}",
                                 i_sum=f"coalesce(sum(close) {DI}, 0)", i_rank="(k + 1 - rk) / k")} from k""")(_industry_all)


def retprod_sql(w: int) -> str:
    f = f"over (partition by tick order by date_idx rows between current row and {w - 1} following)"
    return f"case when count(*) {f} = {w} then coalesce(product(1 + r) {f}, 1) - 1 end"


@query("label_family", f"""{recursive(P2)}, y as (select *, {retprod_sql(1)} as y1, {retprod_sql(3)} as y3 from p2g),
x as (select date_idx, y3 as x from y where y3 is not null),
{yj_search("l3", "x", "-251.3", "249.9")},
yt as (select date_idx, tick, {yj_sql('y3', 'lam')} as t from y left join l3 using (date_idx)),
yz as (select date_idx, tick, case when stddev_pop(t) {D} >= 1e-8 then (t - avg(t) {D}) / stddev_pop(t) {D} end as y3_yeo from yt),
nb as (select date_idx, tick, industry, case when y3 is not null and mv > 0 then y3 end as x, case when y3 is not null and mv > 0 then ln(mv) end as z from y),
nm as (select *, (avg(x) {DI} * avg(z) {DI} - avg(x * z) {DI}) / (avg(z) {DI} * avg(z) {DI} - avg(z * z) {DI} + 1e-6) as slope,
  avg(x) {DI} as mx, avg(z) {DI} as ms from nb),
ne as (select date_idx, tick, industry, x - slope * z - (mx - slope * ms) as res from nm),
nz as (select date_idx, tick, (res - avg(res) {DI}) / (stddev_pop(res) {DI} + 1e-6) as y3_neutral from ne),
k as (select *, {rank_sql("y3")} as rk, count(y3) {D} as n from y),
q as (select date_idx, quantile_cont(y3, 0.1::double) as lo, quantile_cont(y3, 0.9::double) as hi from y group by 1)
select date_idx, tick, {sql_cols(
    y1="y1", y3="y3", y3_z=f"case when stddev_pop(y3) {D} >= 1e-8 then (y3 - avg(y3) {D}) / stddev_pop(y3) {D} end",
    y3_rank="(rk - 1) / case when n > 1 then n - 1 else 1 end",
    y3_shrink="case when y3 < lo then lo - (lo - y3) * 0.5 when y3 > hi then hi + (y3 - hi) * 0.5 else y3 end",
    y3_yeo="floor(y3_yeo * 1000 + 0.5) / 1000.0::double", y3_neutral="floor(y3_neutral * 10000 + 0.5) / 10000.0::double",
    gross="lead(close, 4) over (partition by tick order by date_idx) / nullif(lead(close, 1) over (partition by tick order by date_idx), 0)")}
from k left join q using (date_idx) left join yz using (date_idx, tick) left join nz using (date_idx, tick)""")
def label_family(s, d):
    from quantgrid.factors.labels import gross_return, label_family as op
    df = op(stage(p2g(s, d)), "r", [1, 3], p=0.1)
    df = df.withColumn("gross", gross_return("close", 3))
    return show(df, KEYS, y3_yeo=rnd("y3_yeo", 3), y3_neutral=rnd("y3_neutral", 4), y1="y1", y3="y3", y3_z="y3_z", y3_rank="y3_rank", y3_shrink="y3_shrink", gross="gross")
