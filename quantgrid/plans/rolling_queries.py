"""Rolling windows along the time axis of a tick."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgrid.functions.scalar import log_positive
from quantgrid.operators import rolling as R
from quantgrid.operators import scans as S
from quantgrid.plans.fixtures import P1, P2, P3_BARS, e1, E1, p1, p2, p3_bars
from quantgrid.plans.registry import query, rnd, show, sql_cols, sql_rnd

KEYS = ["date_idx", "tick"]


def frame(a: int, b: int = 0) -> str:
    def end(n):
        return "current row" if n == 0 else f"{abs(n)} {'preceding' if n < 0 else 'following'}"
    return f"over (partition by tick order by date_idx rows between {end(a)} and {end(b)})"


W5, W6, W12, W24 = frame(-4), frame(-5), frame(-11), frame(-23)
ALL = "over (partition by tick order by date_idx rows between unbounded preceding and current row)"
ORD = "over (partition by tick order by date_idx)"


def over_p1(name, sql_values, **values):
    query(name, f"{P1} select date_idx, tick, {sql_cols(**sql_values)} from p1")(
        lambda s, d: show(p1(s, d), KEYS, **{k: v() for k, v in values.items()}))


def over_p2(name, sql_values, dp=6, **values):
    query(name, f"{P2} select date_idx, tick, {sql_cols(dp, **sql_values)} from p2")(
        lambda s, d: show(p2(s, d), KEYS, dp, **{k: v() for k, v in values.items()}))


over_p1("rolling_retprod",
        dict(future=f"case when count(*) {frame(0, 2)} = 3 then coalesce(product(1 + r) {frame(0, 2)}, 1) - 1 end",
             past=f"coalesce(product(1 + r) {W5}, 1) - 1"),
        future=lambda: R.rolling_retprod("r", 3), past=lambda: R.rolling_retprod("r", 5, future=False))

over_p1("rolling_mean", dict(m=f"avg(close) {W5}", m_full=f"case when date_idx >= 4 then avg(close) {W5} end"),
        m=lambda: R.rolling_mean("close", 5), m_full=lambda: R.rolling_mean("close", 5, full=True))

over_p1("rolling_std", dict(s0=f"stddev_pop(close) {W5}", s1=f"stddev_samp(close) {W5}"),
        s0=lambda: R.rolling_std("close", 5), s1=lambda: R.rolling_std("close", 5, ddof=1))

over_p1("rolling_max", dict(mx=f"max(high) {W5}"), mx=lambda: R.rolling_max("high", 5))
over_p1("rolling_min", dict(mn=f"min(low) {W5}"), mn=lambda: R.rolling_min("low", 5))


def corr_sql(x: str, y: str, w: str, full: int) -> str:
    both = f"{x} is not null and {y} is not null"
    cov = (f"(avg({x}*{y}) {w} - avg({x}) {w} * avg(case when {both} then {y} end) {w}"
           f" - avg({y}) {w} * avg(case when {both} then {x} end) {w} + avg({x}) {w} * avg({y}) {w})")
    sd = f"(stddev_pop({x}) {w} * stddev_pop({y}) {w})"
    return f"case when date_idx >= {full} then case when {sd} = 0 then 0 else {cov} / nullif({sd}, 0) end end"


over_p1("rolling_corr", dict(c=corr_sql("r", "volume", W6, 5)), c=lambda: R.rolling_corr("r", "volume", 6))

over_p1("cumulative_ema",
        dict(ema=f"case when sum(case when close is not null then pow(1-2/6.0::double, date_idx) end) {ALL} >= 1e-8 then "
                 f"sum(close*pow(1-2/6.0::double, date_idx)) {ALL} / "
                 f"sum(case when close is not null then pow(1-2/6.0::double, date_idx) end) {ALL} end"),
        ema=lambda: R.cumulative_ema("close", 5))

over_p1("textbook_ema",
        dict(ema=f"sum(close*pow(1.5, date_idx)) {W5} / sum(case when close is not null then pow(1.5, date_idx) end) {W5}"),
        ema=lambda: R.ema("close", 5))

over_p1("diff", dict(d1=f"close - lag(close, 1) {ORD}", d3=f"close - lag(close, 3) {ORD}"),
        d1=lambda: R.diff("close"), d3=lambda: R.diff("close", 3))


def pct_sql(x: str, n: int) -> str:
    return (f"case when {x} is not null and lag({x},{n}) {ORD} = 0 then 0 "
            f"else ({x} - lag({x},{n}) {ORD}) / nullif(lag({x},{n}) {ORD}, 0) end")


def lag_ratio_sql(x: str, n: int) -> str:
    return (f"case when lag({x},{n}) {ORD} = 0 then 0 "
            f"else ({x} - lag({x},{n}) {ORD}) / nullif(lag({x},{n}) {ORD}, 0) end")


over_p1("pct_change", dict(p1=pct_sql("close", 1), p5=pct_sql("volume", 5)),
        p1=lambda: R.pct_change("close"), p5=lambda: R.pct_change("volume", 5))

over_p1("lag_ratio",
        {f"{f}_{n}": lag_ratio_sql(f, n) for f in ("open", "high", "low", "close", "volume", "amount") for n in (1, 5)},
        **{f"{f}_{n}": (lambda f=f, n=n: R.lag_ratio(f, n))
           for f in ("open", "high", "low", "close", "volume", "amount") for n in (1, 5)})

over_p1("forward_shift",
        dict(next_r=f"lead(r, 1) {ORD}",
             y4_shift2=f"case when count(r) {frame(2, 5)} = 4 then product(1 + r) {frame(2, 5)} - 1 end"),
        next_r=lambda: R.forward_shift("r", 1), y4_shift2=lambda: R.rolling_retprod_strict("r", 4, shift=2))


@query("forward_fill", f"""{P1}, f as (select *, last_value(close ignore nulls) {ALL} as filled from p1)
select date_idx, tick, {sql_cols(filled="filled", masked="case when close is not null then filled end",
                                 again=f"last_value(case when close is not null then filled end ignore nulls) {ALL}")} from f""")
def forward_fill(spark, sf):
    once = p1(spark, sf).withColumn("filled", R.forward_fill("close"))
    masked = once.withColumn("masked", F.when(F.col("close").isNotNull(), F.col("filled")))
    return show(masked, KEYS, filled="filled", masked="masked", again=R.forward_fill("masked"))


def ewm_sql(x: str, hl: float, w: str) -> str:
    weight = f"pow(2.0, date_idx / {hl}::double)"
    return f"(sum({x} * {weight}) {w} / sum(case when {x} is not null then {weight} end) {w})"


EWM, EWS = ewm_sql("r", 6.0, W24), ewm_sql("r*r", 6.0, W24)
over_p2("exp_weighted_mean", dict(m=EWM, m_full=f"case when date_idx >= 23 then {EWM} end"),
        m=lambda: R.exp_weighted_mean("r", 24, 6), m_full=lambda: R.exp_weighted_mean("r", 24, 6, full=True))
over_p2("exp_weighted_std", dict(s=f"sqrt(case when {EWS} - {EWM} * {EWM} < 0 then 0 else {EWS} - {EWM} * {EWM} end)"),
        s=lambda: R.exp_weighted_std("r", 24, 6))

MKT = """, mkt as (select date_idx, sum(mv * r) / sum(mv) as rm from p2 group by 1),
p2m as (select p2.*, rm from p2 left join mkt using (date_idx))"""


def with_market(spark, sf):
    from quantgrid.factors.style import market_return
    from quantgrid.core import attach
    panel = p2(spark, sf)
    return attach(panel, market_return(panel, "mv", "r").withColumnRenamed("market", "rm"), ["date_idx"])


def wmean_sql(z: str, w: str = W24, hl: float = 6.0, cond: str = "r is not null and rm is not null") -> str:
    weight = f"case when {cond} then pow(2.0, date_idx / {hl}::double) end"
    return f"(sum(({weight}) * ({z})) {w} / sum({weight}) {w})"


COV = f"({wmean_sql('r*rm')} - {wmean_sql('r')} * {wmean_sql('rm')})"
VM = f"({wmean_sql('rm*rm')} - {wmean_sql('rm')} * {wmean_sql('rm')})"
VR = f"({wmean_sql('r*r')} - {wmean_sql('r')} * {wmean_sql('r')})"
BETA = f"case when date_idx >= 23 then case when {VM} <= 1e-18 then 0 else {COV} / {VM} end end"


@query("rolling_beta", f"{P2}{MKT} select date_idx, tick, {sql_cols(beta=BETA)} from p2m")
def rolling_beta(spark, sf):
    return show(with_market(spark, sf), KEYS, beta=R.rolling_beta("r", "rm", 24, 6))


@query("residual_vol", f"""{P2}{MKT}, b as (select *, {BETA} as beta, {COV} as cov, {VM} as vm, {VR} as vr from p2m),
v as (select *, vr - 2 * beta * cov + beta * beta * vm as v from b)
select date_idx, tick, {sql_cols(vol="sqrt(case when v < 0 then 0 else v end)")} from v""")
def residual_vol(spark, sf):
    b = with_market(spark, sf).withColumn("beta", R.rolling_beta("r", "rm", 24, 6))
    return show(b, KEYS, vol=R.residual_vol("r", "rm", "beta", 24, 6))


MOM = ewm_sql("case when r > -1 then ln(1 + r) end", 12.0, frame(-26, -3))
over_p2("ew_momentum", dict(mom=f"case when date_idx >= 26 then {MOM} end"),
        mom=lambda: R.ew_momentum("r", 24, 12, 3))


@query("cum_range", f"""{P2}, c as (select *, sum(coalesce(case when r > -1 then ln(1 + r) end, 0)) {ALL} as c from p2)
select date_idx, tick, {sql_cols(cmra=f"case when date_idx >= 23 then max(c) {W24} - min(c) {W24} end")} from c""")
def cum_range(spark, sf):
    run = p2(spark, sf).withColumn("c", R.running_log_return("r"))
    return show(run, KEYS, cmra=R.cum_range("c", 24))


SLOPE = f"""case when date_idx >= 23 and count(amount) {W24} >= 2 and abs(avg(amount) {W24}) > 1e-12 then
 ((sum(date_idx * amount) {W24} - (date_idx - 11.5) * sum(amount) {W24})
  - avg(amount) {W24} * (sum(case when amount is not null then date_idx end) {W24} - (date_idx - 11.5) * count(amount) {W24}))
 / (24 * (24 * 24 - 1) / 12.0) / (avg(amount) {W24}) end"""
over_p2("rolling_slope_over_mean", dict(g=SLOPE), g=lambda: R.rolling_slope_over_mean("amount", 24))

over_p1("rolling_sum_strict", dict(s=f"case when count(volume) {W5} = 5 then sum(volume) {W5} end",
                                   m=f"case when count(amount) {frame(-2)} = 3 then avg(amount) {frame(-2)} end"),
        s=lambda: R.rolling_sum_strict("volume", 5), m=lambda: R.rolling_mean_strict("amount", 3))
over_p2("rolling_nansum", dict(s=f"case when date_idx >= 11 then coalesce(sum(volume) {W12}, 0) end"),
        s=lambda: R.rolling_nansum("volume", 12))

BY_DATE = "over (partition by tick order by date)"


@query("lagged_rolling_std", f"""{E1} select date, tick, {sql_cols(
    4, sd="stddev_pop(value) over (partition by tick order by date rows between 12 preceding and 1 preceding)")} from e1""")
def lagged_rolling_std(spark, sf):
    return show(e1(spark, sf), ["date", "tick"], 4, sd=R.lagged_rolling_std("value", 12, "date"))


@query("qoq", f"""{E1} select date, tick, {sql_cols(
    d=f"value - lag(value) {BY_DATE}", ratio=f"value / nullif(lag(value) {BY_DATE}, 0) - 1")} from e1""")
def qoq(spark, sf):
    from quantgrid.operators.pit import qoq as op
    return show(op(e1(spark, sf), diff=["value"], ratio=[], order="date").withColumnRenamed("value_qoq", "d")
                .transform(lambda x: op(x, diff=[], ratio=["value"], order="date")),
                ["date", "tick"], d="d", ratio="value_qoq")


over_p1("conditional_rolling_std", dict(up=f"stddev_pop(case when r > 0 then r end) {frame(-9)}",
                                        down=f"stddev_pop(case when r < 0 then r end) {frame(-9)}"),
        up=lambda: R.conditional_rolling_std("r", 10, 1), down=lambda: R.conditional_rolling_std("r", 10, -1))


@query("series_standardize", f"""{P1}, a as (select date_idx, tick, list(close) {W5} as a from p1)
select date_idx, tick, case when date_idx >= 4 then list_transform(a, lambda v: case when a[1] = 0 then 0.0
  else {sql_rnd('v / nullif(a[1], 0)')} end) end as series from a""")
def series_standardize(spark, sf):
    a = p1(spark, sf).withColumn("a", R.value_array("close", 5))
    return a.select(F.col("date_idx").cast("bigint").alias("date_idx"), "tick",
                    F.transform(R.series_standardize("a"), lambda v: rnd(v)).alias("series"))


@query("lag_window_array", f"""{P1}, a as (select date_idx, tick, list(close) {W5} as c, list(volume) {W5} as v from p1)
select date_idx, tick, c as close_seq, v as volume_seq from a where date_idx >= 4""")
def lag_window_array(spark, sf):
    from quantgrid.operators.samples import lag_windows
    a = lag_windows(p1(spark, sf), ["close", "volume"], 5)
    return a.select(F.col("date_idx").cast("bigint").alias("date_idx"), "tick",
                    F.col("seq.close").alias("close_seq"), F.col("seq.volume").alias("volume_seq"))


@query("instance_normalise", f"""{P1}, a as (select date_idx, tick, list(close) {W5} as a, avg(close) {W5} as m,
  var_pop(close) {W5} as v from p1)
select date_idx, tick, list_transform(a, lambda x: {sql_rnd('(x - m) / sqrt(v + 1e-5)')}) as seq from a where date_idx >= 4""")
def instance_normalise(spark, sf):
    a = p1(spark, sf).withColumn("a", R.value_array("close", 5)).where(F.col("a").isNotNull())
    return a.select(F.col("date_idx").cast("bigint").alias("date_idx"), "tick",
                    F.transform(R.instance_normalise("a"), lambda v: rnd(v)).alias("seq"))


@query("minute_returns", f"""with {P3_BARS} select date, tick, minute_idx::bigint as minute_idx, {sql_cols(
    ret="close / nullif(lag(close) over (partition by tick, date order by minute_idx), 0) - 1")} from p3_bars""")
def minute_returns(spark, sf):
    from quantgrid.factors.intraday import minute_returns as op
    return show(op(p3_bars(spark, sf), ["close"]), ["date", "tick", "minute_idx"], ret="close_ret")


@query("minute_zscore", f"""with {P3_BARS}, z as (select date, tick, minute_idx,
  (volume - avg(volume) over d) / nullif(stddev_pop(volume) over d, 0) as z, row_number() over o as i, count(*) over d as n
  from p3_bars window d as (partition by tick, date), o as (partition by tick, date order by minute_idx))
select date, tick, minute_idx::bigint as minute_idx, {sql_cols(z="z")} from z where i > 1 and i <= n - 3""")
def minute_zscore(spark, sf):
    from quantgrid.factors.intraday import minute_zscore as op
    return show(op(p3_bars(spark, sf), ["volume"], trim=(1, 3)), ["date", "tick", "minute_idx"], z="volume_z")


LONG = 60
W60, AHEAD60 = frame(1 - LONG), frame(0, LONG - 1)


def _pair60(z: str) -> str:
    return wmean_sql(z, W60, 20.0)


COV60 = f"({_pair60('r*rm')} - {_pair60('r')} * {_pair60('rm')})"
VM60, VR60 = (f"({_pair60(f'{x}*{x}')} - {_pair60(x)} * {_pair60(x)})" for x in ("rm", "r"))
FULL60 = f"date_idx >= {LONG - 1}"
BETA60 = f"case when {FULL60} then case when {VM60} <= 1e-18 then 0 else {COV60} / {VM60} end end"
MOM60 = ewm_sql("case when r > -1 then ln(1 + r) end", 30.0, frame(-LONG - 2, -3))
SLOPE60 = (SLOPE.replace(W24, W60).replace("date_idx >= 23", FULL60).replace("11.5", str((LONG - 1) / 2))
           .replace("24 * (24 * 24 - 1)", f"{LONG} * ({LONG} * {LONG} - 1)"))


@query("long_windows", f"""{P2}{MKT}, c as (select *, sum(coalesce(case when r > -1 then ln(1 + r) end, 0)) {ALL} as c, {BETA60} as beta,
  {COV60} as cov, {VM60} as vm, {VR60} as vr from p2m), v as (select *, vr - 2 * beta * cov + beta * beta * vm as v from c)
select date_idx, tick, {sql_cols(4, avg_close=f"avg(close) {W60}", sd_close=f"stddev_pop(close) {W60}", top=f"max(high) {W60}", bottom=f"min(low) {W60}",
  past=f"coalesce(product(1 + r) {W60}, 1) - 1", future=f"case when count(*) {AHEAD60} = {LONG} then coalesce(product(1 + r) {AHEAD60}, 1) - 1 end",
  corr=corr_sql("r", "volume", W60, LONG - 1), paid=f"case when {FULL60} then coalesce(sum(volume) {W60}, 0) end",
  beta="beta", mom=f"case when date_idx >= {LONG + 2} then {MOM60} end", cmra=f"case when {FULL60} then max(c) {W60} - min(c) {W60} end",
  vol="sqrt(case when v < 0 then 0 else v end)", trend=SLOPE60)} from v""")
def long_windows(spark, sf):
    """Every long window by linear scans; those of one length share two sorts."""
    panel = with_market(spark, sf).withColumn("c", R.running_log_return("r"))
    out = S.with_windows(panel, avg_close=S.mean("close", LONG), sd_close=S.std("close", LONG), top=S.top("high", LONG),
                         bottom=S.bottom("low", LONG), past=S.retprod("r", LONG, future=False), future=S.retprod("r", LONG),
                         corr=S.corr("r", "volume", LONG), paid=S.nansum("volume", LONG), beta=S.beta("r", "rm", LONG, 20),
                         mom=S.momentum("r", LONG, 30, 3), cmra=S.cum_range("c", LONG), trend=S.slope_over_mean("amount", LONG))
    out = S.with_windows(out, vol=S.residual_vol("r", "rm", "beta", LONG, 20))
    return show(out, KEYS, 4, **{k: k for k in ("avg_close", "sd_close", "top", "bottom", "past", "future", "corr", "paid", "beta", "mom",
                                                "cmra", "vol", "trend")})


over_p2("log_math",
        dict(lg="case when amount > 0 then ln(amount) end", l1="ln(1 + volume)", pw="pow(volume, 1.5)", sg="sign(r)",
             ab="abs(r)", th="tanh(r)", ex="exp(-abs(r))"),
        lg=lambda: log_positive("amount"), l1=lambda: F.log1p("volume"), pw=lambda: F.pow("volume", F.lit(1.5)),
        sg=lambda: F.signum("r"), ab=lambda: F.abs("r"), th=lambda: F.tanh("r"), ex=lambda: F.exp(-F.abs("r")))
