"""Universe rules, sample assembly and walk-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.core import stage
from quantgrid.operators import filters as FL
from quantgrid.operators import rolling as R
from quantgrid.operators import samples as S
from quantgrid.operators import walkforward as W
from quantgrid.operators.spectrum import dominant_periods
from quantgrid.plans.fixtures import P1, P2, P3_BARS, p1, p2, p2g, p3_bars
from quantgrid.plans.evaluate_queries import ic_sql
from quantgrid.plans.registry import query, rnd, show, sql_cols
from quantgrid.plans.rolling_queries import frame
from quantgrid.plans.xsection_queries import retprod_sql

BASE = f"""{P2}, base as (select *, {retprod_sql(3)} as y, coalesce(volume >= 2, false) as tradable, sector = 1 as pool from p2g)"""


def base(s, d) -> DataFrame:
    """Monthly panel with a forward label, a tradable flag and a pool."""
    return p2g(s, d).withColumns({"y": R.rolling_retprod("r", 3), "tradable": F.coalesce(F.col("volume") >= 2, F.lit(False)),
                                  "pool": F.col("sector") == 1})


def big(c="date_idx"):
    return F.col(c).cast("bigint").alias(c)


HASH = "('0x' || substr(md5({}), 1, 8))::bigint / 4294967296.0::double"
@query("select_universe", f"""{BASE}, v as (select * from base where tradable and y is not null),
k as (select *, row_number() over (partition by date_idx order by md5(tick || '|' || date_idx || '|7'), tick) as rn from v)
select 'universe' as mode, date_idx, tick from v union all select 'pool', date_idx, tick from v where pool
union all select 'fix', date_idx, tick from base where tick in (1, 2, 3) union all select 'sample', date_idx, tick from k where rn <= 2""")
def _universe(s, d):
    b = stage(base(s, d).select("date_idx", "tick", "y", "tradable", "pool"))
    def one(mode, **kw):
        return FL.select_universe(b, mode, "y", **kw).select(F.lit(mode).alias("mode"), big(), "tick")
    return (one("universe").unionByName(one("pool", pool="pool")).unionByName(one("fix", fix=[1, 2, 3]))
            .unionByName(FL.sample_per_date(b.where("tradable and y is not null"), 2, 7, strict=False)
                         .select(F.lit("sample").alias("mode"), big(), "tick")))


query("sample_per_date", f"""{P1}, k as (select *, row_number() over (partition by date_idx
  order by md5(tick || '|' || date_idx || '|3'), tick) as rn from p1 where close is not null)
select date_idx, tick, close from k where rn <= 5""")(
    lambda s, d: FL.sample_per_date(p1(s, d).where("close is not null"), 5, 3).select(big(), "tick", "close"))

STATUS = f"""{P1}, st as (select tick, date, volume, volume = 7 as is_st, amount < 60 as is_suspend, close = high and volume > 1 as hit_ceil,
  close = low and volume > 1 as hit_floor from p1_bars where high > 20),
ls as (select user_id as tick, cast(min(ts) as date) - case when max(value) > 200 then 300 else 230 end as list_date from events group by 1),
j as (select p1.date_idx, p1.tick, p1.date, coalesce(st.volume, 0) = 0 or coalesce(hit_ceil, false) or coalesce(hit_floor, false) as blocked,
  coalesce(is_st, false) or coalesce(is_suspend, true) or coalesce(p1.date - list_date < 242, true) as bad
  from p1 left join st on st.tick = p1.tick and st.date = p1.date left join ls on ls.tick = p1.tick)"""


def _status(s, d):
    from quantgrid.plans.fixtures import p1_bars, table
    st = p1_bars(s, d).where("high > 20").select(
        "tick", "date", "volume", (F.col("volume") == 7).alias("is_st"), (F.col("amount") < 60).alias("is_suspend"),
        F.expr("close = high and volume > 1").alias("hit_ceil"), F.expr("close = low and volume > 1").alias("hit_floor"))
    ls = table(s, d, "events").groupBy(F.col("user_id").alias("tick")).agg(
        F.to_date(F.min("ts")).alias("_first"), F.max("value").alias("_mx")).select(
        "tick", F.when(F.col("_mx") > 200, F.date_sub("_first", 300)).otherwise(F.date_sub("_first", 230)).alias("list_date"))
    return FL.tradable_flag(p1(s, d), st, ls).select(big(), "tick", "tradable")


query("tradable_flag", f"""{STATUS} select date_idx, tick, not (bad or blocked or coalesce(lead(blocked) over (partition by tick order by date_idx), blocked))
  as tradable from j""")(_status)

SEQ = f"""{P1}, q as (select date_idx, tick, list(r) {frame(-3)} as r, list(volume) {frame(-3)} as v, {retprod_sql(3)} as y from p1),
w as (select * from q where date_idx >= 3)"""


def _seq(s, d):
    panel = p1(s, d).withColumn("y", R.rolling_retprod("r", 3))
    return S.lag_windows(panel, ["r", "volume"], 4, keep=["y"])


def _unpack(df):
    return df.select(big(), "tick", F.transform("seq", lambda x: rnd(x["r"])).alias("r"),
                     F.col("seq.volume").alias("volume"))


RSEQ = "list_transform(r, lambda x: floor(x * 1000000.0::double + 0.5) / 1000000.0::double) as r, v as volume"
query("drop_dead_sequences", f"""{SEQ} select date_idx, tick, {RSEQ} from w
where len(list_filter(range(1, 5), lambda i: r[i] is null and v[i] is null)) = 0""")(
    lambda s, d: _unpack(FL.drop_dead_sequences(_seq(s, d), ["r", "volume"])))
query("drop_any_null_sequences", f"""{SEQ} select date_idx, tick, {RSEQ} from w
where y is not null and len(list_filter(range(1, 5), lambda i: r[i] is null or v[i] is null)) = 0""")(
    lambda s, d: _unpack(FL.drop_any_null_sequences(_seq(s, d), ["r", "volume"], label="y")))
query("zero_fill", f"""{SEQ} select date_idx, tick, list_transform(v, lambda x: coalesce(x, 0)) as volume from w""")(
    lambda s, d: _seq(s, d).select(big(), "tick", S.zero_filled("seq", ["volume"]).alias("z"))
    .select("date_idx", "tick", F.col("z.volume").alias("volume")))

# --- assembled samples ----------------------------------------------------------------------------

LISTS = f"""{BASE}, q as (select date_idx, tick, list(close) {frame(-3)} as c, list(volume) {frame(-3)} as v, list(month(date)) {frame(-3)} as m,
  y, tradable, pool from base),
ok as (select * from q where date_idx >= 3 and tradable and y is not null),
ev as (select date_idx as eff, tick, amount as x from p2 where amount > 400000),
lk as (select ok.date_idx, ok.tick, ev.eff, ev.x, row_number() over (partition by ok.date_idx, ok.tick order by ev.eff desc) as rn
  from ok join ev on ev.tick = ok.tick and ev.eff <= ok.date_idx),
el as (select date_idx, tick, list(x order by eff) as x from lk where rn <= 2 group by 1, 2)"""
ZC = "list_transform({}, lambda x: coalesce(x, 0)) as {}"
ALIVE = "len(list_filter(range(1, 5), lambda i: c[i] is null and v[i] is null)) = 0"


def _store(panel):
    return (panel.where("amount > 400000")
            .select("tick", F.col("date_idx").alias("effective_idx"), F.col("date_idx").alias("event_id"), F.col("amount").alias("x")))


@query("batch_by_date_samples", f"""{LISTS} select ok.date_idx, ok.tick, {ZC.format("c", "closes")}, {ZC.format("v", "volumes")}, m as months,
  list_concat(list_resize(cast([] as double[]), 2 - coalesce(len(x), 0), 0.0), coalesce(x, [])) as events, {sql_cols(label="y")}
from ok left join el using (date_idx, tick) where {ALIVE}""")
def _batch_samples(s, d):
    panel = base(s, d)
    chunks = stage(S.sample_chunks(panel, ["close", "volume"], 4, "y"))
    df = S.assemble_samples(None, ["close", "volume"], 4, "y", events=(_store(panel), ["x"], 2), time_code=True, chunks=chunks)
    return df.select(big(), "tick", F.col("daily.close").alias("closes"), F.col("daily.volume").alias("volumes"),
                     F.col("time_code.month").cast("array<bigint>").alias("months"), F.col("events.x").alias("events"),
                     rnd("label").alias("label"))


@query("minute_branch_samples", f"""{P1}, {P3_BARS}, b as (select *, {retprod_sql(3)} as y, coalesce(volume >= 2, false) as tradable from p1),
q as (select date_idx, date, tick, list(close) {frame(-3)} as c, y, tradable from b),
ok as (select * from q where date_idx >= 3 and tradable and y is not null),
mb as (select tick, date, list(close order by minute_idx) as mc, list(volume order by minute_idx) as mv, list(minute_idx::bigint order by minute_idx) as h
  from p3_bars group by 1, 2),
mt as (select tick, date, mc[2:len(mc) - 3] as mc, mv[2:len(mv) - 3] as mv, h[2:len(h) - 3] as h from mb where len(h) > 4),
j as (select ok.*, coalesce(mt.mc, []) as mc, coalesce(mt.mv, []) as mv, coalesce(mt.h, []) as h from ok left join mt using (tick, date))
select date_idx, tick, {ZC.format("c", "closes")}, {ZC.format("mc", "minute_closes")}, {ZC.format("mv", "minute_volumes")}, h as hours,
  list_transform(h, lambda x: 0::bigint) as minutes, list_transform(h, lambda x: (isodow(date) - 1)::bigint) as weekdays, {sql_cols(label="y")}
from j where len(list_filter(range(1, least(4, len(mc)) + 1), lambda i: c[i] is null and mc[i] is null and mv[i] is null)) = 0""")
def _minute_samples(s, d):
    panel = p1(s, d).withColumns({"y": R.rolling_retprod("r", 3), "tradable": F.coalesce(F.col("volume") >= 2, F.lit(False))})
    bars = p3_bars(s, d).withColumn("minute_idx", F.col("minute_idx") * 60)
    df = S.assemble_samples(panel, ["close"], 4, "y", minutes=(bars, ["close", "volume"]), time_code=True)
    code = {n: F.col(f"minute_time_code.{c}").cast("array<bigint>").alias(n) for n, c in (("hours", "hour"), ("minutes", "minute"), ("weekdays", "weekday"))}
    return df.select(big(), "tick", F.col("daily.close").alias("closes"), F.col("minutes.close").alias("minute_closes"),
                     F.col("minutes.volume").alias("minute_volumes"), *code.values(), rnd("label").alias("label"))


query("flatten_samples", f"""{LISTS} select date_idx, tick, {ZC.format("c", "closes")}, {ZC.format("v", "volumes")}, {sql_cols(label="y")}
from ok where pool and {ALIVE}""")(
    lambda s, d: S.assemble_samples(None, ["close", "volume"], 4, "y", mode="pool", pool="pool", flatten=True, chunks=stage(
        S.sample_chunks(base(s, d), ["close", "volume"], 4, "y", pool="pool"))).select(big(), "tick", F.col("daily.close").alias("closes"), F.col("daily.volume").alias("volumes"), rnd("label").alias("label")))

@query("collate", f"""{LISTS}, sm as (select date_idx, tick, c, y, count(*) over (partition by date_idx) as n from ok where {ALIVE}),
bt as (select *, floor({HASH.format("tick::varchar")} * ceil(n / 16.0))::bigint as batch from sm)
select date_idx, batch, list(tick order by tick) as ticks, list(floor(y * 1000000.0::double + 0.5) / 1000000.0::double order by tick) as label
from bt group by 1, 2""")
def _collate(s, d):
    df = S.assemble_samples(base(s, d), ["close", "volume"], 4, "y")
    out = S.collate(stage(df), 16)
    return out.select(big(), big("batch"), "ticks", F.transform("label", lambda v: rnd(v)).alias("label"))


# --- walk-forward -----------------------------------------------------------------------------------

WIN = """win as (select i as "window", u.split, u.s as "start", u.e as "end" from (select i,
  cast(date '1995-01-01' + to_years(i::int) as date) as a from range(20) t(i)) x,
  lateral (select unnest(['train', 'valid', 'test']) as split, unnest([a, cast(a + to_years(2) as date), cast(a + to_years(3) as date)]) as s,
    unnest([cast(a + to_years(2) as date) - 1, cast(a + to_years(3) as date) - 1, cast(a + to_years(4) as date) - 1]) as e) u
  where cast(a + to_years(4) as date) - 1 <= (select max(cast(date_trunc('month', l_shipdate) + interval 2 month as date)) from lineitem))"""


def _windows(s, d) -> DataFrame:
    """2 + 1 + 1 years from 1995, up to the end of the data."""
    end = p2_end(s, d)
    return W.walk_forward_windows(s, "1995-01-01", end, 2, 1, 1, 1)


def p2_end(s, d) -> str:
    from quantgrid.plans.fixtures import table
    top = table(s, d, "lineitem").agg(F.add_months(F.trunc(F.to_date(F.max("l_shipdate")), "month"), 2).cast("string"))
    return top.first()[0]


query("walk_forward_windows", f"""with {WIN} select "window", split, "start", "end" from win""")(
    lambda s, d: _windows(s, d).select(big("window"), "split", "start", "end"))
query("assign_split", f"""{P2}, {WIN} select "window", split, date, tick, close from p2 join win on date between "start" and "end" """)(
    lambda s, d: W.assign_split(p2(s, d), _windows(s, d)).select(big("window"), "split", "date", "tick", "close"))


def _fit_sql(members: str, sampled: str) -> str:
    return f"""{P2}, {WIN}, f as (select date, tick, r as x1, ln(volume) as x2, {retprod_sql(3)} as y from p2),
tg as (select "window", split, f.*, member from f join win on date between "start" and "end", {members} mm(member)),
mo as (select "window", member, avg(x1) as m1, avg(x2) as m2, avg(y) as my, var_pop(x1) as v1, var_pop(x2) as v2, covar_pop(x1, x2) as c12,
  covar_pop(x1, y) as c1, covar_pop(x2, y) as c2 from tg
  where split = 'train' and x1 is not null and x2 is not null and y is not null {sampled} group by 1, 2),
cf as (select "window", member, p, ((v2 + p) * c1 - c12 * c2) / ((v1 + p) * (v2 + p) - c12 * c12) as b1,
  ((v1 + p) * c2 - c12 * c1) / ((v1 + p) * (v2 + p) - c12 * c12) as b2, m1, m2, my from mo, (select unnest([0.0, 0.1, 1.0]::double[]) as p) pp),
va as (select "window", member, p, date, y, my - b1 * m1 - b2 * m2 + b1 * x1 + b2 * x2 as pred from tg join cf using ("window", member) where split = 'valid'),
vi as ({ic_sql("pred", "y", "va").replace("date_idx", '"window", member, p, date').replace("group by 1", "group by 1, 2, 3, 4")}),
sc as (select "window", member, p, round(avg(ic), 9) as s from vi group by 1, 2, 3),
be as (select "window", member, arg_max(p, (s, -p)) as p from sc group by 1, 2),
te as (select "window", member, date, tick, p as penalty, my - b1 * m1 - b2 * m2 + b1 * x1 + b2 * x2 as pred
  from tg join be using ("window", member) join cf using ("window", member, p) where split = 'test')"""


def _features(s, d) -> DataFrame:
    return stage(p2(s, d).select("date", "tick", F.col("r").alias("x1"), F.ln("volume").alias("x2"),
                                 R.rolling_retprod("r", 3).alias("y")))


PEN = (0.0, 0.1, 1.0)
FIT = _fit_sql("(select unnest([0]))", "")
query("walk_forward_predict", f"""{FIT} select "window", date, tick, penalty, {sql_cols(pred="pred")} from te""")(
    lambda s, d: W.walk_forward_predict(_features(s, d), _windows(s, d), ["x1", "x2"], "y", PEN).select(
        big("window"), "date", "tick", "penalty", rnd("pred").alias("pred")))
query("concat_windows", f"""{FIT} select date, tick, {sql_cols(pred="pred")} from te""")(
    lambda s, d: W.concat_windows(W.walk_forward_predict(_features(s, d), _windows(s, d), ["x1", "x2"], "y", PEN)).select(
        "date", "tick", rnd("pred").alias("pred")))
BAG = _fit_sql("(select unnest([0, 1, 2]))", f"and {HASH.format("tick || '|' || date || '|' || (member + 5)")} < 0.8::double")
query("bagging", f"""{BAG} select "window", date, tick, {sql_cols(pred="avg(pred)")} from te group by 1, 2, 3""")(
    lambda s, d: W.bagged_predict(_features(s, d), _windows(s, d), ["x1", "x2"], "y", 3, 0.8, 5, PEN).select(
        big("window"), "date", "tick", rnd("pred").alias("pred")))

query("score_embeddings", f"""{P2}, a as (select date_idx, tick, lag(volume) over (partition by tick order by date_idx) as x0, volume as x1 from p2),
k as (select * from a where x0 is not null and x1 is not null),
m as (select avg(x0) as m0, avg(x1) as m1, var_pop(x0) as a, var_pop(x1) as dd, covar_pop(x0, x1) as b from k),
e as (select *, (a + dd) / 2 + sqrt((a - dd) * (a - dd) / 4 + b * b) as l0, (a + dd) / 2 - sqrt((a - dd) * (a - dd) / 4 + b * b) as l1 from m),
v as (select 0 as dim, b as p, l0 - a as q, m0, m1 from e union all select 1, b, l1 - a, m0, m1 from e),
n as (select dim, p / sqrt(p * p + q * q) as p, q / sqrt(p * p + q * q) as q, m0, m1 from v),
g as (select dim, m0, m1, sign(case when round(abs(q), 9) > round(abs(p), 9) then q else p end) as sg, p, q from n)
select date_idx, tick, dim::bigint as dim, {sql_cols(value="sg * (p * (x0 - m0) + q * (x1 - m1))")} from k, g""")(
    lambda s, d: show(W.score_embeddings(p2(s, d), "volume", 2, 2), ["date_idx", "tick", "dim"], value="value"))

# Full widths: 18 features per window, 60 lags in one group.
LAGGED = [f"{x}_{i}" for x in ("x1", "x2") for i in range(9)]
PAIRS18 = [(a, b) for i, a in enumerate([*LAGGED, "y"]) for b in [*LAGGED, "y"][i:]]
LAGGED_SQL = f"""f as (select date, tick, {retprod_sql(3)} as y, {", ".join(
    f"lag({e}, {i}) over (partition by tick order by date_idx) as {x}_{i}" for x, e in (("x1", "r"), ("x2", "ln(volume)")) for i in range(9))} from p2)"""
COV18 = f"""[{", ".join(f"covar_pop({a}, {b})" for a, b in PAIRS18)}]"""
KNOWN18 = " and ".join(f"{c} is not null" for c in [*LAGGED, "y"])


def _lagged(s, d) -> DataFrame:
    w = Window.partitionBy("tick").orderBy("date_idx")
    panel = p2(s, d).withColumns({"y": R.rolling_retprod("r", 3), "v": F.ln("volume")})
    return panel.select("date", "tick", "y", *[F.lag(e, i).over(w).alias(f"{x}_{i}") for x, e in (("x1", "r"), ("x2", "v")) for i in range(9)])


@query("walk_forward_moments", f"""{P2}, {WIN}, {LAGGED_SQL},
tr as (select "window", f.* from f join win on date between "start" and "end" where split = 'train' and {KNOWN18}),
mo as (select "window", count(*) as n, {COV18} as c from tr group by 1)
select "window", n, i - 1 as pair, floor(c[i] * 100000000.0::double + 0.5) / 100000000.0::double as cov from mo, range(1, {len(PAIRS18) + 1}) t(i)""")
def _window_moments(s, d):
    names = [*LAGGED, "y"]
    states = W.group_states(_lagged(s, d), names, ["date"]).where("n > 0")
    out = W.over_windows(states, _windows(s, d).where("split = 'train'"), len(names))
    cov = F.transform("prod", lambda p: p / F.col("n"))
    return out.select(big("window"), "n", F.posexplode(cov).alias("pair", "cov")).select("window", "n", big("pair"), rnd("cov", 8).alias("cov"))


def _system(i: int) -> str:
    """Row i of the penalised normal equations, the right-hand side last."""
    at = {p: k + 1 for k, p in enumerate(PAIRS18)}
    cells = [f"c[{at[(a, b) if (a, b) in at else (b, a)]}]" for a in [LAGGED[i]] for b in [*LAGGED, "y"]]
    cells[i] += " + p"
    return f"[{', '.join(cells)}]"


# Gauss-Jordan steps, one pivot a round.
WIDE_FIT = f"""{P2.replace("with ", "with recursive ", 1)}, {WIN}, {LAGGED_SQL},
tg as (select "window", split, f.* from f join win on date between "start" and "end"),
mo as (select "window", [{", ".join(f"avg({c})" for c in [*LAGGED, "y"])}] as m, {COV18} as c from tg where split = 'train' and {KNOWN18} group by 1),
g as (select "window", p, m, 1 as k, [{", ".join(_system(i) for i in range(18))}] as a from mo, (select unnest([0.0, 0.1, 1.0]::double[]) as p) pp
  union all select "window", p, m, k + 1, list_transform(a, lambda w, i: case when i = k then list_transform(w, lambda v: v / a[k][k])
    else list_transform(w, lambda v, j: v - w[k] / a[k][k] * a[k][j]) end) from g where k <= 18),
cf as (select "window", p, m, list_transform(a, lambda w: w[19]) as b from g where k = 19),
va as (select "window", p, date, y, m[19] + {" + ".join(f"b[{i + 1}] * ({c} - m[{i + 1}])" for i, c in enumerate(LAGGED))} as pred, tick, split
  from tg join cf using ("window") where split <> 'train'),
vi as ({ic_sql("pred", "y", "va").replace("date_idx", '"window", p, date').replace("group by 1", "where split = 'valid' group by 1, 2, 3")}),
sc as (select "window", p, round(avg(ic), 9) as s from vi group by 1, 2), be as (select "window", arg_max(p, (s, -p)) as p from sc group by 1)
select "window", date, tick, p as penalty, {sql_cols(pred="pred")} from va join be using ("window", p) where split = 'test'"""


@query("walk_forward_predict_wide", WIDE_FIT)
def _predict_wide(s, d):
    out = W.walk_forward_predict(stage(_lagged(s, d)), _windows(s, d), LAGGED, "y", PEN)
    return out.select(big("window"), "date", "tick", "penalty", rnd("pred").alias("pred"))


PAIRS60 = [(i, j) for i in range(60) for j in range(i, 60)]


@query("embedding_moments", f"""{P2}, a as (select list(volume) over (partition by tick order by date_idx rows between 59 preceding and current row) as x,
  count(volume) over (partition by tick order by date_idx rows between 59 preceding and current row) as k from p2),
v as (select x from a where k = 60),
m as (select [{", ".join(f"covar_pop(x[{i + 1}], x[{j + 1}])" for i, j in PAIRS60)}] as c from v)
select n - 1 as pair, floor(c[n] * 1000000.0::double + 0.5) / 1000000.0::double as cov from m, range(1, {len(PAIRS60) + 1}) t(n)""")
def _embedding_moments(s, d):
    a = S.lag_windows(p2(s, d), ["volume"], 60).select(F.col("seq.volume").alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    out = W.moments(a.select(*[F.col("x")[i].alias(f"c{i}") for i in range(60)]), [f"c{i}" for i in range(60)], None, [])
    return out.select(F.posexplode("cov").alias("pair", "cov")).select(big("pair"), rnd("cov").alias("cov"))


@query("score_embeddings_wide")
def _embeddings_wide(s, d):
    """The first 8 of 60 components; eigenvectors are beyond SQL, tests/test_walkforward.py compares them with NumPy."""
    return show(W.score_embeddings(p2(s, d), "volume", 60, 8), ["date_idx", "tick", "dim"], value="value")


query("dominant_periods", f"""{P2}, c as (select tick, date_idx, coalesce(volume, 0) as v, count(*) over (partition by tick) as n from p2),
w as (select tick, f, n, sqrt(pow(sum(v * cos(2 * pi() * f * date_idx / n)), 2) + pow(sum(v * sin(2 * pi() * f * date_idx / n)), 2)) as amp
  from c, range(1, 60) r(f) where f <= n // 2 group by 1, 2, 3),
t as (select f, max(n) as n, avg(amp) as m from w group by 1 order by round(avg(amp), 6) desc, f limit 3)
select w.tick, w.f as freq, t.n // w.f as period, {sql_cols(amp="w.amp")} from w join t on t.f = w.f""")(
    lambda s, d: dominant_periods(p2(s, d), "volume", 3)[1].select(
        "tick", big("freq"), big("period"), rnd("amp").alias("amp")))
