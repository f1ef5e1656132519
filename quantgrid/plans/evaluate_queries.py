"""Signal evaluation and all-pairs operators (A9-A22, J12-J14, X14), and the flagship slice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import stage
from quantgrid.operators import evaluate as E
from quantgrid.operators import pairs as PR
from quantgrid.operators import rolling as R
from quantgrid.operators import xsection as X
from quantgrid.plans.fixtures import P1, P2, p1, p2
from quantgrid.plans.registry import query, show, sql_cols
from quantgrid.plans.xsection_queries import D, mad_sql, rank_sql, retprod_sql

KEYS = ["date_idx", "tick"]

G1 = f"{P1}, g1 as (select date_idx, date, tick, -close as pred, {retprod_sql(3)} as label from p1)"


def g1(spark, sf) -> DataFrame:
    """Predictions (minus close) and three-row forward returns."""
    return p1(spark, sf).select("date_idx", "date", "tick", (-F.col("close")).alias("pred"),
                                R.rolling_retprod("r", 3).alias("label"))


def ic_sql(a: str, b: str, source: str, out: str = "ic") -> str:
    pa, pb = f"case when {b} is not null then {a} end", f"case when {a} is not null then {b} end"
    return (f"select date_idx, coalesce((avg({a}*{b}) - avg({pa}) * avg({pb})) / (stddev_pop({pa}) + 1e-6) "
            f"/ (stddev_pop({pb}) + 1e-6), 0) as {out} from {source} group by 1")


query("ic", f"{G1}, i as ({ic_sql('pred', 'label', 'g1')}) select date_idx, {sql_cols(ic='ic')} from i")(
    lambda s, d: show(E.ic(g1(s, d)), ["date_idx"], ic="ic"))

RANKED = f"""{G1}, k as (select *, {rank_sql('pred')} as rp, {rank_sql('label')} as ry,
  {rank_sql('pred').replace('pred', '(case when label is not null then pred end)')} as rp2,
  {rank_sql('label').replace('label', '(case when pred is not null then label end)')} as ry2 from g1)"""
query("rank_ic", f"""{RANKED}, a as ({ic_sql('rp', 'ry', 'k', 'a')}), b as ({ic_sql('rp2', 'ry2', 'k', 'b')})
select date_idx, {sql_cols(rank_ic='a', reranked='b')} from a join b using (date_idx)""")(
    lambda s, d: show((lambda g: E.rank_ic(g).join(E.rank_ic(g, out="reranked", rerank=True), "date_idx"))(stage(g1(s, d))),
                      ["date_idx"], rank_ic="rank_ic", reranked="reranked"))

GROUPS = f"""{G1}, k as (select *, {rank_sql('pred')} as rk from g1 where pred is not null),
t as (select *, floor(max(rk) {D} / 5.0::double) as size from k),
b as (select *, case when size = 0 then 4 else least(ceil(rk / size) - 1, 4) end as i,
  case when size > 0 and rk / size <> floor(rk / size) and rk / size < 5 then floor(rk / nullif(size, 0)) end as j from t),
gr as (select date_idx, cast(5 - i as bigint) as grp, avg(label) as r from b group by 1, 2),
gro as (select date_idx, cast(5 - j as bigint) as grp, avg(label) as r from b where j is not null group by 1, 2),
ret as (select date_idx, grp, r - avg(r) {D} as ret from gr),
reto as (select date_idx, grp, r - avg(r) {D} as ret from gro),
cum as (select *, case when ret is not null then sum(ret) over (partition by grp order by date_idx
  rows between unbounded preceding and current row) end as cum from reto)"""

query("group_returns", f"""{GROUPS} select date_idx, grp as "group", {sql_cols(ret="ret")} from ret""")(
    lambda s, d: show(E.group_returns(stage(g1(s, d)), groups=5), ["date_idx", "group"], ret="ret"))
query("group_returns_cum", f"""{GROUPS} select date_idx, grp as "group", {sql_cols(ret="ret", cum="cum")} from cum""")(
    lambda s, d: show(E.group_returns_cum(stage(g1(s, d)), groups=5), ["date_idx", "group"], ret="ret", cum="cum"))
query("sharpe", f"""{GROUPS} select grp as "group", {sql_cols(sharpe="avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(242)")}
from ret group by 1""")(
    lambda s, d: show(E.sharpe(E.group_returns(stage(g1(s, d)), groups=5)), ["group"], sharpe="sharpe"))
query("max_drawdown", f"""{GROUPS}, c as (select *, sum(ret) over (partition by grp order by date_idx
  rows between unbounded preceding and current row) as c from ret),
m as (select *, max(c) over (partition by grp order by date_idx rows between unbounded preceding and current row) as m from c)
select grp as "group", {sql_cols(max_drawdown="min(case when m > 0 then (c - m) / m end)")} from m group by 1""")(
    lambda s, d: show(E.max_drawdown(E.group_returns(stage(g1(s, d)), groups=5)), ["group"], max_drawdown="max_drawdown"))

SERIES = f"""{RANKED}, a as ({ic_sql('pred', 'label', 'k')}), b as ({ic_sql('rp', 'ry', 'k', 'rank_ic')}),
s as (select * from a join b using (date_idx))"""
query("ic_summary", f"{SERIES} select {sql_cols(mean_ic='avg(ic)', mean_rank_ic='avg(rank_ic)')} from s")(
    lambda s, d: show(E.ic_summary(E.ic_series(stage(g1(s, d)))), [], mean_ic="mean_ic", mean_rank_ic="mean_rank_ic"))
query("cum_ic", f"""{SERIES}, l as (select 'ic' as metric, date_idx, ic as v from s union all
  select 'rank_ic', date_idx, rank_ic from s)
select metric, date_idx, {sql_cols(value="v", cum="sum(v) over (partition by metric order by date_idx)")} from l""")(
    lambda s, d: show(E.cum_ic(E.ic_series(stage(g1(s, d)))), ["metric", "date_idx"], value="value", cum="cum"))

query("histogram", f"""{G1}, l as (select 'pred' as metric, pred as v from g1 where pred is not null union all
  select 'label', label from g1 where label is not null),
m as (select metric, min(v) as lo, (max(v) - min(v)) / 50 as w from l group by 1),
b as (select metric, lo, w, least(floor((v - lo) / w), 49)::bigint as bin, count(*) as n from l join m using (metric) group by 1, 2, 3, 4)
select metric, bin, n, {sql_cols(low="lo + bin * w", high="lo + (bin + 1) * w")} from b""")(
    lambda s, d: show(E.histogram(stage(g1(s, d)), ["pred", "label"]), ["metric", "bin", "n"], low="low", high="high"))


def members(s, d):
    """Three lagged copies of the signal as ensemble members."""
    w = R.tick_window()
    p = p1(s, d).select("date_idx", "tick", *[F.lag("close", m + 1).over(w).alias(str(m)) for m in range(3)])
    return p.unpivot(["date_idx", "tick"], ["0", "1", "2"], "member", "pred")


query("ensemble_mean", f"""{P1}, m as (select date_idx, tick, unnest([lag(close, 1) over w, lag(close, 2) over w, lag(close, 3) over w]) as pred
  from p1 window w as (partition by tick order by date_idx))
select date_idx, tick, {sql_cols(pred="avg(pred)")} from m group by 1, 2""")(
    lambda s, d: show(E.ensemble_mean(members(s, d)), KEYS, pred="pred"))

query("pred_errors", f"""{G1}, e as (select date_idx, pred / 100 - label as e from g1) select date_idx, {sql_cols(
    mse="avg(e * e)", rmse="sqrt(avg(e * e))",
    huber="avg(case when abs(e) <= 1 then 0.5 * e * e else abs(e) - 0.5 end)")} from e group by 1""")(
    lambda s, d: show(E.pred_errors(g1(s, d).withColumn("pred", F.col("pred") / 100)), ["date_idx"], mse="mse", rmse="rmse",
                      huber="huber"))

query("ic_loss_metric", f"""{G1}, p as (select date_idx, pred as a, label as b from g1 where pred is not null and label is not null),
m as (select date_idx, 1 - covar_pop(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) as l,
  case when count(*) < 2 then 1 else 1 - covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b) + 1e-8) end as le from p group by 1)
select date_idx, {sql_cols(ic_loss="l", ic_loss_eps="case when l is null and le is null then 1 else le end")}
from (select distinct date_idx from g1) left join m using (date_idx)""")(
    lambda s, d: show(E.ic_loss_metric(g1(s, d)), ["date_idx"], ic_loss="ic_loss", ic_loss_eps="ic_loss_eps"))

PAIRS = f"""{G1}, g as (select date_idx, tick, pred / 100 as p, label as y from g1 where pred is not null and label is not null)"""


def _scaled(s, d):
    return g1(s, d).withColumn("pred", F.col("pred") / 100)


query("pairwise_rank_loss", f"""{PAIRS} select a.date_idx, {sql_cols(
    rank_loss="coalesce(avg(case when a.y <> b.y then greatest(-sign(a.y - b.y) * (a.p - b.p), 0) "
              "+ ln(1 + exp(-abs(a.p - b.p))) end), 0)")}
from g a join g b using (date_idx) group by 1""")(
    lambda s, d: show(PR.pairwise_rank_loss(_scaled(s, d)), ["date_idx"], rank_loss="rank_loss"))
query("monotonic_logistic_loss", f"""{PAIRS} select a.date_idx, {sql_cols(
    logistic_loss="avg(ln(1 + exp(-tanh(a.p - b.p) * tanh(a.y - b.y))))")} from g a join g b using (date_idx) group by 1""")(
    lambda s, d: show(PR.monotonic_logistic_loss(_scaled(s, d)), ["date_idx"], logistic_loss="logistic_loss"))

# --- peers ------------------------------------------------------------------------------------

W6 = "over (partition by tick order by date_idx rows between 5 preceding and current row)"
W3 = "over (partition by tick order by date_idx rows between 2 preceding and current row)"
PEERS = f"""{P2}, r3 as (select date_idx, tick, case when count(r) {W3} = 3 then product(1 + r) {W3} - 1 end as x,
  {retprod_sql(3)} as y from p2),
v0 as (select date_idx, tick, y, list(x) {W6} as a, count(x) {W6} as n, avg(x) {W6} as m from r3),
v1 as (select date_idx, tick, y, list_transform(a, lambda z: z - m) as c from v0 where n = 6),
v as (select date_idx, tick, y, list_transform(c, lambda z: z / sqrt(list_sum(list_transform(c, lambda q: q * q)))) as u from v1
  where sqrt(list_sum(list_transform(c, lambda q: q * q))) > 1e-12),
ok as (select date_idx from v group by 1 having count(*) > 5),
pr as (select a.date_idx, a.tick, b.tick as peer_tick, round(list_dot_product(a.u, b.u), 10) as corr
  from v a join v b on a.date_idx = b.date_idx and a.tick <> b.tick where a.date_idx in (select date_idx from ok)),
peers as (select * from (select *, row_number() over (partition by date_idx, tick order by corr desc, peer_tick) as rn from pr)
  where rn <= 5)"""


def _peer_panel(s, d):
    return p2(s, d).select("date_idx", "tick", R.rolling_retprod_strict("r", 3, shift=-2).alias("x"),
                           R.rolling_retprod("r", 3).alias("y"))


query("peer_topk_corr", f"{PEERS} select date_idx, tick, peer_tick, {sql_cols(corr='corr')} from peers")(
    lambda s, d: show(PR.peer_topk_corr(_peer_panel(s, d), "x", 6, 5), ["date_idx", "tick", "peer_tick"],
                      corr="corr"))

@query("peer_zscore", f"""{PEERS}, l as (select v0.date_idx, v0.tick, v0.y, avg(q.y) as m, stddev_pop(q.y) as s
  from v0 left join peers using (date_idx, tick) left join v0 q on q.date_idx = peers.date_idx and q.tick = peers.peer_tick
  group by 1, 2, 3)
select date_idx, tick, {sql_cols(peer_zscore="case when s > 1e-12 then (y - m) / s end", peer_excess="y - m")} from l""")
def peer_zscore(s, d):
    panel = stage(_peer_panel(s, d))
    edges = PR.peer_topk_corr(panel, "x", 6, 5)
    return show(X.peer_stats(edges, panel, "y"), KEYS, peer_zscore="peer_zscore", peer_excess="peer_excess")


def _unit_sql(f: str) -> str:
    return f"list_transform({f}, lambda z: (z - list_avg({f})) / n_{f})"


def _norm_sql(f: str) -> str:
    return f"sqrt(list_sum(list_transform({f}, lambda q: (q - list_avg({f})) * (q - list_avg({f})))))"


W8 = "over (partition by tick order by date_idx rows between 7 preceding and current row)"
EDGES = f"""{P2}, a as (select date_idx, tick, list(volume) {W8} as v, list(amount / 1000) {W8} as m, count(volume) {W8} as n
  from p2),
b as (select *, {_norm_sql("v")} as n_v, {_norm_sql("m")} as n_m from a where date_idx >= 7),
u as (select date_idx, tick, case when n = 8 and n_v > 1e-12 then {_unit_sql("v")} else list_resize(cast([] as double[]), 8, 0.0) end as uv,
  case when n = 8 and n_m > 1e-12 then {_unit_sql("m")} else list_resize(cast([] as double[]), 8, 0.0) end as um from b),
e as (select a.date_idx, a.tick as src, b.tick as dst, round((list_dot_product(a.uv, b.uv) + list_dot_product(a.um, b.um)) / 2, 10) as w
  from u a join u b on a.date_idx = b.date_idx and a.tick <> b.tick),
edges as (select date_idx, src, dst, w from e where w > 0.6 union all select date_idx, tick, tick, 1.0 from u)"""


def _edges(s, d, panel=None):
    panel = p2(s, d) if panel is None else panel
    return PR.corr_graph_edges(panel.withColumn("m", F.col("amount") / 1000), ["volume", "m"], 8, 0.6)


query("corr_graph_edges", f"{EDGES} select date_idx, src, dst, {sql_cols(w='w')} from edges")(
    lambda s, d: show(_edges(s, d), ["date_idx", "src", "dst"], w="w"))


@query("neighbor_aggregate", f"""{EDGES} select e.date_idx, e.src as tick, {sql_cols(4, close_nb="sum(e.w * p2.close)")}
from edges e join p2 on p2.date_idx = e.date_idx and p2.tick = e.dst group by 1, 2""")
def neighbor_aggregate(s, d):
    panel = stage(p2(s, d)).withColumn("m", F.col("amount") / 1000)
    return show(PR.graph_aggregate(panel, ["volume", "m"], ["close"], 8, 0.6), KEYS, 4, close_nb="close_nb")


# --- the minimum end-to-end slice ---------------------------------------------------------------

FLAG = f"""{P1}, f as (select *, last_value(close ignore nulls) over (partition by tick order by date_idx
  rows between unbounded preceding and current row) as fc from p1),
c as (select date_idx, tick, case when fc is not null and lag(fc) over w = 0 then 0 else
  (fc - lag(fc) over w) / nullif(lag(fc) over w, 0) end as x from f window w as (partition by tick order by date_idx)),
y as (select *, {retprod_sql(3).replace('(1 + r)', '(1 + x)')} as label from c),
m as (select date_idx, median(x) as med from y group by 1),
mm as (select y.date_idx, any_value(med) as med, median(abs(x - med)) as mad from y join m using (date_idx) group by 1),
w as (select y.*, {mad_sql('x')} as wx from y join mm using (date_idx)),
z as (select *, case when stddev_pop(wx) {D} >= 1e-8 then (wx - avg(wx) {D}) / stddev_pop(wx) {D} end as z from w),
g as (select date_idx, round(z, 9) as pred, label from z),
k as (select *, {rank_sql('pred')} as rp, {rank_sql('label')} as ry from g), i as ({ic_sql('rp', 'ry', 'k', 'rank_ic')})"""


def flagship(s, d) -> DataFrame:
    """Daily bars -> filled close -> change -> clipped z-score, against three-row forward returns."""
    panel = p1(s, d).withColumn("fc", R.forward_fill("close")).withColumn("x", R.pct_change("fc"))
    panel = stage(panel.select("date_idx", "tick", "x", R.rolling_retprod("x", 3).alias("label")))
    z = X.cs_zscore(X.winsor(panel.withColumn("z", F.col("x")), ["z"], "mad"), ["z"])
    return E.rank_ic(stage(z.select("date_idx", F.round("z", 9).alias("pred"), "label")))


query("flagship_rank_ic", f"{FLAG} select date_idx, {sql_cols(rank_ic='rank_ic')} from i")(
    lambda s, d: show(flagship(s, d), ["date_idx"], rank_ic="rank_ic"))
