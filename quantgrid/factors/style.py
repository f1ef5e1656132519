"""Style factors (risk-model descriptors) over a dense panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, attach
from quantgrid.functions.scalar import log_positive
from quantgrid.operators import rolling as R
from quantgrid.operators import scans as S
from quantgrid.operators.pit import asof_last
from quantgrid.operators.scans import with_windows
from quantgrid.operators.xsection import cs_orthogonalise, cs_zscore, winsor

TRADING_DAYS = 242  # fixed value: trading rows per year


def risk_free_daily(annual: ColumnOrName) -> Column:
    return F.pow(1 + as_col(annual), F.lit(1.0 / TRADING_DAYS)) - 1


def align_rate(axis: DataFrame, rates: DataFrame, annual: str, out: str = "rf") -> DataFrame:
    """Daily risk-free rate on every trading date, carried forward over gaps of the rate's own calendar."""
    grid = axis.select("date", "date_idx").withColumn("tick", F.lit(0))
    daily = rates.select("date", risk_free_daily(annual).alias(out), F.lit(0).alias("tick"))
    return asof_last(grid, daily, [out]).drop("tick")


def market_return(panel: DataFrame, mv: str = "mv", r: str = "r", rf: ColumnOrName | None = None,
                  out: str = "market") -> DataFrame:
    """date_idx + cap-weighted return; the weights also count names without a return."""
    total = F.try_divide(F.sum(F.col(mv) * F.col(r)), F.sum(mv))
    if rf is not None:
        total = total - F.max(as_col(rf))
    return panel.groupBy("date_idx").agg(total.alias(out))


def with_excess(panel: DataFrame, rf: ColumnOrName | None = None, mv: str = "mv",
                r: str = "r") -> DataFrame:
    """panel + xr (excess return) and xm (excess market return)."""
    base = panel.withColumn("_rf", F.lit(0.0) if rf is None else as_col(rf))
    market = market_return(base, mv, r, "_rf", out="xm")
    return attach(base, market, ["date_idx"]).withColumn("xr", F.col(r) - F.col("_rf")).drop("_rf")


def beta(panel: DataFrame, window: int = 242, halflife: float = 62, out: str = "beta") -> DataFrame:
    return with_windows(panel, **{out: S.beta("xr", "xm", window, halflife)})


def momentum(panel: DataFrame, window: int = 484, halflife: float = 124, skip: int = 21, out: str = "momentum") -> DataFrame:
    return with_windows(panel, **{out: S.momentum("xr", window, halflife, skip)})


def size(mv: ColumnOrName = "mv") -> Column:
    return log_positive(mv)


def nonlinear_size(panel: DataFrame, mv: str = "mv", out: str = "nonlinear_size") -> DataFrame:
    """z-scored log cap, cubed, with its linear part regressed out per date."""
    z = cs_zscore(panel.withColumn("_z", size(mv)), ["_z"]).withColumn("_z3", F.pow("_z", F.lit(3.0)))
    return cs_orthogonalise(z, "_z3", "_z", out=out).drop("_z", "_z3")


def residual_volatility(panel: DataFrame, window: int = 242, hl_std: float = 41, hl_res: float = 62,
                        out: str = "residual_volatility") -> DataFrame:
    """0.74 deviation + 0.16 cumulative range + 0.10 residual deviation of excess returns."""
    staged = with_windows(panel.withColumn("_c", R.running_log_return("xr")), _beta=S.beta("xr", "xm", window, hl_res),
                          _dev=S.ew_std("xr", window, hl_std, full=True), _range=S.cum_range("_c", window))
    staged = with_windows(staged, _res=S.residual_vol("xr", "xm", "_beta", window, hl_res))
    mix = 0.74 * F.col("_dev") + 0.16 * F.col("_range") + 0.10 * F.col("_res")
    return staged.withColumn(out, mix).drop("_beta", "_c", "_dev", "_range", "_res")


def book_to_price(book: ColumnOrName, mv: ColumnOrName = "mv") -> Column:
    return F.try_divide(as_col(book), as_col(mv))


def liquidity(panel: DataFrame, turnover: str, month: int = 21, quarter: int = 3, year: int = 12,
              out: str = "liquidity") -> DataFrame:
    """0.35 month + 0.35 quarter + 0.30 year; the longer two average consecutive rows and log again."""
    stom = panel.withColumn("_stom", log_positive(R.rolling_sum_strict(turnover, month)))
    mix = (0.35 * F.col("_stom") + 0.35 * log_positive(R.rolling_mean_strict("_stom", quarter))
           + 0.30 * log_positive(R.rolling_mean_strict("_stom", year)))
    return stom.withColumn(out, mix).drop("_stom")


def earnings_yield(panel: DataFrame, forward_profit: ColumnOrName, cash_dividend: ColumnOrName, profit_ttm: ColumnOrName,
                   close: ColumnOrName = "close", mv: ColumnOrName = "mv", window: int = 242, out: str = "earnings_yield") -> DataFrame:
    """0.68 forward + 0.21 trailing cash dividend over price + 0.11 trailing earnings."""
    mix = (0.68 * F.try_divide(as_col(forward_profit), as_col(mv)) + 0.21 * F.try_divide(F.col("_paid"), as_col(close))
           + 0.11 * F.try_divide(as_col(profit_ttm), as_col(mv)))
    return with_windows(panel, _paid=S.nansum(cash_dividend, window)).withColumn(out, mix).drop("_paid")


def growth(panel: DataFrame, long_forward: ColumnOrName, forward_eps: ColumnOrName, eps_ttm: ColumnOrName, eps: ColumnOrName,
           revenue: ColumnOrName, window: int = 1210, out: str = "growth") -> DataFrame:
    short = F.try_divide(as_col(forward_eps), as_col(eps_ttm) + 1e-8) - 1
    mix = 0.18 * as_col(long_forward) + 0.11 * short + 0.24 * F.col("_eps") + 0.47 * F.col("_rev")
    trends = with_windows(panel, _eps=S.slope_over_mean(eps, window), _rev=S.slope_over_mean(revenue, window))
    return trends.withColumn(out, mix).drop("_eps", "_rev")


def leverage(mv: ColumnOrName, preferred: ColumnOrName, long_debt: ColumnOrName, liabilities: ColumnOrName,
             assets: ColumnOrName, net_asset: ColumnOrName) -> Column:
    mv, pref, ltd, net = as_col(mv), as_col(preferred), as_col(long_debt), as_col(net_asset)
    return (0.38 * F.try_divide(mv + pref + ltd, mv) + 0.35 * F.try_divide(as_col(liabilities), as_col(assets))
            + 0.27 * F.try_divide(net + ltd, net - pref))


def style_factor_postprocess(panel: DataFrame, cols: list[str]) -> DataFrame:
    """MAD clip at 3, then cross-sectional z-score, for every raw factor at once."""
    return cs_zscore(winsor(panel, cols, "mad", n=3), cols)
