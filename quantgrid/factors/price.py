"""Price, volume and turnover features over a dense daily panel (Column builders)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, tick_window
from quantgrid.functions.scalar import log_positive, safe_div
from quantgrid.operators import rolling as R
from quantgrid.operators.xsection import cs_zscore, winsor

# Numerator and denominator of the six intrabar ratios, as features and as model inputs.
RATIO_PAIRS = (("close", "open"), ("close", "high"), ("close", "low"), ("high", "low"), ("high", "open"), ("low", "open"))
INPUT_PAIRS = (("close", "open"), ("high", "open"), ("low", "open"), ("high", "close"), ("low", "close"), ("high", "low"))


def ratio_features(pairs: tuple[tuple[str, str], ...] = RATIO_PAIRS) -> dict[str, Column]:
    return {f"{a}_to_{b}": safe_div(a, b) for a, b in pairs}


def daily_model_inputs(panel: DataFrame, volume: str = "volume", turnover: str = "turnover") -> tuple[DataFrame, list[str]]:
    """18 inputs: z of OHLC, log volume and turnover; clipped changes of the same; intrabar ratios minus 1."""
    base = ["open", "high", "low", "close", "log_volume", turnover]
    df = panel.withColumn("log_volume", log_positive(volume))
    df = df.withColumns({f"{c}_pct": R.pct_change(c) for c in base})
    df = df.withColumns({n: c - 1 for n, c in ratio_features(INPUT_PAIRS).items()})
    df = winsor(cs_zscore(df, base, suffix="_z"), [f"{c}_pct" for c in base], "mad")
    names = [f"{c}_z" for c in base] + [f"{c}_pct" for c in base] + list(ratio_features(INPUT_PAIRS))
    return df, names


def cum_return(close: ColumnOrName, n: int) -> Column:
    c = as_col(close)
    return F.try_divide(c, F.lag(c, n).over(tick_window())) - 1


def momentum_diff(close: ColumnOrName, m: int, n: int) -> Column:
    return cum_return(close, m) - cum_return(close, n)


def return_vol(r: ColumnOrName, window: int) -> Column:
    return R.rolling_std(r, window)


def turnover_cv(turnover: ColumnOrName, window: int) -> Column:
    return safe_div(R.rolling_std(turnover, window), R.rolling_mean(turnover, window))


def log_turnover(turnover: ColumnOrName, window: int) -> Column:
    mean = R.rolling_mean(turnover, window)
    return F.when(mean >= 1e-8, F.ln(mean))


def updown_vol(r: ColumnOrName, window: int) -> dict[str, Column]:
    return {"up_vol": R.conditional_rolling_std(r, window, 1), "down_vol": R.conditional_rolling_std(r, window, -1)}


def price_volume_corr(x: ColumnOrName, volume: ColumnOrName, window: int) -> Column:
    return R.rolling_corr(x, volume, window)


def avg_amount(amount: ColumnOrName, window: int = 20) -> Column:
    return R.rolling_mean(amount, window)


def amount_vol(amount: ColumnOrName, window: int = 20) -> Column:
    return R.rolling_std(amount, window)


def illiquidity(r: ColumnOrName, amount: ColumnOrName, window: int = 20) -> Column:
    """Log mean of |return| per unit traded; NULL below 1e-12."""
    mean = R.rolling_mean(safe_div(F.abs(as_col(r)), amount), window)
    return F.when(mean >= 1e-12, F.ln(mean))


def money_flow(r: ColumnOrName, amount: ColumnOrName) -> Column:
    return F.signum(as_col(r)) * as_col(amount)


def turnover_change(turnover: ColumnOrName, lag: int = 5) -> Column:
    return R.lag_ratio(turnover, lag)


def revenue_yoy(revenue: ColumnOrName, lag: int = 242) -> Column:
    return cum_return(revenue, lag)
