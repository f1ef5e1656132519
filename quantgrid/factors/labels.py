"""Forward labels: compounded returns over several horizons and their transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col, tick_window
from quantgrid.operators import rolling as R
from quantgrid.operators import xsection as X

KINDS = ("raw", "yeo", "z", "neutral", "rank", "shrink")


def gross_return(close: ColumnOrName, horizon: int) -> Column:
    """Growth factor from the next row to ``horizon`` rows after it (no minus one)."""
    c, w = as_col(close), tick_window()
    return F.try_divide(F.lead(c, 1 + horizon).over(w), F.lead(c, 1).over(w))


def label_family(panel: DataFrame, r: str, horizons: Sequence[int] = (1, 3, 5, 10), p: float = 0.01,
                 group: str = "industry", mv: str = "mv", kinds: Sequence[str] = KINDS, yeo: dict | None = None) -> DataFrame:
    """y<h> and its variants y<h>_<kind> for every horizon.

    The window step comes first for all horizons (one exchange on tick), then the
    per-date steps for all of them together.  ``yeo`` sets the exponent search (:func:`xsection.yeo_johnson_lambda`).
    """
    ys = [f"y{h}" for h in horizons]
    df = panel.withColumns({f"y{h}": R.rolling_retprod(r, h) for h in horizons})
    if "yeo" in kinds:
        for y in ys:
            df = X.yeo_johnson(df, y, out=f"{y}_yeo", **(yeo or {}))
    if "z" in kinds:
        df = X.cs_zscore(df, ys, suffix="_z")
    if "neutral" in kinds:
        df = X.neutralise(df, ys, group, mv, suffix="_neutral")
    if "rank" in kinds:
        for y in ys:
            df = X.cs_rank(df, y, out=f"{y}_rank")
    if "shrink" in kinds:
        df = X.winsor_shrink(df, ys, p, suffix="_shrink")
    return df
