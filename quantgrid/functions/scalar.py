"""Column -> Column helpers with this library's missing-value and zero rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col


def null_if_not_finite(x: ColumnOrName) -> Column:
    """Ingest rule: NaN and infinities become NULL, once, at the edge."""
    x = as_col(x)
    return F.when(F.abs(x) < math.inf, x)


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, and 0 wherever b is 0 (even for a NULL numerator)."""
    a, b = as_col(a), as_col(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def ratio_null_zero(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b with a zero denominator giving NULL."""
    return F.try_divide(as_col(a), as_col(b))


def log_positive(x: ColumnOrName) -> Column:
    x = as_col(x)
    return F.when(x > 0, F.ln(x))


def softplus(x: ColumnOrName) -> Column:
    """ln(1 + e^x) without overflow."""
    x = as_col(x)
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def clip(x: ColumnOrName, low: ColumnOrName, high: ColumnOrName) -> Column:
    """Bound x; NULL stays NULL."""
    x, low, high = as_col(x), as_col(low), as_col(high)
    return F.when(x > high, high).when(x < low, low).otherwise(x)


def zero_fill(x: ColumnOrName) -> Column:
    return F.coalesce(null_if_not_finite(x), F.lit(0.0))


def coalesce_default(x: ColumnOrName, default) -> Column:
    return F.coalesce(as_col(x), F.lit(default))


def quarter_end(year: ColumnOrName, quarter: ColumnOrName) -> Column:
    return F.last_day(F.make_date(as_col(year), as_col(quarter) * 3, F.lit(1)))


def code_suffix(code: ColumnOrName) -> Column:
    """Exchange suffix from the leading digit of a security code."""
    code = as_col(code)
    return F.concat(code, F.when(F.substring(code, 1, 1).isin("0", "3"), ".SZ").otherwise(".SH"))


def mask_untraded(x: ColumnOrName, close: ColumnOrName = "close") -> Column:
    return F.when(as_col(close).isNotNull(), as_col(x))


def event_age_bucket(age: ColumnOrName) -> Column:
    """Coarse age classes of an event; a negative age means there is none."""
    age = as_col(age)
    # Upper edge -> class.
    edges = [(1, 1), (5, 2), (10, 3), (20, 4), (40, 5), (60, 6)]
    out = F.when(age < 0, 0)
    for edge, cls in edges:
        out = out.when(age <= edge, cls)
    return out.otherwise(7)


def event_age_decay_inputs(age: ColumnOrName, horizon: float = 60.0) -> tuple[Column, Column]:
    """(age scaled and capped at 5 horizons, log age scaled to 1 at the horizon)."""
    a = F.greatest(as_col(age), F.lit(0)).cast("double")
    return F.least(a / horizon, F.lit(5.0)), F.log1p(a) / math.log1p(horizon)


def yeo_johnson_value(x: ColumnOrName, lam: ColumnOrName) -> Column:
    """Yeo-Johnson power transform of x for exponent lam."""
    x, lam = as_col(x), as_col(lam)
    l2 = F.lit(2.0) - lam
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.nullif(lam, F.lit(0.0)))
    down = F.when(F.abs(l2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, l2) - 1) / F.nullif(l2, F.lit(0.0)))
    return F.when(x >= 0, up).when(x < 0, down)


def _growth(m: Column, size: Column) -> tuple[Column, Column, Column]:
    """Integrals over t from 0 to ``size`` of exp(m t), t exp(m t) and t^2 exp(m t); by series where m size is small."""
    z = m * size
    e = F.exp(z)
    whole = (F.expm1(z) / z, (z * e - F.expm1(z)) / (z * z), (e * (z * z - 2 * z + 2) - 2) / (z * z * z))

    def series(k: int) -> Column:
        out = F.lit(0.0)
        for i in range(12, -1, -1):  # |z| < 0.25: the next term is below 1e-17
            out = out * z + 1.0 / (math.factorial(i) * (i + 1 + k))
        return out

    parts = [F.when(F.abs(z) < 0.25, series(k)).otherwise(w) for k, w in enumerate(whole)]
    return parts[0] * size, parts[1] * size * size, parts[2] * size * size * size


def yeo_johnson_derivatives(x: ColumnOrName, lam: ColumnOrName) -> tuple[Column, Column, Column]:
    """The Yeo-Johnson transform of x and its first two derivatives in the exponent."""
    x, lam = as_col(x), as_col(lam)
    up = x >= 0
    g, g1, g2 = _growth(F.when(up, lam).otherwise(2.0 - lam), F.log1p(F.abs(x)))
    return F.when(up, g).otherwise(-g), g1, F.when(up, g2).otherwise(-g2)
