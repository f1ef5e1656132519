"""Calendar and clock features of a date or timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantgrid.core import ColumnOrName, as_col


def daily_time_code(date: ColumnOrName) -> dict[str, Column]:
    d = as_col(date)
    return {"month": F.month(d), "day": F.dayofmonth(d), "weekday": F.weekday(d)}


def temporal_index(ts: ColumnOrName) -> dict[str, Column]:
    """Integer month, day, weekday (1 = Monday), hour and minute."""
    t = as_col(ts)
    return {"month": F.month(t), "day": F.dayofmonth(t), "weekday": F.weekday(t) + 1,
            "hour": F.hour(t), "minute": F.minute(t)}


def _scaled(ts: Column) -> dict[str, Column]:
    # Each clock part, its first value and its span.
    return {
        "second_of_minute": F.second(ts) / 59.0,
        "minute_of_hour": F.minute(ts) / 59.0,
        "hour_of_day": F.hour(ts) / 23.0,
        "day_of_week": F.weekday(ts) / 6.0,
        "day_of_month": (F.dayofmonth(ts) - 1) / 30.0,
        "day_of_year": (F.dayofyear(ts) - 1) / 365.0,
        "month_of_year": (F.month(ts) - 1) / 11.0,
        "week_of_year": (F.weekofyear(ts) - 1) / 52.0,
    }


# Feature set per sampling frequency.
CYCLIC_SETS = {
    "Y": [],
    "Q": ["month_of_year"],
    "M": ["month_of_year"],
    "W": ["day_of_month", "week_of_year"],
    "D": ["day_of_week", "day_of_month", "day_of_year"],
    "B": ["day_of_week", "day_of_month", "day_of_year"],
    "H": ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "T": ["minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "S": ["second_of_minute", "minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
}

_ALIASES = {"A": "Y", "ME": "M", "QE": "Q", "YE": "Y", "MIN": "T"}


def cyclic_time_features(ts: ColumnOrName, freq: str = "h") -> dict[str, Column]:
    """Clock parts scaled to [-0.5, 0.5]; the set depends on the frequency.

    A leading multiple is ignored, so "12H" and "5min" work too.
    """
    key = freq.lstrip("0123456789").upper()
    key = _ALIASES.get(key, key)
    if key not in CYCLIC_SETS:
        raise ValueError(f"unsupported frequency {freq!r}; use one of {sorted(CYCLIC_SETS)}")
    parts = _scaled(as_col(ts))
    return {name: parts[name] - 0.5 for name in CYCLIC_SETS[key]}


# Vector layout per frequency.
TIME2VEC_SETS = {
    "h": ["month", "day", "hour", "weekday"],
    "t": ["month", "day", "hour", "minute", "weekday"],
    "s": ["month", "day", "hour", "minute", "second", "weekday"],
    "m": ["month"],
    "a": ["year_offset"],
    "w": ["iso_week", "week_day"],
    "d": ["month", "day", "weekday"],
    "b": ["month", "day", "weekday"],
}


def time2vec(ts: ColumnOrName, freq: str) -> dict[str, Column]:
    """Clock parts scaled to [0, 1], named t2v_<part>."""
    t = as_col(ts)
    s = _scaled(t)
    parts = {
        "month": s["month_of_year"], "day": s["day_of_month"], "hour": s["hour_of_day"],
        "minute": s["minute_of_hour"], "second": s["second_of_minute"], "weekday": s["day_of_week"],
        "iso_week": F.weekofyear(t) / 52.0, "week_day": (F.weekday(t) + 1) / 7.0,
        "year_offset": (F.year(t) - 2020) / 10.0,
    }
    return {"t2v_" + p: parts[p] for p in TIME2VEC_SETS[freq]}


# The two trading sessions in minutes after midnight, both ends included.
SESSIONS = ((9 * 60 + 30, 11 * 60 + 30), (13 * 60 + 1, 15 * 60))


def minute_axis(trim: tuple[int, int] = (1, 3)) -> Column:
    """Array of the day's bar times (minutes after midnight), trimmed at both ends."""
    bars = F.concat(*[F.sequence(F.lit(a), F.lit(b)) for a, b in SESSIONS])
    total = sum(b - a + 1 for a, b in SESSIONS)
    return F.slice(bars, trim[0] + 1, total - sum(trim))
