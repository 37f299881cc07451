"""Calendar helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Presentation names (Spanish, as shown to users).
MONTH_NAMES = ["Ene", "Feb", "Mar", "Abr", "May", "Jun",
               "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]
WEEKDAY_NAMES = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]

# Cyclical periods per calendar feature.
CYCLE_PERIODS = {"month": 12, "day": 31, "day_of_week": 7, "hour": 24}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_week(ts) -> Column:
    """Monday=0 .. Sunday=6 (pandas ``dayofweek``)."""
    return F.weekday(_c(ts))


def add_calendar_features(df: DataFrame, ts: str, prefix: str = "") -> DataFrame:
    """P10: hour, day_of_week (Mon=0), day, month, is_weekend."""
    p = f"{prefix}_" if prefix else ""
    dow = day_of_week(ts)
    return df.withColumns({
        f"{p}hour": F.hour(ts),
        f"{p}day_of_week": dow,
        f"{p}day": F.dayofmonth(ts),
        f"{p}month": F.month(ts),
        f"{p}is_weekend": F.coalesce(dow.isin(5, 6), F.lit(False)).cast("int"),
    })


def week_of_year(ts) -> Column:
    """ISO week number."""
    return F.weekofyear(_c(ts))


_EPOCH_NTZ = "1970-01-01 00:00:00"


def interval_micros(interval: Column) -> Column:
    """A day-time interval in whole microseconds, reading it once."""
    seconds = interval.cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast("long")


def wall_micros(ts) -> Column:
    """Microseconds from 1970-01-01 00:00 to a timestamp_ntz's wall clock.

    The difference of two timestamp_ntz is taken on the wall clock, so neither
    the session time zone nor its daylight-saving gaps enter (``timestamp_diff``
    converts through the session zone); reads ``ts`` once.
    """
    return interval_micros(_c(ts).cast("timestamp_ntz") - F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))


def floor_to(ts, unit_us: int) -> Column:
    """Floor a timestamp_ntz to a multiple of ``unit_us`` microseconds.

    Wall-clock arithmetic on timestamp_ntz (``date_trunc`` and
    ``date_format`` go through the session time zone and move times that
    fall in a daylight-saving gap); reads ``ts`` once.
    """
    epoch = F.lit(_EPOCH_NTZ).cast("timestamp_ntz")
    units = F.floor(wall_micros(ts) / F.lit(float(unit_us)))  # exact: |us| < 2**53 in the supported range
    return F.timestamp_add("MICROSECOND", units * F.lit(unit_us), epoch)


def floor_hour(ts) -> Column:
    """Truncate to the hour, keeping timestamp_ntz (session-zone free)."""
    return floor_to(ts, 3_600_000_000)


def floor_day(ts) -> Column:
    """Truncate to the day, keeping timestamp_ntz (session-zone free)."""
    return floor_to(ts, 86_400_000_000)


def cyclical(df: DataFrame, cols: dict, drop: bool = True) -> DataFrame:
    """``sin``/``cos`` of ``2*pi*c/period``; drops originals if asked."""
    out = {}
    for c, period in cols.items():
        ang = F.lit(2 * math.pi) * F.col(c) / F.lit(float(period))
        out[f"{c}_sin"] = F.sin(ang)
        out[f"{c}_cos"] = F.cos(ang)
    df = df.withColumns(out)
    return df.drop(*cols.keys()) if drop else df


def month_name(c) -> Column:
    """Month number (1-12) -> short name."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), _c(c).cast("int"))


def weekday_name(c) -> Column:
    """Weekday (Mon=0) -> name."""
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAY_NAMES]), _c(c).cast("int") + 1)


def format_minute(ts) -> Column:
    """``%Y-%m-%d %H:%M`` of the wall clock.

    Cut from the timestamp_ntz's own text: ``date_format`` goes through the
    session zone and moves times inside a daylight-saving gap.
    """
    return F.substring(_c(ts).cast("timestamp_ntz").cast("string"), 1, 16)


def percent_text(c, decimals: int = 1) -> Column:
    """``12.3%``."""
    return F.format_string(f"%.{decimals}f%%", _c(c).cast("double"))
