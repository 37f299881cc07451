"""Parsing, flags and numeric rules as Column expressions (P4-P9, P13-P16,
P21, P25, P28, P31-P33).

Everything is a built-in expression, so parsing runs inside whole-stage
codegen and never throws under ANSI mode (``try_*`` forms only).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from careflow.functions.text import empty_to_null, unicode_trim

# Pandas can only represent timestamps in this window, so
# parsed values outside it are null in the reference.
PANDAS_TS_MIN = "1677-09-22 00:00:00"
PANDAS_TS_MAX = "2262-04-11 00:00:00"

# Text pandas ``to_numeric`` accepts (a Spark cast would also
# accept suffixes such as ``15D``/``15F`` and must not).
NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Attendance and triage domains, label map.
ATTENDANCE_VALUES = ["A", "I"]
TRIAGE_VALUES = ["A", "C", "E", "M", "N"]
ATTENDANCE_LABEL = {"A": 0, "I": 1}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digits(c) -> Column:
    """Strip, blank->null, drop a trailing ``.0``, keep digits only."""
    s = _c(c).cast("string")
    return F.when(s.rlike(r"^\d+\z"), s).otherwise(F.regexp_replace(empty_to_null(unicode_trim(s)), r"\.0$|\D", ""))


def hhmmss_from_digits(s: Column) -> Column:
    """P4 on an already digit-only string (see :func:`standardize_hhmmss`).

    Written as a chain that reads its input once (filters pushed below a
    projection inline their inputs, so multi-reference forms multiply):
    more than six digits keep the last six; 1, 3 or 5 digits get a
    leading ``0``; then zeros are appended up to six. This gives 6 as is,
    5 ``0``+v, 4 v+``00``, 3 ``0``+v+``00``, 2 v+``0000``, 1 ``0``+v+``0000``
    and ``000000`` for no digits.
    """
    x = F.regexp_replace(s, r"^\d+(\d{6})$", "$1")
    x = F.regexp_replace(x, r"^(\d(?:\d\d){0,2})$", "0$1")
    return F.substring(F.concat(x, F.lit("000000")), 1, 6)


def standardize_hhmmss(c) -> Column:
    """Normalise a raw time to six digits ``HHMMSS``.

    By digit count: 6 as is; 5 ``0``+v; 4 v+``00``; 3 ``0``+v+``00``;
    2 v+``0000``; 1 ``0``+v+``0000``; otherwise zero-fill and keep the last
    six (so text without digits becomes ``000000``). Null stays null.
    """
    return hhmmss_from_digits(_digits(c))


_EPOCH_NTZ = "1970-01-01 00:00:00"
# Whole-second bounds of what pandas can represent
# (1677-09-21 00:12:44 .. 2262-04-11 23:47:16) in microseconds since epoch.
PANDAS_MIN_US = -9223372036000000
PANDAS_MAX_US = 9223372036000000


#: 14 digits in the parts of a time; other text becomes a text without digits, which no cast takes.
_PARTS = r"(?s)\A(?:(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)|.*)\z"
_ABOVE, _BELOW = 2 ** 63 - 1 - PANDAS_MAX_US, PANDAS_MIN_US + 2 ** 63


def _ts_from_digits(raw: Column) -> Column:
    """14 digits ``yyyyMMddHHmmss`` -> timestamp_ntz; invalid -> null.

    The text is cast with an explicit ``Z`` offset (a cast's parser takes a
    fraction of a pattern's time) and turned into a wall-clock
    ``timestamp_ntz`` by epoch arithmetic, so the session time zone (and its
    daylight-saving gaps) never changes the result. Values outside the range
    pandas can represent are null, as in the reference: sums past a long's
    ends are. Every input is referenced once, so filters pushed below this
    expression cannot multiply the parsing work.
    """
    us = F.unix_micros(F.regexp_replace(raw, _PARTS, "$1-$2-$3T$4:$5:$6Z").try_cast("timestamp"))
    us = F.try_add(us, F.lit(_ABOVE)) - F.lit(_ABOVE)
    us = F.try_subtract(us, F.lit(_BELOW)) + F.lit(_BELOW)
    return F.timestamp_add("MICROSECOND", us, F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))


def parse_datetime(date_col, time_col) -> Column:
    """P5: ``YYYYMMDD`` + raw time (P4) -> timestamp_ntz; bad -> null."""
    return _ts_from_digits(F.concat(_digits(date_col), standardize_hhmmss(time_col)))


def with_datetime(df, out: str, date_col: str, time_col: str):
    """P5 on a DataFrame (same result as :func:`parse_datetime`).

    Parsed in a lambda, which keeps a table's several times out of one generated
    method: the JVM compiles none of more than 8,000 bytes, and would run all of
    the projection's cleaning interpreted.
    """
    raw = F.array(F.struct(F.col(date_col).alias("d"), F.col(time_col).alias("t")))
    return df.withColumn(out, F.get(F.transform(raw, lambda x: parse_datetime(x["d"], x["t"])), F.lit(0)))


def parse_date(c) -> Column:
    """``YYYYMMDD`` birth date -> date; bad -> null."""
    s = unicode_trim(c)
    return _ts_from_digits(F.concat(F.regexp_extract(s, r"^(\d{8})$", 1), F.lit("000000"))).cast("date")


def parse_datetime_loose(date_col, time_col, midnight_is_null: bool = True) -> Column:
    """Notebook parser. The time is cut at the first ``.``, trimmed and
    zero-filled on the left to six characters; a time of ``000000`` means
    "no time": null (default) or, with ``midnight_is_null=False``, the
    date at midnight. Null or non-numeric parts give null."""
    t = unicode_trim(F.split(_c(time_col).cast("string"), r"\.", 2).getItem(0))
    t = F.regexp_replace(F.concat(F.lit("000000"), t), r"^0{0,6}(.{6,})$", "$1")
    ts = _ts_from_digits(F.concat(unicode_trim(_c(date_col).cast("string")), t))
    return F.when(t != F.lit("000000"), ts) if midnight_is_null else ts


def safe_numeric(c) -> Column:
    """Trim, parse as double; text pandas rejects -> null."""
    s = unicode_trim(_c(c).cast("string"))
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


def null_if(c, cond: Column) -> Column:
    """Null when ``cond`` holds (range rules)."""
    return F.when(cond, F.lit(None)).otherwise(_c(c))


def domain_clean(c, allowed) -> tuple[Column, Column]:
    """(cleaned value, invalid flag). Out-of-domain -> null, flag 1;
    null input -> (null, 0)."""
    col = _c(c)
    ok = col.isin(list(allowed))
    clean = F.when(ok, col)
    invalid = (col.isNotNull() & ~ok).cast("int")
    return clean, invalid


def label_map(c, mapping: dict | None = None) -> Column:
    """``A``->0, ``I``->1, anything else null."""
    mapping = mapping or ATTENDANCE_LABEL
    expr = None
    for k, v in mapping.items():
        expr = F.when(_c(c) == k, F.lit(v)) if expr is None else expr.when(_c(c) == k, F.lit(v))
    return expr


def _wall_diff(start, end) -> Column:
    from careflow.functions.calendar import interval_micros
    return interval_micros(_c(end).cast("timestamp_ntz") - _c(start).cast("timestamp_ntz"))


def minutes_between(start, end) -> Column:
    """(end - start) in minutes as double, on the wall clock (naive
    timestamps, as pandas), whatever the session time zone."""
    return _wall_diff(start, end) / F.lit(60_000_000.0)


def days_between(start, end) -> Column:
    """(end - start) in days as double (wall clock)."""
    return _wall_diff(start, end) / F.lit(86_400_000_000.0)


def within_flag(c, lo: float = 0.0, hi: float = 1440.0) -> Column:
    """1 when not null and ``lo <= c <= hi``, else 0."""
    return F.coalesce(_c(c).between(lo, hi), F.lit(False)).cast("int")


def negative_flag(c) -> Column:
    """1 when not null and negative."""
    return F.coalesce(_c(c) < 0, F.lit(False)).cast("int")


def code_flag(c, code: str) -> Column:
    """1 when equal to ``code``; null -> 0."""
    return F.coalesce(_c(c) == F.lit(code), F.lit(False)).cast("int")


def log1p_clip(c) -> Column:
    """P25: ``log1p(max(x, 0))``; null stays null."""
    return F.log1p(F.greatest(_c(c).cast("double"), F.lit(0.0)))


def wait_band(c, high: float = 120.0, medium: float = 60.0) -> Column:
    """``high`` (> 120), ``medium`` (> 60), else ``low``."""
    return (F.when(_c(c) > high, F.lit("high"))
            .when(_c(c) > medium, F.lit("medium"))
            .otherwise(F.lit("low")))


def threshold_flag(c, threshold: float) -> Column:
    """1 when the probability is ``>= threshold``."""
    return (_c(c) >= F.lit(float(threshold))).cast("int")


def clip_zero(c) -> Column:
    """``max(pred, 0)``."""
    return F.greatest(_c(c).cast("double"), F.lit(0.0))
