"""Text cleaning as Column expressions.

All helpers are built-in Spark expressions (whole-stage codegen) except
:func:`accent_key`, which needs Unicode NFKD and is applied by
:func:`careflow.operators.projection.with_accent_key` on distinct values only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Control characters removed before trimming (U+0000-U+001F
# and U+007F), and the whitespace set of Python's ``str.strip`` (derived
# by rule from ``str.isspace``; it includes NBSP, which Spark ``trim``
# keeps). ``translate``/``btrim`` with explicit sets avoid regular
# expressions and keep generated code small.
CONTROL_CHARS = "".join(chr(i) for i in range(0x20)) + "\x7f"
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
# what is left of it once the control characters are gone
_TRIM_AFTER_CONTROL = "".join(c for c in WHITESPACE if c not in CONTROL_CHARS)

# Codes treated as "no information" by the patient cleaner.
NONINFORMATIVE_CODES = {
    "m_cp": ["000", "00000", "NA", "N/A", "NULL", "NONE"],
    "m_edo": ["NA", "N/A", "NULL", "NONE"],
    "m_pai": ["NA", "N/A", "NULL", "NONE"],
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_to_null(x: Column) -> Column:
    """``""`` -> null. ``x`` stands in it twice; a projection evaluates it once,
    as generated code shares common subexpressions. (Forms that name it once
    go through a one-element array for each value and cost five times as much.)
    """
    return F.when(x != F.lit(""), x)


def _unless_plain(s: Column, cleaned: Column) -> Column:
    """``cleaned``, but ``s`` itself where it has visible ASCII only: nothing to
    trim or to drop then, and looking costs a fraction of ``translate`` and ``btrim``."""
    return F.when(s.rlike("[^!-~]"), cleaned).otherwise(s)


def unicode_trim(c) -> Column:
    """Trim Unicode whitespace at both ends (Python ``str.strip``)."""
    s = _c(c).cast("string")
    return _unless_plain(s, F.btrim(s, F.lit(WHITESPACE)))


def strip_text(c) -> Column:
    """Drop control characters, trim, and map ``""`` to null."""
    s = _c(c).cast("string")
    return empty_to_null(_unless_plain(s, F.btrim(F.translate(s, CONTROL_CHARS, ""), F.lit(_TRIM_AFTER_CONTROL))))


def normalize_code(c) -> Column:
    """:func:`strip_text` then upper-case."""
    return F.upper(strip_text(c))


def null_out_codes(c, invalid) -> Column:
    """upper/trim, then null when the value is in ``invalid``."""
    s = F.upper(unicode_trim(c))
    return F.when(s.isin(list(invalid)), F.lit(None).cast("string")).otherwise(s)


def join_key(c) -> Column:
    """Trimmed string copy used as a join key."""
    return unicode_trim(_c(c).cast("string"))


def blank_to_null(c) -> Column:
    """Whitespace-only text becomes null (other values unchanged)."""
    col = _c(c)
    return F.when(col.cast("string").rlike(r"^\s*$"), F.lit(None)).otherwise(col)


def code_clean(c, pad_len: int = 0, replace: dict | None = None,
               unknown: str = "UNKNOWN") -> Column:
    """Trim, drop a trailing ``.0``, replace by dictionary, zero-pad.

    Padding is ``zfill`` semantics: only text shorter than ``pad_len`` is
    padded (``lpad`` alone would truncate longer text); ``unknown`` is never
    padded. Null becomes the text ``"<NA>"``-free ``unknown`` only when the
    caller filled it before (the reference casts nulls to text first).
    """
    s = F.regexp_replace(unicode_trim(c), r"\.0$", "")
    if replace:
        expr = None
        for k, v in replace.items():
            cond = s == F.lit(k)
            expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
        s = expr.otherwise(s)
    if pad_len > 0:
        s = F.when((s != F.lit(unknown)) & (F.length(s) < pad_len),
                   F.lpad(s, pad_len, "0")).otherwise(s)
    return s


def _accent_key_py(v):
    if v is None:
        return "MISSING"
    s = str(v).strip().upper()
    s = unicodedata.normalize("NFKD", s)
    return "".join(ch for ch in s if not unicodedata.combining(ch))


@pandas_udf(StringType())
def accent_key(s: pd.Series) -> pd.Series:
    """Strip, upper, NFKD, drop combining marks; null -> ``MISSING``.

    Vectorised over Arrow batches; callers apply it to distinct values.
    """
    return s.map(_accent_key_py)
