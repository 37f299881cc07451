"""DataFrame-level cleaning and projection.

Column-set decisions (which columns are strings, which exist) are made
from the schema at plan-build time; no data is read to make them.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from careflow.functions import text as T


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in ex]


def strip_strings(df: DataFrame) -> DataFrame:
    """Clean every string column (control chars, trim, blank -> null)."""
    cols = string_columns(df)
    return df.withColumns({c: T.strip_text(c) for c in cols}) if cols else df


def normalize_codes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """P1 + upper-case on the listed columns that exist."""
    cols = [c for c in columns if c in df.columns]
    return df.withColumns({c: T.normalize_code(c) for c in cols}) if cols else df


def strip_and_normalize(df: DataFrame, code_columns: Iterable[str]) -> DataFrame:
    """P1 on every string column, then P2 on the listed code columns.

    Same result as ``normalize_codes(strip_strings(df), cols)``: stripping
    is idempotent, so the code columns only need upper-casing after P1.
    """
    out = strip_strings(df)
    cols = [c for c in code_columns if c in out.columns]
    return out.withColumns({c: F.upper(c) for c in cols}) if cols else out


def null_out_codes(df: DataFrame, replacements: dict) -> DataFrame:
    """Per column, upper/trim then null when in the given set."""
    cols = {c: T.null_out_codes(c, vals) for c, vals in replacements.items() if c in df.columns}
    return df.withColumns(cols) if cols else df


def select_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Project the listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def fill_unknown(df: DataFrame, exclude: Iterable[str] = (), value: str = "UNKNOWN") -> DataFrame:
    """Fill nulls in string columns (except ``exclude``) with UNKNOWN."""
    cols = string_columns(df, exclude)
    return df.fillna(value, subset=cols) if cols else df


def drop_if_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """P20: drop columns, ignoring those that are absent."""
    return df.drop(*[c for c in columns if c in df.columns])


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Whitespace-only text -> null in every string column."""
    cols = string_columns(df)
    return df.withColumns({c: T.blank_to_null(c) for c in cols}) if cols else df


def with_accent_key(df: DataFrame, col: str, out: str) -> DataFrame:
    """Accent-insensitive key of ``col`` as ``out``.

    The vectorised UDF runs once per *distinct* value (an aggregate
    shuffle), and the mapping is joined back on a null-safe key; the
    join is planned by AQE (broadcast when the distinct set is small,
    sort-merge otherwise), so nothing is assumed about its size.
    """
    distinct = df.select(F.col(col).alias("__v")).distinct()
    mapping = distinct.withColumn(out, T.accent_key(F.col("__v")))
    return (df.join(mapping, df[col].eqNullSafe(mapping["__v"]), "left")
              .drop("__v"))


def mask_rare(df: DataFrame, col: str, mask: str, min_count: int = 2,
              count_over: DataFrame | None = None) -> DataFrame:
    """Values seen fewer than ``min_count`` times become ``mask``.

    Counts come from ``count_over`` (default: ``df`` itself; pass the
    training part to avoid the reference's full-table leak). The count
    table is an aggregate joined back (AQE picks broadcast or sort-merge).
    """
    src = df if count_over is None else count_over
    counts = src.groupBy(F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    j = df.join(counts, df[col].eqNullSafe(counts["__v"]), "left")
    rare = F.coalesce(F.col("__n"), F.lit(0)) < min_count
    if count_over is None:
        # values counted in df itself: a value present once has __n == 1
        rare = F.col("__n") < min_count
    return (j.withColumn(col, F.when(rare & F.col(col).isNotNull(), F.lit(mask)).otherwise(F.col(col)))
             .drop("__v", "__n"))
