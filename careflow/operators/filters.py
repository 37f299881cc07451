"""Row filters.

Conditions on stored columns reach the parquet scan as pushed filters;
head/tail are distributed top-k (k rows kept per task), never a full sort
gathered on one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def non_null(df: DataFrame, *cols: str) -> DataFrame:
    """keep rows where every listed column is not null."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond) if cond is not None else df


def date_range(df: DataFrame, col: str, start: str, end: str) -> DataFrame:
    """inclusive range on a timestamp column (bounds as literals of
    the column's type, so the predicate is pushed to the scan)."""
    t = df.schema[col].dataType.simpleString()
    return df.filter(F.col(col).between(F.lit(start).cast(t), F.lit(end).cast(t)))


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """drop rows with a null in any listed column."""
    return df.dropna(subset=list(cols))


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """first ``n`` rows in ``order``."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(n)


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """last ``n`` rows in ``order`` (returned in ascending order)."""
    last = df.orderBy(*[F.desc_nulls_first(c) for c in order]).limit(n)
    return last.orderBy(*[F.asc_nulls_last(c) for c in order])


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample with a fixed seed (the sampling operator)."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
