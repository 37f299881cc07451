"""Registry of checked queries: one Spark query and (when SQL can state
it) one DuckDB oracle per operator ID.

Spark results are normalised for comparison only: integral columns as
bigint, floating columns rounded to 6 decimals with the same rule the
oracle uses (``round(x*1e6)/1e6``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(dt, T.BooleanType):
            c = c.cast("boolean")
        elif isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double") * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)
        elif isinstance(dt, T.DateType):
            c = c.cast("date")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, raw: bool = False):
    def deco(fn):
        if raw:
            QUERIES[name] = fn
        else:
            QUERIES[name] = lambda spark, sf_dir, _f=fn: finish(_f(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from careflow.checks import (q_clean, q_agg, q_ts, q_quality, q_kpi, q_ml)  # noqa: F401
