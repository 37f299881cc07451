"""Joins and deduplication.

All reference joins are equi left-outer merges in which null keys match
null keys, so joins use ``eqNullSafe`` (Catalyst rewrites it to a
``coalesce``/``isnull`` key pair, still a hash-partitioned join). AQE
chooses broadcast or sort-merge at run time and splits skewed partitions;
no side is forced into a broadcast here.

Keep-first / keep-earliest deduplication is an aggregation (``min`` of a
struct whose first fields are the sort key), not a window: the aggregate
combines map-side, so a key holding a third of all rows is reduced in
every task before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct (nulls compare equal, as in pandas)."""
    return df.dropDuplicates()


def _first_by(df: DataFrame, keys: Sequence[str], sort_fields: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[f.alias(f"__s{i}") for i, f in enumerate(sort_fields)],
                      *[F.col(c).alias(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.min(packed).alias("__row"))
    return agg.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order_by`` (ascending, nulls
    last). Pass a unique ``order_by`` (e.g. the file row index) for a
    deterministic result."""
    fields = []
    for c in order_by:
        fields += [F.col(c).isNull(), F.col(c)]
    return _first_by(df, keys, fields)


def keep_earliest(df: DataFrame, keys: Sequence[str], time_col: str,
                  tie_breaks: Sequence[str] = ()) -> DataFrame:
    """D3: per key the row with the earliest ``time_col`` (nulls last),
    ties broken by ``tie_breaks``."""
    return keep_first(df, keys, [time_col, *tie_breaks])


def _clash_renamed(left: DataFrame, right: DataFrame, skip: Sequence[str], suffix: str) -> DataFrame:
    ren = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in skip}
    return right.withColumnsRenamed(ren) if ren else right


def left_join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   suffix: str = "_right", indicator: str | None = None) -> DataFrame:
    """Left join on same-named keys, null-safe; right columns that
    clash with left ones get ``suffix``; left keys are kept."""
    r = _clash_renamed(left, right, keys, suffix)
    r = r.withColumnsRenamed({k: f"__rk_{k}" for k in keys})
    if indicator:
        r = r.withColumn(indicator, F.lit(1))
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__rk_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, "left").drop(*[f"__rk_{k}" for k in keys])
    if indicator:
        out = out.withColumn(indicator, F.coalesce(F.col(indicator), F.lit(0)))
    return out


def left_join_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                 suffix: str = "_right", indicator: str | None = None) -> DataFrame:
    """Left join on differently named keys, null-safe; both keys kept."""
    r = _clash_renamed(left, right, (), suffix)
    rk = right_key if right_key not in left.columns else f"{right_key}{suffix}"
    if indicator:
        r = r.withColumn(indicator, F.lit(1))
    out = left.join(r, left[left_key].eqNullSafe(r[rk]), "left")
    if indicator:
        out = out.withColumn(indicator, F.coalesce(F.col(indicator), F.lit(0)))
    return out


def left_join_fill(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                   fill: dict) -> DataFrame:
    """Left join on key column(s) and fill the right side's gaps
    (counts with 0, severity with a constant)."""
    on = [on] if isinstance(on, str) else list(on)
    out = left.join(right, on, "left")
    fill = {c: v for c, v in fill.items() if c in out.columns}
    return out.fillna(fill) if fill else out


def join_audit(joined: DataFrame, rows_before: DataFrame, indicator: str,
               name: str = "join") -> DataFrame:
    """One-row report: rows before, rows after, preserved?, matched,
    match rate %, unmatched."""
    before = rows_before.agg(F.count(F.lit(1)).alias("rows_before"))
    after = joined.agg(F.count(F.lit(1)).alias("rows_after"),
                       F.sum(F.col(indicator)).cast("long").alias("matched"))
    rep = before.join(F.broadcast(after), how="inner")
    return rep.select(
        F.lit(name).alias("join_name"),
        "rows_before", "rows_after",
        (F.col("rows_before") == F.col("rows_after")).alias("rows_preserved"),
        F.coalesce(F.col("matched"), F.lit(0)).alias("matched"),
        (F.col("rows_after") - F.coalesce(F.col("matched"), F.lit(0))).alias("unmatched"),
        (F.coalesce(F.col("matched"), F.lit(0)) * F.lit(100.0) / F.col("rows_after")).alias("match_rate_pct"))
