"""Sorting and top-k reports.

Top-k uses ``orderBy().limit()`` (TakeOrderedAndProject keeps k rows per
task) or ``row_number() <= k`` per group (Spark inserts a partial group
limit before the shuffle), so no group is gathered whole.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.operators.ordering import attach_scalars


def sort_by(df: DataFrame, *cols: str) -> DataFrame:
    """Output ordering (only at the end of a plan)."""
    return df.orderBy(*cols)


def top_groups_by_rate(df: DataFrame, key: str, label: str = "no_show", n: int = 10) -> DataFrame:
    """The ``n`` groups with the highest mean label (ties: key order,
    as ``nlargest`` on a key-sorted index)."""
    rates = (df.filter(F.col(key).isNotNull()).groupBy(key)
               .agg((F.avg(F.col(label).cast("double")) * 100.0).alias("rate")))
    return rates.orderBy(F.desc("rate"), F.asc(key)).limit(n)


def top_n_with_others(df: DataFrame, col: str, n: int = 15, other: str = "Otros") -> DataFrame:
    """Counts of the ``n`` most frequent values (nulls included) and
    one ``other`` row with the rest. The top-n keys (n rows) are
    broadcast back; everything else is aggregated."""
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(n).select(
        F.col("value").alias("__top"), F.lit(True).alias("__is_top"))
    j = counts.join(F.broadcast(top), counts["value"].eqNullSafe(top["__top"]), "left")
    lab = F.when(F.col("__is_top"), F.col("value")).otherwise(F.lit(other))
    return j.groupBy(lab.alias("value"), F.coalesce("__is_top", F.lit(False)).alias("is_top")).agg(
        F.sum("count").alias("count"))


def top_n_share(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """T4: the ``n`` most frequent values with their % of the table."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("__t"))
    top = counts.orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(n)
    return attach_scalars(top, total).withColumn("pct", F.col("count") * 100.0 / F.col("__t")).drop("__t")


def top_k_per_group(df: DataFrame, group: Sequence[str], order, k: int) -> DataFrame:
    """Top ``k`` rows per group by ``order`` (row_number with a group limit)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def best_row(df: DataFrame, metric: str, maximize: bool = True, tie: str | None = None) -> DataFrame:
    """The single best row (max AUC / min MAE), ties by ``tie``."""
    order = [F.desc(metric) if maximize else F.asc(metric)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*order).limit(1)
