"""Hourly demand aggregation.

Hour buckets are a ``groupBy(date_trunc('hour', ts))`` with map-side
partial aggregation. The exact median of A1 comes from running totals of
the (hour, wait) counts (:func:`careflow.operators.ordering.count_quantiles`),
so an hour holding a third of all rows is split across tasks; the other
columns are sums of the same counts, so the notes are read once.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.functions.calendar import floor_day, floor_hour
from careflow.functions.parse import TRIAGE_VALUES
from careflow.operators.ordering import count_quantiles, written


def hourly_demand(notes: DataFrame, ts: str = "arrival_datetime",
                  wait: str = "wait_proxy_min", valid: str = "valid_wait_proxy",
                  out_ts: str = "timestamp", median: str = "exact") -> DataFrame:
    """A1: per hour: arrivals, mean and median wait over valid rows, valid count.

    ``median``: ``exact`` (default), ``buffer`` (Spark's ``median``
    aggregate, buffers each hour's values) or ``approx``
    (``percentile_approx``).
    """
    base = (notes.filter(F.col(ts).isNotNull())
                 .select(floor_hour(ts).alias(out_ts),
                         F.when(F.col(valid) == 1, F.col(wait)).alias("__w"),
                         F.col(valid).alias("__valid")))
    aggs = [F.count(F.lit(1)).alias("pacientes_llegando"),
            F.avg("__w").alias("tiempo_espera"),
            F.coalesce(F.sum("__valid"), F.lit(0)).cast("long").alias("wait_proxy_valid_count")]
    cols = [out_ts, "pacientes_llegando", "tiempo_espera", "tiempo_espera_mediana", "wait_proxy_valid_count"]
    if median == "buffer":
        return base.groupBy(out_ts).agg(*aggs, F.median("__w").alias("tiempo_espera_mediana")).select(*cols)
    if median == "approx":
        return base.groupBy(out_ts).agg(
            *aggs, F.percentile_approx("__w", 0.5, 10000).cast("double").alias("tiempo_espera_mediana")).select(*cols)
    counts = base.withColumn("__w", F.col("__w").cast("double")).groupBy(out_ts, "__w").agg(
        F.count(F.lit(1)).alias("__rows"), F.count("__w").alias("__waits"), F.sum("__valid").alias("__ok"))
    found = count_quantiles(counts, [out_ts], "__w", "__waits", [0.5], [
        F.sum("__rows").alias("pacientes_llegando"),
        F.try_divide(F.sum(F.col("__w") * F.col("__waits")), F.sum("__waits")).alias("tiempo_espera"),
        F.coalesce(F.sum("__ok"), F.lit(0)).cast("long").alias("wait_proxy_valid_count")])
    return found.withColumnRenamed("q0", "tiempo_espera_mediana").select(*cols)


def hourly_events(df: DataFrame, ts: str, out_ts: str = "timestamp",
                  out: str = "triage_events") -> DataFrame:
    """A2: event count per hour."""
    return (df.filter(F.col(ts).isNotNull())
              .groupBy(floor_hour(ts).alias(out_ts))
              .agg(F.count(F.lit(1)).alias(out)))


def hourly_crosstab(df: DataFrame, ts: str, category: str,
                    values: Sequence[str] = tuple(TRIAGE_VALUES), prefix: str = "triage_",
                    out_ts: str = "timestamp", total: str | None = "triage_events") -> DataFrame:
    """A2 + A3 in one pass: per hour the event count and one count column
    per fixed category value (stable schema, no distinct-value job)."""
    aggs = []
    if total:
        aggs.append(F.count(F.lit(1)).alias(total))
    aggs += [F.count(F.when(F.col(category) == v, F.lit(1))).alias(f"{prefix}{v}") for v in values]
    return (df.filter(F.col(ts).isNotNull())
              .groupBy(floor_hour(ts).alias(out_ts)).agg(*aggs))


def hourly_distinct(df: DataFrame, ts: str, key: str, out_ts: str = "timestamp",
                    out: str = "n_unique") -> DataFrame:
    """Distinct (non-null) keys per hour, plus rows per hour."""
    return (df.filter(F.col(ts).isNotNull())
              .groupBy(floor_hour(ts).alias(out_ts))
              .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(key)).alias(out)))


def hour_spine(df: DataFrame, ts: str, out_ts: str = "timestamp") -> DataFrame:
    """Every hour between the first and last hour of ``df[ts]``.

    Built in two steps so no task explodes the whole range: one row per
    day (from a one-row min/max aggregate), then 24 hours per day in
    parallel, trimmed to the range.
    """
    rng = df.agg(F.min(floor_hour(ts)).alias("__lo"), F.max(floor_hour(ts)).alias("__hi"))
    days = rng.select("__lo", "__hi", F.explode(F.sequence(
        floor_day("__lo"), floor_day("__hi"), F.expr("INTERVAL 1 DAY"))).alias("__day"))
    days = days.repartition("__day")
    hours = days.select("__lo", "__hi", F.explode(F.sequence(
        F.col("__day"), F.col("__day") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias(out_ts))
    return hours.filter(F.col(out_ts).between(F.col("__lo"), F.col("__hi"))).select(out_ts)


def resample_hourly_count(df: DataFrame, ts: str, out_ts: str = "timestamp",
                          out: str = "count") -> DataFrame:
    """Count per hour with empty hours = 0 (regular hourly series).

    The hours that have rows are written once, and the spine's ends read from
    them, so that ``df``, often a costly plan, is evaluated once.
    """
    counts = written(hourly_events(df, ts, out_ts, out))
    return hour_spine(counts, out_ts, out_ts).join(counts, out_ts, "left").fillna({out: 0})


def resample_hourly_mean(df: DataFrame, ts: str, value: str, fill: float = 3.0,
                         out_ts: str = "timestamp", out: str = "mean") -> DataFrame:
    """Mean per hour over a regular spine, empty hours = ``fill``; ``df`` is
    evaluated once, as for A16."""
    means = written(df.filter(F.col(ts).isNotNull())
                    .groupBy(floor_hour(ts).alias(out_ts)).agg(F.avg(F.col(value).cast("double")).alias(out)))
    return hour_spine(means, out_ts, out_ts).join(means, out_ts, "left").fillna({out: float(fill)})
