"""Operational KPIs and what-if scenarios.

KPIs are small aggregates over the appointment base and the hourly
master; every function returns a DataFrame (nothing is collected), so
several KPIs can be computed in one job and joined.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.operators.ordering import attach_scalars, global_index, prefix_sums

# KPI weights, staffing rule and recommendation texts.
SATISFACTION_WEIGHTS = {"noshow": 0.30, "wait": 0.40, "utilization": 0.30}
CAPACITY_PER_DOCTOR = 3.0
CURRENT_DOCTORS = 3
HIGH_DEMAND_FACTOR = 1.3
OVERTIME_HOURS_PER_HIGH_HOUR = 0.5
WAIT_PER_PATIENT_MIN = 5.0
MIN_WAIT_ESTIMATE = 10.0
TEXT_EMERGENCY = ("Activar apoyo de emergencia. Mover {diff} médicos de Consulta Externa "
                  "(baja demanda) a Urgencias.")
TEXT_REDISTRIBUTE = ("Redistribuir personal: Trasladar {diff} médicos de Consulta Externa a Urgencias "
                     "para evitar picos de espera de {wait} minutos.")
TEXT_RELEASE = "Optimizar personal: Liberar {diff} médicos para otras actividades o Consulta Externa."


def overall_rate(df: DataFrame, label: str = "no_show") -> DataFrame:
    """A5: one row: rate % (2-decimal half-even, as Python ``round``),
    total rows and positives."""
    return df.agg(F.bround(F.avg(F.col(label).cast("double")) * 100.0, 2).alias("overall_rate"),
                  F.count(F.lit(1)).alias("total"),
                  F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positives"))


def rate_by(df: DataFrame, dims: Sequence[str], label: str = "no_show") -> DataFrame:
    """Rate % per value of each dimension in ONE aggregation pass
    (grouping sets), long format (dimension, key, rate, n); null keys
    dropped as in pandas ``groupby``."""
    dims = [d for d in dims if d in df.columns]
    x = df.select(*[F.col(d).cast("string").alias(d) for d in dims], F.col(label).cast("double").alias("__y"))
    g = x.groupingSets([[d] for d in dims], *dims).agg(
        F.avg("__y").alias("__m"), F.count(F.lit(1)).alias("n"),
        *[F.grouping(d).alias(f"__g_{d}") for d in dims])
    dim = None
    key = None
    for d in dims:
        cond = F.col(f"__g_{d}") == 0
        dim = F.when(cond, F.lit(d)) if dim is None else dim.when(cond, F.lit(d))
        key = F.when(cond, F.col(d)) if key is None else key.when(cond, F.col(d))
    out = g.select(dim.alias("dimension"), key.alias("key"), (F.col("__m") * 100.0).alias("rate"), "n")
    return out.filter(F.col("key").isNotNull())


def utilization(df: DataFrame, label: str = "no_show", by: str | None = None) -> DataFrame:
    """Attended / total %, overall or per ``by``."""
    agg = [(100.0 * (1.0 - F.avg(F.col(label).cast("double")))).alias("utilization"),
           F.count(F.lit(1)).alias("total_slots"),
           (F.count(F.lit(1)) - F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).alias("attended")]
    if by:
        return df.filter(F.col(by).isNotNull()).groupBy(by).agg(*agg)
    return df.agg(*agg)


def hour_column(df: DataFrame) -> str:
    """The master's hour column: ``hour`` (pipeline) or ``hour_of_day``."""
    return "hour" if "hour" in df.columns else "hour_of_day"


def wait_estimate(master: DataFrame, wait: str = "tiempo_espera", demand: str = "pacientes_llegando") -> DataFrame:
    """Mean wait; without a wait column, ``max(10, mean demand * 5)``;
    without either, the reference's 45.0."""
    if wait in master.columns:
        return master.agg(F.avg(wait).alias("avg_minutes"))
    if demand in master.columns:
        return master.agg(F.greatest(F.lit(MIN_WAIT_ESTIMATE), F.avg(demand) * WAIT_PER_PATIENT_MIN).alias("avg_minutes"))
    return master.sparkSession.createDataFrame([(45.0,)], "avg_minutes double")


def wait_by_hour(master: DataFrame, wait: str = "tiempo_espera", demand: str = "pacientes_llegando") -> DataFrame:
    """Mean wait per hour of day (or demand * 5 without waits)."""
    h = hour_column(master)
    if wait in master.columns:
        return master.groupBy(F.col(h).alias("hour")).agg(F.avg(wait).alias("avg_minutes"))
    return master.groupBy(F.col(h).alias("hour")).agg((F.avg(demand) * WAIT_PER_PATIENT_MIN).alias("avg_minutes"))


def mean_by(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of ``value`` per ``by`` (hour of day, weekday...)."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.avg(value).alias(f"mean_{value}"))


def pivot_mean(df: DataFrame, rows: str, cols: str, value: str, values: Sequence | None = None) -> DataFrame:
    """A10: pivot table rows x cols of mean ``value`` (fixed column list,
    e.g. hours 0..23, gives one pass and a stable schema)."""
    vals = list(values) if values is not None else list(range(24))
    return df.groupBy(rows).pivot(cols, vals).agg(F.avg(value))


def satisfaction_index(noshow_rate: Column, wait_minutes: Column, utilization_rate: Column,
                       weights: dict | None = None) -> dict:
    """K1 component expressions: scores 0-100 and the weighted composite."""
    w = weights or SATISFACTION_WEIGHTS
    ns = F.greatest(F.lit(0.0), F.lit(100.0) - noshow_rate * 2.0)
    ws = F.greatest(F.lit(0.0), F.lit(100.0) - wait_minutes / 1.2)
    us = utilization_rate
    return {"noshow_score": ns, "wait_score": ws, "utilization_score": us,
            "score": F.lit(w["noshow"]) * ns + F.lit(w["wait"]) * ws + F.lit(w["utilization"]) * us}


def kpi_table(base: DataFrame, master: DataFrame, label: str = "no_show",
              weights: dict | None = None) -> DataFrame:
    """K1: one row with the rounded KPI inputs (rate 2 decimals, wait 1,
    utilisation 2, half-even like Python ``round``) and the satisfaction
    score (1 decimal) with its components."""
    a = base.agg(F.bround(F.avg(F.col(label).cast("double")) * 100.0, 2).alias("noshow_rate"),
                 F.bround(100.0 * (F.count(F.lit(1)) - F.sum(F.col(label).cast("long"))) / F.count(F.lit(1)), 2)
                 .alias("utilization_rate"))
    w = wait_estimate(master).select(F.bround("avg_minutes", 1).alias("wait_minutes"))
    one = attach_scalars(a, w)
    parts = satisfaction_index(F.col("noshow_rate"), F.col("wait_minutes"), F.col("utilization_rate"), weights)
    return one.select("noshow_rate", "wait_minutes", "utilization_rate",
                      *[v.alias(k) for k, v in parts.items() if k != "score"],
                      F.bround(parts["score"], 1).alias("satisfaction_score"))


def kpi_summary(kpis: DataFrame) -> DataFrame:
    """K2: the four KPIs as (name, value, unit) rows."""
    return kpis.select(F.explode(F.array(
        F.struct(F.lit("tasa_ausentismo").alias("kpi"), F.col("noshow_rate").alias("value"), F.lit("%").alias("unit")),
        F.struct(F.lit("tiempo_espera").alias("kpi"), F.col("wait_minutes").alias("value"), F.lit("min").alias("unit")),
        F.struct(F.lit("utilizacion_consultorios").alias("kpi"), F.col("utilization_rate").alias("value"),
                 F.lit("%").alias("unit")),
        F.struct(F.lit("indice_satisfaccion").alias("kpi"), F.col("satisfaction_score").alias("value"),
                 F.lit("pts").alias("unit")))).alias("r")).select("r.*")


def staffing_plan(master: DataFrame, demand: str = "pacientes_llegando",
                  capacity: float = CAPACITY_PER_DOCTOR, current: int = CURRENT_DOCTORS) -> DataFrame:
    """K3: per hour of day: mean arrivals, doctors needed, status and text."""
    h = hour_column(master)
    avg = master.groupBy(F.col(h).cast("int").alias("hour")).agg(F.avg(demand).alias("patients_arrival"))
    needed = F.ceil(F.col("patients_arrival") / capacity).cast("int")
    x = avg.withColumn("__needed", needed).withColumn("diff", F.col("__needed") - F.lit(current))
    status = (F.when(F.col("diff") >= 2, F.lit("saturated")).when(F.col("diff") > 0, F.lit("warning"))
               .when(F.col("diff") < 0, F.lit("underutilized")).otherwise(F.lit("normal")))
    off_hours = (F.col("hour") < 9) | (F.col("hour") > 17)
    wait = F.floor(F.col("patients_arrival") * 6).cast("long")
    e_pre, e_post = TEXT_EMERGENCY.split("{diff}")
    r_pre, r_mid = TEXT_REDISTRIBUTE.split("{diff}")
    r_mid, r_post = r_mid.split("{wait}")
    l_pre, l_post = TEXT_RELEASE.split("{diff}")
    text = (F.when((F.col("diff") > 0) & off_hours, F.concat(F.lit(e_pre), F.col("diff").cast("string"), F.lit(e_post)))
             .when(F.col("diff") > 0, F.concat(F.lit(r_pre), F.col("diff").cast("string"), F.lit(r_mid),
                                               wait.cast("string"), F.lit(r_post)))
             .when(F.col("diff") < 0, F.concat(F.lit(l_pre), (-F.col("diff")).cast("string"), F.lit(l_post)))
             .otherwise(F.lit("")))
    return x.select("hour", F.format_string("%02d:00", "hour").alias("hour_label"), "patients_arrival",
                    F.greatest(F.col("__needed"), F.lit(1)).alias("needed_doctors"),
                    F.lit(current).alias("current_doctors"), "diff", status.alias("status"),
                    text.alias("recommendation"))


def staffing_alerts(plan: DataFrame) -> DataFrame:
    """K3: the hours that need more doctors than there are, in the order of
    the day: severity, mean arrivals to one decimal (half to even) and what to do."""
    severity = F.when(F.col("status") == "saturated", F.lit("critical")).otherwise(F.lit("warning"))
    return (plan.where("diff > 0").orderBy("hour")
            .select(F.col("hour_label").alias("hour"), severity.alias("severity"),
                    F.bround("patients_arrival", 1).alias("patients_arrival"), "needed_doctors", "current_doctors",
                    "recommendation"))


def staffing_summary(plan: DataFrame) -> DataFrame:
    """K4: alerts, critical alerts, max mean arrivals and the peak hour
    (earliest hour among ties, like ``idxmax``)."""
    return plan.agg(F.sum((F.col("diff") > 0).cast("long")).alias("total_alerts"),
                    F.sum((F.col("status") == "saturated").cast("long")).alias("critical_alerts"),
                    F.max("patients_arrival").alias("max_arrival"),
                    F.format_string("%02d:00", F.min_by("hour", F.struct(-F.col("patients_arrival"), F.col("hour"))))
                    .alias("peak_hour"))


def high_demand_hours(master: DataFrame, demand: str = "pacientes_llegando",
                      factor: float = HIGH_DEMAND_FACTOR) -> DataFrame:
    """Hours whose demand exceeds ``factor`` x the global mean."""
    mean = master.agg(F.avg(demand).alias("__mean"))
    return attach_scalars(master, mean).filter(F.col(demand) > F.col("__mean") * factor).drop("__mean")


def count_at_least(values: DataFrame, value: str, thresholds: DataFrame, t: str, out: str = "n_at_least") -> DataFrame:
    """Per threshold row: number of ``values`` rows with value >= threshold.

    Exact and distributed in both tables: values are reduced to (value, count)
    with map-side combine and merged with the distinct thresholds in one
    descending order, where a threshold stands behind the values equal to it;
    the running total at a threshold is its count. A null threshold has none.
    """
    hist = values.where(F.col(value).isNotNull()).groupBy((-F.col(value).cast("double")).alias("__k")).agg(
        F.count(F.lit(1)).alias("__c"))
    ts = thresholds.select((-F.col(t).cast("double")).alias("__k")).where("__k is not null").distinct()
    both = hist.select("__k", F.lit(0).alias("__last"), "__c").unionByName(
        ts.select("__k", F.lit(1).alias("__last"), F.lit(0).cast("long").alias("__c")))
    counted = prefix_sums(both, ["__k", "__last"], ["__c"]).where("__last = 1").select(
        "__k", F.col("cum___c").alias(out))
    return thresholds.join(counted, -thresholds[t].cast("double") == counted["__k"], "left").drop("__k")


def overbooking_impact(scored: DataFrame, scenarios: DataFrame, master: DataFrame | None,
                       prob: str = "prob", label: str = "no_show", demand: str = "pacientes_llegando") -> DataFrame:
    """K5: business impact for every scenario row (threshold, overbooking_rate,
    consultation_cost, hourly_overtime_cost). Truncations are Python
    ``int()`` (toward zero); amounts are unrounded."""
    base = scored.agg(F.count(F.lit(1)).alias("total_appointments"),
                      (F.avg(F.col(label).cast("double")) * 100.0).alias("overall_noshow_rate"))
    flagged = count_at_least(scored, prob, scenarios, "threshold", "predicted_noshows")
    x = attach_scalars(flagged, base)
    if master is not None:
        hh = high_demand_hours(master, demand).agg(F.count(F.lit(1)).alias("__high"))
        x = attach_scalars(x, hh.select(F.floor(F.col("__high") * OVERTIME_HOURS_PER_HIGH_HOUR).cast("long")
                                        .alias("overtime_hours_saved")))
    else:
        x = x.withColumn("overtime_hours_saved", F.lit(480).cast("long"))
    trunc = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("long")
    x = x.withColumn("overbooked_slots", trunc(F.col("predicted_noshows") * (F.col("overbooking_rate") / 100.0)))
    show_rate = (100.0 - F.col("overall_noshow_rate")) / 100.0
    x = x.withColumn("recovered_appointments", trunc(F.col("overbooked_slots") * show_rate))
    x = x.withColumn("original_loss", F.col("total_appointments") * (F.col("overall_noshow_rate") / 100.0)
                     * F.col("consultation_cost"))
    x = x.withColumn("recovered_revenue", F.col("recovered_appointments") * F.col("consultation_cost"))
    x = x.withColumn("remaining_loss", F.col("original_loss") - F.col("recovered_revenue"))
    x = x.withColumn("original_utilization", 100.0 - F.col("overall_noshow_rate"))
    x = x.withColumn("optimized_utilization", F.least(F.lit(100.0), F.col("original_utilization")
                     + F.col("recovered_appointments") / F.col("total_appointments") * 100.0))
    x = x.withColumn("overtime_savings", F.col("overtime_hours_saved") * F.col("hourly_overtime_cost"))
    x = x.withColumn("total_annual_benefit", F.col("recovered_revenue") + F.col("overtime_savings"))
    x = x.withColumn("nps_points_gain", F.least(F.lit(10.0), (F.col("optimized_utilization")
                                                               - F.col("original_utilization")) * 0.5))
    return x


def class_weights(df: DataFrame, label: str = "no_show") -> DataFrame:
    """Per class count, balanced weight n/(k*n_c), and the
    negatives/positives ratio used as the positive-class weight."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("__n"), F.count(F.lit(1)).alias("__k"),
                     F.sum(F.when(F.col(label) == 0, F.col("count"))).alias("__neg"),
                     F.sum(F.when(F.col(label) == 1, F.col("count"))).alias("__pos"))
    out = attach_scalars(counts, tot)
    return out.select(label, "count", (F.col("__n") / (F.col("__k") * F.col("count"))).alias("balanced_weight"),
                      (F.col("__neg") / F.col("__pos")).alias("scale_pos_weight"))


def block_means(df: DataFrame, value: str, order: Sequence[str], block: int = 100) -> DataFrame:
    """Mean of each run of ``block`` consecutive rows in ``order``
    (global row numbers, then a grouped average)."""
    idx = global_index(df, order, "__i")
    return (idx.groupBy(F.floor((F.col("__i") - 1) / block).cast("long").alias("block"))
               .agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count(F.lit(1)).alias("rows")))


def residual_summary(df: DataFrame, actual: str, pred: str, by: str | None = None) -> DataFrame:
    """Bias (mean residual) and population std of residuals, overall
    or per ``by`` (e.g. hour)."""
    r = F.col(actual).cast("double") - F.col(pred).cast("double")
    agg = [F.avg(r).alias("bias"), F.stddev_pop(r).alias("resid_std"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(by).agg(*agg) if by else df.agg(*agg)
