"""Integrated tables (C6 no-show base, C7 hourly master, C11, C12)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.functions import parse as P
from careflow.functions.calendar import add_calendar_features, floor_hour
from careflow.operators import hourly as H
from careflow.operators import joins as J
from careflow.operators import projection as PR
from careflow.operators.timeseries import ts_features

# Columns of the appointment base, in the reference's order.
BASE_COLUMNS = ["area", "med", "esp", "tpo_cita", "conflicto", "agregada", "ultimahora", "buffer",
                "duration_min", "appointment_hour", "appointment_day_of_week", "appointment_day",
                "appointment_month", "appointment_is_weekend", "lead_time_days",
                "lead_time_invalid", "p_status", "p_sexo", "p_tpo_pac", "p_tpo_cita", "m_status",
                "m_sexo", "m_edad_num", "m_ciu", "m_col", "m_cp", "m_edo", "m_pai", "no_show"]
APPOINTMENT_KEYS = ["area_key", "cve_num_key", "cve_mbo_key"]


def no_show_base(appointments: DataFrame, encounters: DataFrame, patients: DataFrame,
                 encounter_tie_breaks: Sequence[str] = ()) -> DataFrame:
    """One row per labelled appointment.

    D3 keeps the earliest registration per appointment key, so J1 cannot
    multiply appointments; J2 adds patient attributes; lead time is days
    from reservation to appointment (negative -> flagged and nulled);
    unlabelled rows are dropped; string columns are filled with UNKNOWN.
    """
    enc = J.keep_earliest(encounters, APPOINTMENT_KEYS, "registration_datetime",
                          list(encounter_tie_breaks))
    df = J.left_join_keys(appointments, enc, APPOINTMENT_KEYS, suffix="_hospac")
    df = J.left_join_on(df, patients, "p_num_exp_key", "m_num_exp_key")
    lead = P.days_between("reservation_datetime", "appointment_datetime")
    df = df.withColumn("lead_time_days", lead)
    df = df.withColumn("lead_time_invalid", P.negative_flag("lead_time_days"))
    df = df.withColumn("lead_time_days", P.null_if("lead_time_days", F.col("lead_time_days") < 0))
    df = df.filter(F.col("no_show").isNotNull()).withColumn("no_show", F.col("no_show").cast("int"))
    df = PR.select_existing(df, BASE_COLUMNS)
    return PR.fill_unknown(df, exclude=["no_show"])


def hourly_master(notes: DataFrame, triage: DataFrame | None,
                  triage_values: Sequence[str] = tuple(P.TRIAGE_VALUES),
                  median: str = "exact") -> DataFrame:
    """One row per active arrival hour.

    Hourly demand (A1) left-joined with hourly triage counts (A2+A3 in one
    pass); hours without triage get 0 (J3/A4); calendar features (P10).
    Both sides are aggregates keyed by hour, so the join is between two
    tables whose size is the number of hours.
    """
    demand = H.hourly_demand(notes, median=median)
    if triage is not None and "triage_datetime" in triage.columns:
        tri = H.hourly_crosstab(triage, "triage_datetime", "triage_clean", triage_values)
    else:
        tri = demand.select("timestamp", F.lit(0).cast("long").alias("triage_events"))
    counts = [c for c in tri.columns if c != "timestamp"]
    master = J.left_join_fill(demand, tri, "timestamp", {c: 0 for c in counts})
    master = add_calendar_features(master, "timestamp")
    return master.orderBy("timestamp")


def encounters_with_patients(encounters: DataFrame, patients: DataFrame) -> DataFrame:
    """C11: encounters left-joined with patients on the file number."""
    return J.left_join_on(encounters, patients, "p_num_exp_key", "m_num_exp_key")


def labelled_appointments(appointments: DataFrame) -> DataFrame:
    """C11: appointments with a known label (F1)."""
    return appointments.filter(F.col("no_show").isNotNull())


def severity_demand_matrix(arrivals: DataFrame, ts: str, severity: DataFrame, sev_ts: str,
                           sev_value: str, fill_severity: float = 3.0) -> DataFrame:
    """Regular hourly arrivals (A16) with mean triage severity (A17,
    P33) joined on the hour (J4, missing -> 3) and calendar features."""
    counts = H.resample_hourly_count(arrivals, ts, out="pacientes")
    sev = severity.withColumn("__sev", P.safe_numeric(sev_value))
    means = (sev.filter(F.col(sev_ts).isNotNull())
                .groupBy(floor_hour(sev_ts).alias("timestamp"))
                .agg(F.avg("__sev").alias("triage_promedio")))
    out = J.left_join_fill(counts, means, "timestamp", {"triage_promedio": float(fill_severity)})
    return add_calendar_features(out, "timestamp")


__all__ = ["no_show_base", "hourly_master", "encounters_with_patients",
           "labelled_appointments", "severity_demand_matrix", "ts_features"]
