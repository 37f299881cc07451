"""Checked queries: hourly tables and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.checks import sqlkit as S
from careflow.checks.registry import query
from careflow.operators import hourly as H
from careflow.operators.ordering import written
from careflow.plans import cleaning as C
from careflow.plans import integration as I
from careflow.plans.roles import Inputs

# Wait proxies above 240 minutes count as invalid for the driver tables
# (the reference's bound is 1440 for real emergency notes).
MAX_WAIT = 240.0
TRI = ("A", "C", "E", "M", "N")


def notes(spark, sf):
    return C.clean_notes(Inputs(spark, sf).notes(), max_wait_min=MAX_WAIT)


def triage(spark, sf):
    return C.clean_triage(Inputs(spark, sf).triage())


BASE_CTES = ",\n".join([S.RAW_NOTES, S.clean_notes_sql(MAX_WAIT), S.RAW_TRIAGE, S.clean_triage_sql(TRI)])

DEMAND_SQL = """demand AS (
  SELECT date_trunc('hour', arrival_datetime) AS timestamp, count(*) AS pacientes_llegando,
         avg(CASE WHEN valid_wait_proxy = 1 THEN wait_proxy_min END) AS tiempo_espera,
         median(CASE WHEN valid_wait_proxy = 1 THEN wait_proxy_min END) AS tiempo_espera_mediana,
         CAST(coalesce(sum(valid_wait_proxy), 0) AS BIGINT) AS wait_proxy_valid_count
  FROM notes WHERE arrival_datetime IS NOT NULL GROUP BY 1)"""

TRI_H_SQL = """tri_h AS (
  SELECT date_trunc('hour', triage_datetime) AS timestamp, count(*) AS triage_events,
         """ + ", ".join(f"count(CASE WHEN triage_clean = '{v}' THEN 1 END) AS triage_{v}" for v in TRI) + """
  FROM tri WHERE triage_datetime IS NOT NULL GROUP BY 1)"""

CAL = ("hour(timestamp) AS hour, isodow(timestamp) - 1 AS day_of_week, day(timestamp) AS day, "
       "month(timestamp) AS month, CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend")

MASTER_CTE = f"""master AS (
SELECT d.timestamp, d.pacientes_llegando, d.tiempo_espera, d.tiempo_espera_mediana, d.wait_proxy_valid_count,
       coalesce(t.triage_events, 0) AS triage_events,
       {", ".join(f"coalesce(t.triage_{v}, 0) AS triage_{v}" for v in TRI)},
       {CAL.replace('timestamp', 'd.timestamp')}
FROM demand d LEFT JOIN tri_h t ON d.timestamp = t.timestamp)"""

MASTER_CTES = f"{BASE_CTES}, {DEMAND_SQL}, {TRI_H_SQL}, {MASTER_CTE}"
MASTER_SQL = f"WITH {MASTER_CTES} SELECT * FROM master"


def master(spark, sf):
    return I.hourly_master(notes(spark, sf), triage(spark, sf), TRI)


def hours(spark, sf, *cols):
    """The master (or some columns) as a table, for operators that scan it several times."""
    m = master(spark, sf)
    return written(m.select(*cols) if cols else m)


@query("c7_hourly_master", S.wrap(MASTER_SQL, ["tiempo_espera", "tiempo_espera_mediana"]))
def c7_hourly_master(spark, sf):
    """Hourly master from cleaned notes (events) and triage."""
    return master(spark, sf)


@query("a1_hourly_demand", S.wrap(f"WITH {BASE_CTES}, {DEMAND_SQL} SELECT * FROM demand",
                                  ["tiempo_espera", "tiempo_espera_mediana"]))
def a1_hourly_demand(spark, sf):
    """A1: arrivals, mean and exact median of valid waits per hour."""
    return H.hourly_demand(notes(spark, sf))


@query("a2_hourly_events", f"""WITH {BASE_CTES}
SELECT date_trunc('hour', triage_datetime) AS timestamp, count(*) AS triage_events
FROM tri WHERE triage_datetime IS NOT NULL GROUP BY 1""")
def a2_hourly_events(spark, sf):
    """A2: triage events per hour."""
    return H.hourly_events(triage(spark, sf), "triage_datetime")


@query("a3_crosstab", f"WITH {BASE_CTES}, {TRI_H_SQL} SELECT * FROM tri_h")
def a3_crosstab(spark, sf):
    """A3: hour x triage category counts with a fixed category list."""
    return H.hourly_crosstab(triage(spark, sf), "triage_datetime", "triage_clean", TRI)


@query("j3_hourly_join_fill", f"""WITH {BASE_CTES}, {DEMAND_SQL}, {TRI_H_SQL}
SELECT d.timestamp, d.pacientes_llegando, coalesce(t.triage_events, 0) AS triage_events
FROM demand d LEFT JOIN tri_h t ON d.timestamp = t.timestamp""")
def j3_hourly_join_fill(spark, sf):
    """Hourly demand left-joined to hourly triage, gaps -> 0."""
    from careflow.operators.joins import left_join_fill
    d = H.hourly_demand(notes(spark, sf), median="buffer").select("timestamp", "pacientes_llegando")
    t = H.hourly_events(triage(spark, sf), "triage_datetime")
    return left_join_fill(d, t, "timestamp", {"triage_events": 0})


@query("a13_hourly_distinct", f"""WITH {BASE_CTES}
SELECT date_trunc('hour', arrival_datetime) AS timestamp, count(*) AS n_rows,
       count(DISTINCT expediente_key) AS n_unique
FROM notes WHERE arrival_datetime IS NOT NULL GROUP BY 1""")
def a13_hourly_distinct(spark, sf):
    """Distinct admission keys per hour."""
    return H.hourly_distinct(notes(spark, sf), "arrival_datetime", "expediente_key")


SPINE_SQL = """spine AS (
  SELECT unnest(generate_series(min(date_trunc('hour', {ts})), max(date_trunc('hour', {ts})), INTERVAL 1 HOUR)) AS timestamp
  FROM {src} WHERE {ts} IS NOT NULL)"""


@query("a16_resample_count", f"""WITH {BASE_CTES}, {SPINE_SQL.format(ts='arrival_datetime', src='notes')},
c AS (SELECT date_trunc('hour', arrival_datetime) AS timestamp, count(*) AS n FROM notes
      WHERE arrival_datetime IS NOT NULL GROUP BY 1)
SELECT s.timestamp, coalesce(c.n, 0) AS count FROM spine s LEFT JOIN c ON s.timestamp = c.timestamp""")
def a16_resample_count(spark, sf):
    """Arrivals per hour on a regular hourly spine (gaps = 0)."""
    return H.resample_hourly_count(notes(spark, sf), "arrival_datetime")


@query("a17_resample_mean", S.wrap(f"""WITH {BASE_CTES}, {SPINE_SQL.format(ts='arrival_datetime', src='notes')},
c AS (SELECT date_trunc('hour', arrival_datetime) AS timestamp,
             avg(CASE WHEN valid_wait_proxy = 1 THEN wait_proxy_min END) AS m
      FROM notes WHERE arrival_datetime IS NOT NULL GROUP BY 1)
SELECT s.timestamp, coalesce(c.m, 3.0) AS mean FROM spine s LEFT JOIN c ON s.timestamp = c.timestamp""", ["mean"]))
def a17_resample_mean(spark, sf):
    """Mean valid wait per hour on a regular spine, gaps = 3."""
    n = notes(spark, sf).withColumn("w", F.when(F.col("valid_wait_proxy") == 1, F.col("wait_proxy_min")))
    return H.resample_hourly_mean(n, "arrival_datetime", "w", fill=3.0)


@query("a4_no_triage_fallback", S.wrap(f"""WITH {BASE_CTES}, {DEMAND_SQL}
SELECT timestamp, pacientes_llegando, tiempo_espera, tiempo_espera_mediana, wait_proxy_valid_count,
       CAST(0 AS BIGINT) AS triage_events, {CAL} FROM demand""", ["tiempo_espera", "tiempo_espera_mediana"]))
def a4_no_triage_fallback(spark, sf):
    """A4: without a triage table the master still has triage_events = 0."""
    return I.hourly_master(notes(spark, sf), None)
