"""Checked queries: KPIs, filters, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.checks import sqlkit as S
from careflow.checks.q_agg import MASTER_CTES, hours, master
from careflow.checks.q_clean import RAW, base
from careflow.checks.registry import query
from careflow.operators import filters as FL
from careflow.operators import kpi as K
from careflow.operators import ranking as RK
from careflow.operators.joins import left_join_fill
from careflow.operators.ordering import attach_scalars, written
from careflow.plans.roles import Inputs

BASE = f"{RAW}, {S.NO_SHOW_BASE}"
BOTH = f"{RAW}, {S.NO_SHOW_BASE}, {MASTER_CTES}"
PROB_SQL = "(CAST((TRY_CAST(med AS BIGINT) * 7919) % 1000 AS DOUBLE) / 1000.0)"


def scored(spark, sf):
    """The base with a deterministic score per appointment (from the
    doctor code), standing in for model probabilities."""
    b = base(spark, sf)
    return b.withColumn("prob", ((F.col("med").try_cast("bigint") * 7919) % 1000).cast("double") / 1000.0)


@query("a5_overall_rate", S.wrap(f"""WITH {BASE} SELECT round_even(avg(no_show) * 100.0, 2) AS overall_rate,
  count(*) AS total, CAST(coalesce(sum(no_show), 0) AS BIGINT) AS positives FROM base""", ["overall_rate"]))
def a5_overall_rate(spark, sf):
    """A5: overall no-show rate %, totals."""
    return K.overall_rate(base(spark, sf))


DIMS = ["area", "appointment_month", "appointment_day_of_week", "esp"]


@query("a6_rate_by_dimension", S.wrap(f"WITH {BASE} " + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS key, avg(no_show) * 100.0 AS rate, count(*) AS n "
    f"FROM base WHERE {d} IS NOT NULL GROUP BY {d}" for d in DIMS), ["rate"]))
def a6_rate_by_dimension(spark, sf):
    """Rate by area, month, weekday and specialty in one grouping-sets pass."""
    return K.rate_by(base(spark, sf), DIMS)


@query("a7_utilization", S.wrap(f"""WITH {BASE} SELECT 100.0 * (1 - avg(no_show)) AS utilization,
  count(*) AS total_slots, count(*) - CAST(sum(no_show) AS BIGINT) AS attended FROM base""", ["utilization"]))
def a7_utilization(spark, sf):
    """Overall utilisation."""
    return K.utilization(base(spark, sf))


@query("a7_utilization_by_area", S.wrap(f"""WITH {BASE} SELECT area, 100.0 * (1 - avg(no_show)) AS utilization,
  count(*) AS total_slots, count(*) - CAST(sum(no_show) AS BIGINT) AS attended FROM base GROUP BY area""",
                                        ["utilization"]))
def a7_utilization_by_area(spark, sf):
    """Utilisation per area."""
    return K.utilization(base(spark, sf), by="area")


@query("a8_wait_estimate", S.wrap(f"WITH {MASTER_CTES} SELECT avg(tiempo_espera) AS avg_minutes FROM master",
                                  ["avg_minutes"]))
def a8_wait_estimate(spark, sf):
    """Mean hourly wait."""
    return K.wait_estimate(master(spark, sf))


@query("a8_wait_by_hour", S.wrap(f"""WITH {MASTER_CTES} SELECT hour, avg(tiempo_espera) AS avg_minutes
  FROM master GROUP BY hour""", ["avg_minutes"]))
def a8_wait_by_hour(spark, sf):
    """Mean wait by hour of day (the master's own hour column)."""
    return K.wait_by_hour(master(spark, sf))


@query("a8_wait_from_demand", S.wrap(f"""WITH {MASTER_CTES}
  SELECT greatest(10.0, avg(pacientes_llegando) * 5.0) AS avg_minutes FROM master""", ["avg_minutes"]))
def a8_wait_from_demand(spark, sf):
    """A8 fallback: no wait column -> max(10, mean demand x 5)."""
    return K.wait_estimate(master(spark, sf).drop("tiempo_espera"))


@query("a9_mean_by_weekday", S.wrap(f"""WITH {MASTER_CTES} SELECT day_of_week,
  avg(pacientes_llegando) AS mean_pacientes_llegando FROM master GROUP BY day_of_week""",
                                    ["mean_pacientes_llegando"]))
def a9_mean_by_weekday(spark, sf):
    """Mean arrivals by weekday."""
    return K.mean_by(master(spark, sf), "day_of_week", "pacientes_llegando")


@query("a10_pivot_weekday_hour", S.wrap(f"""WITH {MASTER_CTES} SELECT day_of_week, """ + ", ".join(
    f'avg(CASE WHEN hour = {h} THEN pacientes_llegando END) AS "{h}"' for h in range(24)) +
    " FROM master GROUP BY day_of_week", [f'"{h}"' for h in range(24)]))
def a10_pivot_weekday_hour(spark, sf):
    """A10: weekday x hour pivot of mean arrivals."""
    return K.pivot_mean(master(spark, sf), "day_of_week", "hour", "pacientes_llegando")


@query("a21_class_weights", S.wrap(f"""WITH {BASE}, c AS (SELECT no_show, count(*) AS count FROM base GROUP BY 1),
t AS (SELECT sum(count) AS n, count(*) AS k, sum(CASE WHEN no_show = 0 THEN count END) AS neg,
             sum(CASE WHEN no_show = 1 THEN count END) AS pos FROM c)
SELECT no_show, count, n / (k * count) AS balanced_weight, CAST(neg AS DOUBLE) / pos AS scale_pos_weight
FROM c CROSS JOIN t""", ["balanced_weight", "scale_pos_weight"]))
def a21_class_weights(spark, sf):
    """Class counts, balanced weights, negatives/positives."""
    return K.class_weights(base(spark, sf))


@query("a22_block_means", S.wrap("""SELECT CAST(floor((rn - 1) / 100) AS BIGINT) AS block, avg(l_quantity) AS mean,
  count(*) AS rows FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_shipdate) AS rn FROM lineitem)
  GROUP BY 1""", ["mean"]))
def a22_block_means(spark, sf):
    """Mean of every 100 consecutive line items (global order)."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    li = Inputs(spark, sf).t("lineitem").select(*order)
    return K.block_means(li, "l_quantity", order, 100)


RES_SQL = f"""WITH {MASTER_CTES}, r AS (SELECT hour, pacientes_llegando AS y,
  coalesce(lag(pacientes_llegando, 24) OVER (ORDER BY timestamp), pacientes_llegando) AS p FROM master)"""


def _seasonal_naive(spark, sf):
    from careflow.operators.timeseries import add_lags
    m = hours(spark, sf, "timestamp", "hour", "pacientes_llegando")
    m = add_lags(m, "pacientes_llegando", [24], ["timestamp"], name="p")
    return m.withColumn("p", F.coalesce("p", "pacientes_llegando"))


@query("a23_residual_summary", S.wrap(f"""{RES_SQL} SELECT hour, avg(y - p) AS bias, stddev_pop(y - p) AS resid_std,
  count(*) AS n FROM r GROUP BY hour""", ["bias", "resid_std"]))
def a23_residual_summary(spark, sf):
    """Residual bias and std by hour for a seasonal-naive forecast."""
    return K.residual_summary(_seasonal_naive(spark, sf), "pacientes_llegando", "p", by="hour")


KPI_SQL = f"""WITH {BOTH},
a AS (SELECT round_even(avg(no_show) * 100.0, 2) AS noshow_rate,
             round_even(100.0 * (count(*) - sum(no_show)) / count(*), 2) AS utilization_rate FROM base),
w AS (SELECT round_even(avg(tiempo_espera), 1) AS wait_minutes FROM master),
k AS (SELECT noshow_rate, wait_minutes, utilization_rate,
             greatest(0.0, 100.0 - noshow_rate * 2.0) AS noshow_score,
             greatest(0.0, 100.0 - wait_minutes / 1.2) AS wait_score, utilization_rate AS utilization_score
      FROM a CROSS JOIN w)
SELECT *, round_even(0.3 * noshow_score + 0.4 * wait_score + 0.3 * utilization_score, 1) AS satisfaction_score FROM k"""
KPI_DOUBLES = ["noshow_rate", "wait_minutes", "utilization_rate", "noshow_score", "wait_score",
               "utilization_score", "satisfaction_score"]


@query("k1_kpi_table", S.wrap(KPI_SQL, KPI_DOUBLES))
def k1_kpi_table(spark, sf):
    """K1: no-show, wait, utilisation and the satisfaction index."""
    return K.kpi_table(base(spark, sf), master(spark, sf))


@query("k2_kpi_summary", S.wrap(f"""WITH kk AS ({KPI_SQL})
SELECT 'tasa_ausentismo' AS kpi, noshow_rate AS value, '%' AS unit FROM kk UNION ALL
SELECT 'tiempo_espera', wait_minutes, 'min' FROM kk UNION ALL
SELECT 'utilizacion_consultorios', utilization_rate, '%' FROM kk UNION ALL
SELECT 'indice_satisfaccion', satisfaction_score, 'pts' FROM kk""", ["value"]))
def k2_kpi_summary(spark, sf):
    """K2: the four KPIs as rows."""
    return K.kpi_summary(K.kpi_table(base(spark, sf), master(spark, sf)))


STAFF_SQL = f"""WITH {MASTER_CTES},
a AS (SELECT hour, avg(pacientes_llegando) AS patients_arrival FROM master GROUP BY hour),
b AS (SELECT *, CAST(ceil(patients_arrival / 3.0) AS INTEGER) AS needed, CAST(ceil(patients_arrival / 3.0) AS INTEGER) - 3 AS diff FROM a)
SELECT hour, printf('%02d:00', hour) AS hour_label, patients_arrival, greatest(needed, 1) AS needed_doctors,
  3 AS current_doctors, diff,
  CASE WHEN diff >= 2 THEN 'saturated' WHEN diff > 0 THEN 'warning' WHEN diff < 0 THEN 'underutilized' ELSE 'normal' END AS status,
  CASE WHEN diff > 0 AND (hour < 9 OR hour > 17) THEN 'Activar apoyo de emergencia. Mover ' || diff || ' médicos de Consulta Externa (baja demanda) a Urgencias.'
       WHEN diff > 0 THEN 'Redistribuir personal: Trasladar ' || diff || ' médicos de Consulta Externa a Urgencias para evitar picos de espera de ' || CAST(floor(patients_arrival * 6) AS BIGINT) || ' minutos.'
       WHEN diff < 0 THEN 'Optimizar personal: Liberar ' || (-diff) || ' médicos para otras actividades o Consulta Externa.'
       ELSE '' END AS recommendation
FROM b"""


@query("k3_staffing_plan", S.wrap(STAFF_SQL, ["patients_arrival"]))
def k3_staffing_plan(spark, sf):
    """K3: staffing need, status and recommendation per hour of day."""
    return K.staffing_plan(master(spark, sf))


@query("k3_staffing_alerts", S.wrap(f"""WITH sp AS ({STAFF_SQL})
SELECT hour_label AS hour, CASE WHEN status = 'saturated' THEN 'critical' ELSE 'warning' END AS severity,
  round_even(patients_arrival, 1) AS patients_arrival, needed_doctors, current_doctors, recommendation FROM sp WHERE diff > 0""",
                                    ["patients_arrival"]))
def k3_staffing_alerts(spark, sf):
    """K3: the alert list beside the schedule."""
    return K.staffing_alerts(K.staffing_plan(master(spark, sf)))


@query("k4_staffing_summary", S.wrap(f"""WITH sp AS ({STAFF_SQL})
SELECT CAST(sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) AS BIGINT) AS total_alerts,
  CAST(sum(CASE WHEN status = 'saturated' THEN 1 ELSE 0 END) AS BIGINT) AS critical_alerts,
  max(patients_arrival) AS max_arrival, printf('%02d:00', arg_min(hour, (-patients_arrival, hour))) AS peak_hour FROM sp""",
                                 ["max_arrival"]))
def k4_staffing_summary(spark, sf):
    """K4: alerts, critical alerts, max arrivals, peak hour."""
    return K.staffing_summary(K.staffing_plan(master(spark, sf)))


SCENARIOS = [(t, o, 80.0, 50.0) for t in (0.3, 0.45, 0.6, 0.75, 0.9) for o in (0.0, 15.0, 40.0)]
SCEN_SQL = ("sc AS (SELECT CAST(a AS DOUBLE) AS threshold, CAST(b AS DOUBLE) AS overbooking_rate, "
            "CAST(c AS DOUBLE) AS consultation_cost, CAST(d AS DOUBLE) AS hourly_overtime_cost FROM (VALUES "
            + ", ".join(f"({t}, {o}, {c}, {h})" for t, o, c, h in SCENARIOS) + ") v(a, b, c, d))")

K5_SQL = f"""WITH {BOTH}, {SCEN_SQL},
scored AS (SELECT no_show, {PROB_SQL} AS prob FROM base),
b AS (SELECT count(*) AS total_appointments, avg(no_show) * 100.0 AS overall_noshow_rate FROM scored),
hh AS (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) AS overtime_hours_saved FROM master
       WHERE pacientes_llegando > (SELECT avg(pacientes_llegando) FROM master) * 1.3),
x1 AS (SELECT sc.*, (SELECT count(*) FROM scored WHERE prob >= sc.threshold) AS predicted_noshows, b.*, hh.*
       FROM sc CROSS JOIN b CROSS JOIN hh),
x2 AS (SELECT *, CAST(trunc(predicted_noshows * (overbooking_rate / 100.0)) AS BIGINT) AS overbooked_slots FROM x1),
x3 AS (SELECT *, CAST(trunc(overbooked_slots * ((100.0 - overall_noshow_rate) / 100.0)) AS BIGINT) AS recovered_appointments FROM x2),
x4 AS (SELECT *, total_appointments * (overall_noshow_rate / 100.0) * consultation_cost AS original_loss,
              recovered_appointments * consultation_cost AS recovered_revenue,
              100.0 - overall_noshow_rate AS original_utilization,
              overtime_hours_saved * hourly_overtime_cost AS overtime_savings FROM x3),
x5 AS (SELECT *, original_loss - recovered_revenue AS remaining_loss,
              least(100.0, original_utilization + recovered_appointments / total_appointments * 100.0) AS optimized_utilization,
              recovered_revenue + overtime_savings AS total_annual_benefit FROM x4)
SELECT *, least(10.0, (optimized_utilization - original_utilization) * 0.5) AS nps_points_gain FROM x5"""
K5_DOUBLES = ["threshold", "overbooking_rate", "consultation_cost", "hourly_overtime_cost", "overall_noshow_rate",
              "original_loss", "recovered_revenue", "original_utilization", "overtime_savings", "remaining_loss",
              "optimized_utilization", "total_annual_benefit", "nps_points_gain"]


@query("k5_overbooking_impact", S.wrap(K5_SQL, K5_DOUBLES))
def k5_overbooking_impact(spark, sf):
    """K5: overbooking impact for a grid of scenarios over scored appointments."""
    sc = spark.createDataFrame(SCENARIOS, "threshold double, overbooking_rate double, consultation_cost double, "
                                          "hourly_overtime_cost double")
    s = written(scored(spark, sf).select("no_show", "prob"))
    return K.overbooking_impact(s, sc, hours(spark, sf, "timestamp", "pacientes_llegando"))


@query("f4_high_demand_hours", f"""WITH {MASTER_CTES} SELECT timestamp, pacientes_llegando FROM master
  WHERE pacientes_llegando > (SELECT avg(pacientes_llegando) FROM master) * 1.3""")
def f4_high_demand_hours(spark, sf):
    """Hours above 1.3 x the mean demand."""
    return K.high_demand_hours(master(spark, sf).select("timestamp", "pacientes_llegando"))


@query("j6_attach_global", S.wrap(f"""WITH {MASTER_CTES} SELECT timestamp, pacientes_llegando,
  pacientes_llegando / (SELECT avg(pacientes_llegando) FROM master) AS demand_ratio FROM master""", ["demand_ratio"]))
def j6_attach_global(spark, sf):
    """Every hour with its demand relative to the global mean."""
    m = master(spark, sf).select("timestamp", "pacientes_llegando")
    x = attach_scalars(m, m.agg(F.avg("pacientes_llegando").alias("__m")))
    return x.select("timestamp", "pacientes_llegando", (F.col("pacientes_llegando") / F.col("__m")).alias("demand_ratio"))


@query("j4_fill_join", S.wrap(f"""WITH {MASTER_CTES},
sv AS (SELECT date_trunc('hour', ts) AS timestamp, avg(value) AS sev FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT m.timestamp, m.pacientes_llegando, coalesce(sv.sev, 3.0) AS sev FROM master m LEFT JOIN sv ON m.timestamp = sv.timestamp""",
                              ["sev"]))
def j4_fill_join(spark, sf):
    """Left join on the hour with a constant fill for gaps."""
    from careflow.functions.calendar import floor_hour
    e = Inputs(spark, sf).t("events").filter(F.col("event_type") == "error")
    sv = e.groupBy(floor_hour("ts").alias("timestamp")).agg(F.avg("value").alias("sev"))
    m = master(spark, sf).select("timestamp", "pacientes_llegando")
    return left_join_fill(m, sv, "timestamp", {"sev": 3.0})


@query("f1_non_null", f"WITH {RAW}, {S.CLEAN_ENCOUNTERS} SELECT * FROM enc WHERE p_sexo IS NOT NULL")
def f1_non_null(spark, sf):
    """rows with a non-null value."""
    from careflow.checks.q_clean import encs
    return FL.non_null(encs(spark, sf), "p_sexo")


@query("f2_date_range", """SELECT o_orderkey, o_orderdate FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-02-27 00:00:00'""")
def f2_date_range(spark, sf):
    """inclusive date range (pushed to the parquet scan)."""
    o = Inputs(spark, sf).t("orders").select("o_orderkey", "o_orderdate")
    return FL.date_range(o, "o_orderdate", "1996-01-01 00:00:00", "1997-02-27 00:00:00")


@query("f3_drop_incomplete", f"WITH {BASE} SELECT * FROM base WHERE lead_time_days IS NOT NULL AND duration_min IS NOT NULL",
)
def f3_drop_incomplete(spark, sf):
    """drop rows with nulls in the listed columns."""
    return FL.drop_incomplete(base(spark, sf), ["lead_time_days", "duration_min"])


@query("f5_head", "SELECT * FROM events ORDER BY ts, event_id LIMIT 5")
def f5_head(spark, sf):
    """first rows in time order."""
    return FL.head(Inputs(spark, sf).t("events"), 5, ["ts", "event_id"])


@query("f5_tail", "SELECT * FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)")
def f5_tail(spark, sf):
    """last rows in time order."""
    return FL.tail(Inputs(spark, sf).t("events"), 5, ["ts", "event_id"])


@query("f5_sample", None)
def f5_sample(spark, sf):
    """seeded 10% Bernoulli sample of events (the sampling operator)."""
    return FL.sample_rows(Inputs(spark, sf).t("events"), 0.1, seed=42)


@query("t1_sort", "SELECT timestamp, pacientes_llegando FROM (" + f"WITH {MASTER_CTES} SELECT * FROM master" + ")")
def t1_sort(spark, sf):
    """Hourly master sorted by time."""
    return RK.sort_by(master(spark, sf).select("timestamp", "pacientes_llegando"), "timestamp")


@query("t2_top_specialties", S.wrap(f"""WITH {BASE} SELECT esp, avg(no_show) * 100.0 AS rate FROM base
  WHERE esp IS NOT NULL GROUP BY esp ORDER BY rate DESC, esp LIMIT 10""", ["rate"]))
def t2_top_specialties(spark, sf):
    """Top-10 specialties by no-show rate."""
    return RK.top_groups_by_rate(base(spark, sf), "esp")


@query("t2_top_doctors", S.wrap(f"""WITH {BASE} SELECT med, avg(no_show) * 100.0 AS rate FROM base
  WHERE med IS NOT NULL GROUP BY med ORDER BY rate DESC, med LIMIT 10""", ["rate"]))
def t2_top_doctors(spark, sf):
    """Top-10 doctors by no-show rate (ties in key order)."""
    return RK.top_groups_by_rate(base(spark, sf), "med")


@query("t3_top_n_others", """WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY 1),
t AS (SELECT value FROM c ORDER BY count DESC, value NULLS FIRST LIMIT 15)
SELECT CASE WHEN t.value IS NOT NULL THEN c.value ELSE 'Otros' END AS value, t.value IS NOT NULL AS is_top,
       sum(c.count) AS count FROM c LEFT JOIN t ON c.value IS NOT DISTINCT FROM t.value GROUP BY 1, 2""")
def t3_top_n_others(spark, sf):
    """15 most frequent suppliers, the rest summed as Otros."""
    return RK.top_n_with_others(Inputs(spark, sf).t("lineitem"), "l_suppkey", 15)


@query("t4_top_n_share", S.wrap("""SELECT c_mktsegment AS value, count(*) AS count,
  count(*) * 100.0 / (SELECT count(*) FROM customer) AS pct FROM customer GROUP BY 1 ORDER BY count DESC, value LIMIT 3""",
                                ["pct"]))
def t4_top_n_share(spark, sf):
    """T4: top market segments with their share of the table."""
    return RK.top_n_share(Inputs(spark, sf).t("customer"), "c_mktsegment", 3)
