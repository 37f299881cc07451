"""Checked queries: time-series windows over the hourly master."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.checks import sqlkit as S
from careflow.checks.q_agg import MASTER_CTES, hours, notes
from careflow.checks.registry import query
from careflow.operators import timeseries as TS
from careflow.plans import integration as I
from careflow.plans.roles import Inputs

Y = "pacientes_llegando"
LAGS = TS.DEFAULT_LAGS
WINS = TS.DEFAULT_WINDOWS
W = "OVER (ORDER BY timestamp)"


def _frame(k: int) -> str:
    return f"OVER (ORDER BY timestamp ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


LAG_SQL = ", ".join(f"lag({Y}, {k}) {W} AS lag_{k}h" for k in LAGS)
ROLL_MEAN_SQL = ", ".join(f"avg({Y}) {_frame(k)} AS roll_mean_{k}h" for k in WINS)
ROLL_STD_SQL = ", ".join(f"coalesce(stddev_samp({Y}) {_frame(k)}, 0) AS roll_std_{k}h" for k in WINS)
ROLL_COLS = [f"roll_mean_{k}h" for k in WINS] + [f"roll_std_{k}h" for k in WINS]


@query("w1_lags", f"WITH {MASTER_CTES} SELECT timestamp, {Y}, {LAG_SQL} FROM master")
def w1_lags(spark, sf):
    """Arrivals 1, 2, 3, 6, 12, 24 rows back (halo-block windows)."""
    m = hours(spark, sf, "timestamp", Y)
    return TS.add_lags(m, Y, LAGS, ["timestamp"])


@query("w2_w3_rolling", S.wrap(f"WITH {MASTER_CTES} SELECT timestamp, {Y}, {ROLL_MEAN_SQL}, {ROLL_STD_SQL} FROM master",
                               ROLL_COLS))
def w2_w3_rolling(spark, sf):
    """Rolling mean and sample std over the previous k rows."""
    m = hours(spark, sf, "timestamp", Y)
    return TS.add_rolling(m, Y, WINS, ["timestamp"])


@query("w4_diffs", f"""WITH {MASTER_CTES} SELECT timestamp, {Y},
  lag({Y}, 1) {W} - lag({Y}, 2) {W} AS diff_1h, lag({Y}, 1) {W} - lag({Y}, 25) {W} AS diff_24h FROM master""")
def w4_diffs(spark, sf):
    """Leak-free differences (previous row minus the row before it / 25 back)."""
    return TS.add_diffs(hours(spark, sf, "timestamp", Y), Y, ["timestamp"])


@query("w4_diffs_leaky", S.wrap(f"""WITH {MASTER_CTES} SELECT timestamp, {Y},
  CAST({Y} AS DOUBLE) - lag({Y}, 1) {W} AS diff_1h, CAST({Y} AS DOUBLE) - lag({Y}, 24) {W} AS diff_24h FROM master""",
                                ["diff_1h", "diff_24h"]))
def w4_diffs_leaky(spark, sf):
    """W4 (reference form): value minus lag 1 / lag 24."""
    return TS.add_diffs(hours(spark, sf, "timestamp", Y), Y, ["timestamp"], leaky=True)


@query("w5_lag_wait", S.wrap(f"""WITH {MASTER_CTES} SELECT timestamp, tiempo_espera,
  lag(tiempo_espera, 1) {W} AS lag_wait_1h, lag(tiempo_espera, 24) {W} AS lag_wait_24h FROM master""",
                             ["tiempo_espera", "lag_wait_1h", "lag_wait_24h"]))
def w5_lag_wait(spark, sf):
    """Lagged mean wait."""
    m = hours(spark, sf, "timestamp", "tiempo_espera")
    return TS.add_lags(m, "tiempo_espera", [1, 24], ["timestamp"], name="lag_wait_{k}h")


TRI_COLS = ["triage_events", "triage_A", "triage_C", "triage_E", "triage_M", "triage_N"]
CYC = ("sin(2 * pi() * hour(timestamp) / 24.0) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24.0) AS hour_cos, "
       "sin(2 * pi() * day_of_week / 7.0) AS dow_sin, cos(2 * pi() * day_of_week / 7.0) AS dow_cos, "
       "sin(2 * pi() * month / 12.0) AS month_sin, cos(2 * pi() * month / 12.0) AS month_cos")
FEATURES = TS.feature_columns(["timestamp", Y] + TRI_COLS)
FEAT_DOUBLES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
                "lag_wait_1h", "lag_wait_24h"] + ROLL_COLS

FEATURES_SQL = f"""WITH {MASTER_CTES},
f AS (SELECT timestamp, {Y}, hour(timestamp) AS hour_of_day, day_of_week, month, is_weekend,
             weekofyear(timestamp) AS week_of_year, {CYC}, {LAG_SQL}, {ROLL_MEAN_SQL}, {ROLL_STD_SQL},
             lag({Y}, 1) {W} - lag({Y}, 2) {W} AS diff_1h, lag({Y}, 1) {W} - lag({Y}, 25) {W} AS diff_24h,
             {", ".join(TRI_COLS)},
             lag(tiempo_espera, 1) {W} AS lag_wait_1h, lag(tiempo_espera, 24) {W} AS lag_wait_24h
      FROM master)
SELECT * FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in FEATURES)}"""


@query("c9_demand_features", S.wrap(FEATURES_SQL, FEAT_DOUBLES))
def c9_demand_features(spark, sf):
    """Full demand feature table (lags, rolling, diffs, cyclical,
    triage counts, lagged wait), incomplete rows dropped."""
    return TS.ts_features(hours(spark, sf))


@query("w7_running_best", f"""WITH {MASTER_CTES} SELECT timestamp, {Y},
  max({Y}) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far,
  CASE WHEN max({Y}) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL
         OR {Y} > max({Y}) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
       THEN 1 ELSE 0 END AS is_best FROM master""")
def w7_running_best(spark, sf):
    """Running maximum and new-best flag in time order."""
    return TS.running_max(hours(spark, sf, "timestamp", Y), Y, ["timestamp"])


@query("w8_sequences", f"""WITH {MASTER_CTES},
s AS (SELECT timestamp, list({Y}) OVER (ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS x,
             {Y} AS y FROM master)
SELECT timestamp, array_to_string(x, ',') AS x_seq, CAST(y AS VARCHAR) AS y_seq FROM s WHERE len(x) = 6""")
def w8_sequences(spark, sf):
    """Previous 6 hourly counts as a sequence, current count as label."""
    s = TS.sequences(hours(spark, sf, "timestamp", Y), Y, ["timestamp"], 6, 1)
    return s.select("timestamp", F.array_join(F.transform("x_seq", lambda v: v.cast("string")), ",").alias("x_seq"),
                    F.array_join(F.transform("y_seq", lambda v: v.cast("string")), ",").alias("y_seq"))


@query("w8_forecast_windows", f"""WITH {MASTER_CTES},
s AS (SELECT timestamp, list({Y}) OVER (ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS x,
             list({Y}) OVER (ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS y FROM master)
SELECT timestamp, array_to_string(x, ',') AS x_seq, array_to_string(y, ',') AS y_seq FROM s
WHERE len(x) = 24 AND len(y) = 6""")
def w8_forecast_windows(spark, sf):
    """24 hours back as input, the next 6 (current first) as target."""
    s = TS.sequences(hours(spark, sf, "timestamp", Y), Y, ["timestamp"], 24, 6)
    return s.select("timestamp", F.array_join(F.transform("x_seq", lambda v: v.cast("string")), ",").alias("x_seq"),
                    F.array_join(F.transform("y_seq", lambda v: v.cast("string")), ",").alias("y_seq"))


@query("w9_time_index", f"""WITH {MASTER_CTES} SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS time_idx,
  '0' AS group_id FROM master""")
def w9_time_index(spark, sf):
    """Continuous time index and constant group id."""
    return TS.time_index(hours(spark, sf, "timestamp"), ["timestamp"])


SEASONAL_SQL = f"""WITH {MASTER_CTES},
t AS (SELECT timestamp, {Y}, row_number() OVER (ORDER BY timestamp) - 1 AS pos,
        CASE WHEN count({Y}) OVER (ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25
             THEN (sum(CAST({Y} AS DOUBLE)) OVER (ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)
                   - 0.5 * (lag({Y}, 12) {W} + lead({Y}, 12) {W})) / 24.0 END AS trend FROM master),
ph AS (SELECT pos % 24 AS phase, avg({Y} - trend) AS pm FROM t GROUP BY 1),
c AS (SELECT avg(pm) AS pc FROM ph)
SELECT timestamp, {Y}, trend, CAST(t.pos % 24 AS INTEGER) AS phase, pm - pc AS seasonal, {Y} - trend - (pm - pc) AS resid
FROM t JOIN ph ON t.pos % 24 = ph.phase CROSS JOIN c"""


@query("w10_seasonal_decompose", S.wrap(SEASONAL_SQL, ["trend", "seasonal", "resid"]))
def w10_seasonal_decompose(spark, sf):
    """Additive decomposition, period 24 (centred 2x24 trend)."""
    d = TS.seasonal_decompose(hours(spark, sf, "timestamp", Y), Y, ["timestamp"], 24)
    return d.select("timestamp", Y, "trend", "phase", "seasonal", "resid")


def _severity_triage(spark, sf):
    """Triage rows whose severity text is derived from the event value."""
    e = Inputs(spark, sf).t("events")
    sev = F.least(F.lit(5), F.lit(1) + F.floor(F.col("value") / 50)).cast("string")
    return e.select(F.col("ts").alias("triage_ts"), sev.alias("nivel"))


@query("c12_severity_matrix", S.wrap(f"""WITH {MASTER_CTES},
spine AS (SELECT unnest(generate_series(min(date_trunc('hour', arrival_datetime)), max(date_trunc('hour', arrival_datetime)),
          INTERVAL 1 HOUR)) AS timestamp FROM notes WHERE arrival_datetime IS NOT NULL),
c AS (SELECT date_trunc('hour', arrival_datetime) AS timestamp, count(*) AS n FROM notes
      WHERE arrival_datetime IS NOT NULL GROUP BY 1),
sv AS (SELECT date_trunc('hour', ts) AS timestamp, avg({S.numeric("CAST(least(5, 1 + floor(value / 50)) AS VARCHAR)")}) AS sev
       FROM events GROUP BY 1)
SELECT s.timestamp, coalesce(c.n, 0) AS pacientes, coalesce(sv.sev, 3.0) AS triage_promedio,
       {S.cal('s.timestamp')}
FROM spine s LEFT JOIN c ON s.timestamp = c.timestamp LEFT JOIN sv ON s.timestamp = sv.timestamp""", ["triage_promedio"]))
def c12_severity_matrix(spark, sf):
    """Regular hourly arrivals with mean triage severity (gaps -> 3)."""
    return I.severity_demand_matrix(notes(spark, sf), "arrival_datetime", _severity_triage(spark, sf),
                                    "triage_ts", "nivel")
