"""DuckDB SQL fragments for the second-engine checks.

The oracle queries restate each operator's rule in plain SQL so that a
different engine confirms the Spark result. Helpers here build the SQL
text of the shared rules (cleaning, parsing) and the raw stand-ins of
:mod:`careflow.plans.roles`.
"""

from __future__ import annotations

# Unicode whitespace (Python str.strip / Java (?U)\s).
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim_u(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip(x: str) -> str:
    inner = f"regexp_replace({x}, '[\\x00-\\x1F\\x7F]', '', 'g')"
    return f"nullif({trim_u(inner)}, '')"


def norm(x: str) -> str:
    return f"upper({strip(x)})"


def digits(x: str) -> str:
    return (f"regexp_replace(regexp_replace(nullif({trim_u(x)}, ''), '\\.0$', ''), "
            f"'\\D', '', 'g')")


def p4(x: str) -> str:
    s = digits(x)
    return (f"(CASE WHEN {s} IS NULL THEN NULL WHEN length({s}) = 6 THEN {s} "
            f"WHEN length({s}) = 5 THEN '0' || {s} WHEN length({s}) = 4 THEN {s} || '00' "
            f"WHEN length({s}) = 3 THEN '0' || {s} || '00' WHEN length({s}) = 2 THEN {s} || '0000' "
            f"WHEN length({s}) = 1 THEN '0' || {s} || '0000' WHEN length({s}) = 0 THEN '000000' "
            f"ELSE right({s}, 6) END)")


def ts14(raw: str) -> str:
    t = (f"(CASE WHEN regexp_full_match({raw}, '\\d{{14}}') AND TRY_CAST(substr({raw}, 13, 2) AS INTEGER) < 60 "
         f"THEN try_strptime({raw}, '%Y%m%d%H%M%S') END)")
    return (f"(CASE WHEN {t} BETWEEN TIMESTAMP '1677-09-21 00:12:44' AND TIMESTAMP '2262-04-11 23:47:16' "
            f"THEN {t} END)")


def p5(d: str, t: str) -> str:
    return ts14(f"({digits(d)} || {p4(t)})")


def minutes(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 60000000.0)"


def days(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 86400000000.0)"


def numeric(x: str) -> str:
    s = trim_u(f"CAST({x} AS VARCHAR)")
    return (f"(CASE WHEN regexp_full_match({s}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
            f"THEN TRY_CAST({s} AS DOUBLE) END)")


def R(x: str) -> str:
    """Round to 6 decimals the same way on both engines."""
    return f"(round(({x}) * 1e6) / 1e6 + 0.0)"


def wrap(sql: str, doubles=()) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"{R(c)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"


def note_ts() -> str:
    return "(ts + to_seconds(CAST(floor(value * 60) AS BIGINT)))"


RAW_NOTES = f"""raw_notes AS (
  SELECT ' ' || CAST(user_id AS VARCHAR) || ' ' AS Expediente,
         CAST(event_id AS VARCHAR) AS ClaveIngreso,
         strftime(ts, '%Y%m%d') AS Llegada_Fecha, strftime(ts, '%H%M') AS Llegada_Hora,
         strftime({note_ts()}, '%Y%m%d') AS Fecha, strftime({note_ts()}, '%H%M%S') AS Hora,
         lower(event_type) AS Especialidad, upper(substr(event_type, 1, 1)) AS Triage
  FROM events)"""

RAW_TRIAGE = f"""raw_triage AS (
  SELECT CAST(user_id AS VARCHAR) AS Expediente, CAST(event_id AS VARCHAR) AS ClaveIngreso,
         strftime({note_ts()}, '%Y%m%d') AS Fecha, strftime({note_ts()}, '%H%M%S') AS Hora,
         lower(substr(event_type, 1, 1)) || ' ' AS Triage
  FROM events)"""

RAW_APPOINTMENTS = """raw_appointments AS (
  SELECT CAST(o_orderkey % 10 AS VARCHAR) AS area, CAST(o_orderkey AS VARCHAR) AS cve_num,
         CAST(o_orderkey % 7 AS VARCHAR) AS cve_mbo, CAST(o_custkey AS VARCHAR) AS med,
         ' ' || lower(o_orderpriority) || ' ' AS esp,
         CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 's' END AS tpo_cita,
         CASE WHEN o_totalprice > 400000 THEN 'C' END AS conflicto,
         CASE WHEN o_orderkey % 3 = 0 THEN 'A' END AS agregada,
         CASE WHEN o_orderkey % 11 = 0 THEN 'U' END AS ultimahora,
         CAST(o_orderkey % 4 AS VARCHAR) AS buffer,
         strftime(o_orderdate, '%Y%m%d') AS a_fecha,
         CAST(800 + (o_orderkey % 10) * 100 AS VARCHAR) AS hra_ini,
         CAST(830 + (o_orderkey % 10) * 100 AS VARCHAR) AS hra_fin,
         CAST((o_orderkey % 7) * 15 AS VARCHAR) AS dur,
         CASE WHEN o_orderstatus = 'F' THEN 'a' WHEN o_orderstatus = 'P' THEN 'I' ELSE 'o' END AS asistencia
  FROM orders)"""

RAW_ENCOUNTERS = """raw_encounters AS (
  SELECT CAST(l_orderkey % 10 AS VARCHAR) AS p_area, CAST(l_orderkey AS VARCHAR) AS p_res_cve_num,
         CAST(l_orderkey % 7 AS VARCHAR) AS p_res_cve_mbo, CAST(l_partkey AS VARCHAR) AS p_num_exp,
         lower(l_linestatus) AS p_status,
         CASE WHEN l_returnflag = 'A' THEN 'f' WHEN l_returnflag = 'N' THEN 'm' END AS p_sexo,
         strftime(l_shipdate, '%Y%m%d') AS p_res_fec, '0800' AS p_res_hra,
         strftime(l_shipdate, '%Y%m%d') AS p_fec_reg, CAST(l_linenumber * 100 AS VARCHAR) AS p_hra_reg
  FROM lineitem)"""

RAW_PATIENTS = """raw_patients AS (
  SELECT CAST(c_custkey AS VARCHAR) || ' ' AS m_num_exp,
         CASE WHEN c_acctbal < 0 THEN 'b' ELSE 'a' END AS m_status,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS m_sexo,
         CASE WHEN c_custkey % 5 = 0 THEN CAST(c_nationkey * 5 AS VARCHAR) || 'A'
              ELSE CAST(c_nationkey * 6 AS VARCHAR) END AS m_edad,
         strftime(DATE '1940-01-01' + CAST((c_custkey * 37) % 25000 AS INTEGER), '%Y%m%d') AS m_fec_nac,
         lower(c_mktsegment) AS m_ciu, CAST(c_custkey % 50 AS VARCHAR) AS m_col,
         lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') AS m_cp,
         CAST(c_nationkey AS VARCHAR) AS m_edo,
         CASE WHEN c_nationkey = 0 THEN 'n/a' ELSE 'MX' END AS m_pai
  FROM customer)"""


def clean_notes_sql(max_wait: float) -> str:
    arr = p5("Llegada_Fecha", "Llegada_Hora")
    note = p5("Fecha", "Hora")
    return f"""notes AS (
  SELECT DISTINCT * FROM (
    SELECT {trim_u(strip('Expediente'))} AS expediente_key, {trim_u(strip('ClaveIngreso'))} AS clave_ingreso_key,
           {arr} AS arrival_datetime, {note} AS note_datetime,
           CAST(NULL AS TIMESTAMP) AS destination_datetime,
           {minutes(arr, note)} AS wait_proxy_min,
           CASE WHEN {minutes(arr, note)} BETWEEN 0 AND {float(max_wait)} THEN 1 ELSE 0 END AS valid_wait_proxy,
           {norm('Especialidad')} AS Especialidad, {norm('Triage')} AS Triage
    FROM raw_notes))"""


def clean_triage_sql(allowed=("A", "C", "E", "M", "N")) -> str:
    t = f"nullif(upper({trim_u(norm('Triage'))}), '')"
    lst = ", ".join(f"'{v}'" for v in allowed)
    return f"""tri AS (
  SELECT DISTINCT * FROM (
    SELECT {trim_u(strip('Expediente'))} AS expediente_key, {trim_u(strip('ClaveIngreso'))} AS clave_ingreso_key,
           {p5('Fecha', 'Hora')} AS triage_datetime,
           CASE WHEN {t} IN ({lst}) THEN {t} END AS triage_clean,
           CASE WHEN {t} IS NOT NULL AND {t} NOT IN ({lst}) THEN 1 ELSE 0 END AS triage_invalid
    FROM raw_triage))"""


def cal(ts: str, prefix: str = "") -> str:
    p = f"{prefix}_" if prefix else ""
    return (f"hour({ts}) AS {p}hour, isodow({ts}) - 1 AS {p}day_of_week, day({ts}) AS {p}day, "
            f"month({ts}) AS {p}month, CASE WHEN isodow({ts}) >= 6 THEN 1 ELSE 0 END AS {p}is_weekend")


def key(x: str) -> str:
    return trim_u(x)


CLEAN_APPOINTMENTS = f"""appt AS (
  SELECT DISTINCT * FROM (
    SELECT {key(norm('area'))} AS area_key, {key(norm('cve_num'))} AS cve_num_key, {key(norm('cve_mbo'))} AS cve_mbo_key,
           {norm('area')} AS area, {norm('cve_num')} AS cve_num, {norm('cve_mbo')} AS cve_mbo,
           {norm('med')} AS med, {norm('esp')} AS esp, {strip('a_fecha')} AS a_fecha,
           {strip('hra_ini')} AS hra_ini, {strip('hra_fin')} AS hra_fin,
           appointment_datetime, {cal('appointment_datetime', 'appointment')},
           CASE WHEN {numeric(strip('dur'))} <= 0 THEN NULL ELSE {numeric(strip('dur'))} END AS duration_min,
           {norm('tpo_cita')} AS tpo_cita, {norm('conflicto')} AS conflicto, {norm('agregada')} AS agregada,
           {norm('ultimahora')} AS ultimahora, {norm('buffer')} AS buffer,
           CASE WHEN {norm('asistencia')} IN ('A', 'I') THEN {norm('asistencia')} END AS asistencia_clean,
           CASE WHEN {norm('asistencia')} IS NOT NULL AND {norm('asistencia')} NOT IN ('A', 'I') THEN 1 ELSE 0 END AS asistencia_invalid,
           CASE WHEN {norm('asistencia')} = 'A' THEN 0 WHEN {norm('asistencia')} = 'I' THEN 1 END AS no_show
    FROM (SELECT *, {p5(strip('a_fecha'), strip('hra_ini'))} AS appointment_datetime FROM raw_appointments)))"""

CLEAN_ENCOUNTERS = f"""enc AS (
  SELECT DISTINCT * FROM (
    SELECT {key(norm('p_area'))} AS area_key, {key(norm('p_res_cve_num'))} AS cve_num_key,
           {key(norm('p_res_cve_mbo'))} AS cve_mbo_key, {key(strip('p_num_exp'))} AS p_num_exp_key,
           {norm('p_area')} AS p_area, {norm('p_status')} AS p_status, {norm('p_sexo')} AS p_sexo,
           {p5(strip('p_res_fec'), strip('p_res_hra'))} AS reservation_datetime,
           CAST(NULL AS TIMESTAMP) AS arrival_datetime,
           {p5(strip('p_fec_reg'), strip('p_hra_reg'))} AS registration_datetime
    FROM raw_encounters))"""


def _null_codes(col: str, vals) -> str:
    lst = ", ".join(f"'{v}'" for v in vals)
    return f"CASE WHEN upper({trim_u(norm(col))}) IN ({lst}) THEN NULL ELSE upper({trim_u(norm(col))}) END"


_AGE = numeric(strip("m_edad"))
_BIRTH = strip("m_fec_nac")
PATIENT_FIELDS = f"""{key(strip('m_num_exp'))} AS m_num_exp_key, {norm('m_status')} AS m_status,
           {norm('m_sexo')} AS m_sexo,
           CASE WHEN {_AGE} < 0 OR {_AGE} > 120 THEN NULL ELSE {_AGE} END AS m_edad_num,
           CAST(CAST({ts14(f"(CASE WHEN regexp_full_match({trim_u(_BIRTH)}, '\\d{{8}}') THEN {trim_u(_BIRTH)} END || '000000')")} AS DATE) AS TIMESTAMP) AS m_fec_nac_clean,
           {norm('m_ciu')} AS m_ciu, {norm('m_col')} AS m_col,
           {_null_codes('m_cp', ['000', '00000', 'NA', 'N/A', 'NULL', 'NONE'])} AS m_cp,
           {_null_codes('m_edo', ['NA', 'N/A', 'NULL', 'NONE'])} AS m_edo,
           {_null_codes('m_pai', ['NA', 'N/A', 'NULL', 'NONE'])} AS m_pai"""

PATIENT_COLS = ["m_status", "m_sexo", "m_edad_num", "m_fec_nac_clean", "m_ciu", "m_col", "m_cp", "m_edo", "m_pai"]

CLEAN_PATIENTS = f"""pat AS (
  SELECT m_num_exp_key, {", ".join(PATIENT_COLS)} FROM (
    SELECT *, row_number() OVER (PARTITION BY m_num_exp_key ORDER BY
           {", ".join(c + " ASC NULLS LAST" for c in PATIENT_COLS)}) AS rn
    FROM (SELECT {PATIENT_FIELDS} FROM raw_patients)) WHERE rn = 1)"""

ENC_TIES = ["p_num_exp_key", "p_area", "p_status", "p_sexo", "reservation_datetime", "arrival_datetime"]

ENC_FIRST = f"""enc1 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY area_key, cve_num_key, cve_mbo_key
           ORDER BY registration_datetime ASC NULLS LAST, {", ".join(c + " ASC NULLS LAST" for c in ENC_TIES)}) AS rn
    FROM enc) WHERE rn = 1)"""

BASE_STRING = ["area", "med", "esp", "tpo_cita", "conflicto", "agregada", "ultimahora", "buffer",
               "p_status", "p_sexo", "m_status", "m_sexo", "m_ciu", "m_col", "m_cp", "m_edo", "m_pai"]

NO_SHOW_BASE = f"""{CLEAN_APPOINTMENTS}, {CLEAN_ENCOUNTERS}, {CLEAN_PATIENTS}, {ENC_FIRST},
j AS (
  SELECT a.*, e.p_num_exp_key, e.p_area, e.p_status, e.p_sexo, e.reservation_datetime, e.registration_datetime,
         p.m_num_exp_key, p.m_status, p.m_sexo, p.m_edad_num, p.m_fec_nac_clean, p.m_ciu, p.m_col, p.m_cp, p.m_edo, p.m_pai,
         {days('e.reservation_datetime', 'a.appointment_datetime')} AS lt
  FROM appt a
  LEFT JOIN enc1 e ON a.area_key IS NOT DISTINCT FROM e.area_key AND a.cve_num_key IS NOT DISTINCT FROM e.cve_num_key
                  AND a.cve_mbo_key IS NOT DISTINCT FROM e.cve_mbo_key
  LEFT JOIN pat p ON e.p_num_exp_key IS NOT DISTINCT FROM p.m_num_exp_key),
base AS (
  SELECT {", ".join(f"coalesce({c}, 'UNKNOWN') AS {c}" for c in BASE_STRING[:8])},
         duration_min, appointment_hour, appointment_day_of_week, appointment_day, appointment_month,
         appointment_is_weekend,
         CASE WHEN lt < 0 THEN NULL ELSE lt END AS lead_time_days,
         CASE WHEN lt < 0 THEN 1 ELSE 0 END AS lead_time_invalid,
         {", ".join(f"coalesce({c}, 'UNKNOWN') AS {c}" for c in BASE_STRING[8:12])}, m_edad_num,
         {", ".join(f"coalesce({c}, 'UNKNOWN') AS {c}" for c in BASE_STRING[12:])},
         CAST(no_show AS INTEGER) AS no_show
  FROM j WHERE no_show IS NOT NULL)"""
