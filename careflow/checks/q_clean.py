"""Checked queries: cleaning, parsing, joins and dedup (P, D, J, C1-C6, C11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.checks import sqlkit as S
from careflow.checks.registry import query
from careflow.functions import calendar as CAL
from careflow.functions import parse as P
from careflow.functions import text as T
from careflow.operators import joins as J
from careflow.operators import projection as PR
from careflow.plans import cleaning as C
from careflow.plans import integration as I
from careflow.plans.roles import Inputs

RAW = ",\n".join([S.RAW_APPOINTMENTS, S.RAW_ENCOUNTERS, S.RAW_PATIENTS])
ENC_TIES = S.ENC_TIES


def appts(spark, sf):
    return C.clean_appointments(Inputs(spark, sf).appointments())


def encs(spark, sf):
    return C.clean_encounters(Inputs(spark, sf).encounters())


def pats(spark, sf):
    return C.clean_patients(Inputs(spark, sf).patients())


def base(spark, sf):
    return I.no_show_base(appts(spark, sf), encs(spark, sf), pats(spark, sf), ENC_TIES)


# ---------------------------------------------------------------- C1-C6, C11

@query("c1_clean_encounters", f"WITH {RAW}, {S.CLEAN_ENCOUNTERS} SELECT * FROM enc")
def c1_clean_encounters(spark, sf):
    """Encounters cleaned from lineitem-shaped raw rows."""
    return encs(spark, sf)


@query("c2_clean_appointments", S.wrap(f"WITH {RAW}, {S.CLEAN_APPOINTMENTS} SELECT * FROM appt",
                                       ["duration_min"]))
def c2_clean_appointments(spark, sf):
    """Appointments with parsed time, calendar, duration and label."""
    return appts(spark, sf)


@query("c3_clean_patients", S.wrap(f"WITH {RAW}, {S.CLEAN_PATIENTS} SELECT * FROM pat", ["m_edad_num"]))
def c3_clean_patients(spark, sf):
    """Patients with null-out codes, age rule, birth date, keep-first."""
    return pats(spark, sf)


NOTE_MAX_WAIT = 240.0  # the driver's waits (README, driver tables)


@query("c4_clean_triage", S.wrap(f"WITH {S.RAW_TRIAGE}, {S.clean_triage_sql()} SELECT * FROM tri"))
def c4_clean_triage(spark, sf):
    """C4: triage records with parsed time and a domain-checked category."""
    return C.clean_triage(Inputs(spark, sf).triage())


@query("c5_clean_notes", S.wrap(f"WITH {S.RAW_NOTES}, {S.clean_notes_sql(NOTE_MAX_WAIT)} SELECT * FROM notes",
                                ["wait_proxy_min"]))
def c5_clean_notes(spark, sf):
    """Emergency notes with parsed times and the wait proxy."""
    return C.clean_notes(Inputs(spark, sf).notes(), NOTE_MAX_WAIT)


@query("c6_no_show_base", S.wrap(f"WITH {RAW}, {S.NO_SHOW_BASE} SELECT * FROM base",
                                 ["duration_min", "lead_time_days", "m_edad_num"]))
def c6_no_show_base(spark, sf):
    """Labelled appointments joined to earliest encounter and patient."""
    return base(spark, sf)


@query("c11_encounters_with_patients", S.wrap(f"""WITH {RAW}, {S.CLEAN_ENCOUNTERS}, {S.CLEAN_PATIENTS}
SELECT e.*, p.* FROM enc e LEFT JOIN pat p ON e.p_num_exp_key IS NOT DISTINCT FROM p.m_num_exp_key""",
                                              ["m_edad_num"]))
def c11_encounters_with_patients(spark, sf):
    """C11: every encounter with its patient attributes (left join)."""
    return I.encounters_with_patients(encs(spark, sf), pats(spark, sf))


@query("c11_labelled_appointments", S.wrap(f"WITH {RAW}, {S.CLEAN_APPOINTMENTS} SELECT * FROM appt "
                                           "WHERE no_show IS NOT NULL", ["duration_min"]))
def c11_labelled_appointments(spark, sf):
    """C11/F1: appointments with a known label."""
    return I.labelled_appointments(appts(spark, sf))


# ---------------------------------------------------------------- D, J

@query("d1_distinct_rows", f"""WITH {RAW}
SELECT DISTINCT p_area, p_status, p_sexo, p_res_fec FROM raw_encounters""")
def d1_distinct_rows(spark, sf):
    """Full-row distinct after projection."""
    return J.distinct_rows(Inputs(spark, sf).encounters().select("p_area", "p_status", "p_sexo", "p_res_fec"))


@query("d2_keep_first", """SELECT c_nationkey, c_custkey, c_name, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1""")
def d2_keep_first(spark, sf):
    """First customer per nation in key order."""
    c = Inputs(spark, sf).t("customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal")
    return J.keep_first(c, ["c_nationkey"], ["c_custkey"])


@query("d3_keep_earliest", f"WITH {RAW}, {S.CLEAN_ENCOUNTERS}, {S.ENC_FIRST} SELECT * FROM enc1")
def d3_keep_earliest(spark, sf):
    """D3: per appointment key the encounter with the earliest registration."""
    return J.keep_earliest(encs(spark, sf), I.APPOINTMENT_KEYS, "registration_datetime", ENC_TIES)


@query("j1_keep_earliest_join", S.wrap(f"""WITH {RAW}, {S.CLEAN_APPOINTMENTS}, {S.CLEAN_ENCOUNTERS}, {S.ENC_FIRST}
SELECT a.*, e.p_num_exp_key, e.p_area, e.p_status, e.p_sexo, e.reservation_datetime, e.arrival_datetime,
       e.registration_datetime
FROM appt a LEFT JOIN enc1 e ON a.area_key IS NOT DISTINCT FROM e.area_key
 AND a.cve_num_key IS NOT DISTINCT FROM e.cve_num_key AND a.cve_mbo_key IS NOT DISTINCT FROM e.cve_mbo_key""",
                                       ["duration_min"]))
def j1_keep_earliest_join(spark, sf):
    """Appointments left-joined on the composite key to D3 encounters."""
    enc = J.keep_earliest(encs(spark, sf), I.APPOINTMENT_KEYS, "registration_datetime", ENC_TIES)
    return J.left_join_keys(appts(spark, sf), enc, I.APPOINTMENT_KEYS, suffix="_hospac")


@query("j2_patient_join", S.wrap(f"""WITH {RAW}, {S.CLEAN_ENCOUNTERS}, {S.CLEAN_PATIENTS}
SELECT e.p_num_exp_key, e.registration_datetime, p.m_num_exp_key, p.m_edad_num, p.m_cp
FROM enc e LEFT JOIN pat p ON e.p_num_exp_key IS NOT DISTINCT FROM p.m_num_exp_key""", ["m_edad_num"]))
def j2_patient_join(spark, sf):
    """Left join on differently named keys (file number)."""
    e = encs(spark, sf).select("p_num_exp_key", "registration_datetime")
    p = pats(spark, sf).select("m_num_exp_key", "m_edad_num", "m_cp")
    return J.left_join_on(e, p, "p_num_exp_key", "m_num_exp_key")


@query("j5_join_audit", S.wrap(f"""WITH {RAW}, {S.CLEAN_ENCOUNTERS}, {S.CLEAN_PATIENTS},
jj AS (SELECT e.*, CASE WHEN p.m_num_exp_key IS NOT NULL OR p.m_status IS NOT NULL THEN 1 ELSE 0 END AS matched
       FROM enc e LEFT JOIN pat p ON e.p_num_exp_key IS NOT DISTINCT FROM p.m_num_exp_key)
SELECT 'encounters_patients' AS join_name, (SELECT count(*) FROM enc) AS rows_before, count(*) AS rows_after,
       (SELECT count(*) FROM enc) = count(*) AS rows_preserved, CAST(sum(matched) AS BIGINT) AS matched,
       count(*) - CAST(sum(matched) AS BIGINT) AS unmatched, sum(matched) * 100.0 / count(*) AS match_rate_pct
FROM jj""", ["match_rate_pct"]))
def j5_join_audit(spark, sf):
    """Row preservation and match rate of the patient join."""
    e = encs(spark, sf)
    j = J.left_join_on(e, pats(spark, sf), "p_num_exp_key", "m_num_exp_key", indicator="__m")
    return J.join_audit(j, e, "__m", "encounters_patients")


# ---------------------------------------------------------------- P scalars

def _raw_times(spark, sf):
    """Raw times in mixed shapes from events: HMM/HHMM digits, a ``.0``
    float form, and text without digits."""
    e = Inputs(spark, sf).t("events")
    hm = (F.hour("ts") * 100 + F.minute("ts")).cast("string")
    hms = (F.hour("ts") * 10000 + F.minute("ts") * 100 + F.second("ts")).cast("string")
    raw = (F.when(F.col("event_id") % 5 == 0, F.concat(hm, F.lit(".0")))
            .when(F.col("event_id") % 5 == 1, hms)
            .when(F.col("event_id") % 5 == 2, F.concat(F.lit(" "), hm))
            .when(F.col("event_id") % 5 == 3, F.col("event_type"))
            .otherwise(hm))
    return e.select("event_id", F.date_format("ts", "yyyyMMdd").alias("d"), raw.alias("t"))


RAW_TIMES_SQL = """rt AS (
  SELECT event_id, strftime(ts, '%Y%m%d') AS d,
    CASE WHEN event_id % 5 = 0 THEN CAST(hour(ts) * 100 + minute(ts) AS VARCHAR) || '.0'
         WHEN event_id % 5 = 1 THEN CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS VARCHAR)
         WHEN event_id % 5 = 2 THEN ' ' || CAST(hour(ts) * 100 + minute(ts) AS VARCHAR)
         WHEN event_id % 5 = 3 THEN event_type
         ELSE CAST(hour(ts) * 100 + minute(ts) AS VARCHAR) END AS t
  FROM events)"""


@query("p1_strip_strings", f"""SELECT doc_id, {S.strip('text')} AS text, {S.strip('lang')} AS lang,
  {S.strip('source')} AS source FROM documents""")
def p1_strip_strings(spark, sf):
    """Control characters removed, Unicode trim, blank -> null (whole texts)."""
    return PR.strip_strings(Inputs(spark, sf).t("documents").select("doc_id", "text", "lang", "source"))


@query("p2_normalize_codes", f"""WITH {RAW} SELECT m_num_exp, {S.norm('m_ciu')} AS m_ciu,
  {S.norm('m_pai')} AS m_pai FROM raw_patients""")
def p2_normalize_codes(spark, sf):
    """Code columns stripped and upper-cased."""
    r = Inputs(spark, sf).patients().select("m_num_exp", "m_ciu", "m_pai")
    return PR.normalize_codes(r, ["m_ciu", "m_pai", "absent_column"])


@query("p3_null_out_codes", f"""WITH {RAW} SELECT m_num_exp,
  CASE WHEN upper({S.trim_u('m_cp')}) IN ('000', '00000', 'NA', 'N/A', 'NULL', 'NONE') THEN NULL ELSE upper({S.trim_u('m_cp')}) END AS m_cp,
  CASE WHEN upper({S.trim_u('m_pai')}) IN ('NA', 'N/A', 'NULL', 'NONE') THEN NULL ELSE upper({S.trim_u('m_pai')}) END AS m_pai
  FROM raw_patients""")
def p3_null_out_codes(spark, sf):
    """Non-informative codes -> null."""
    r = Inputs(spark, sf).patients().select("m_num_exp", "m_cp", "m_pai")
    return PR.null_out_codes(r, {"m_cp": T.NONINFORMATIVE_CODES["m_cp"], "m_pai": T.NONINFORMATIVE_CODES["m_pai"]})


@query("p4_standardize_time", f"WITH {RAW_TIMES_SQL} SELECT event_id, t, {S.p4('t')} AS hhmmss FROM rt")
def p4_standardize_time(spark, sf):
    """Raw times of every shape -> HHMMSS."""
    return _raw_times(spark, sf).select("event_id", "t", P.standardize_hhmmss("t").alias("hhmmss"))


@query("p5_parse_datetime", f"WITH {RAW_TIMES_SQL} SELECT event_id, {S.p5('d', 't')} AS ts FROM rt")
def p5_parse_datetime(spark, sf):
    """P5: date + raw time -> timestamp (invalid -> null)."""
    return _raw_times(spark, sf).select("event_id", P.parse_datetime("d", "t").alias("ts"))


@query("p6_parse_date", f"""WITH {RAW}
SELECT m_num_exp, CAST({S.ts14(f"(CASE WHEN regexp_full_match({S.trim_u('m_fec_nac')}, '\\d{{8}}') THEN {S.trim_u('m_fec_nac')} END || '000000')")} AS DATE) AS birth
FROM raw_patients""")
def p6_parse_date(spark, sf):
    """YYYYMMDD birth dates -> date."""
    return Inputs(spark, sf).patients().select("m_num_exp", P.parse_date("m_fec_nac").alias("birth"))


def _loose_sql(d: str, t: str, midnight_null: bool) -> str:
    tt = f"regexp_replace('000000' || {S.trim_u(f'split_part(CAST({t} AS VARCHAR), {chr(39)}.{chr(39)}, 1)')}, '^0{{0,6}}(.{{6,}})$', '\\1')"
    ts = S.ts14(f"({S.trim_u(d)} || {tt})")
    return f"(CASE WHEN {tt} <> '000000' THEN {ts} END)" if midnight_null else ts


@query("p7_parse_datetime_loose", f"""WITH {RAW_TIMES_SQL}
SELECT event_id, {_loose_sql('d', 't', True)} AS ts_null_midnight, {_loose_sql('d', 't', False)} AS ts_midnight FROM rt""")
def p7_parse_datetime_loose(spark, sf):
    """Notebook parser, both treatments of a zero time."""
    r = _raw_times(spark, sf)
    return r.select("event_id", P.parse_datetime_loose("d", "t").alias("ts_null_midnight"),
                    P.parse_datetime_loose("d", "t", midnight_is_null=False).alias("ts_midnight"))


@query("p8_safe_numeric", f"""WITH {RAW} SELECT m_num_exp, m_edad, {S.numeric('m_edad')} AS age FROM raw_patients""")
def p8_safe_numeric(spark, sf):
    """Text to number, suffixed text such as 49A -> null."""
    return Inputs(spark, sf).patients().select("m_num_exp", "m_edad", P.safe_numeric("m_edad").alias("age"))


@query("p9_range_null", f"""WITH {RAW} SELECT m_num_exp,
  CASE WHEN {S.numeric('m_edad')} < 0 OR {S.numeric('m_edad')} > 120 THEN NULL ELSE {S.numeric('m_edad')} END AS age
  FROM raw_patients""")
def p9_range_null(spark, sf):
    """Ages outside 0-120 -> null."""
    r = Inputs(spark, sf).patients().withColumn("a", P.safe_numeric("m_edad"))
    return r.select("m_num_exp", P.null_if("a", (F.col("a") < 0) | (F.col("a") > 120)).alias("age"))


@query("p10_calendar_features", f"SELECT event_id, {S.cal('ts')} FROM events")
def p10_calendar_features(spark, sf):
    """P10: hour, day_of_week (Mon=0), day, month, is_weekend."""
    e = Inputs(spark, sf).t("events").select("event_id", "ts")
    return CAL.add_calendar_features(e, "ts").drop("ts")


@query("p11_week_of_year", "SELECT o_orderkey, weekofyear(o_orderdate) AS week_of_year FROM orders")
def p11_week_of_year(spark, sf):
    """ISO week of year."""
    o = Inputs(spark, sf).t("orders")
    return o.select("o_orderkey", CAL.week_of_year("o_orderdate").alias("week_of_year"))


@query("p12_floor_hour", "SELECT event_id, date_trunc('hour', ts) AS hour_ts FROM events")
def p12_floor_hour(spark, sf):
    """Timestamps floored to the hour."""
    return Inputs(spark, sf).t("events").select("event_id", CAL.floor_hour("ts").alias("hour_ts"))


@query("p13_domain_clean", f"""WITH {S.RAW_TRIAGE} SELECT ClaveIngreso,
  CASE WHEN upper(trim(Triage)) IN ('A','C','E','M','N') THEN upper(trim(Triage)) END AS triage_clean,
  CASE WHEN upper(trim(Triage)) NOT IN ('A','C','E','M','N') THEN 1 ELSE 0 END AS triage_invalid FROM raw_triage""")
def p13_domain_clean(spark, sf):
    """Out-of-domain triage letters -> null plus invalid flag."""
    r = Inputs(spark, sf).triage()
    clean, invalid = P.domain_clean(F.upper(T.unicode_trim("Triage")), P.TRIAGE_VALUES)
    return r.select("ClaveIngreso", clean.alias("triage_clean"), invalid.alias("triage_invalid"))


@query("p14_label_map", f"""WITH {RAW} SELECT cve_num,
  CASE WHEN upper(asistencia) = 'A' THEN 0 WHEN upper(asistencia) = 'I' THEN 1 END AS no_show FROM raw_appointments""")
def p14_label_map(spark, sf):
    """Attendance code -> 0/1 label."""
    r = Inputs(spark, sf).appointments()
    return r.select("cve_num", P.label_map(F.upper("asistencia")).alias("no_show"))


@query("p15_durations", S.wrap(f"""SELECT l_orderkey, l_linenumber,
  {S.minutes('o_orderdate', 'l_shipdate')} AS minutes, {S.days('l_shipdate', 'o_orderdate')} AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", ["minutes", "days"]))
def p15_durations(spark, sf):
    """Minutes and days between timestamps."""
    i = Inputs(spark, sf)
    j = i.t("lineitem").join(i.t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber",
                    P.minutes_between("o_orderdate", "l_shipdate").alias("minutes"),
                    P.days_between("l_shipdate", "o_orderdate").alias("days"))


@query("p16_validity_flags", f"""SELECT event_id,
  CASE WHEN value BETWEEN 0 AND 240.0 THEN 1 ELSE 0 END AS valid_wait,
  CASE WHEN value - 100 < 0 THEN 1 ELSE 0 END AS negative FROM events""")
def p16_validity_flags(spark, sf):
    """Within-range flag and negative flag."""
    e = Inputs(spark, sf).t("events")
    return e.select("event_id", P.within_flag("value", 0.0, 240.0).alias("valid_wait"),
                    P.negative_flag(F.col("value") - 100).alias("negative"))


@query("p17_select_existing", f"WITH {RAW} SELECT p_area, p_status, p_res_fec FROM raw_encounters")
def p17_select_existing(spark, sf):
    """Keep-if-exists projection."""
    return PR.select_existing(Inputs(spark, sf).encounters(), ["p_area", "p_tpo_pac", "p_status", "p_res_fec"])


@query("p18_join_keys", f"""WITH {S.RAW_NOTES} SELECT ClaveIngreso, {S.trim_u('Expediente')} AS expediente_key FROM raw_notes""")
def p18_join_keys(spark, sf):
    """Trimmed string join keys."""
    r = Inputs(spark, sf).notes()
    return r.select("ClaveIngreso", T.join_key("Expediente").alias("expediente_key"))


@query("p19_fill_unknown", f"""WITH {RAW} SELECT p_res_cve_num, p_status,
  coalesce(p_sexo, 'UNKNOWN') AS p_sexo, p_linenumber_hour FROM
  (SELECT p_res_cve_num, p_status, p_sexo, CAST(p_hra_reg AS INTEGER) / 100 AS p_linenumber_hour FROM raw_encounters)""")
def p19_fill_unknown(spark, sf):
    """Missing categoricals -> UNKNOWN; numeric columns untouched."""
    r = Inputs(spark, sf).encounters().select(
        "p_res_cve_num", "p_status", "p_sexo", (F.col("p_hra_reg").cast("int") / 100).alias("p_linenumber_hour"))
    return PR.fill_unknown(r)


@query("p21_binary_flags", f"""WITH {RAW} SELECT cve_num,
  CASE WHEN conflicto = 'C' THEN 1 ELSE 0 END AS conflicto, CASE WHEN agregada = 'A' THEN 1 ELSE 0 END AS agregada,
  CASE WHEN ultimahora = 'U' THEN 1 ELSE 0 END AS ultimahora FROM raw_appointments""")
def p21_binary_flags(spark, sf):
    """Code columns -> 0/1 flags."""
    r = Inputs(spark, sf).appointments()
    return r.select("cve_num", P.code_flag("conflicto", "C").alias("conflicto"),
                    P.code_flag("agregada", "A").alias("agregada"), P.code_flag("ultimahora", "U").alias("ultimahora"))


@query("p22_cyclical", S.wrap("""SELECT event_id,
  sin(2 * pi() * month(ts) / 12.0) AS month_sin, cos(2 * pi() * month(ts) / 12.0) AS month_cos,
  sin(2 * pi() * day(ts) / 31.0) AS day_sin, cos(2 * pi() * day(ts) / 31.0) AS day_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7.0) AS day_of_week_sin, cos(2 * pi() * (isodow(ts) - 1) / 7.0) AS day_of_week_cos,
  sin(2 * pi() * hour(ts) / 24.0) AS hour_sin, cos(2 * pi() * hour(ts) / 24.0) AS hour_cos FROM events""",
                              [f"{c}_{f}" for c in ("month", "day", "day_of_week", "hour") for f in ("sin", "cos")]))
def p22_cyclical(spark, sf):
    """sin/cos encodings of calendar fields, originals dropped."""
    e = CAL.add_calendar_features(Inputs(spark, sf).t("events").select("event_id", "ts"), "ts")
    return CAL.cyclical(e.drop("ts", "is_weekend"), CAL.CYCLE_PERIODS)


@query("p23_code_clean", f"""WITH {RAW} SELECT m_num_exp,
  CASE WHEN c <> 'UNKNOWN' AND length(c) < 5 THEN lpad(c, 5, '0') ELSE c END AS m_cp FROM (
    SELECT m_num_exp, CASE WHEN b = 'A' THEN 'UNKNOWN' WHEN b = '001' THEN 'UNKNOWN' ELSE b END AS c FROM (
      SELECT m_num_exp, regexp_replace({S.trim_u("coalesce(m_cp, 'UNKNOWN')")}, '\\.0$', '') AS b FROM raw_patients))""")
def p23_code_clean(spark, sf):
    """Strip, drop .0, dictionary replace, guarded zero-pad."""
    r = Inputs(spark, sf).patients().fillna("UNKNOWN", subset=["m_cp"])
    return r.select("m_num_exp", T.code_clean("m_cp", 5, {"A": "UNKNOWN", "001": "UNKNOWN"}).alias("m_cp"))


@query("p25_log1p_clip", S.wrap("SELECT event_id, ln(1 + greatest(value - 100, 0)) AS x FROM events", ["x"]))
def p25_log1p_clip(spark, sf):
    """P25: log1p of the value clipped at 0."""
    e = Inputs(spark, sf).t("events")
    return e.select("event_id", P.log1p_clip(F.col("value") - 100).alias("x"))


@query("p26_accent_key", """SELECT doc_id, lang, CASE WHEN lang IS NULL THEN 'MISSING' ELSE
  strip_accents(upper(trim(lang))) END AS lang_key FROM documents""")
def p26_accent_key(spark, sf):
    """Accent-insensitive key via a vectorised UDF over distinct values."""
    d = Inputs(spark, sf).t("documents").select("doc_id", "lang")
    return PR.with_accent_key(d, "lang", "lang_key")


@query("p27_blank_to_null", f"""WITH {S.RAW_NOTES} SELECT ClaveIngreso,
  CASE WHEN regexp_full_match(Expediente, '\\s*') THEN NULL ELSE Expediente END AS Expediente,
  CASE WHEN regexp_full_match(Triage, '\\s*') THEN NULL ELSE Triage END AS Triage FROM raw_notes""")
def p27_blank_to_null(spark, sf):
    """Whitespace-only text -> null."""
    r = Inputs(spark, sf).notes().select("ClaveIngreso", "Expediente", "Triage")
    return r.select("ClaveIngreso", T.blank_to_null("Expediente").alias("Expediente"),
                    T.blank_to_null("Triage").alias("Triage"))


@query("p28_bands", """SELECT event_id,
  CASE WHEN value > 120 THEN 'high' WHEN value > 60 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN (o % 1000) / 1000.0 >= 0.6 THEN 1 ELSE 0 END AS flagged
  FROM (SELECT *, event_id * 7919 AS o FROM events)""")
def p28_bands(spark, sf):
    """Severity bands and probability threshold flag."""
    e = Inputs(spark, sf).t("events").withColumn("p", ((F.col("event_id") * 7919) % 1000) / F.lit(1000.0))
    return e.select("event_id", P.wait_band("value").alias("band"), P.threshold_flag("p", 0.6).alias("flagged"))


@query("p29_presentation", f"""SELECT event_id,
  ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'][month(ts)] AS month_name,
  ['Lunes','Martes','Miércoles','Jueves','Viernes','Sábado','Domingo'][isodow(ts)] AS weekday_name,
  strftime(ts, '%Y-%m-%d %H:%M') AS ts_text FROM events""")
def p29_presentation(spark, sf):
    """Month and weekday names, minute-resolution timestamp text."""
    e = Inputs(spark, sf).t("events")
    return e.select("event_id", CAL.month_name(F.month("ts")).alias("month_name"),
                    CAL.weekday_name(F.weekday("ts")).alias("weekday_name"),
                    CAL.format_minute("ts").alias("ts_text"))


@query("p31_clip_zero", "SELECT event_id, greatest(value - 100, 0.0) AS pred FROM events")
def p31_clip_zero(spark, sf):
    """Predictions clipped at zero."""
    e = Inputs(spark, sf).t("events")
    return e.select("event_id", P.clip_zero(F.col("value") - 100).alias("pred"))


@query("p32_casts", """SELECT event_id, CAST(hour(ts) AS VARCHAR) AS hour_text,
  CAST(user_id AS DOUBLE) AS user_float FROM events""")
def p32_casts(spark, sf):
    """Calendar fields to text categories, counts to float."""
    e = Inputs(spark, sf).t("events")
    return e.select("event_id", F.hour("ts").cast("string").alias("hour_text"),
                    F.col("user_id").cast("double").alias("user_float"))


@query("p33_severity_number", f"""WITH {S.RAW_TRIAGE} SELECT ClaveIngreso,
  {S.numeric("CASE trim(Triage) WHEN 'p' THEN ' 1 ' WHEN 'c' THEN '2.5' WHEN 'e' THEN '' ELSE Triage END")} AS sev FROM raw_triage""")
def p33_severity_number(spark, sf):
    """Text severity -> number (bad -> null)."""
    r = Inputs(spark, sf).triage()
    # numbers with blanks, empty text and letters
    text = (F.when(F.trim("Triage") == "p", " 1 ").when(F.trim("Triage") == "c", "2.5").when(F.trim("Triage") == "e", "")
            .otherwise(F.col("Triage")))
    return r.select("ClaveIngreso", P.safe_numeric(text).alias("sev"))
