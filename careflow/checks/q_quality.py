"""Checked queries: data-quality reports and profiles (Q1-Q11, A11, A12, A14, A15,
A18-A20, U1, U2, S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.checks import sqlkit as S
from careflow.checks.q_agg import MASTER_CTES, master
from careflow.checks.q_clean import RAW, appts, base, encs
from careflow.checks.registry import query
from careflow.operators import quality as Q
from careflow.plans.roles import Inputs
from careflow.session import checkpoint_dir
from careflow.sources import io as IO

BASE = f"{RAW}, {S.NO_SHOW_BASE}"


ENC_COLS = ["area_key", "cve_num_key", "cve_mbo_key", "p_num_exp_key", "p_area", "p_status", "p_sexo",
            "reservation_datetime", "arrival_datetime", "registration_datetime"]
ENC_TYPES = {"reservation_datetime": "timestamp_ntz", "arrival_datetime": "timestamp_ntz",
             "registration_datetime": "timestamp_ntz"}


@query("q1_missing_summary", S.wrap(f"WITH {RAW}, {S.CLEAN_ENCOUNTERS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_count, "
    f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*) AS missing_pct, "
    f"'{ENC_TYPES.get(c, 'string')}' AS dtype FROM enc" for c in ENC_COLS), ["missing_pct"]))
def q1_missing_summary(spark, sf):
    """Q1: missing count, % and type for every column in one pass."""
    return Q.missing_summary(encs(spark, sf))


NOTE_RAW_COLS = ["Expediente", "ClaveIngreso", "Llegada_Fecha", "Llegada_Hora", "Fecha", "Hora", "Especialidad",
                 "Triage"]


@query("q2_missing_with_blanks", S.wrap(f"WITH {S.RAW_NOTES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(sum(CASE WHEN {c} IS NULL OR regexp_full_match({c}, '\\s*') THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS missing_count, sum(CASE WHEN {c} IS NULL OR regexp_full_match({c}, '\\s*') THEN 1 ELSE 0 END) * 100.0 / count(*) "
    f"AS missing_pct, 'string' AS dtype FROM raw_notes" for c in NOTE_RAW_COLS), ["missing_pct"]))
def q2_missing_with_blanks(spark, sf):
    """Q2: missing summary where blank text counts as missing."""
    return Q.missing_summary(Inputs(spark, sf).notes(), blanks_as_missing=True)


@query("q3_shape_duplicates", f"""WITH {RAW} SELECT 'raw_encounters_projection' AS table, count(*) AS rows, 4 AS columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_area, p_status, p_sexo, p_res_fec FROM raw_encounters)) AS duplicated_rows
  FROM raw_encounters""")
def q3_shape_duplicates(spark, sf):
    """Q3: shape and fully duplicated rows."""
    e = Inputs(spark, sf).encounters().select("p_area", "p_status", "p_sexo", "p_res_fec")
    return Q.shape_and_duplicates(e, "raw_encounters_projection")


@query("q4_key_duplicates", S.wrap(f"""WITH {RAW}, {S.CLEAN_ENCOUNTERS},
c AS (SELECT area_key, cve_num_key, cve_mbo_key, count(*) AS n FROM enc GROUP BY ALL)
SELECT 'encounters' AS table, 'area_key + cve_num_key + cve_mbo_key' AS key, 'ok' AS status,
  CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated_keys,
  sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100.0 / sum(n) AS pct_rows_in_duplicated_keys FROM c""",
                                   ["pct_rows_in_duplicated_keys"]))
def q4_key_duplicates(spark, sf):
    """Q4: duplicated business keys and % of rows inside them."""
    return Q.key_duplicates(encs(spark, sf), ["area_key", "cve_num_key", "cve_mbo_key"], "encounters")


@query("q4_key_duplicates_missing_cols", """SELECT 'encounters' AS table, 'area_key + no_such_column' AS key,
  'missing columns' AS status, CAST(NULL AS BIGINT) AS duplicated_keys, CAST(NULL AS DOUBLE) AS pct_rows_in_duplicated_keys
  FROM (SELECT count(*) FROM lineitem)""")
def q4_key_duplicates_missing_cols(spark, sf):
    """Q4: a key with an absent column reports ``missing columns``."""
    return Q.key_duplicates(encs(spark, sf), ["area_key", "no_such_column"], "encounters")


@query("q5_grain_check", f"""WITH {MASTER_CTES} SELECT 'master' AS table, 'timestamp' AS key, count(*) AS rows,
  count(DISTINCT timestamp) AS distinct_keys, count(*) = count(DISTINCT timestamp) AS grain_ok FROM master""")
def q5_grain_check(spark, sf):
    """Q5: one row per hour in the master."""
    return Q.grain_check(master(spark, sf), ["timestamp"], "master")


DATE_COLS = ["reservation_datetime", "arrival_datetime", "registration_datetime"]


@query("q6_date_validation", S.wrap(f"WITH {RAW}, {S.CLEAN_ENCOUNTERS} " + " UNION ALL ".join(
    f"SELECT 'encounters' AS table, '{c}' AS column, count(*) AS rows, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS missing_dates, sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*) AS missing_pct, "
    f"min({c}) AS min_date, max({c}) AS max_date FROM enc" for c in DATE_COLS), ["missing_pct"]))
def q6_date_validation(spark, sf):
    """Q6: per date column missing, %, min and max."""
    return Q.date_validation(encs(spark, sf), DATE_COLS, "encounters")


RULES = [("duration_min", lambda x: x <= 0, "duration <= 0"),
         ("appointment_hour", lambda x: (x < 0) | (x > 23), "hour outside 0-23"),
         ("lead_time_days", lambda x: x < 0, "negative lead time"),
         ("dur", lambda x: x > 60, "raw duration > 60")]


@query("q7_rule_checks", S.wrap(f"WITH {RAW}, {S.CLEAN_APPOINTMENTS}, ap AS (SELECT a.*, r.dur FROM appt a "
                                "JOIN raw_appointments r ON a.cve_num = r.cve_num) " + " UNION ALL ".join([
    "SELECT 'appointments' AS table, 'duration_min' AS column, 'duration <= 0' AS rule, "
    "CAST(sum(CASE WHEN duration_min <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS count, "
    "sum(CASE WHEN duration_min <= 0 THEN 1 ELSE 0 END) * 100.0 / count(*) AS pct FROM ap",
    "SELECT 'appointments', 'appointment_hour', 'hour outside 0-23', "
    "CAST(sum(CASE WHEN appointment_hour < 0 OR appointment_hour > 23 THEN 1 ELSE 0 END) AS BIGINT), "
    "sum(CASE WHEN appointment_hour < 0 OR appointment_hour > 23 THEN 1 ELSE 0 END) * 100.0 / count(*) FROM ap",
    f"SELECT 'appointments', 'dur', 'raw duration > 60', CAST(sum(CASE WHEN {S.numeric('dur')} > 60 THEN 1 ELSE 0 END) AS BIGINT), "
    f"sum(CASE WHEN {S.numeric('dur')} > 60 THEN 1 ELSE 0 END) * 100.0 / count(*) FROM ap"]), ["pct"]))
def q7_rule_checks(spark, sf):
    """Q7: impossible-value rules (absent columns are skipped)."""
    a = appts(spark, sf)
    raw = Inputs(spark, sf).appointments().select("cve_num", "dur")
    ap = a.join(raw, a["cve_num"] == raw["cve_num"]).drop(raw["cve_num"])
    return Q.rule_checks(ap, RULES, "appointments")


DOMAINS = {"asistencia_clean": {"A", "I"}, "tpo_cita": {"P", "S"}, "esp": {"1-URGENT", "2-HIGH"},
           "buffer": {"0", "1", "2"}}


@query("q8_domain_check", S.wrap(f"WITH {RAW}, {S.CLEAN_APPOINTMENTS} " + " UNION ALL ".join(
    f"""SELECT 'appointments' AS table, '{c}' AS column, '{", ".join(sorted(v))}' AS expected_domain,
    CAST(sum(CASE WHEN {c} IS NOT NULL AND {c} NOT IN ({", ".join(repr(x) for x in sorted(v))}) THEN 1 ELSE 0 END) AS BIGINT) AS invalid_count,
    sum(CASE WHEN {c} IS NOT NULL AND {c} NOT IN ({", ".join(repr(x) for x in sorted(v))}) THEN 1 ELSE 0 END) * 100.0 / count(*) AS invalid_pct,
    coalesce((SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT {c} AS x FROM appt
              WHERE {c} IS NOT NULL AND {c} NOT IN ({", ".join(repr(x) for x in sorted(v))}) ORDER BY 1 LIMIT 10)), '') AS invalid_examples
    FROM appt""" for c, v in DOMAINS.items()), ["invalid_pct"]))
def q8_domain_check(spark, sf):
    """Q8: invalid count, % and up to 10 invalid examples per column."""
    return Q.domain_check(appts(spark, sf), DOMAINS, "appointments")


TEXT_COLS = ["lang", "source"]


@query("q9_text_inconsistency", "" + " UNION ALL ".join(
    f"""SELECT 'documents' AS table, '{c}' AS column, count(DISTINCT {c}) AS raw_unique,
    count(DISTINCT CASE WHEN {c} IS NULL THEN 'MISSING' ELSE strip_accents(upper(trim({c}))) END) AS normalized_unique,
    CASE WHEN count(DISTINCT CASE WHEN {c} IS NULL THEN 'MISSING' ELSE strip_accents(upper(trim({c}))) END) < count(DISTINCT {c})
         THEN 1 ELSE 0 END AS possible_text_inconsistency,
    CAST(sum(CASE WHEN {c} IS NULL OR upper(trim({c})) IN ('UNKNOWN', 'MISSING', 'NA', 'N/A', '') THEN 1 ELSE 0 END) AS BIGINT)
      AS missing_or_unknown_count FROM documents""" for c in TEXT_COLS))
def q9_text_inconsistency(spark, sf):
    """Q9: raw vs accent-insensitive distinct counts per column."""
    return Q.text_inconsistency(Inputs(spark, sf).t("documents"), TEXT_COLS, "documents")


@query("q10_hours_without_valid_wait", S.wrap(f"""WITH {MASTER_CTES} SELECT count(*) AS hours,
  CAST(sum(CASE WHEN wait_proxy_valid_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS hours_without_valid,
  avg(CASE WHEN wait_proxy_valid_count = 0 THEN 1.0 ELSE 0.0 END) * 100.0 AS pct FROM master""", ["pct"]))
def q10_hours_without_valid_wait(spark, sf):
    """Q10: hours without any valid wait proxy."""
    return Q.hours_without_valid(master(spark, sf))


UNIQ = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]


@query("q11_unique_counts", " UNION ALL ".join(f"SELECT '{c}' AS column, count(DISTINCT {c}) AS unique FROM orders"
                                               for c in UNIQ))
def q11_unique_counts(spark, sf):
    """Q11: distinct values per column."""
    return Q.unique_counts(Inputs(spark, sf).t("orders"), UNIQ)


@query("a11_value_counts", S.wrap("""SELECT c_mktsegment AS value, count(*) AS count,
  count(*) * 100.0 / (SELECT count(*) FROM customer) AS pct FROM customer GROUP BY 1""", ["pct"]))
def a11_value_counts(spark, sf):
    """Value counts with % (nulls included)."""
    return Q.value_counts(Inputs(spark, sf).t("customer"), "c_mktsegment")


@query("a12_two_column_counts", f"WITH {BASE} SELECT no_show, p_status, count(*) AS count FROM base GROUP BY ALL")
def a12_two_column_counts(spark, sf):
    """Label vs status counts (leakage evidence)."""
    return Q.crosstab_counts(base(spark, sf), "no_show", "p_status")


PROFILE_COLS = ["duration_min", "lead_time_days", "m_edad_num"]


def _profile_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column, count({c}) AS count, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  min({c}) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, avg({c}) AS mean,
  quantile_cont({c}, 0.75) AS q3, max({c}) AS max, stddev_samp({c}) AS std,
  CASE WHEN count({c}) > 2 THEN (avg(power({c} - (SELECT avg({c}) FROM base), 3)) /
       power(avg(power({c} - (SELECT avg({c}) FROM base), 2)), 1.5)) * sqrt(count({c}) * (count({c}) - 1.0)) / (count({c}) - 2.0) END AS skew,
  CAST(sum(CASE WHEN {c} < (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM base)
             OR {c} > (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM base)
           THEN 1 ELSE 0 END) AS BIGINT) AS iqr_outliers FROM base"""


def _profiled(spark, sf):
    """The base's profiled columns as a written table: a profile reads it several times."""
    checkpoint_dir(spark)
    return base(spark, sf).select(*PROFILE_COLS).checkpoint(eager=True)


PROFILE_DOUBLES = ["min", "q1", "median", "mean", "q3", "max", "std", "skew"]


@query("a14_numeric_profile", S.wrap(f"WITH {BASE} " + " UNION ALL ".join(_profile_sql(c) for c in PROFILE_COLS),
                                     PROFILE_DOUBLES))
def a14_numeric_profile(spark, sf):
    """Exact quartiles, moments, bias-corrected skew, IQR outliers."""
    return Q.numeric_profile(_profiled(spark, sf), PROFILE_COLS)


@query("a15_describe", S.wrap(f"WITH {BASE} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
    quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max
    FROM base""" for c in PROFILE_COLS), ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def a15_describe(spark, sf):
    """describe() with exact quantiles."""
    return Q.describe(_profiled(spark, sf), PROFILE_COLS)


TRI_COLS = ["triage_A", "triage_C", "triage_E", "triage_M", "triage_N"]


@query("a18_prefix_sums", f"WITH {MASTER_CTES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(sum({c}) AS BIGINT) AS total FROM master" for c in TRI_COLS + ["triage_events"]))
def a18_prefix_sums(spark, sf):
    """Totals of the triage_* count columns, largest first."""
    return Q.column_sums(master(spark, sf), "triage_")


CORR_COLS = ["duration_min", "lead_time_days", "lead_time_invalid", "appointment_hour", "appointment_day_of_week",
             "m_edad_num"]


@query("a19_label_correlations", S.wrap(f"WITH {BASE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, corr(CAST({c} AS DOUBLE), CAST(no_show AS DOUBLE)) AS corr, "
    f"abs(corr(CAST({c} AS DOUBLE), CAST(no_show AS DOUBLE))) AS abs_corr FROM base" for c in CORR_COLS),
    ["corr", "abs_corr"]))
def a19_label_correlations(spark, sf):
    """Correlation of numeric features with the label, ranked."""
    return Q.label_correlations(base(spark, sf), "no_show", CORR_COLS)


@query("a20_histogram", S.wrap("""WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT range AS bin FROM range(0, 30)),
c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 30.0)), 29) AS INTEGER) AS bin, count(*) AS count
      FROM lineitem CROSS JOIN r GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * (hi - lo) / 30 AS lower, lo + (b.bin + 1) * (hi - lo) / 30 AS upper,
       coalesce(c.count, 0) AS count FROM b CROSS JOIN r LEFT JOIN c ON b.bin = c.bin""", ["lower", "upper"]))
def a20_histogram(spark, sf):
    """30 equal-width bins of line prices."""
    return Q.histogram(Inputs(spark, sf).t("lineitem"), "l_extendedprice", 30)


@query("u1_union_reports", f"""WITH {RAW}, {S.CLEAN_ENCOUNTERS}, {S.CLEAN_APPOINTMENTS},
ce AS (SELECT area_key, cve_num_key, cve_mbo_key, count(*) AS n FROM enc GROUP BY ALL),
ca AS (SELECT area_key, cve_num_key, cve_mbo_key, count(*) AS n FROM appt GROUP BY ALL)
SELECT 'encounters' AS table, 'area_key + cve_num_key + cve_mbo_key' AS key, 'ok' AS status,
  CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicated_keys,
  round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100.0 / sum(n) * 1e6) / 1e6 + 0.0 AS pct_rows_in_duplicated_keys FROM ce
UNION ALL
SELECT 'appointments', 'area_key + cve_num_key + cve_mbo_key', 'ok',
  CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT),
  round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100.0 / sum(n) * 1e6) / 1e6 + 0.0 FROM ca""")
def u1_union_reports(spark, sf):
    """Per-table key reports concatenated."""
    keys = ["area_key", "cve_num_key", "cve_mbo_key"]
    return Q.union_reports([Q.key_duplicates(encs(spark, sf), keys, "encounters"),
                            Q.key_duplicates(appts(spark, sf), keys, "appointments")])


def u2_schema_diff(spark, sf):
    """Raw vs processed columns (kept / removed / new) for appointments."""
    raw = Inputs(spark, sf).appointments()
    return Q.schema_diff(spark, raw.columns, appts(spark, sf).columns, "appointments")


@query("s8_output_audit", """SELECT 'orders' AS dataset, true AS exists, count(*) AS rows, 6 AS columns FROM orders
UNION ALL SELECT 'lineitem', true, count(*), 11 FROM lineitem
UNION ALL SELECT 'customer', true, count(*), 5 FROM customer
UNION ALL SELECT 'missing_table', false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM (SELECT 1)""")
def s8_output_audit(spark, sf):
    """For each expected dataset: exists?, rows, columns."""
    paths = {n: f"{sf}/{n}.parquet" for n in ("orders", "lineitem", "customer")}
    paths["missing_table"] = f"{sf}/no_such_table.parquet"
    return IO.output_audit(spark, paths)
