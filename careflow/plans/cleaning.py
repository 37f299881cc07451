"""Cleaning entry points for the five raw tables.

Each is one lazy projection over the raw table followed by a full-row
distinct (D1) or keep-first dedup (D2); column lists are the reference's,
filtered to the columns that exist (P17). The plan is the same at every size;
a caller whose files have fewer row groups than the cluster has cores reads
them with ``read_table(balance=True)``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.functions import parse as P
from careflow.functions import text as T
from careflow.functions.calendar import add_calendar_features
from careflow.operators import joins as J
from careflow.operators import projection as PR

# Code columns normalised per table and output columns kept.
ENCOUNTER_CODES = ["p_area", "p_status", "p_sexo", "p_tpo_pac", "p_tpo_cita",
                   "p_res_cve_num", "p_res_cve_mbo"]
ENCOUNTER_COLUMNS = ["area_key", "cve_num_key", "cve_mbo_key", "p_num_exp_key", "p_area",
                     "p_status", "p_sexo", "p_tpo_pac", "p_tpo_cita", "reservation_datetime",
                     "arrival_datetime", "registration_datetime"]
APPOINTMENT_CODES = ["area", "cve_num", "cve_mbo", "med", "esp", "tpo_cita", "conflicto",
                     "agregada", "ultimahora", "buffer", "asistencia"]
APPOINTMENT_COLUMNS = ["area_key", "cve_num_key", "cve_mbo_key", "area", "cve_num", "cve_mbo",
                       "med", "esp", "a_fecha", "hra_ini", "hra_fin", "appointment_datetime",
                       "appointment_hour", "appointment_day_of_week", "appointment_day",
                       "appointment_month", "appointment_is_weekend", "duration_min", "tpo_cita",
                       "conflicto", "agregada", "ultimahora", "buffer", "asistencia_clean",
                       "asistencia_invalid", "no_show"]
#: Those that follow from the other columns of a cleaned row.
APPOINTMENT_DERIVED = ["area_key", "cve_num_key", "cve_mbo_key", "appointment_datetime", "appointment_hour",
                       "appointment_day_of_week", "appointment_day", "appointment_month", "appointment_is_weekend",
                       "no_show"]
PATIENT_CODES = ["m_status", "m_sexo", "m_ciu", "m_col", "m_cp", "m_edo", "m_pai"]
PATIENT_COLUMNS = ["m_num_exp_key", "m_status", "m_sexo", "m_edad_num", "m_fec_nac_clean",
                   "m_ciu", "m_col", "m_cp", "m_edo", "m_pai"]
TRIAGE_CODES = ["Sexo", "Area", "Departamento", "NomDepartamento", "LlegadaServicio",
                "Destino", "Triage"]
TRIAGE_COLUMNS = ["expediente_key", "clave_ingreso_key", "triage_datetime", "Edad", "Sexo",
                  "Area", "Departamento", "NomDepartamento", "LlegadaServicio", "MotivoConsulta",
                  "triage_clean", "triage_invalid", "Destino", "TiempoEvolucion"]
NOTE_CODES = ["Sexo", "Especialidad", "LlegadaServicio", "Triage", "Salida"]
NOTE_COLUMNS = ["expediente_key", "clave_ingreso_key", "arrival_datetime", "note_datetime",
                "destination_datetime", "wait_proxy_min", "valid_wait_proxy", "Edad", "Sexo",
                "Especialidad", "LlegadaServicio", "MotivoConsulta", "Triage", "Salida"]


def _with_dt(df: DataFrame, out: str, date_col: str, time_col: str) -> DataFrame:
    """P5 with the reference's guard: absent column -> null timestamp."""
    if date_col not in df.columns or time_col not in df.columns:
        return df.withColumn(out, F.lit(None).cast("timestamp_ntz"))
    return P.with_datetime(df, out, date_col, time_col)


def _key(df: DataFrame, col: str):
    return T.join_key(col) if col in df.columns else F.lit(None).cast("string")


def _distinct(df: DataFrame, columns: list[str], derived: list[str]) -> DataFrame:
    """D1 on the listed columns that exist, without those that are derived from
    the rest: rows are distinct with them exactly if they are without them, and
    they need neither be hashed nor shuffled."""
    return J.distinct_rows(PR.select_existing(df, [c for c in columns if c not in derived]))


def clean_encounters(raw: DataFrame) -> DataFrame:
    """Encounters (hospac)."""
    df = PR.strip_and_normalize(raw, ENCOUNTER_CODES)
    df = df.withColumns({
        "cve_num_key": _key(df, "p_res_cve_num"),
        "cve_mbo_key": _key(df, "p_res_cve_mbo"),
        "p_num_exp_key": _key(df, "p_num_exp"),
    })
    df = _with_dt(df, "reservation_datetime", "p_res_fec", "p_res_hra")
    df = _with_dt(df, "arrival_datetime", "p_fec_lld", "p_hra_lld")
    df = _with_dt(df, "registration_datetime", "p_fec_reg", "p_hra_reg")
    df = _distinct(df, ENCOUNTER_COLUMNS, ["area_key"])
    return PR.select_existing(df.withColumn("area_key", _key(df, "p_area")), ENCOUNTER_COLUMNS)


def clean_appointments(raw: DataFrame, max_duration: float | None = None) -> DataFrame:
    """Appointments (hosagd) with the no-show label."""
    df = PR.strip_and_normalize(raw, APPOINTMENT_CODES)
    if "dur" in df.columns:
        dur = P.safe_numeric("dur")
        df = df.withColumn("duration_min", P.null_if(dur, dur <= 0))
    if "asistencia" in df.columns:
        clean, invalid = P.domain_clean(T.normalize_code("asistencia"), P.ATTENDANCE_VALUES)
        df = df.withColumns({"asistencia_clean": clean, "asistencia_invalid": invalid})
    df = _distinct(df, APPOINTMENT_COLUMNS, APPOINTMENT_DERIVED)
    df = df.withColumns({
        "area_key": _key(df, "area"),
        "cve_num_key": _key(df, "cve_num"),
        "cve_mbo_key": _key(df, "cve_mbo"),
    })
    df = _with_dt(df, "appointment_datetime", "a_fecha", "hra_ini")
    df = add_calendar_features(df, "appointment_datetime", prefix="appointment")
    if "asistencia_clean" in df.columns:
        df = df.withColumn("no_show", P.label_map("asistencia_clean"))
    return PR.select_existing(df, APPOINTMENT_COLUMNS)


def clean_patients(raw: DataFrame, order_by: str | None = None) -> DataFrame:
    """Patients (hosmpi); one row per file number, the first in
    ``order_by``. Default: file order (path, row index) when ``raw`` is a
    file scan or a projection of one, else the order of the other columns."""
    if order_by is None:
        try:
            raw = raw.withColumns({"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
            raw.schema  # resolves the names
        except AnalysisException:
            pass
    df = PR.strip_and_normalize(raw, PATIENT_CODES)
    df = PR.null_out_codes(df, T.NONINFORMATIVE_CODES)
    df = df.withColumn("m_num_exp_key", _key(df, "m_num_exp"))
    if "m_edad" in df.columns:
        age = P.safe_numeric("m_edad")
        df = df.withColumn("m_edad_num", P.null_if(age, (age < 0) | (age > 120)))
    if "m_fec_nac" in df.columns:
        df = df.withColumn("m_fec_nac_clean", P.parse_date("m_fec_nac").cast("timestamp_ntz"))
    order = [order_by] if order_by else []
    if order_by and order_by not in PATIENT_COLUMNS:
        df = df.withColumn("__order", F.col(order_by))
        order = ["__order"]
    order = [c for c in ("__path", "__row") if c in df.columns] or order
    own = [c for c in order if c.startswith("__")]
    out = PR.select_existing(df, PATIENT_COLUMNS + own)
    out = J.keep_first(out, ["m_num_exp_key"], order or [c for c in out.columns if c != "m_num_exp_key"])
    return out.drop(*own)


def clean_triage(raw: DataFrame, allowed=tuple(P.TRIAGE_VALUES)) -> DataFrame:
    """C4: triage records with a domain-checked category."""
    df = PR.strip_and_normalize(raw, TRIAGE_CODES)
    df = df.withColumns({
        "expediente_key": _key(df, "Expediente"),
        "clave_ingreso_key": _key(df, "ClaveIngreso"),
    })
    df = _with_dt(df, "triage_datetime", "Fecha", "Hora")
    if "Triage" in df.columns:
        clean, invalid = P.domain_clean(T.empty_to_null(F.upper(T.unicode_trim("Triage"))), allowed)
        df = df.withColumns({"triage_clean": clean, "triage_invalid": invalid})
    return J.distinct_rows(PR.select_existing(df, TRIAGE_COLUMNS))


def clean_notes(raw: DataFrame, max_wait_min: float = 1440.0) -> DataFrame:
    """Emergency notes with the wait proxy (note time - arrival)."""
    df = PR.strip_and_normalize(raw, NOTE_CODES)
    df = df.withColumns({
        "expediente_key": _key(df, "Expediente"),
        "clave_ingreso_key": _key(df, "ClaveIngreso"),
    })
    df = _with_dt(df, "arrival_datetime", "Llegada_Fecha", "Llegada_Hora")
    df = _with_dt(df, "note_datetime", "Fecha", "Hora")
    df = _with_dt(df, "destination_datetime", "Destino_Fecha", "Destino_Hora")
    df = _distinct(df, NOTE_COLUMNS, ["wait_proxy_min", "valid_wait_proxy"])
    df = df.withColumn("wait_proxy_min", P.minutes_between("arrival_datetime", "note_datetime"))
    df = df.withColumn("valid_wait_proxy", P.within_flag("wait_proxy_min", 0.0, max_wait_min))
    return PR.select_existing(df, NOTE_COLUMNS)
