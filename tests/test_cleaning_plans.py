"""The cleaners' distinct reads the columns that tell rows apart, and no derived ones."""

from careflow.plans import cleaning as C


def _grouped(df) -> str:
    """The keys of the first aggregation of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.index("Aggregate ["):].split("], [")[0]


def _appointments(spark):
    row = (" 1", "7 ", "3", "d1", "x", "p", "20240115", "0930", "1000", "30", "a")
    rows = [row, row[:-2] + ("30.0", "A "), row[:-1] + ("i",), row[:7] + ("9999",) + row[8:]]
    return spark.createDataFrame(rows, "area string, cve_num string, cve_mbo string, med string, esp string, "
                                       "tpo_cita string, a_fecha string, hra_ini string, hra_fin string, dur string, "
                                       "asistencia string")


def test_derived_columns_are_not_hashed(spark):
    out = C.clean_appointments(_appointments(spark))
    assert out.columns == [c for c in C.APPOINTMENT_COLUMNS if c in out.columns]
    assert "duration_min" in _grouped(out) and "appointment_" not in _grouped(out) and "_key" not in _grouped(out)
    notes = spark.createDataFrame([("1", "20240115", "0930", "20240115", "1000")] * 2,
                                  "Expediente string, Llegada_Fecha string, Llegada_Hora string, Fecha string, Hora string")
    out = C.clean_notes(notes)
    assert "arrival_datetime" in _grouped(out) and "wait_proxy" not in _grouped(out)
    assert [(r.wait_proxy_min, r.valid_wait_proxy) for r in out.collect()] == [(30.0, 1)]


def test_distinct_rows_stay_whole(spark):
    got = {(r.area_key, r.cve_num_key, str(r.appointment_datetime), r.appointment_hour, r.duration_min, r.no_show)
           for r in C.clean_appointments(_appointments(spark)).collect()}
    assert got == {("1", "7", "2024-01-15 09:30:00", 9, 30.0, 0), ("1", "7", "2024-01-15 09:30:00", 9, 30.0, 1),
                   ("1", "7", "None", None, 30.0, 0)}
