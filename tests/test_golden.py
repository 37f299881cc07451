"""Golden micro-tables worked out by hand from the rules (FIXTURES.md)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from careflow.functions import calendar as CAL
from careflow.functions import parse as P
from careflow.functions import text as T
from careflow.operators import joins as J
from careflow.operators import kpi as K
from careflow.operators import projection as PR
from careflow.operators import quality as Q
from careflow.operators import split as SP
from careflow.operators import timeseries as TS


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_p4_standardize_time(spark):
    rows = ["0900", "93000", "930", "9", "12", "0900.0", "abc", None, "1234567"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert col(df, P.standardize_hhmmss("t")) == ["090000", "093000", "093000", "090000", "120000", "090000",
                                                  "000000", None, "234567"]


def test_p5_parse_datetime(spark):
    df = spark.createDataFrame([("20240115", "930"), ("20241315", "0900"), ("20230229", "0000"), ("20240115", "93")],
                               "d string, t string")
    assert col(df, P.parse_datetime("d", "t")) == [dt.datetime(2024, 1, 15, 9, 30), None, None, None]


def test_p5_independent_of_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("20240310", "0230")], "d string, t string")  # inside a DST gap in New York
        assert col(df, P.parse_datetime("d", "t")) == [dt.datetime(2024, 3, 10, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_p1_strip(spark):
    df = spark.createDataFrame([("  a\u0007 ",), ("  ",), (" b ",)], "s string")
    assert col(df, T.strip_text("s")) == ["a", None, "b"]


def test_p8_safe_numeric(spark):
    df = spark.createDataFrame([(" 7 ",), ("49A",), ("15D",), ("",)], "s string")
    assert col(df, P.safe_numeric("s")) == [7.0, None, None, None]


def test_p10_p11_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 6),), (dt.datetime(2024, 12, 30),)],
                               "ts timestamp_ntz")
    out = CAL.add_calendar_features(df, "ts").withColumn("w", CAL.week_of_year("ts")).collect()
    assert [(r.day_of_week, r.is_weekend) for r in out] == [(0, 0), (5, 1), (0, 0)]
    assert out[2].w == 1


def test_p13_domain(spark):
    df = spark.createDataFrame([("A",), ("X",), (None,)], "c string")
    clean, bad = P.domain_clean("c", ["A", "I"])
    assert [tuple(r) for r in df.select(clean, bad).collect()] == [("A", 0), (None, 1), (None, 0)]


def test_p16_validity(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1440.0,), (1441.0,), (None,)], "w double")
    assert col(df, P.within_flag("w")) == [0, 1, 1, 0, 0]


def test_p23_code_clean(spark):
    df = spark.createDataFrame([("7",), ("1234",), ("UNKNOWN",), ("7.0",)], "c string")
    assert col(df, T.code_clean("c", 3)) == ["007", "1234", "UNKNOWN", "007"]


def test_p24_rare_mask(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    assert sorted(col(PR.mask_rare(df, "c", "OTHERS"), "c")) == ["OTHERS", "a", "a"]


def test_j1_j2_null_keys_match(spark):
    left = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    right = spark.createDataFrame([(None, 10)], "k string, b int")
    out = J.left_join_keys(left, right, ["k"]).orderBy("a").collect()
    assert [(r.a, r.b) for r in out] == [(1, 10), (2, None)]
    out2 = J.left_join_on(left, right.withColumnRenamed("k", "rk"), "k", "rk").orderBy("a").collect()
    assert [(r.a, r.b) for r in out2] == [(1, 10), (2, None)]


def test_d3_keep_earliest(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", dt.datetime(2024, 1, 1, 10), 2),
                                ("x", dt.datetime(2024, 1, 1, 9), 3)], "k string, t timestamp_ntz, id int")
    assert col(J.keep_earliest(df, ["k"], "t"), "id") == [3]


def test_w3_single_row_std_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0)], "t int, y double")
    out = TS.add_rolling(df, "y", [3], ["t"]).orderBy("t").collect()
    assert [r.roll_std_3h for r in out] == [0.0, 0.0]
    assert out[0].roll_mean_3h is None and out[1].roll_mean_3h == 5.0


def test_a14_bias_corrected_skew(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    r = Q.numeric_profile(df, ["x"]).first()
    assert math.isclose(r.skew, 1.1376243669576889, rel_tol=1e-12)
    assert (r.q1, r.median, r.q3) == (1.75, 3.0, 5.0)


def test_k1_satisfaction(spark):
    df = spark.createDataFrame([(25.0, 60.0, 75.0)], "n double, w double, u double")
    parts = K.satisfaction_index(F.col("n"), F.col("w"), F.col("u"))
    assert math.isclose(df.select(parts["score"]).first()[0], 57.5)


def test_k3_staffing_status(spark):
    rows = [(0, 7.0), (1, 10.0), (2, 13.0), (3, 2.0)]
    df = spark.createDataFrame(rows, "hour int, pacientes_llegando double")
    out = K.staffing_plan(df).orderBy("hour").collect()
    assert [(r.needed_doctors, r.status) for r in out] == [(3, "normal"), (4, "warning"), (5, "saturated"),
                                                          (1, "underutilized")]
    assert out[1].recommendation.startswith("Activar apoyo de emergencia. Mover 1 ")


def test_m4_expanding_folds(spark):
    df = spark.range(12).withColumnRenamed("id", "t")
    out = SP.expanding_folds(df, ["t"], 5).orderBy("t").collect()
    assert out[0].fold_size == 2
    assert [r.fold for r in out] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_m2_exact_sizes(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(103)], "id int, y int")
    s = SP.stratified_split(df, "y", ["id"], 0.2, 42)
    sizes = {(r.y, r.is_test): r.n for r in s.groupBy("y", "is_test").agg(F.count("*").alias("n")).collect()}
    assert sizes[(1, True)] == round(26 * 0.2) and sizes[(0, True)] == round(77 * 0.2)


def test_hour_floor_and_durations_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    rows = [(dt.datetime(2024, 3, 10, 1, 50), dt.datetime(2024, 3, 10, 2, 10))]  # 02:10 is in a New York DST gap
    try:
        out = []
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
            out.append(tuple(df.select(CAL.floor_hour("b"), P.minutes_between("a", "b")).first()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert out[0] == out[1] == (dt.datetime(2024, 3, 10, 2, 0), 20.0)
