"""Properties from the survey's test strategy."""

from pyspark.sql import functions as F

from careflow.checks import q_clean as QC
from careflow.checks import q_kpi as QK
from careflow.functions import text as T
from careflow.operators import joins as J
from careflow.operators import timeseries as TS
from careflow.plans import integration as I

SF = "/root/testdata/sf0.001"


def test_joins_keep_row_count(spark):
    a = QC.appts(spark, SF)
    enc = J.keep_earliest(QC.encs(spark, SF), I.APPOINTMENT_KEYS, "registration_datetime", QC.ENC_TIES)
    j1 = J.left_join_keys(a, enc, I.APPOINTMENT_KEYS)
    assert j1.count() == a.count()
    j2 = J.left_join_on(j1, QC.pats(spark, SF), "p_num_exp_key", "m_num_exp_key")
    assert j2.count() == a.count()


def test_cleaning_idempotent(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source")
    once = d.select(T.strip_text("lang").alias("lang"))
    twice = once.select(T.strip_text("lang").alias("lang"))
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)


def test_satisfaction_in_range(spark):
    k = QK.k1_kpi_table(spark, SF).first()
    assert 0 <= k.satisfaction_score <= 100


def test_leak_free_diff_ignores_current_row(spark):
    df = spark.createDataFrame([(t, float(t * t)) for t in range(40)], "t int, y double")
    a = TS.add_diffs(df, "y", ["t"]).orderBy("t").collect()
    b = TS.add_diffs(df.withColumn("y", F.when(F.col("t") == 30, 1e9).otherwise(F.col("y"))), "y", ["t"]) \
        .orderBy("t").collect()
    assert a[30].diff_1h == b[30].diff_1h and a[30].diff_24h == b[30].diff_24h


def test_partition_count_invariance(spark):
    from __spark_entry__ import queries
    qs = queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append([sorted(map(tuple, qs[q](spark, SF).collect()), key=repr)
                            for q in ("c6_no_show_base", "c9_demand_features", "d3_keep_earliest")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
