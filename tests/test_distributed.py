"""The distributed forms agree with
plain single-window / pandas computations."""

import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from careflow.operators import metrics as ME
from careflow.operators import ordering as O
from careflow.operators import timeseries as TS


def test_global_index_dense(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "k int, v int")
    idx = O.global_index(df, ["k", "v"])
    got = [(r.k, r.v, r._rn) for r in idx.orderBy("_rn").collect()]
    exp = sorted((k, v) for k, v in [(i % 7, i) for i in range(200)])
    assert [(a, b) for a, b, _ in got] == exp
    assert [r for *_, r in got] == list(range(1, 201))


def test_index_over_many_types_and_zones(spark):
    df = spark.sql("""select timestamp_ntz'2024-03-10 02:30:00.123456' + make_dt_interval(0, 0, 0, id / 1000000) t, id,
                      timestamp'2024-11-03 05:59:59.9Z' + make_dt_interval(0, 0, 0, id / 100) z,
                      date'2020-01-01' + int(id % 3) d, cast(cast(id as string) as binary) b, array(id % 2, id) r,
                      cast(id as decimal(20, 3)) c, if(id % 9 = 0, double('NaN'), id / 7) f from range(150)""")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for order in (["t"], ["z"], ["d", "t"], ["b"], ["r"], ["c"], ["f", "id"]):
            got = O.global_index(df, order, num_partitions=7).select("_rn", "id").orderBy("_rn").collect()
            assert [r._rn for r in got] == list(range(1, 151))
            assert [r.id for r in got] == [r.id for r in df.orderBy(*order).select("id").collect()], order
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_parts_are_even_under_hot_and_null_keys(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as g", "id")
    part = O.part_of(df, [F.col("g"), F.col("id")], 9)
    sizes = [r[1] for r in df.groupBy(part.alias("p")).count().collect()]
    assert len(sizes) == 9 and max(sizes) < 500
    got = [r.id for r in O.global_index(df, ["g", "id"], num_partitions=9).orderBy("_rn").collect()]
    assert got == [r.id for r in df.orderBy("g", "id").collect()]


def test_index_of_few_or_equal_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 20, "k int, v string")
    assert sorted(r._rn for r in O.global_index(df, ["k", "v"], num_partitions=5).collect()) == list(range(1, 21))
    assert O.global_index(df.limit(0), ["k"]).collect() == []
    assert [r._rn for r in O.global_index(df.limit(1), ["k"]).collect()] == [1]


def test_exact_quantiles_distributed_match_pandas(spark):
    rng = random.Random(1)
    rows = [(g, rng.random() * 100) for g in ("a", "b", "c") for _ in range(rng.randint(5, 40))]
    rows += [("hot", float(i % 13)) for i in range(300)]  # one hot group with ties
    df = spark.createDataFrame(rows, "g string, x double")
    q = O.exact_quantiles(df, ["g"], "x", [0.25, 0.5, 0.75]).collect()
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for r in q:
        assert abs(r.value - pdf[pdf.g == r.g].x.quantile(r.q)) < 1e-9


def test_halo_windows_match_plain_window(spark):
    rows = [(s, t, float((t * 7 + s) % 11)) for s in (1, 2) for t in range(90)]
    df = spark.createDataFrame(rows, "s int, t int, y double")
    got = TS.add_lags(df, "y", [1, 5], ["t"], series=["s"], block_rows=10)
    got = TS.add_rolling(got, "y", [3], ["t"], series=["s"], block_rows=10)
    w = Window.partitionBy("s").orderBy("t")
    exp = df.select("s", "t", F.lag("y", 1).over(w).alias("lag_1h"), F.lag("y", 5).over(w).alias("lag_5h"),
                    F.avg("y").over(w.rowsBetween(-3, -1)).alias("roll_mean_3h"))
    a = sorted((r.s, r.t, r.lag_1h, r.lag_5h, r.roll_mean_3h) for r in got.collect())
    b = sorted((r.s, r.t, r.lag_1h, r.lag_5h, r.roll_mean_3h) for r in exp.collect())
    assert a == b


def test_prefix_sums_and_auc(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    auc = ME.roc_auc(df, "y", "s").first()[0]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    mw = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - mw) < 1e-12
    # monotone transform of scores leaves AUC unchanged
    auc2 = ME.roc_auc(df.withColumn("s", F.col("s") * 3 + 1), "y", "s").first()[0]
    assert abs(auc - auc2) < 1e-12


def test_running_max_distributed(spark):
    vals = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = spark.createDataFrame(list(enumerate(vals)), "t int, v int")
    out = TS.running_max(df, "v", ["t"], num_partitions=3).orderBy("t").collect()
    best = []
    m = None
    for v in vals:
        m = v if m is None else max(m, v)
        best.append(m)
    assert [r.best_so_far for r in out] == best
    assert [r.is_best for r in out] == [1, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0]


def test_lookahead_sequences_distributed(spark):
    rows = [(t, float(t % 9)) for t in range(60)]
    df = spark.createDataFrame(rows, "t int, y double")
    got = TS.sequences(df, "y", ["t"], 4, 3, block_rows=7).orderBy("t").collect()
    ys = [y for _, y in rows]
    exp = [(t, ys[t - 4:t], ys[t:t + 3]) for t in range(4, 60 - 2)]
    assert [(r.t, list(r.x_seq), list(r.y_seq)) for r in got] == exp


def test_patients_keep_the_first_row_in_file_order(spark, tmp_path):
    from careflow.plans.cleaning import clean_patients
    rows = [("1", "B", "20"), ("1", "A", "99"), ("2", "C", "30")]
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame(rows, "m_num_exp string, m_sexo string, m_edad string").coalesce(1).write.parquet(path)
    raw = spark.read.parquet(path).select("m_num_exp", "m_sexo", "m_edad")
    got = {r.m_num_exp_key: (r.m_sexo, r.m_edad_num) for r in clean_patients(raw).collect()}
    assert got["1"][1] == 20 and got["2"][1] == 30


def test_quantiles_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0), ("b", None)], "g string, x double")
    got = {(r.g, r.q): r.value for r in O.exact_quantiles(df, ["g"], "x", [0.5, 1.0]).collect()}
    assert got == {(None, 0.5): 1.5, (None, 1.0): 2.0, ("a", 0.5): 5.0, ("a", 1.0): 5.0}


def test_resampling_evaluates_its_input_once(spark):
    from careflow.operators import hourly as H
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for out in (H.resample_hourly_mean(e, "ts", "value"), H.resample_hourly_count(e, "ts")):
        assert out.inputFiles() == []  # hours and spine come from the written hours
        lo, hi = e.selectExpr("min(date_trunc('hour', ts)) lo", "max(date_trunc('hour', ts)) hi").first()
        assert out.count() == (hi - lo).total_seconds() // 3600 + 1
