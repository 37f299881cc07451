"""Sources and sinks (S1-S9) on a scratch folder under the checkpoint dir."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from careflow.session import checkpoint_dir
from careflow.sources import io as IO

SF = "/root/testdata/sf0.001"


def _path(spark, name):
    return f"{checkpoint_dir(spark)}/test-io/{name}-{uuid.uuid4().hex}"


def test_guarded_scan_missing_path(spark):
    df = IO.read_if_exists(spark, f"{SF}/does_not_exist.parquet", "a bigint, b string")
    assert df.count() == 0 and df.columns == ["a", "b"]


def test_parquet_json_csv_roundtrips(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, "y")], "fold int, MAE double, tag string")
    for write, read in ((IO.write_table, lambda p: IO.read_table(spark, p)),
                        (IO.write_json, lambda p: IO.read_json(spark, p, df.schema)),
                        (IO.write_csv, lambda p: IO.read_csv(spark, p, df.schema))):
        p = _path(spark, "rt")
        write(df, p)
        assert sorted(map(tuple, read(p).select(*df.columns).collect()), key=repr) == \
            sorted(map(tuple, df.collect()), key=repr)


def test_prediction_log_and_history(spark):
    p = _path(spark, "log")
    scored = spark.createDataFrame([("m1", 0.7), ("m2", 0.2)], "med string, prob double")
    IO.append_predictions(scored, p, "ana")
    IO.append_predictions(scored, p, "ana")
    log = spark.read.parquet(p)
    assert log.count() == 4 and set(log.columns) >= {"username", "timestamp", "date"}
    hist = spark.createDataFrame([("u", dt.datetime(2024, 1, d), d) for d in range(1, 6)],
                                 "username string, timestamp timestamp_ntz, id int")
    out = IO.prediction_history(hist, "u", 2, id_col="id").collect()
    assert [r.id for r in out] == [5, 4]


def test_output_audit(spark):
    rep = IO.output_audit(spark, {"orders": f"{SF}/orders.parquet", "nope": f"{SF}/nope.parquet"})
    rows = {r.dataset: (r.exists, r.rows, r.columns) for r in rep.collect()}
    assert rows["orders"] == (True, spark.read.parquet(f"{SF}/orders.parquet").count(), 6)
    assert rows["nope"] == (False, None, None)


def test_spread_only_narrow_scans(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    wide = df.repartition(spark.sparkContext.defaultParallelism * 2)
    assert IO.spread(wide) is wide
    assert IO.spread(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert IO.spread(df.coalesce(1)).filter(F.col("value") > 0).count() == df.filter(F.col("value") > 0).count()


def test_one_row_group_in_many_cuts_is_spread(spark):
    path = "/root/testdata/sf0.01/events.parquet"  # one row group, which goes whole to one of the cuts
    held = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        want = spark.sparkContext.defaultParallelism
        df = IO.read_table(spark, path)
        assert df.rdd.getNumPartitions() >= want and df.select(F.spark_partition_id()).distinct().count() == 1
        out = IO.read_table(spark, path, balance=True)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == want and max(sizes) * want < 1.5 * sum(sizes)
        assert out.exceptAll(df).count() == 0 and sum(sizes) == df.count()
        empty = df.where("false")
        assert IO.spread(empty).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
