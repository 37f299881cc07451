"""Readers and writers.

Paths are plain strings understood by Hadoop file systems (local, HDFS,
object stores); existence checks go through the JVM's Hadoop FileSystem
of the session, never the driver's local disk.
"""

from __future__ import annotations

import uuid
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


#: rows of a task that spread rows are dealt to, where the cluster's cores are too few for them
_TASK_ROWS = 1_000_000


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy row-wise work enough tasks.

    A scan of few large row groups yields fewer tasks with rows than the
    cluster has cores, and everything before the first shuffle then runs
    in those few tasks. Only in that case the rows are spread round-robin
    over ``min_partitions`` (default: the session's default parallelism), or
    more of a million rows each; scans whose largest task is at most a quarter
    above an even share (the large-data case) are left as they are.
    Files are cut by bytes, and a row group goes whole to one of its cuts, so
    partitions tell nothing of the work: where they are enough, the rows of
    each are counted. Of a parquet scan that reads the footers alone.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        tasks = df.groupBy(F.spark_partition_id().alias("task")).count()
        rows, largest = tasks.agg(F.sum("count"), F.max("count")).first()
        if not rows or largest * want <= 1.25 * rows:
            return df
        want = max(want, -(-rows // _TASK_ROWS))
    # The observed row count (a CollectMetrics node) also keeps predicates on
    # derived columns above the spread, so parsing in those predicates runs in
    # the spread tasks instead of the narrow scan; column pruning still
    # reaches the scan. Wide scans never get here and keep full pushdown.
    return df.repartition(want).observe(f"careflow_spread_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               balance: bool = False) -> DataFrame:
    """Parquet scan of a named dataset, with an explicit schema when
    given (no inference job; unknown columns fail at analysis). Filters
    and projections reach the scan. ``balance``, for costly row-wise work on
    files of few row groups, spreads a narrow scan (:func:`spread`); nothing
    in the library asks for it by itself."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    return spread(df) if balance else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Parquet sink per stage (overwrite), optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_if_exists(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S3: guarded scan: a missing path gives an empty DataFrame with the
    declared schema instead of an error."""
    if _fs_exists(spark, path):
        return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """Metrics document(s) as JSON lines (one file)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Metrics documents back (schema optional)."""
    r = spark.read
    return (r.schema(schema) if schema is not None else r).json(path)


def model_report(spark: SparkSession, documents: Mapping[str, str]) -> DataFrame:
    """K6: stored metric documents (S4) in one report, a row for each with its
    name as ``model``; fields that a document lacks are null, and so are all
    fields of one that isn't there."""
    out = None
    for name, path in documents.items():
        if _fs_exists(spark, path):
            part = read_json(spark, path).withColumn("model", F.lit(name))
        else:
            part = spark.createDataFrame([(name,)], "model string")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Trial log as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Trial log with a declared schema (no inference)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def append_predictions(df: DataFrame, path: str, username: str, ts_col: str = "timestamp",
                       batch_id: str | None = None, at: str | None = None) -> str:
    """Append scored rows with user and time; returns the batch's id.

    Every batch is a partition of its own (``batch``, then ``date``), written
    whole: a write that is tried again under its ``batch_id`` takes the place
    of what an earlier attempt left, and adds nothing. ``at`` is the time of
    the batch (default: now), the same for all its rows.
    """
    batch_id = batch_id or uuid.uuid4().hex
    if not batch_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a batch id has letters, digits, - and _ only")
    time = F.lit(at).cast("timestamp_ntz") if at else F.current_timestamp().cast("timestamp_ntz")
    out = df.withColumn("username", F.lit(username)).withColumn(ts_col, time).withColumn("date", F.to_date(ts_col))
    out.write.mode("overwrite").partitionBy("date").parquet(f"{path.rstrip('/')}/batch=b-{batch_id}")
    return batch_id


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The prediction log, with ``batch`` and ``date`` as partition columns."""
    return spark.read.option("basePath", path).parquet(path)


def prediction_history(log: DataFrame, username: str, limit: int = 50, ts_col: str = "timestamp",
                       id_col: str | None = None, user_col: str = "username", date_col: str | None = None) -> DataFrame:
    """One user's predictions, newest first, at most ``limit`` rows
    (a top-k: the feature is the limit).

    With ``date_col``, the partition column of the time's date, only the
    newest dates that hold enough of the user's rows are read: twice as many
    in each step, until the limit is filled or no dates are left.
    """
    mine = log.filter(F.col(user_col) == username)
    if date_col:
        dates = [r[0] for r in log.select(date_col).distinct().orderBy(F.desc(date_col)).collect()]  # a row a day
        take = 1
        while take < len(dates):
            newest = mine.filter(F.col(date_col) >= F.lit(dates[take - 1]))
            if newest.limit(limit).count() >= limit:
                mine = newest
                break
            take *= 2
    order = [F.desc(ts_col)] + ([F.desc(id_col)] if id_col else [])
    return mine.orderBy(*order).limit(limit)


def output_audit(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """For every expected dataset: exists?, rows and columns.

    Row counts are one aggregate per present dataset, unioned into one
    plan (parquet answers counts from footers); column counts come from
    the schema.
    """
    parts = []
    for name, path in paths.items():
        if _fs_exists(spark, path):
            df = spark.read.parquet(path)
            parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("dataset"), F.lit(True).alias("exists"), "rows",
                F.lit(len(df.columns)).cast("long").alias("columns")))
        else:
            parts.append(spark.createDataFrame([(name, False, None, None)],
                                               "dataset string, exists boolean, rows bigint, columns bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline (model with its transformers)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a fitted pipeline."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
