"""Session helpers.

Library code never creates a session; tests, the bench and command-line
use call :func:`build_session`. :func:`checkpoint_dir` honours the
cluster's ``spark.checkpoint.dir`` and sets a scratch folder only when a
local session has none (tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.ansi.enabled": "true",
    "spark.driver.memory": "12g",
    # checkpoint files go when their DataFrame does
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "careflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; set one only if unset.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is; without it a cluster session is refused. Only a session with
    a ``local`` master gets a fresh scratch folder, registered so that
    ``DataFrame.checkpoint()`` works.
    """
    sc = spark.sparkContext
    current = (spark.conf.get("spark.checkpoint.dir", None)
               or sc.getConf().get("spark.checkpoint.dir", None)
               or sc.getCheckpointDir())
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="careflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path
