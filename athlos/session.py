"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "athlos", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one for local runs and tests.

    On a cluster the session comes from the launcher and only ``getOrCreate`` applies; the settings here are
    the local defaults.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and we use it as given. Only when it is unset (local runs, tests)
    do we make one of our own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="athlos-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def let_workers_import(spark: SparkSession) -> None:
    """Python workers started from now on find this package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


SPREAD_ROWS = 1 << 16       # rows a partition should have at least; smaller tables stay as they are


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` checkpointed, in a partition per core at least (one per ``SPREAD_ROWS`` rows at most): iterative fits read it hundreds of
    times, and a small file or a coalesced shuffle leaves few partitions. Rows are dealt and sorted by ``key``, so a
    partition holds the same rows in the same order on every run."""
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint()
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, done.count() // SPREAD_ROWS + 1)
    if done.select(F.spark_partition_id()).distinct().count() >= wanted:        # partitions that hold rows
        return done
    return done.repartition(wanted, F.xxhash64(key)).sortWithinPartitions(key).checkpoint()
