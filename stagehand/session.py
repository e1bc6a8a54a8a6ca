"""Session helpers: a sane local session for tests/bench and a shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "stagehand", checkpoint_dir: str | None = None) -> SparkSession:
    """Local session used by tests and bench. A cluster job gets its session from
    the cluster (and its shared ``spark.checkpoint.dir``); nothing here is
    required for correctness."""
    b = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STAGEHAND_DRIVER_MEMORY", "8g"))
    )
    if checkpoint_dir:
        b = b.config(CHECKPOINT_CONF, checkpoint_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is only read. Only
    when nothing is configured (a local test run) is a folder created and set
    as the context's checkpoint directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf = sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf:
        if not sc.master.startswith("local"):
            # a machine-local folder is lost with its executor: refuse rather than guess
            raise RuntimeError(f"{CHECKPOINT_CONF} is not set; a cluster job needs a shared folder there")
        conf = tempfile.mkdtemp(prefix="stagehand-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never machine-local on a cluster).

    Spark's checkpoint folder is already one per application; scratch tables go
    in its ``scratch`` subfolder, which ``drop_scratch`` removes when a job is done.
    """
    return f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables (call once every result is written:
    frames read from scratch are lazy and need their files until then)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir().rstrip('/')}/scratch")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str):
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage so a frame used by many downstream checks is computed once,
    and survives executor loss (unlike a cache or a local checkpoint).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
