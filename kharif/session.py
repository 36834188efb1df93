"""Session construction and the shared scratch location.

Cluster runs pass their own settings; ``build_session`` only fills the
defaults used for local tests and the bench.  Anything written to disk goes
below the checkpoint directory the cluster names (``spark.checkpoint.dir``),
never to a machine-local temp folder, so a lost executor cannot lose it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "kharif",
    driver_memory: str = "16g",
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory; create one only when unset.

    A cluster names the shared folder in ``spark.checkpoint.dir``; local
    tests have none, so a fresh directory is made for them.  On any other
    master a missing setting is an error: executors do not share the driver's
    disk, and stages written there would be lost.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="kharif-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and
    read it back.

    The lineage ends at the written table, so a lost executor re-reads files
    instead of recomputing upstream joins, and later branches (fits, bounds,
    medians) scan a small columnar table with column pruning.  Unlike an
    unpersisted ``checkpoint()``, the input is computed only once.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fitted(df: DataFrame, name: str = "fitted") -> DataFrame:
    """Fitted statistics (medians, bounds, encoder codes...) as a small written
    table, whatever their number.

    Nothing passes the driver, upstream work is done once, and Catalyst sizes
    the join from the table's files (broadcast while small, else by shuffle).
    """
    return cut_lineage(df, name)
