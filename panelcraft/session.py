"""Session settings and lineage helpers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, app: str = "panelcraft", extra: dict | None = None
) -> SparkSession:
    """A session with the settings the library is designed for.

    By default the master, memory and ``spark.sql.shuffle.partitions`` stay as ``spark-submit``
    or the cluster gives them (size shuffle partitions to about 128-256 MB each); pass
    ``master`` and ``shuffle_partitions`` for local work.
    """
    builder = SparkSession.builder
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    if master:  # None: keep the master given by spark-submit / the cluster
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(256 * 1024 * 1024))
        # draws of up to this many rows per group are limited before their shuffle
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A scratch folder is picked only under a ``local`` master, where driver and executors are
    one process; elsewhere a machine-local folder could not be read by the other executors,
    so a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelcraft-ckpt-"))
    else:
        raise ValueError(f"spark.checkpoint.dir is not set: master {sc.master} needs a folder that all executors share")


def freeze(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint folder and cut its lineage.

    Used where later steps must see exactly the same partition assignment (a sampled
    range partitioning): a lost executor then re-reads the checkpoint instead of
    recomputing a possibly different assignment.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
