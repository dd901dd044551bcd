"""Session construction and the shared staging folder.

Staged outputs (written samples, text files, lineage cuts) go under the folder
named by ``spark.checkpoint.dir``.  On a cluster that must be a shared file
system; only a local-mode session without the setting gets a temporary folder
of its own (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "impressa",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    d = None
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - conf lookup differs across deployments
        d = None
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    return d or None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only in local mode."""
    d = _configured_dir(spark)
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/GCS) before staging data on a cluster")
    d = tempfile.mkdtemp(prefix="impressa-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def staging_root(spark: SparkSession) -> str:
    """The folder of all that this application stages."""
    return os.path.join(checkpoint_root(spark), "staging", spark.sparkContext.applicationId)


def staging_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the checkpoint root for one staged output."""
    return os.path.join(staging_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
