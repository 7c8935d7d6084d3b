"""SparkSession helpers for tests, bench and command-line runs.

Library operators never build a session themselves; they take DataFrames.
This module only centralises the settings every entry point wants:
UTC session time zone, AQE with partition coalescing and skew-join handling,
no web UI, and a checkpoint directory that is read from the session and only
defaulted when the cluster has not named one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
METHOD_CONF = "spark.sql.codegen.hugeMethodLimit"


def build_session(
    app: str = "coffer",
    cpus: int | str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local session with the settings the operators are tuned for.

    On a cluster, submit with the cluster's own master and leave
    ``spark.sql.shuffle.partitions`` to AQE (initial partition count sized
    for the largest stage, coalesced at run time).
    """
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.driver.memory", os.environ.get("COFFER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the JVM compiles no method above 8,000 bytes: longer generated ones run in its interpreter
        .config(METHOD_CONF, "8000")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def compiled_methods(spark: SparkSession) -> None:
    """Sets the JVM's own limit for generated methods where the session has Spark's default.

    The JVM compiles no method above 8,000 bytes. With the default of 65,535
    wide projections become one longer method, which its interpreter runs; with
    this limit Spark cuts them up. A session's own setting stays.
    """
    if spark.conf.get(METHOD_CONF, None) in (None, "65535"):
        spark.conf.set(METHOD_CONF, "8000")


_SCRATCH: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint directory, remembered for ``cleanup``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library made, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cleanup(spark: SparkSession) -> int:
    """Removes the folders that this application's operators staged data in; returns how many.

    DataFrames that read from them (results that were not written elsewhere)
    cannot be used afterwards. Call it between runs of a long application.
    """
    made = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in made:
        remove_folder(spark, path)
    return len(made)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory named by the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    always used. Only when it is unset (local tests) is a scratch folder
    created and registered; elsewhere executors would each write to a disk
    of their own, so a missing setting is an error.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors of {master} share")
    path = tempfile.mkdtemp(prefix="coffer-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path
