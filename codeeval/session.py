"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every job in this package is written for.  AQE re-plans joins
# and shuffle partition counts at runtime and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the streaming dedup's state is the hash ledger: keep it in RocksDB
    # (bundled with Spark) rather than on the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # eager checkpoints (ordinals, J2's hash set) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "codeeval", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    # local mode: the driver JVM is the executor, so this is the memory knob
    conf.setdefault("spark.driver.memory", os.environ.get("CODEEVAL_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only
    where neither is set and everything runs in one process (a ``local``
    master) a folder of our own is chosen; on a cluster that is an error, as
    executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- no SparkContext on a Connect session
        sc = None
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join("/tmp", f"codeeval-checkpoints-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder, unique per call."""
    path = os.path.join(shared_dir(spark), "codeeval", f"{name}-{uuid.uuid4().hex}")
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process has written so far; call it once
    their results are no longer read.  Returns how many there were."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        at = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n
