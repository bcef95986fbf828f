"""Spark session helpers.

The library never creates a session behind the caller's back; these helpers are
for tests, the bench and command-line use.  Cluster deployments pass their own
session, and every operator only needs a ``DataFrame``.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every session of this project should carry.  AQE re-plans joins and
# coalesces shuffle partitions at run time; skew-join splitting is on by default
# with AQE and matters for hot merchants / duplicated order ids.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
    # PySpark records the Python call site of every Column call for error
    # messages (several JVM round trips per call); query plans are unaffected.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# JVM options of the local (single-JVM) session only; cluster JVMs are configured
# by the deployment.
LOCAL_JAVA_OPTIONS = "-XX:+UseParallelGC"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "16g"))
    java_opts = os.environ.get("LEDGERLENS_DRIVER_JAVA_OPTIONS", LOCAL_JAVA_OPTIONS)
    if java_opts:
        conf.setdefault("spark.driver.extraJavaOptions", java_opts)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment (a shared file system); an unset one
    is an error there.  A local session, as in tests, gets a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``'s application, also
    where it is not installed: Spark copies one zip of its sources to every executor.
    Operators that run Python in tasks call it; the first call of an application counts.
    An installed package is taken to be installed everywhere."""
    sc = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _shipped or f"{os.sep}site-packages{os.sep}" in here:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-src-"), f"{os.path.basename(here)}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def cluster_conf(total_cores: int, *, shuffle_partition_mb: int = 256, split_mb: int = 256) -> dict[str, str]:
    """Suggested settings for a large cluster (pass to the session builder).

    * Shuffles start with many partitions (4 per core) and AQE coalesces them to
      ``shuffle_partition_mb`` each, so small group-by results do not spawn
      thousands of empty tasks while big joins still spread out.
    * Skew-join splitting triggers for partitions 5x the median and over 512 MiB
      (a hot merchant, day or duplicated id).
    * File splits of ``split_mb``: Parquet row groups and CSV splits sized for one
      task's memory; CSV day files stay splittable (no ``multiLine``).
    * Broadcasts stay under Spark's own size check (``autoBroadcastJoinThreshold``).
    """
    conf = dict(BASE_CONF)
    conf.pop("spark.ui.enabled", None)
    conf.pop("spark.ui.showConsoleProgress", None)
    conf.update({
        "spark.sql.shuffle.partitions": str(4 * total_cores),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(4 * total_cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{shuffle_partition_mb}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.files.maxPartitionBytes": f"{split_mb}m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    })
    return conf
