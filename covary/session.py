"""Session helpers.

Library operators never create a session: they take DataFrames. These
helpers exist for tests, the benchmark and the driver entry point.
"""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import SparkSession

# Settings every session of ours relies on. AQE re-plans joins from runtime
# sizes (a small shuffled side becomes a broadcast, skewed partitions are
# split) and coalesces small shuffle partitions.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of intermediates are deleted once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "covary", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(CORE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def materialize(df):
    """Write a small intermediate that several branches of a plan read to the
    reliable checkpoint folder, so the facts behind it are scanned once and a
    lost executor re-reads the files instead of recomputing the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    # A reliable checkpoint writes its files in a second job; without a
    # persisted input that job recomputes the whole plan. The copy kept
    # (memory, spilling to disk) lives only until the files are written.
    # A frame that the caller has cached stays cached.
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        return df.checkpoint(eager=True)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    file system) and is required. Only a local-mode session that names none,
    as in a bare test, gets a fresh folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            configured = None
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster "
                             "(checkpoints and scratch tables are written there)")
        configured = tempfile.mkdtemp(prefix="covary-ckpt-")
    # the folder is made by the file system it is on
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
