"""Session settings the engine relies on.

ANSI mode stays on (bad casts must be explicit ``try_*`` calls), the session
time zone is UTC (all timestamps are TIMESTAMP_NTZ anyway), AQE is on for
runtime partition coalescing and skew-join splitting.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a post-shuffle partition and of a scan split.
PARTITION_BYTES = 256 << 20

# Fixed settings every session of the engine gets.
ENGINE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Partition sizes for large inputs: scan splits and post-shuffle partitions
    # of about 256 MB fit comfortably in executor memory; AQE coalesces small
    # ones and splits skewed join partitions above 5x the median.
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    # A persisted frame's partitions are merged like any others (Spark leaves them at the number of
    # shuffle partitions): what reads it has as few tasks, its shuffles and files as few pieces.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tally", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's settings.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings on an existing session (e.g. the driver's)."""
    for k, v in ENGINE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; make a scratch one only in local mode.

    On a cluster the shared folder is named by ``spark.checkpoint.dir`` and
    used as is; without one, lineage cannot be cut safely, so this fails
    rather than fall back to a machine-local folder.  Local runs and tests
    get a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="tally-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: cuts lineage, fixes what chance decided."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tally-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions_for(input_bytes: int, least: int = 1) -> int:
    """Partitions that hold ``PARTITION_BYTES`` of the input each, at least ``least``."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def size_shuffles(spark: SparkSession, paths: list[str] | str) -> int:
    """Raise ``spark.sql.shuffle.partitions`` to fit the files at ``paths``; AQE merges, but never adds partitions."""
    total = 0
    for path in [paths] if isinstance(paths, str) else paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(p) or []:
            total += fs.getContentSummary(found.getPath()).getLength()
    n = shuffle_partitions_for(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n
