"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import math
import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "ledgerlens", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    Master, driver memory and shuffle partitions are set only when an argument
    or an environment variable names them: settings made here would outrank
    the submit command's.
    * UTC session time zone: day arithmetic must not move with DST.
    * AQE on, with skew-join splitting and partition coalescing: hot
      customers / baskets are split at run time, tiny stages are merged.
    * Spark UI off: no server is opened.
    """
    chosen = {
        "spark.master": master or os.environ.get("LEDGERLENS_MASTER"),
        "spark.driver.memory": os.environ.get("LEDGERLENS_DRIVER_MEMORY"),
        "spark.sql.shuffle.partitions": shuffle_partitions or os.environ.get("LEDGERLENS_SHUFFLE_PARTITIONS"),
    }
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in chosen.items():
        if value:
            builder = builder.config(name, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on, applied to a caller's session:
    UTC day arithmetic and a checkpoint folder (the cluster's own when set)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


#: Shuffle bytes that one task reads, table bytes for each partition of a shuffle, and file bytes that one task scans.
TASK_BYTES, TABLE_BYTES, SCAN_BYTES = 8 << 20, 4 << 20, 16 << 20
ADVISORY, INITIAL = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SCAN = "spark.sql.files.maxPartitionBytes"


def size_shuffles(spark: SparkSession, paths: list[str]) -> None:
    """Shuffles over the tables at ``paths`` get partitions in proportion to the
    tables' bytes, so that the sorts and hash tables of a task stay as small
    however large the tables are.

    Adaptive execution merges partitions up to its advisory size, 64 MB of
    packed rows by default, which grow tenfold and more once sorted and hashed.
    So do files: a scan's task combines all keys of its part, up to 128 MB by
    default, before they are shuffled.  A caller's advisory size and scan size
    stay; a number of partitions is only raised.
    """
    for name, size in ((ADVISORY, TASK_BYTES), (SCAN, SCAN_BYTES)):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, size)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).agg(F.sum("length"))
    needed = math.ceil((sizes.collect()[0][0] or 0) / TABLE_BYTES)
    if needed > int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, needed)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is; without it an error is raised, since executors do not see the
    driver's disk.  Only a local session gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing: dict = {"n": 0, "before": None, "lock": threading.Lock()}


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that run meanwhile, in any thread, delete their shuffle files when they end."""
    with _freeing["lock"]:
        if not _freeing["n"]:
            _freeing["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _freeing["n"] += 1
    try:
        yield
    finally:
        with _freeing["lock"]:
            _freeing["n"] -= 1
            if not _freeing["n"]:
                spark.conf.unset(CLEANUP) if _freeing["before"] is None else spark.conf.set(CLEANUP, _freeing["before"])


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written to the shared checkpoint folder and read again.

    Cuts lineage as ``checkpoint()`` does, and the plan's size estimates start
    anew from the files, which loops need.  The shuffles of the rows are never
    read again: their files go at once, not when the driver collects its garbage.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
