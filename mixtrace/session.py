"""Spark session and lineage helpers.

Library code never invents a storage location on a cluster: the shared folder
for lineage cuts comes from ``spark.checkpoint.dir`` (or the SparkContext's
checkpoint dir).  Only a ``local[...]`` master (tests, bench) gets a fresh
scratch folder when none is configured.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "mixtrace") -> SparkSession:
    """Session used by tests and bench; a cluster passes its own session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    partitions = partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # superseded checkpoints (per-step parameter tables) are deleted once
        # nothing references them, so iterative jobs do not fill the folder
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  When it is unset and the
    master is local (tests), a scratch folder is created and registered; on a
    cluster an unset value is an error, because a machine-local folder would
    not survive the loss of the executor that wrote it.  A ``file:`` folder may
    be a mount that all machines share; on a cluster that is tried out once.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        folder = sc.getCheckpointDir().rstrip("/")
        if folder.startswith("file:") and not sc.master.startswith("local"):
            _require_shared(spark, folder)
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
    path = tempfile.mkdtemp(prefix="mixtrace-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return sc.getCheckpointDir().rstrip("/")


#: ``file:`` folders (Spark names one per context) that were found to be shared.
_SHARED: set[str] = set()


def _require_shared(spark: SparkSession, folder: str) -> None:
    """Error unless rows that tasks write under ``folder`` are all read again.

    Of a machine-local folder the driver sees its own machine's files only; a
    later read with a given schema would then lack rows without an error.
    """
    if folder in _SHARED:
        return
    n = 2 * spark.sparkContext.defaultParallelism
    path = f"{folder}/shared-{uuid.uuid4().hex[:12]}"
    spark.range(0, n, 1, n).write.parquet(path)
    try:
        seen = spark.read.schema("id long").parquet(path).count()
    except Exception as e:  # a task lacks a file that the driver lists
        raise RuntimeError(f"spark.checkpoint.dir is a machine-local folder on a cluster: {folder}") from e
    if seen != n:
        raise RuntimeError(f"spark.checkpoint.dir is a machine-local folder on a cluster: {folder}")
    _SHARED.add(folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder and drop its lineage.

    Reliable checkpoint (not a local one): the files live in the shared folder,
    so a lost executor does not force a recomputation from the source scans.
    The partition count is kept; the hash partitioning is not (under AQE the
    checkpointed plan reports an unknown partitioning), so a later shuffle
    join on the same keys shuffles both sides again - broadcast joins, the
    common case in the loops, are unaffected.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder: for long tables that are
    read as they are, a small part of a checkpoint's bytes.  The files stay as
    long as the folder; their splits, not the partitions of ``df``, make the tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Size check used before broadcasting a side whose size is data-dependent."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy stage at least one task per core.

    A table of fewer files than cores may hold fewer row groups than cores,
    which bound the tasks that have rows; then a round-robin repartition pays
    off.  At scale a table has far more files and nothing is added to the
    plan.  Only the file list is looked at; nothing is executed.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < want:
        return df.repartition(want)
    return df


def shuffle_width(df: DataFrame) -> int:
    """How many tasks at least feed a shuffle of ``df``, without running it."""
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
