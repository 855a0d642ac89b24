"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that may change on a running session. Skewed join partitions are split at run time even
# where the split costs one more exchange: one thread may hold a third of all comments.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a bucket written by sources.layout is one sorted file, which a merge join reads as it stands
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _own_folder() -> str:
    """The folder of a local session; it is removed with the process."""
    folder = tempfile.mkdtemp(prefix="forumlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and for the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("forumlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FORUMLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", _own_folder())
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the checkpoint folder that the context already has.

    Only a local-mode session without either gets a folder of its own, which goes when the process ends: on a
    cluster a folder of one machine would not survive the loss of that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _own_folder()


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, so that a lost executor costs a file read and not a second full scan."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
    return df.checkpoint(eager=True)


# a side of at most so many rows and bytes is broadcast; a larger one is joined by shuffle, with the same result
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame) -> DataFrame:
    """Compute an aggregate once, measure it, and mark it for broadcast if it is as small as expected.

    Without the mark the plan would first shuffle the large side by a key that may be hot.
    """
    kept = cut_lineage(df)
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept.columns]))))
    rows, bytes_ = kept.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(kept) if rows <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES else kept
