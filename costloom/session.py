"""Session set-up shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Session settings the package relies on: day buckets and clock rules are defined in UTC, and ranked
# filters up to this many rows per key are applied before the shuffle too.
PINNED = {"spark.sql.session.timeZone": "UTC", "spark.sql.optimizer.windowGroupLimitThreshold": "2000"}

BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def pin_utc(spark: SparkSession) -> SparkSession:
    for key, value in PINNED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes too: ten thousand long texts in one batch are tens of megabytes, several times over, on
    both sides of a Python worker. A bound that the session has been given stays."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    return spark


STATE_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streaming queries started inside keep their state in RocksDB, whatever the session's own setting is: lists and timers
    need it. A query copies its settings as it starts, so the session gets its own back at once."""
    own = spark.conf.get(STATE_KEY, None)
    spark.conf.set(STATE_KEY, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_KEY, own) if own is not None else spark.conf.unset(STATE_KEY)


def build_session(master: str | None = None, app: str = "costloom", **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling; `conf` overrides any key (dots as `__`)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Streaming state (envelope hashes, admission windows) lives on disk, not in executor heap.
        .config(STATE_KEY, ROCKSDB)
        # Call-site capture costs more than analysing these plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is set, a local master gets a fresh folder of its own; on a cluster that is an error, since executors
    and driver would each write to their own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder: master {master} has no common disk")
        shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table under the shared checkpoint folder and reads it back.

    For results used several times, or whose lineage must not grow: a lost executor rereads the files
    instead of replaying the job, and scans still prune columns.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/costloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


_staged: list[str] = []


def clear_staged(spark: SparkSession) -> int:
    """Deletes all tables staged so far and returns their number; for the end of a job, when results are written."""
    done = 0
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        done += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return done
