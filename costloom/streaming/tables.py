"""Tables fed by micro-batches: one parquet folder per batch id, plus compacted snapshots.

A batch only ever (over)writes its own folder, so a retried batch leaves the same table. Because every
merge rule here gives the same result whether deliveries come at once or in pieces, the current state is
the last snapshot merged with the batches after it; nothing is rewritten per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from costloom.operators import merge


# Tables looked up by key are split into so many buckets by default. A small batch reads few of many; give a large
# lake thousands.
BUCKETS = 64


class BatchTable:
    """Rows per batch; with a `key`, each batch is further split by a hash bucket of it."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.ddl, self.key, self.buckets = spark, path.rstrip("/"), ddl, key, buckets
        self.schema = StructType.fromDDL(ddl)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self, df: DataFrame, batch_id: int) -> None:
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        target = f"{self.path}/batch_id={batch_id}"
        if self.key is None:
            rows.write.mode("overwrite").parquet(target)
            return
        # Rebalancing gathers a bucket's rows into few files and splits a bucket that holds a hot key.
        rows = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(target)

    def read(self, after: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """All batches (or those after a batch id), with their `batch_id`; empty when nothing was written.

        `only` (distinct keys) restricts a keyed table: its buckets are pruned by folder, the rest by a
        semi-join, before anything is merged.
        """
        schema = StructType.fromDDL(f"{self.ddl}, batch_id bigint" + (", bucket int" if self.key else ""))
        try:
            df = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], schema)
        if after is not None:
            df = df.where(F.col("batch_id") > after)
        if only is not None:
            buckets = [r[0] for r in only.select(self._bucket()).distinct().collect()]  # at most self.buckets
            df = df.where(F.col("bucket").isin(buckets)).join(only.select(self.key), self.key, "left_semi")
        return df.drop("bucket")


class Numbers:
    """Lake-wide numbers of (writer, batch): every writer counts its own batches from 0, tables do not.

    A number is claimed once, by creating a file that must not exist yet, and kept for ever: a retried batch gets
    its own number again and overwrites its own folder only, and no other writer ever gets it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def of(self, writer: str, batch_id: int) -> int:
        jvm = self.spark._jvm
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        at = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *p]))
        fs = at().getFileSystem(hadoop)
        name = hashlib.sha256(f"{writer}\x1f{batch_id}".encode()).hexdigest()[:40]
        known = fs.globStatus(at(f"*-{name}"))
        if known:
            return int(known[0].getPath().getName().split("-")[0])
        fs.mkdirs(at())
        taken = [int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(at())]
        number = max(taken, default=-1) + 1
        while not fs.createNewFile(at(str(number) + "-claimed")):
            number += 1
        # The claim stays, so that a number is never claimed twice.
        fs.createNewFile(at(f"{number}-{name}"))
        return number


class MergedTable:
    """A keyed state: batches plus snapshots, read through `fold(rows, state)`."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        ddl: str,
        state_ddl: str,
        fold: Callable[[DataFrame, DataFrame | None], DataFrame],
        key: str | None = None,
        buckets: int = BUCKETS,
    ):
        self.batches = BatchTable(spark, f"{path.rstrip('/')}/batches", ddl, key, buckets)
        self.snapshots = BatchTable(spark, f"{path.rstrip('/')}/snapshots", state_ddl, key, buckets)
        # Written after a snapshot's rows: a snapshot without its mark does not exist.
        self.marks = BatchTable(spark, f"{path.rstrip('/')}/marks", "complete boolean")
        self.fold = fold

    def write(self, df: DataFrame, batch_id: int) -> None:
        self.batches.write(df, batch_id)

    def _last_snapshot(self) -> int | None:
        return self.marks.read().agg(F.max("batch_id").alias("b")).first()["b"]

    def replace(self, state: DataFrame, batch_id: int) -> None:
        """Makes `state` the state as of a batch: rows first, then the mark."""
        self.snapshots.write(state, batch_id)
        self.marks.write(self.marks.spark.createDataFrame([(True,)], "complete boolean"), batch_id)

    def current(self, only: DataFrame | None = None) -> DataFrame:
        """The state of all keys, or of the given ones."""
        last = self._last_snapshot()
        if last is None:
            return self.fold(self.batches.read(only=only), None)
        state = self.snapshots.read(only=only).where(F.col("batch_id") == last).drop("batch_id")
        return self.fold(self.batches.read(after=last, only=only), state)

    def compact(self) -> int | None:
        """Writes the state up to the newest batch as a snapshot; later reads start from it."""
        newest = self.batches.read().agg(F.max("batch_id").alias("b")).first()["b"]
        if newest is not None and newest != self._last_snapshot():
            self.replace(self.current(), newest)
        return newest


def latest(keys: list[str]) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    """Fold: last write per key, by batch and then by `offset`."""

    def fold(rows: DataFrame, state: DataFrame | None) -> DataFrame:
        ranked = rows.withColumn("arrival", F.struct("batch_id", "offset")).drop("batch_id", "offset")
        if state is not None:
            first = F.struct(F.lit(-1).cast("bigint").alias("batch_id"), F.lit(0).cast("bigint").alias("offset"))
            ranked = ranked.unionByName(state.withColumn("arrival", first))
        return merge.latest_by_key(ranked, keys)

    return fold
