"""Small stores that streams keep beside their tables: whole days, deliveries in parts, hashes seen before.

Each is rewritten only where a batch touches it and holds nothing of what is settled, so what a batch reads does not grow with
history. A batch starts from the state of the one before and writes its own, so a retry gives the same again; folders
that no retry can ask for any more are deleted.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costloom import schemas
from costloom.operators.merge import covered_days, latest_by_key
from costloom.operators.normalize import ATTR_PREFIX, part_of
from costloom.session import stage
from costloom.sources import envelopes
from costloom.streaming.tables import BatchTable


class Folders:
    """Names below a path, and their removal, by the file system that Spark itself uses there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):  # noqa: ANN202
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def values(self, column: str) -> list[str]:
        """Values of the partition folders `column=value`."""
        found = self._fs().globStatus(self._at(f"{column}=*")) or []
        return [s.getPath().getName().split("=", 1)[1] for s in found]

    def drop(self, column: str, value: str) -> None:
        self._fs().delete(self._at(f"{column}={value}"), True)


class DayTable:
    """The aggregate as a table partitioned by day. A refresh replaces whole days; files of other days are not touched."""

    def __init__(self, spark: SparkSession, path: str, ddl: str = schemas.AGGREGATE, day: str = "bucket_day"):
        self.spark, self.path, self.ddl, self.day = spark, path.rstrip("/"), ddl, day
        self.folders = Folders(spark, path)

    def read(self) -> DataFrame:
        if not self.folders.values(self.day):
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(self.path).select(*schemas.columns(self.ddl))

    def put(self, rows: DataFrame) -> None:
        """Replaces the days that `rows` have."""
        whole = rows.select(*schemas.columns(self.ddl)).hint("rebalance", self.day)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day).parquet(self.path)

    def refresh(self, runs: DataFrame, recomputed: DataFrame) -> None:
        """Days with a run that has a start hold exactly the recomputed rows afterwards, also if these are none; other
        days stay. `recomputed` comes from `runs`. A refresh that broke off is made good by the next one."""
        covered = stage(covered_days(runs).withColumnRenamed("bucket_day", self.day), "covered-days")
        rows = stage(recomputed.join(covered, self.day, "left_semi").select(*schemas.columns(self.ddl)), "recomputed-days")
        self.put(rows)
        kept = covered.join(rows.select(self.day).distinct(), self.day, "left_anti")
        emptied = {str(r[0]) for r in kept.collect()}  # days, not rows
        for value in self.folders.values(self.day):
            if value in emptied:
                self.folders.drop(self.day, value)


class _Chain:
    """A state per batch: read from the one before, written for its own batch, older ones deleted."""

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.table, self.folders = BatchTable(spark, path, ddl), Folders(spark, path)

    def before(self, batch_id: int) -> tuple[int | None, DataFrame]:
        ids = [int(v) for v in self.folders.values("batch_id")]
        last = max((i for i in ids if i < batch_id), default=None)
        if last is None:
            return None, self.table.spark.createDataFrame([], self.table.schema)
        return last, self.table.spark.read.schema(self.table.schema).parquet(f"{self.table.path}/batch_id={last}")

    def write(self, state: DataFrame, batch_id: int, last: int | None) -> None:
        """Writes the state of a batch. A retry of this batch reads `last`; nothing reads what is older."""
        self.table.write(state, batch_id)
        for value in self.folders.values("batch_id"):
            if last is not None and int(value) < last:
                self.folders.drop("batch_id", value)


def _name(writer: str) -> str:
    return hashlib.sha256(writer.encode()).hexdigest()[:16]


class PendingParts:
    """Deliveries of which not all parts have come, one store per writer.

    `waiting` has a small row per open delivery: its number of parts, those seen, and the batches that brought them. Payloads lie
    in those batches' folders until the delivery is complete.
    """

    def __init__(self, spark: SparkSession, root: str, writer: str, prefix: str = ATTR_PREFIX):
        path = f"{root.rstrip('/')}/pending/{_name(writer)}"
        self.spark, self.prefix = spark, prefix
        self.payloads = BatchTable(spark, f"{path}/payloads", "delivery string, part int, payload string, content_hash string, arrival bigint")
        self.held = Folders(spark, f"{path}/payloads")
        self.waiting = _Chain(spark, f"{path}/waiting", "delivery string, parts int, seen array<int>, batches array<bigint>")

    def settle(self, fresh: DataFrame, batch_id: int) -> DataFrame:
        """The envelopes of `fresh` (payload, content_hash, arrival) that can be counted now: those that are whole, and all
        parts of the deliveries that this batch completes."""
        cols = ["payload", "content_hash", "arrival"]
        mark = F.col("payload").contains(f'"{self.prefix}.delivery"')
        part = part_of(F.col("trace.resourceSpans"), self.prefix)
        tagged = envelopes.parse_trace(fresh.where(mark)).withColumn("_p", part).select("_p.delivery", F.col("_p.part").cast("int").alias("part"), F.col("_p.parts").cast("int").alias("parts"), *cols)
        tagged = stage(tagged, "delivery-parts")
        now = tagged.where("delivery is not null")
        last, open_ones = self.waiting.before(batch_id)
        if now.isEmpty():
            # Nothing can be completed: the state goes on as it is.
            return fresh.select(*cols)
        self.payloads.write(now, batch_id)
        one = now.select("delivery", "parts", F.array("part").alias("seen"), F.array(F.lit(batch_id).cast("bigint")).alias("batches"))
        union = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
        state = stage(open_ones.unionByName(one).groupBy("delivery").agg(F.max("parts").alias("parts"), union("seen"), union("batches")), "delivery-states")
        done = state.where("parts is null or size(seen) >= parts")
        self.waiting.write(state.where("parts is not null and size(seen) < parts"), batch_id, last)
        brought = [r[0] for r in done.select(F.explode("batches")).distinct().collect()]  # batch numbers
        whole = fresh.where(~mark).select(*cols).unionByName(tagged.where("delivery is null").select(*cols))
        if brought:
            paths = [f"{self.payloads.path}/batch_id={b}" for b in brought]
            rows = self.spark.read.schema(self.payloads.schema).parquet(*paths)
            whole = whole.unionByName(rows.join(done.select("delivery"), "delivery", "left_semi").select(*cols))
        # A retry reads what the state before names; no other folder is asked for again.
        named = {batch_id, *(r[0] for s in (open_ones, state) for r in s.select(F.explode("batches")).distinct().collect())}
        for value in self.held.values("batch_id"):
            if int(value) not in named:
                self.held.drop("batch_id", value)
        return whole


class SeenHashes:
    """Hashes seen before, in bounded memory: a Bloom filter per hash bucket, and the hashes themselves on disk.

    A row that its bucket's filter does not know is new. Only rows that it may know meet the stored hashes of their buckets, so
    the answer is exact. Filters have a fixed size; where they fill up, more rows are looked up.
    """

    PROBES = 4

    def __init__(self, spark: SparkSession, root: str, writer: str, buckets: int = 64, words: int = 16_384):
        path = f"{root.rstrip('/')}/seen/{_name(writer)}"
        self.spark, self.buckets, self.words = spark, buckets, words
        self.hashes = BatchTable(spark, f"{path}/hashes", "content_hash string", key="content_hash", buckets=buckets)
        self.filters = _Chain(spark, f"{path}/filters", "filter_bucket int, bits array<bigint>")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("content_hash"), F.lit(self.buckets)).cast("int")

    def _bits(self) -> Column:
        """The bits of a hash: positions in its bucket's filter."""
        return F.array(*[F.pmod(F.xxhash64("content_hash", F.lit(i)), F.lit(64 * self.words)) for i in range(self.PROBES)])

    def first(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of `batch` whose content_hash no earlier batch had, one per hash, and remembers them."""
        rows = stage(envelopes.dedupe_envelopes(batch), "batch-hashes")
        last, filters = self.filters.before(batch_id)
        names = rows.select("content_hash", self._bucket().alias("filter_bucket"), self._bits().alias("_at"))
        # Filters are `buckets` rows of `words` numbers, whatever has been seen.
        probed = names.join(F.broadcast(filters), "filter_bucket", "left")
        known = F.forall("_at", lambda p: F.getbit(F.get("bits", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        maybe = stage(probed.where(F.col("bits").isNotNull() & known).select("content_hash"), "maybe-seen")
        if not maybe.isEmpty():
            stored = self.hashes.read(only=maybe).where(F.col("batch_id") < batch_id).select("content_hash").distinct()
            rows = rows.join(stored, "content_hash", "left_anti").select(*rows.columns)
        rows = stage(rows, "new-hashes")
        self.hashes.write(rows, batch_id)
        added = rows.select(self._bucket().alias("filter_bucket"), F.explode(self._bits()).alias("p")).select(
            "filter_bucket", F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")
        )
        words = added.groupBy("filter_bucket", "w").agg(F.bit_or("b").alias("b"))
        held = words.groupBy("filter_bucket").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
        none = F.lit(0).cast("bigint")
        fresh = F.transform(F.sequence(F.lit(0), F.lit(self.words - 1)), lambda i: F.coalesce(F.try_element_at("m", i), none))
        both = filters.join(held.select("filter_bucket", fresh.alias("more")), "filter_bucket", "full")
        merged = F.coalesce(F.zip_with("bits", "more", lambda a, b: a.bitwiseOR(b)), "bits", "more")
        self.filters.write(both.select("filter_bucket", merged.alias("bits")), batch_id, last)
        return rows


class FencedTable:
    """Latest rows per key by their version (`offset`), and whole replacements from elsewhere under a version fence.

    A replacement holds everything up to its fence; only rows with a higher version count beside it. Which of the two is
    written first makes no difference, so they can come from different streams.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str, state_ddl: str, keys: list[str]):
        base = path.rstrip("/")
        self.batches = BatchTable(spark, f"{base}/batches", ddl)
        self.snapshots = BatchTable(spark, f"{base}/snapshots", state_ddl)
        # Written after a replacement's rows: without its mark it does not exist.
        self.marks = BatchTable(spark, f"{base}/marks", "fence bigint")
        self.keys = keys

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self.batches.write(rows, batch_id)

    def newest(self) -> int:
        """The highest version written so far; -1 for none."""
        return self.batches.read().agg(F.coalesce(F.max("offset"), F.lit(-1).cast("bigint"))).first()[0]

    def replace(self, state: DataFrame, batch_id: int, fence: int) -> None:
        self.snapshots.write(state, batch_id)
        self.marks.write(self.marks.spark.createDataFrame([(fence,)], "fence bigint"), batch_id)

    def current(self) -> DataFrame:
        last = self.marks.read().agg(F.max(F.struct("fence", "batch_id")).alias("m")).first()["m"]
        rows = self.batches.read()
        if last is not None:
            rows = rows.where(F.col("offset") > last["fence"])
        ranked = rows.withColumn("arrival", F.struct("offset", "batch_id")).drop("offset", "batch_id")
        if last is not None:
            state = self.snapshots.read().where(F.col("batch_id") == last["batch_id"]).drop("batch_id")
            first = F.struct(F.lit(last["fence"]).cast("bigint").alias("offset"), F.lit(-1).cast("bigint").alias("batch_id"))
            ranked = ranked.unionByName(state.withColumn("arrival", first))
        return latest_by_key(ranked, self.keys)
