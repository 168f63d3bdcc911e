"""The topic chain as checkpointed foreachBatch jobs.

raw -> runs/messages/priced -> search documents/indexed -> embeddings; priced -> findings; aggregate ->
latest buckets. Each job takes a streaming DataFrame (files here, Kafka in deployment), writes its tables
first and its output topic last, and only then is the batch committed by the checkpoint.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from costloom import schemas
from costloom.operators import admission, merge, normalize, pricing, search, waste
from costloom.sources import envelopes, topics
from costloom.streaming.stores import FencedTable, PendingParts, SeenHashes
from costloom.streaming.tables import BUCKETS, BatchTable, MergedTable, Numbers, latest

DELIVERY_DDL = f"{schemas.RUNS}, arrival bigint"
TOPIC_DDL = "key string, value string, offset bigint"
ENVELOPE_DDL = "content_hash string, payload string, session_key string"
REJECT_DDL = "payload string, reason string"
MESSAGE_DDL = f"{schemas.MESSAGES}, arrival bigint"
DOC_DDL = f"{schemas.RUNS}, searchable_text string, offset bigint"
DOC_STATE_DDL = f"{schemas.RUNS}, searchable_text string"
EMBED_DDL = "id string, embedding array<float>, embedding_text string, offset bigint"
EMBED_STATE_DDL = "id string, embedding array<float>, embedding_text string"
ACTIVITY_DDL = "window_start timestamp, kind string, n bigint"
AGG_DDL = f"{schemas.AGGREGATE}, offset bigint"

# Arrival numbers: batch id in the high bits, position of the delivery in its session's batch below.
BATCH_SHIFT = 2**40


def _fold_runs(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    return merge.merge_runs(rows.drop("batch_id"), state)


def _fold_findings(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    old = rows.sparkSession.createDataFrame([], schemas.FINDINGS) if state is None else state
    return merge.merge_findings(old, rows.drop("batch_id"))


def _fold_activity(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    counts = rows.drop("batch_id")
    both = counts if state is None else counts.unionByName(state)
    return both.groupBy("window_start", "kind").agg(F.sum("n").cast("bigint").alias("n"))


@dataclass
class Lake:
    """All tables and topics of one deployment under a root folder."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    numbers: Numbers = field(init=False)
    envelopes: BatchTable = field(init=False)
    rejects: BatchTable = field(init=False)
    runs: MergedTable = field(init=False)
    messages: BatchTable = field(init=False)
    priced: BatchTable = field(init=False)
    documents: MergedTable = field(init=False)
    indexed: BatchTable = field(init=False)
    embeddings: MergedTable = field(init=False)
    findings: MergedTable = field(init=False)
    aggregates: FencedTable = field(init=False)
    activity: MergedTable = field(init=False)

    def __post_init__(self) -> None:
        s, r = self.spark, self.root.rstrip("/")
        self.numbers = Numbers(s, f"{r}/numbers")
        self.envelopes = BatchTable(s, f"{r}/envelopes", ENVELOPE_DDL)
        self.rejects = BatchTable(s, f"{r}/rejects", REJECT_DDL)
        self.runs = MergedTable(s, f"{r}/runs", DELIVERY_DDL, schemas.RUNS, _fold_runs, key="id", buckets=self.buckets)
        self.messages = BatchTable(s, f"{r}/messages", MESSAGE_DDL, key="run_id", buckets=self.buckets)
        self.priced = BatchTable(s, f"{r}/topics/telemetry.priced", TOPIC_DDL)
        self.indexed = BatchTable(s, f"{r}/topics/telemetry.indexed", TOPIC_DDL)
        self.documents = MergedTable(s, f"{r}/documents", DOC_DDL, DOC_STATE_DDL, latest(["id"]), key="id", buckets=self.buckets)
        self.embeddings = MergedTable(s, f"{r}/embeddings", EMBED_DDL, EMBED_STATE_DDL, latest(["id"]))
        self.findings = MergedTable(s, f"{r}/findings", schemas.FINDINGS, schemas.FINDINGS, _fold_findings)
        self.activity = MergedTable(s, f"{r}/activity", ACTIVITY_DDL, ACTIVITY_DDL, _fold_activity)
        self.aggregates = FencedTable(s, f"{r}/aggregate", AGG_DDL, schemas.AGGREGATE, ["bucket_day", "model_slug", "service"])

    def topic(self, table: BatchTable) -> DataFrame:
        """A written topic as a stream, offsets included."""
        return self.spark.readStream.schema(f"{TOPIC_DDL}, batch_id bigint").parquet(table.path)

    def current_messages(self, only: DataFrame | None = None) -> DataFrame:
        """Messages of accepted, priced deliveries, last write per (run, sequence); of all runs or of `only` (id).

        Acceptance is decided over the runs' delivery batches, so those are kept after a compaction.
        """
        deliveries = self.runs.batches.read(only=only).drop("batch_id")
        accepted = merge.accepted_deliveries(deliveries)
        good = accepted.where(F.col("applied") & (F.col("pricing_status") == "Priced"))
        ids = None if only is None else only.select(F.col("id").alias("run_id"))
        rows = self.messages.read(only=ids).drop("batch_id")
        kept = rows.join(good.select(F.col("id").alias("run_id"), "arrival"), ["run_id", "arrival"], "left_semi")
        return merge.latest_by_key(kept, ["run_id", "sequence"])


def _start(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _each_batch(
    stream: DataFrame, lake: Lake, job: str, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool
) -> StreamingQuery:
    """Runs `handle` on every batch, computed once, under the batch's own number in the lake."""

    def run(batch: DataFrame, batch_id: int) -> None:
        number = lake.numbers.of(f"{job}@{checkpoint}", batch_id)
        held = batch.persist()
        try:
            handle(held, number)
        finally:
            held.unpersist()

    return _start(stream.writeStream.foreachBatch(run), checkpoint, available_now)


def deliveries_of(batch: DataFrame, batch_id: int, prefix: str = normalize.ATTR_PREFIX) -> DataFrame:
    """Unpriced run deliveries of a batch of envelopes: one per (delivery, session), in arrival order."""
    merged = normalize.otlp_deliveries(envelopes.parse_trace(batch), prefix)
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("arrival", "content_hash"))
    return merged.withColumn("arrival", F.lit(batch_id * BATCH_SHIFT) + order).drop("content_hash")


def stream_priced(
    raw: DataFrame,
    lake: Lake,
    book: pricing.PriceBook,
    checkpoint: str,
    prefix: str = normalize.ATTR_PREFIX,
    available_now: bool = True,
) -> StreamingQuery:
    """raw envelopes -> dedupe -> normalize -> price -> run deliveries -> priced topic.

    Hashes seen before are dropped: a Bloom filter of fixed size tells most new ones apart, the rest meet the stored hashes of
    their buckets. A delivery in several parts counts in the batch that brings its last part; the others wait in a store
    of open deliveries, so neither lookup reads what is settled. Bad payloads go to `rejects` with a reason.
    """
    writer = f"priced@{checkpoint}"
    seen, pending = SeenHashes(lake.spark, lake.root, writer, lake.buckets), PendingParts(lake.spark, lake.root, writer, prefix)

    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = envelopes.quarantine(seen.first(batch, batch_id))
        lake.rejects.write(bad, batch_id)
        fresh = good.select("payload", "content_hash", "arrival")
        whole = pending.settle(fresh, batch_id)
        lake.runs.write(pricing.price_runs(deliveries_of(whole, batch_id, prefix), book), batch_id)
        key = envelopes.envelope_session_key(F.col("trace.resourceSpans"))
        lake.envelopes.write(envelopes.parse_trace(fresh).withColumn("session_key", key), batch_id)
        written = lake.runs.batches.read().where(F.col("batch_id") == batch_id)
        lake.priced.write(topics.priced_topic(written.withColumn("offset", F.col("arrival"))), batch_id)

    return _each_batch(raw, lake, "priced", handle, checkpoint, available_now)


def stream_indexed(priced: DataFrame, lake: Lake, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """priced -> search documents (overwritten by id) -> indexed topic."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        runs = topics.from_topic(batch.drop("batch_id"), topics.PRICED)
        docs = search.run_documents(runs)
        lake.documents.write(docs, batch_id)
        acks = runs.select(F.col("id").alias("run_id"), "session_id", "offset")
        lake.indexed.write(topics.to_topic(acks, "session_id", topics.INDEXED), batch_id)

    return _each_batch(priced, lake, "indexed", handle, checkpoint, available_now)


def stream_embedded(
    indexed: DataFrame,
    lake: Lake,
    checkpoint: str,
    embedder: search.Embedder,
    dims: int = search.EMBED_DIMS,
    available_now: bool = True,
) -> StreamingQuery:
    """indexed -> the two embedding fields of the acknowledged runs, nothing else."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        acked = topics.from_topic(batch.drop("batch_id"), topics.INDEXED)
        ids = acked.groupBy(F.col("run_id").alias("id")).agg(F.max("offset").alias("offset")).persist()
        docs, messages = lake.documents.current(ids), lake.current_messages(ids)
        texts = search.embedding_text(messages, docs)
        lake.embeddings.write(search.embed(texts, "embedding_text", embedder, dims).join(ids, "id"), batch_id)
        ids.unpersist()

    return _each_batch(indexed, lake, "embedded", handle, checkpoint, available_now)


def stream_findings(
    priced: DataFrame,
    lake: Lake,
    book: pricing.PriceBook,
    checkpoint: str,
    opts: waste.WasteOptions = waste.WasteOptions(),
    available_now: bool = True,
) -> StreamingQuery:
    """priced -> waste findings of the runs in the batch; re-detected findings merge into the stored ones."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ids = topics.from_topic(batch.drop("batch_id"), topics.PRICED).select("id").distinct().persist()
        runs, messages = lake.runs.current(ids), lake.current_messages(ids)
        found = waste.detect_waste(runs, messages, book, F.current_timestamp(), opts)
        lake.findings.write(found, batch_id)
        ids.unpersist()

    return _each_batch(priced, lake, "findings", handle, checkpoint, available_now)


def stream_latest_aggregate(
    topic: DataFrame, lake: Lake, checkpoint: str, durable: Callable[[], DataFrame] | None = None, available_now: bool = True
) -> StreamingQuery:
    """aggregate topic -> latest value per (day, model, service).

    With `durable`, every batch also replaces the whole state by the durable table, so withdrawn buckets
    vanish; `stream_reconcile` does that on a trigger of its own.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        lake.aggregates.write(topics.from_topic(batch.drop("batch_id"), topics.PUBLIC_AGGREGATE), batch_id)
        if durable is not None:
            _reconcile(lake, durable, batch_id)

    return _each_batch(topic, lake, "aggregate", handle, checkpoint, available_now)


def _reconcile(lake: Lake, durable: Callable[[], DataFrame], batch_id: int) -> None:
    # The durable table is written before its rows are published: read after the fence, it holds all of them up to it.
    fence = lake.aggregates.newest()
    lake.aggregates.replace(durable(), batch_id, fence)


def stream_reconcile(
    lake: Lake, durable: Callable[[], DataFrame], checkpoint: str, seconds: int = 300, available_now: bool = False
) -> StreamingQuery:
    """Replaces the aggregate's state by the durable table at its own pace, whether or not the topic brings anything.

    Rows that the topic brings later, or brought since the table was read, keep counting: the replacement only stands
    for versions up to the highest one seen before the table was read.
    """
    ticks = lake.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def handle(_: DataFrame, batch_id: int) -> None:
        _reconcile(lake, durable, lake.numbers.of(f"reconcile@{checkpoint}", batch_id))

    writer = ticks.writeStream.foreachBatch(handle)
    if not available_now:
        writer = writer.trigger(processingTime=f"{seconds} seconds")
        return writer.option("checkpointLocation", checkpoint).start()
    return _start(writer, checkpoint, True)


def stream_activity(
    events: DataFrame, at: str, lake: Lake, checkpoint: str, minutes: int = 60, available_now: bool = True
) -> StreamingQuery:
    """Counts per tumbling window and kind, kept in `lake.activity`.

    Each batch adds its own partial counts; the table's state is their sum. Nothing is dropped: open windows show
    what has come so far, and rows that come late are added to their window.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        counts = (
            batch.groupBy(F.window(at, f"{minutes} minutes").alias("w"), "kind")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "kind", "n")
        )
        lake.activity.write(counts, batch_id)

    return _each_batch(events, lake, "activity", handle, checkpoint, available_now)


def stream_admission(
    requests: DataFrame, limit: int = admission.MAX_REQUESTS, window_seconds: int = admission.WINDOW_SECONDS
) -> DataFrame:
    """Streaming `admit`: the state of a principal is the times of its accepted requests in the window.

    A micro-batch hands each principal its new requests in Arrow batches; two numbers of each are held, and they are
    decided in time order. The state is at most `limit` times.
    """
    width = window_seconds * 1_000_000

    def decide(key: tuple, batches: Callable, state: GroupState):  # noqa: ANN202
        import pandas as pd

        times, arrivals = [], []
        for part in batches:
            times.append(part["us"].to_numpy())
            arrivals.append(part["arrival"].to_numpy())
        us, arrival = np.concatenate(times), np.concatenate(arrivals)
        taken = deque(state.get[0] if state.exists else ())
        accepted = np.zeros(len(us), bool)
        for i in np.lexsort((arrival, us)):
            while taken and us[i] - taken[0] >= width:
                taken.popleft()
            if len(taken) < limit:
                taken.append(int(us[i]))
                accepted[i] = True
        state.update((list(taken),))
        yield pd.DataFrame({"principal": key[0], "arrival": arrival, "accepted": accepted})

    keyed = requests.select(
        F.col("principal").cast("string").alias("principal"), F.col("arrival").cast("bigint").alias("arrival"), F.unix_micros("at").alias("us")
    )
    return keyed.groupBy("principal").applyInPandasWithState(
        decide, "principal string, arrival bigint, accepted boolean", "taken array<bigint>", "append", "NoTimeout"
    )


class _OrderedAdmission(StatefulProcessor):
    """Requests wait until the watermark has passed them, are decided in time order, and leave with their window."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us bigint, arrival bigint")
        self.taken = handle.getListState("taken", "us bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        first = None
        for part in rows:
            us = part["us"].to_numpy()
            self.pending.appendList(list(zip(us.tolist(), part["arrival"].tolist())))
            first = int(us.min()) if first is None else min(first, int(us.min()))
        # The timer goes off once the watermark has reached the earliest of them.
        self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.pending.get())
        taken = deque(us for (us,) in self.taken.get())
        arrivals, accepted, at = [], [], 0
        while at < len(waiting) and waiting[at][0] <= now:
            us, arrival = waiting[at]
            while taken and us - taken[0] >= self.width:
                taken.popleft()
            accepted.append(len(taken) < self.limit)
            if accepted[-1]:
                taken.append(us)
            arrivals.append(arrival)
            at += 1
        while taken and now - taken[0] >= self.width:
            taken.popleft()
        for state, held in ((self.pending, waiting[at:]), (self.taken, [(us,) for us in taken])):
            state.put(held) if held else state.clear()
        if at < len(waiting):
            self.handle.registerTimer(waiting[at][0] // 1000 + 1)
        elif taken:
            self.handle.registerTimer((taken[-1] + self.width) // 1000 + 1)
        if arrivals:
            yield pd.DataFrame({
                "principal": pd.Series([key[0]] * len(arrivals), dtype=object), "arrival": pd.Series(arrivals, dtype="int64"), "accepted": pd.Series(accepted, dtype=bool),
            })

    def close(self) -> None:
        pass


def stream_admission_ordered(
    requests: DataFrame, limit: int = admission.MAX_REQUESTS, window_seconds: int = admission.WINDOW_SECONDS, delay: str = "1 minute"
) -> DataFrame:
    """Streaming `admit` in event-time order: requests (principal, arrival, at) that come in any order within `delay` get
    the answers that they would get in time order.

    A request is answered once the watermark has passed it; one that comes later than `delay` is not answered, and that is a
    refusal. State is a principal's unanswered requests and the accepted ones still in its window; timers drop both, so a
    principal that has gone quiet leaves nothing behind.
    """
    keyed = requests.select(
        F.col("principal").cast("string").alias("principal"), F.col("arrival").cast("bigint").alias("arrival"), F.unix_micros("at").alias("us"), "at"
    )
    return keyed.withWatermark("at", delay).groupBy("principal").transformWithStateInPandas(
        statefulProcessor=_OrderedAdmission(limit, window_seconds * 1_000_000),
        outputStructType="principal string, arrival bigint, accepted boolean",
        outputMode="Append",
        timeMode="EventTime",
    )
