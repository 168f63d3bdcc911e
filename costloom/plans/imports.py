"""Bulk imports: transcript trees to runs and messages, document trees to documents and chunks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from costloom import schemas
from costloom.operators import documents, merge, normalize, pricing
from costloom.session import stage
from costloom.sources import files, topics
from costloom.streaming.jobs import BATCH_SHIFT, Lake


@dataclass(frozen=True)
class TranscriptImport:
    runs: DataFrame  # next state of the runs table
    messages: DataFrame  # next state of the messages table
    report: DataFrame


def import_transcripts(
    spark: SparkSession,
    path: str,
    book: pricing.PriceBook,
    runs: DataFrame | None = None,
    messages: DataFrame | None = None,
    since: str | datetime | None = None,
    now: datetime | None = None,
) -> TranscriptImport:
    """Reads all transcripts, prices runs and messages, merges both into the stored tables.

    Fails when every file was skipped. Two files of one session are deliveries in file-name order.
    """
    events, report = _read_events(spark, path, since, now)
    priced = stage(_file_deliveries(events, book), "deliveries")
    accepted = merge.accepted_deliveries(_with_state(priced.drop("file"), runs))
    costed = _file_messages(events, priced, book)
    good = accepted.where(F.col("applied") & (F.col("pricing_status") == "Priced") & (F.col("arrival") > merge.STATE_ARRIVAL))
    kept = costed.join(good.select(F.col("id").alias("run_id"), "arrival"), ["run_id", "arrival"], "left_semi")
    # A run keeps the id it was first stored under; its new messages follow.
    renamed = merge.stored_ids(_with_state(priced.drop("file"), runs)).withColumnRenamed("id", "run_id")
    kept = kept.join(renamed, "run_id", "left").withColumn("run_id", F.coalesce("stored_id", "run_id")).drop("stored_id")
    if messages is not None:
        stored = messages.withColumn("arrival", F.lit(merge.STATE_ARRIVAL).cast("bigint"))
        kept = kept.unionByName(stored)
    return TranscriptImport(
        merge.merge_runs(priced.drop("file"), runs), merge.latest_by_key(kept, ["run_id", "sequence"]), report
    )


def _read_events(spark: SparkSession, path: str, since: str | datetime | None, now: datetime | None) -> tuple[DataFrame, DataFrame]:
    """(events of clean files, report). Texts are read and parsed once: the typed lines are staged."""
    parsed = files.parse_json(files.read_lines(spark, path, "*.jsonl", since, now), schemas.TRANSCRIPT)
    lines, per_file = files.skip_bad_files(stage(parsed, "transcript-lines"))
    report = files.import_report(per_file)
    files.require_some(report, "Transcript")
    return normalize.transcript_events(lines), report


def _with_state(deliveries: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is None:
        return deliveries
    return deliveries.unionByName(state.withColumn("arrival", F.lit(merge.STATE_ARRIVAL).cast("bigint")))


def _file_deliveries(events: DataFrame, book: pricing.PriceBook, base: int = 0) -> DataFrame:
    """Priced run deliveries, one per file, with `file` and `arrival`."""
    by_file = normalize.normalize_transcript_runs(events, keep_file=True)
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("file")).cast("bigint")
    return pricing.price_runs(by_file.withColumn("arrival", order + F.lit(base)), book)


def _file_messages(events: DataFrame, priced: DataFrame, book: pricing.PriceBook) -> DataFrame:
    """Messages at the price of the delivery they came with (not of another file of the same run)."""
    tags = priced.select("file", F.col("id").alias("run_id"), "arrival")
    rows = normalize.normalize_transcript_messages(events, keep_file=True).join(tags, ["file", "run_id"])
    per_file = priced.withColumn("id", F.concat_ws("\x1f", "id", "file"))
    keyed = rows.withColumn("run_id", F.concat_ws("\x1f", "run_id", "file"))
    out = pricing.price_messages(keyed, per_file, book)
    return out.withColumn("run_id", F.substring_index("run_id", "\x1f", 1)).drop("file")


def import_into(lake: Lake, path: str, book: pricing.PriceBook, name: str, **window: str | datetime | None) -> DataFrame:
    """The same import as one batch of a lake: run deliveries, their messages and the priced topic.

    `name` names the import; repeating one replaces what it wrote before, and nothing that another import or a stream
    wrote. Returns the report.
    """
    batch_id = lake.numbers.of(f"import@{name}", 0)
    events, report = _read_events(lake.spark, path, window.get("since"), window.get("now"))
    priced = stage(_file_deliveries(events, book, batch_id * BATCH_SHIFT), "deliveries")
    lake.runs.write(priced, batch_id)
    lake.messages.write(_file_messages(events, priced, book), batch_id)
    lake.priced.write(topics.priced_topic(priced.withColumn("offset", F.col("arrival"))), batch_id)
    return report


@dataclass(frozen=True)
class DocumentImport:
    documents: DataFrame  # newly stored documents
    chunks: DataFrame  # their chunks
    report: DataFrame


def import_documents(
    spark: SparkSession,
    path: str,
    stored: DataFrame | None = None,
    since: str | datetime | None = None,
    now: datetime | None = None,
    source: str = "documents",
) -> DocumentImport:
    """Reads a document tree, keeps one document per content hash that is not stored yet, and chunks it.

    The kept copy is the one with the smallest uri; ids derive from the content hash.
    """
    docs, report = files.stage_document_tree(spark, path, since, now)
    files.require_some(report, "Documents")
    firsts = docs.groupBy("content_hash").agg(F.min("uri").alias("uri"))
    unique = docs.join(firsts, ["content_hash", "uri"], "left_semi")
    if stored is not None:
        unique = unique.join(stored.select("content_hash"), "content_hash", "left_anti")
    new = unique.withColumn("id", F.left("content_hash", F.lit(32))).withColumn("source", F.lit(source))
    return DocumentImport(
        new.drop("text"), documents.chunk_documents(new, id_col="id", text="text"), report
    )
