"""Ingest envelopes: trace payload source, dedupe by raw bytes, session keys, quarantine, ledger encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from costloom import schemas
from costloom.functions.text import col, content_hash, is_blank
from costloom.operators.normalize import ATTR_PREFIX, SOURCE_LEDGER, is_otlp, parse_time
from costloom.session import stage
from costloom.sources.files import list_files, open_files, packed

# Resource attribute keys that name the session of an envelope.
SESSION_KEYS = ("session.id", "session_id")
# About 500 bytes a span: a document of this many stays well below the 2 GB that one value can hold.
MAX_SPANS = 1_000_000
# Spans of one part of a large session (about 25 MB), so what a task gathers does not grow with the session.
PART_SPANS = 50_000


def read_otlp(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """JSON trace payloads, one document per file: payload, content_hash, arrival (when it was written)."""
    listed = list_files(spark, path) if not stream and options == {"recursiveFileLookup": "true"} else None
    if listed is not None:
        found = open_files(listed, unpack=True)
        return found.select(
            F.col("content").cast("string").alias("payload"),
            F.sha2("content", 256).alias("content_hash"),
            F.unix_micros("modificationTime").alias("arrival"),
        )
    reader = spark.readStream if stream else spark.read
    text = reader.options(**options).text(path, wholetext=True)
    text = text if stream else packed(text)
    # The text source keeps the bytes as they are, so this is the hash of the raw payload.
    return text.select(
        F.col("value").alias("payload"),
        content_hash("value").alias("content_hash"),
        F.unix_micros(F.col("_metadata.file_modification_time")).alias("arrival"),
    )


def parse_trace(envelopes: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds `trace`: the typed payload; unknown fields are ignored."""
    return envelopes.withColumn("trace", F.from_json(payload, schemas.OTLP_TRACE))


def parse_logs(envelopes: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds `logs`: the typed log payload, of which the resources name the session; unknown fields are ignored."""
    return envelopes.withColumn("logs", F.from_json(payload, schemas.OTLP_LOGS))


def quarantine_logs(envelopes: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(log envelopes with `session_key`, rejected ones with `reason`), as `quarantine` for traces: an object without
    resourceLogs is a log envelope of no session."""
    parsed = F.from_json(payload, f"{schemas.OTLP_LOGS}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    reason = F.when(is_blank(payload), F.lit("empty")).when(F.col("_e").isNull() | F.col("_e._bad").isNotNull(), F.lit("malformed"))
    tagged = envelopes.withColumn("_e", parsed).withColumn("reason", reason)
    good = tagged.where(F.col("reason").isNull()).withColumn("session_key", envelope_session_key(F.col("_e.resourceLogs")))
    return good.drop("_e", "reason"), tagged.where(F.col("reason").isNotNull()).drop("_e")


def quarantine(envelopes: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good envelopes, rejected ones with `reason`): nothing is lost and nothing stops the job."""
    parsed = F.from_json(payload, f"{schemas.OTLP_TRACE}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    reason = (
        F.when(is_blank(payload), F.lit("empty"))
        .when(F.col("_e").isNull() | F.col("_e._bad").isNotNull(), F.lit("malformed"))
        .when(~is_otlp(payload), F.lit("no resourceSpans"))
    )
    tagged = envelopes.withColumn("_e", parsed).withColumn("reason", reason).drop("_e")
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def dedupe_envelopes(envelopes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """First arrival per content hash, minus hashes already stored.

    Copies are byte-equal, so the grouped arg-min keeps one per task before the shuffle.
    """
    rest = [c for c in envelopes.columns if c != "content_hash"]
    first = (
        envelopes.groupBy("content_hash")
        .agg(F.min_by(F.struct(*rest), "arrival").alias("_e"))
        .select("content_hash", "_e.*")
        .select(*envelopes.columns)
    )
    return first if existing is None else first.join(existing.select("content_hash"), "content_hash", "left_anti")


def envelope_session_key(resources: Column | str) -> Column:
    """Session attribute of the first resource (of resourceSpans or resourceLogs), else ''."""
    attrs = F.get(col(resources), F.lit(0))["resource"]["attributes"]
    found = F.get(F.filter(attrs, lambda a: a["key"].isin(*SESSION_KEYS)), F.lit(0))
    return F.coalesce(found["value"]["stringValue"], F.lit(""))


# ---------------------------------------------------------------- ledger rows to trace envelopes

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double>"


def _attr(key: str, value: Column, kind: str) -> Column:
    parts = {"stringValue": "string", "intValue": "string", "doubleValue": "double"}
    body = F.struct(*[(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in parts.items()])
    return F.struct(F.lit(key).alias("key"), body.alias("value"))


def _ledger_spans(rows: DataFrame, prefix: str) -> DataFrame:
    """session_id (null when blank), ts, handle, ord, span."""
    start = F.unix_micros(parse_time("ts")) * 1000
    took = (F.coalesce("duration_s", F.lit(0.0)) * 1_000_000_000).cast("bigint")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cost = F.col("cost_usd").cast("double")
    attributes = F.concat(
        F.array(
            _attr(f"{prefix}.handle", F.col("handle"), "stringValue"),
            _attr(f"{prefix}.persona", text("persona"), "stringValue"),
            _attr("gen_ai.request.model", text("model"), "stringValue"),
            _attr(f"{prefix}.status", text("status"), "stringValue"),
            _attr("gen_ai.usage.input_tokens", F.coalesce("miss_tokens", F.lit(0)), "intValue"),
            _attr("gen_ai.usage.cache_read_tokens", F.coalesce("hit_tokens", F.lit(0)), "intValue"),
            _attr("gen_ai.usage.output_tokens", F.coalesce("output_tokens", F.lit(0)), "intValue"),
        ),
        F.when(cost.isNotNull(), F.array(_attr(f"{prefix}.cost_usd", cost, "doubleValue"))).otherwise(
            F.array().cast(f"array<struct<key:string,value:{_VALUE}>>")
        ),
    )
    span = F.struct(
        F.col("handle").alias("name"),
        start.cast("string").alias("startTimeUnixNano"),
        (start + took).cast("string").alias("endTimeUnixNano"),
        attributes.alias("attributes"),
    )
    return rows.select(
        F.when(~is_blank("session_id"), F.col("session_id")).alias("session_id"), "ts", "handle", "ord", span.alias("span")
    )


def _documents(gathered: DataFrame, prefix: str) -> DataFrame:
    """(session_id, spans, further resource attributes `_more`) to (session_id, payload)."""
    own = F.array(
        _attr("session.id", F.col("session_id"), "stringValue"),
        _attr(f"{prefix}.source", F.lit(SOURCE_LEDGER), "stringValue"),
    )
    resource = F.struct(F.concat(own, "_more").alias("attributes"))
    document = F.struct(
        F.array(
            F.struct(resource.alias("resource"), F.array(F.struct(F.col("spans").alias("spans"))).alias("scopeSpans"))
        ).alias("resourceSpans")
    )
    return gathered.select("session_id", F.to_json(document).alias("payload"))


def _whole(spans: DataFrame) -> DataFrame:
    """One (session_id, spans, _more) per session, spans in (ts, handle, ord) order; one per row without a session."""
    none = F.array().cast(f"array<struct<key:string,value:{_VALUE}>>").alias("_more")
    loose = spans.where(F.col("session_id").isNull()).select(F.lit("").alias("session_id"), F.array("span").alias("spans"), none)
    named = spans.where(F.col("session_id").isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct("ts", "handle", "ord", "span")))
    kept = named.groupBy("session_id").agg(F.transform(ordered, lambda x: x["span"]).alias("spans"))
    return kept.select("session_id", "spans", none).unionByName(loose)


def _in_parts(spans: DataFrame, prefix: str, part_spans: int) -> DataFrame:
    """As `_whole`, of sessions of any size: parts of `part_spans` spans each, in the order of the whole.

    A range sort on (session, order) spreads a session over tasks; positions follow from row numbers inside the sorted
    partitions and the counts before them, so the cuts and the delivery id depend on the session's rows alone.
    """
    numbered = spans.sort("session_id", "ts", "handle", "ord").withColumn("_at", F.monotonically_increasing_id())
    rows = stage(numbered, "large-sessions").withColumn("_split", F.shiftright("_at", 33))
    splits = rows.groupBy("session_id", "_split").agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    # A row per session and sorted partition it touches: at most the partitions plus the sessions.
    before = F.sum("_n").over(Window.partitionBy("session_id").orderBy("_split")) - F.col("_n")
    starts = splits.withColumn("_shift", before - F.col("_least")).select("session_id", "_split", "_shift")
    content = F.xxhash64("ts", "handle", "ord", "span").cast("decimal(38,0)")
    ids = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(content).alias("_sum"), F.min("ts").alias("_ts"))
    delivery = F.sha2(F.concat_ws("|", "session_id", "_n", "_sum", "_ts", F.lit(part_spans)), 256)
    named = ids.select("session_id", delivery.alias("_delivery"), F.ceil(F.col("_n") / part_spans).alias("_parts"))
    part = F.floor((F.col("_at") + F.col("_shift")) / part_spans).alias("_part")
    cut = rows.join(starts, ["session_id", "_split"]).select("session_id", part, "_at", "span")
    ordered = F.sort_array(F.collect_list(F.struct("_at", "span")))
    parts = cut.groupBy("session_id", "_part").agg(F.transform(ordered, lambda x: x["span"]).alias("spans"))
    more = F.array(
        _attr(f"{prefix}.delivery", F.col("_delivery"), "stringValue"),
        _attr(f"{prefix}.part", F.col("_part"), "intValue"),
        _attr(f"{prefix}.parts", F.col("_parts"), "intValue"),
    )
    return parts.join(named, "session_id").select("session_id", "spans", more.alias("_more"))


def encode_ledger_otlp(rows: DataFrame, prefix: str = ATTR_PREFIX, max_spans: int = MAX_SPANS) -> DataFrame:
    """Ledger rows to trace payloads: (session_id, payload), one per session.

    A session is one resource with all its spans in (ts, handle) order; rows without a session get an envelope
    each, with an empty session. For receivers that want one document per session: one of more than `max_spans`
    rows, which no single document can hold, fails the job with its name. `encode_ledger_parts` takes any size.
    Sizes are counted before spans are gathered.
    """
    spans = _ledger_spans(rows, prefix)
    large = _sizes(spans).where(F.col("n") > max_spans).first()
    if large is not None:
        raise ValueError(f"session {large['session_id']} has {large['n']} rows; an envelope holds at most {max_spans}")
    return _documents(_whole(spans), prefix)


def encode_ledger_parts(rows: DataFrame, prefix: str = ATTR_PREFIX, part_spans: int = PART_SPANS) -> DataFrame:
    """As `encode_ledger_otlp`, for sessions of any size: (session_id, payload).

    A session of more than `part_spans` rows becomes several envelopes that share a delivery id and carry a part number
    and the number of parts as resource attributes; `otlp_deliveries` adds them up to the one delivery they are.
    """
    spans = _ledger_spans(rows, prefix)
    hot = _sizes(spans).where(F.col("n") > part_spans).select("session_id")
    if hot.isEmpty():
        return _documents(_whole(spans), prefix)
    hot = stage(hot, "large-session-ids")
    usual = spans.join(hot, "session_id", "left_anti")
    return _documents(_whole(usual).unionByName(_in_parts(spans.join(hot, "session_id"), prefix, part_spans)), prefix)


def _sizes(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
