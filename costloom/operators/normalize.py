"""Normalization: source rows to one run per session, plus message rows.

All adapters end in the same fold (`merge_sessions`), a plain grouped aggregate with map-side combine:
a session holding a large share of the rows costs its reducer only one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom import schemas
from costloom.functions import money
from costloom.functions.text import (
    blank_to_null,
    col,
    derived_id,
    is_blank,
    is_test_handle,
    ledger_status,
    resolve_session,
    run_id,
    terminal_status,
)
from costloom.operators.merge import merge_runs
from costloom.operators.skew import number_blocked

# Provenance labels of the row formats.
SOURCE_LEDGER = "delegate-ledger"
SOURCE_RUN_LOG = "delegate-run-log"
SOURCE_TRANSCRIPT = "claude-code-transcript"
SOURCE_USAGE_RING = "usage-ring"

# Prefix of the vendor attributes (`<prefix>.handle`, `.persona`, `.status`, `.cost_usd`, `.source`);
# pass the prefix your emitters write.
ATTR_PREFIX = "agent"

RUN_TYPES = dict(f.split(" ", 1) for f in schemas.RUNS.split(", "))
RUN_COLUMNS = list(RUN_TYPES)


def attr(attrs: Column, key: str, kind: str = "stringValue") -> Column:
    """Value of the first attribute with `key`, read only in the expected kind, else null."""
    return F.get(F.filter(attrs, lambda a: a["key"] == key), F.lit(0))["value"][kind]


def parse_time(c: Column | str) -> Column:
    """ISO text to timestamp, UTC when no zone is given, null when it does not parse."""
    return F.try_to_timestamp(col(c))


def nanos_to_timestamp(c: Column) -> Column:
    """Epoch nanoseconds (text) to timestamp, cut to whole milliseconds."""
    return F.timestamp_millis(F.floor(c.try_cast("decimal(20,0)") / 1_000_000).cast("bigint"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    micros = F.unix_micros(ts) + F.round(F.coalesce(seconds, F.lit(0.0)) * 1_000_000).cast("bigint")
    return F.timestamp_micros(micros)


# ---------------------------------------------------------------- session fold


def merge_sessions(rows: DataFrame, order: str = "ord", keys: tuple[str, ...] = ()) -> DataFrame:
    """Many rows of one session to one run keyed (session_id, agent_id='').

    Further `keys` (an envelope, say) give one run per session and key, and stay in the result.

    Tokens are summed, the time span is min start to max end; external id, persona, model, status and
    source come from the row with the highest cost, the earliest by `order` on ties (null cost counts
    as 0). The reported cost is 0, not null, when no row carries one.
    """
    return _folded_runs(_fold_sessions(rows, order, keys), keys)


def _fold_sessions(rows: DataFrame, order: str, keys: tuple[str, ...]) -> DataFrame:
    label = F.struct("source", "handle", "persona", "model_slug", "status")
    # Any orderable type will do for `order`, such as (file, block, row).
    rank = F.struct((-F.coalesce(F.col("cost_usd"), F.lit(0))).alias("c"), F.col(order).alias("o"))
    return rows.groupBy(*keys, "session_id").agg(
        F.min_by(label, rank).alias("_best"),
        F.min(rank).alias("_rank"),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        *[F.sum(F.coalesce(F.col(f), F.lit(0))).alias(f) for f in money.TOKEN_FIELDS],
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast(schemas.MONEY).alias("reported_cost_usd"),
    )


def _folded_runs(folded: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return to_runs(
        folded.select(
            *keys,
            "session_id",
            F.col("_best.source").alias("source"),
            blank_to_null("_best.handle").alias("external_id"),
            F.col("_best.persona").alias("persona"),
            F.col("_best.model_slug").alias("model_slug"),
            F.col("_best.status").alias("status"),
            "started_at",
            "ended_at",
            *money.TOKEN_FIELDS,
            "reported_cost_usd",
        ),
        extra=keys,
    )


def to_runs(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pads a normalized projection to the runs table: deterministic id, quarantined until priced."""
    defaults = {"agent_id": "''", "pricing_status": "'Quarantined'", "version": "1"}
    have = set(df.columns)
    out = []
    for name, kind in RUN_TYPES.items():
        value = f"`{name}`" if name in have else defaults.get(name, "null")
        out.append(f"cast({value} as {kind}) AS `{name}`")
    if "id" not in have:
        df, out[0] = df.withColumn("id", run_id("session_id")), "`id`"
    return df.selectExpr(*out, *extra)


# ---------------------------------------------------------------- OTLP traces


def explode_spans(envelopes: DataFrame, body: str = "trace", keep: tuple[str, ...] = ()) -> DataFrame:
    """resourceSpans > scopeSpans > spans to rows; missing levels vanish. `ord` keeps document order.

    The outer generators keep the optimizer from parsing every payload once more only to see whether it has any rows.
    """
    keep_cols = [F.col(c) for c in keep]
    resources = envelopes.select(*keep_cols, F.posexplode_outer(f"{body}.resourceSpans").alias("_r", "_res"))
    scopes = resources.select(
        *keep_cols, "_r", F.col("_res.resource.attributes").alias("resource_attrs"),
        F.posexplode_outer("_res.scopeSpans").alias("_s", "_scope"),
    )
    spans = scopes.select(
        *keep_cols, "_r", "_s", "resource_attrs", F.posexplode_outer("_scope.spans").alias("_p", "span")
    ).where("_p is not null")
    # Positions are packed into one number: document order within an envelope.
    order = (F.col("_r").cast("bigint") * 2**40 + F.col("_s").cast("bigint") * 2**24 + F.col("_p")).alias("ord")
    return spans.select(*keep_cols, "resource_attrs", "span", order)


def part_of(resources: Column, prefix: str = ATTR_PREFIX) -> Column:
    """struct(delivery, part, parts) of an envelope's first resource; nulls for an envelope that is a delivery of its own."""
    return _part(F.get(resources, F.lit(0))["resource"]["attributes"], prefix)


def _part(attrs: Column, prefix: str) -> Column:
    number = lambda name: attr(attrs, f"{prefix}.{name}", "intValue").try_cast("bigint").alias(name)
    delivery = attr(attrs, f"{prefix}.delivery")
    return F.struct(delivery.alias("delivery"), number("part"), number("parts"))


def span_rows(spans: DataFrame, prefix: str = ATTR_PREFIX, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exploded spans to the common row shape; test handles and blank identities are dropped."""
    attrs, res = F.col("span.attributes"), F.col("resource_attrs")

    def tokens(name: str) -> Column:
        value = attr(attrs, f"gen_ai.usage.{name}", "intValue").try_cast("bigint")
        return F.coalesce(value, F.lit(0)).alias(name)

    handle = attr(attrs, f"{prefix}.handle")
    return (
        spans.select(
            *keep,
            resolve_session(attr(res, "session.id"), handle).alias("session_id"),
            F.coalesce(attr(res, f"{prefix}.source"), F.lit(SOURCE_LEDGER)).alias("source"),
            F.coalesce(handle, F.lit("")).alias("handle"),
            attr(attrs, f"{prefix}.persona").alias("persona"),
            attr(attrs, "gen_ai.request.model").alias("model_slug"),
            ledger_status(attr(attrs, f"{prefix}.status")).alias("status"),
            nanos_to_timestamp(F.col("span.startTimeUnixNano")).alias("started_at"),
            nanos_to_timestamp(F.col("span.endTimeUnixNano")).alias("ended_at"),
            tokens("input_tokens"),
            tokens("cache_read_tokens"),
            tokens("cache_write_tokens"),
            tokens("output_tokens"),
            attr(attrs, f"{prefix}.cost_usd", "doubleValue").try_cast(schemas.MONEY).alias("cost_usd"),
            "ord",
        )
        .where(~is_test_handle("handle") & F.col("session_id").isNotNull())
    )


def otlp_deliveries(envelopes: DataFrame, prefix: str = ATTR_PREFIX) -> DataFrame:
    """Parsed trace envelopes (`trace`, `content_hash`, `arrival`) to one run per (delivery, session).

    An envelope is a delivery of its own unless it names the delivery it is a part of. Spans are folded inside their
    envelope, positions of different envelopes being not comparable; then the parts of a delivery are added up, in part
    order and each part once. A delivery arrives with its last part; parts that are not there do not count.
    """
    keep = ("content_hash", "arrival")
    spans = explode_spans(envelopes, keep=keep).withColumn("_part", _part(F.col("resource_attrs"), prefix))
    rows = span_rows(spans, prefix, keep=(*keep, "_part"))
    by_envelope = _fold_sessions(rows, "ord", (*keep, "_part"))
    own = F.struct("content_hash", "arrival")
    delivery = ("session_id", "_own", "_delivery")
    named = by_envelope.withColumn("_delivery", F.col("_part.delivery")).withColumn("_own", F.when(F.col("_delivery").isNull(), own))
    # One shuffle, of one row per envelope and session, for both steps.
    latest = F.max_by(F.struct(*by_envelope.columns), F.struct("arrival", "content_hash")).alias("_row")
    by_part = named.repartition(*delivery).groupBy(*delivery, "_part").agg(latest)
    whole = by_part.groupBy(*delivery).agg(
        F.min("_row.content_hash").alias("content_hash"),
        F.max("_row.arrival").alias("arrival"),
        F.min_by("_row._best", F.struct(F.col("_row._rank.c"), F.col("_part.part"), F.col("_row._rank.o"))).alias("_best"),
        F.min("_row.started_at").alias("started_at"),
        F.max("_row.ended_at").alias("ended_at"),
        *[F.sum(f"_row.{f}").alias(f) for f in money.TOKEN_FIELDS],
        F.sum("_row.reported_cost_usd").cast(schemas.MONEY).alias("reported_cost_usd"),
    )
    return _folded_runs(whole, keep)


def normalize_otlp(envelopes: DataFrame, prefix: str = ATTR_PREFIX) -> DataFrame:
    """Parsed trace envelopes (`trace`, `content_hash`, `arrival`) to runs: each envelope is a delivery of its
    sessions' runs, a later one replaces an earlier one by the rule of `merge_runs`. One run per session."""
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("arrival", "content_hash"))
    numbered = otlp_deliveries(envelopes, prefix).withColumn("arrival", order.cast("bigint"))
    return merge_runs(numbered.drop("content_hash"))


# ---------------------------------------------------------------- row adapters


def ledger_rows(ledger: DataFrame) -> DataFrame:
    """Ledger rows (with `ord`) to the common row shape: misses are input, hits are cache reads."""
    started = parse_time("ts")
    return (
        ledger.select(
            resolve_session("session_id", "handle").alias("session_id"),
            F.lit(SOURCE_LEDGER).alias("source"),
            F.coalesce("handle", F.lit("")).alias("handle"),
            "persona",
            F.col("model").alias("model_slug"),
            ledger_status("status").alias("status"),
            started.alias("started_at"),
            add_seconds(started, F.col("duration_s")).alias("ended_at"),
            F.col("miss_tokens").alias("input_tokens"),
            F.col("hit_tokens").alias("cache_read_tokens"),
            F.lit(0).cast("bigint").alias("cache_write_tokens"),
            "output_tokens",
            F.col("cost_usd").try_cast(schemas.MONEY).alias("cost_usd"),
            "ord",
        )
        .where(~is_test_handle("handle") & F.col("session_id").isNotNull())
    )


def normalize_ledger(ledger: DataFrame) -> DataFrame:
    return merge_sessions(ledger_rows(ledger))


def normalize_usage_ring(entries: DataFrame, source: str = SOURCE_USAGE_RING) -> DataFrame:
    """Usage-ring entries (with `ord`) to runs; entries carry no status, so runs are Unknown."""
    at = parse_time("ts")
    rows = entries.where(F.col("record_type") == "entry").select(
        resolve_session("session_id", "handle").alias("session_id"),
        F.lit(source).alias("source"),
        F.coalesce("handle", F.lit("")).alias("handle"),
        F.lit(None).cast("string").alias("persona"),
        F.col("model").alias("model_slug"),
        F.lit("Unknown").alias("status"),
        at.alias("started_at"),
        at.alias("ended_at"),
        *_usage("usage"),
        F.col("cost_usd").try_cast(schemas.MONEY).alias("cost_usd"),
        "ord",
    )
    return merge_sessions(rows.where(F.col("session_id").isNotNull()))


def _usage(struct: str) -> list[Column]:
    names = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")
    return [
        F.coalesce(F.col(f"{struct}.{n}"), F.lit(0)).cast("bigint").alias(f)
        for n, f in zip(names, money.TOKEN_FIELDS, strict=True)
    ]


def normalize_run_log(lines: DataFrame) -> DataFrame:
    """Run-log lines (file, line_no, RUN_LOG fields) to runs: first meta and first result line per file.

    Both lines are required and the result must name a session. There is no end time in the format, so
    these runs stay unpriced until another source delivers one.
    """
    payload = F.struct(
        "started", "handle", "persona", "session_id", "is_error", "stop_reason", "usage"
    )

    def first_line(kind: str) -> Column:
        return F.min_by(payload, F.when(F.col("type") == kind, F.col("line_no"))).alias(kind)

    both = (
        lines.where(F.col("type").isin("meta", "result"))
        .groupBy("file")
        .agg(first_line("meta"), first_line("result"))
        .where(F.col("meta").isNotNull() & ~is_blank("result.session_id"))
    )
    status = (
        F.when(F.coalesce(F.col("result.is_error"), F.lit(False)), F.lit("Failed"))
        .when(is_blank("result.stop_reason"), F.lit("Running"))
        .otherwise(F.lit("Completed"))
    )
    return to_runs(
        both.select(
            F.col("result.session_id").alias("session_id"),
            F.lit(SOURCE_RUN_LOG).alias("source"),
            blank_to_null("meta.handle").alias("external_id"),
            F.col("meta.persona").alias("persona"),
            status.alias("status"),
            F.timestamp_millis(F.rint(F.col("meta.started") * 1000).cast("bigint")).alias("started_at"),
            F.lit(None).cast("timestamp").alias("ended_at"),
            *_usage("result.usage"),
        )
    )


# ---------------------------------------------------------------- transcripts


def transcript_events(lines: DataFrame) -> DataFrame:
    """Adds the typed views `at` and `msg` (null unless `message` is a JSON object) to transcript lines."""
    msg = F.when(
        F.ltrim("message").startswith("{"), F.from_json("message", schemas.TRANSCRIPT_MESSAGE)
    )
    return lines.withColumn("at", parse_time("timestamp")).withColumn("msg", msg)


def normalize_transcript_runs(events: DataFrame, keep_file: bool = False) -> DataFrame:
    """One run per transcript file: first session id, first and last time by line order, last type and
    model, summed usage. Files whose events carry no session are dropped."""
    line = F.col("line_no")

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), line))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), line))

    model = F.col("msg.model")
    folded = events.withColumn("model", model).groupBy("file").agg(
        first("sessionId").alias("session_id"),
        first("at").alias("started_at"),
        last("at").alias("ended_at"),
        last("type").alias("type"),
        last("model").alias("model_slug"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f) for c, f in zip(_usage("msg.usage"), money.TOKEN_FIELDS, strict=True)],
    )
    return to_runs(
        folded.where(~is_blank("session_id")).select(
            "file",
            "session_id",
            F.lit(SOURCE_TRANSCRIPT).alias("source"),
            "model_slug",
            terminal_status("type").alias("status"),
            "started_at",
            "ended_at",
            *money.TOKEN_FIELDS,
        ),
        extra=("file",) if keep_file else (),
    )


def _blocks(content: Column) -> Column:
    """Object elements of a content block array (other elements are skipped); null for anything else."""
    items = F.from_json(F.when(content.startswith("["), content), "array<string>")
    objects = F.filter(items, lambda e: F.ltrim(e).startswith("{"))
    return F.transform(objects, lambda e: F.from_json(e, schemas.CONTENT_BLOCK))


def message_content(content: Column | str) -> Column:
    """Text as is; a block array gives its text blocks joined by newlines, null when it has none."""
    c = col(content)
    texts = F.transform(
        F.filter(_blocks(c), lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]
    )
    joined = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    is_array = F.from_json(F.when(c.startswith("["), c), "array<string>").isNotNull()
    return F.when(is_array, joined).when(c.startswith("{"), None).otherwise(c)


def tool_name(content: Column | str) -> Column:
    """Name of the first tool_use block, if the content is a block array."""
    used = F.filter(_blocks(col(content)), lambda b: (b["type"] == "tool_use") & b["name"].isNotNull())
    return F.get(used, F.lit(0))["name"]


def normalize_transcript_messages(events: DataFrame, keep_file: bool = False) -> DataFrame:
    """One row per line with a message object, numbered from 1 in line order.

    Lines are cut by the file split they were read from (`block`), so a huge transcript is numbered and
    back-filled split by split rather than in one task. The row's time falls back to the first time seen
    so far in the file, then to the epoch.
    """
    first_at = events.groupBy("file").agg(
        F.min_by("at", F.when(F.col("at").isNotNull(), F.col("line_no"))).alias("_first"),
        F.min(F.when(F.col("at").isNotNull(), F.col("line_no"))).alias("_first_line"),
        F.min_by("sessionId", F.when(F.col("sessionId").isNotNull(), F.col("line_no"))).alias("session_id"),
    )
    rows = number_blocked(events.where(F.col("msg").isNotNull()), ["file"], "block", ["line_no"], "sequence")
    seen = F.when(F.col("_first_line") <= F.col("line_no"), F.col("_first"))
    content = F.col("msg.content")
    out = rows.join(first_at, "file").where(~is_blank("session_id"))
    rid = run_id("session_id")
    return out.select(
        *(["file"] if keep_file else []),
        derived_id(rid, F.col("sequence")).alias("id"),
        rid.alias("run_id"),
        F.col("sequence").cast("int").alias("sequence"),
        F.coalesce(F.col("msg.role"), F.lit("")).alias("role"),
        message_content(content).alias("content"),
        tool_name(content).alias("tool_name"),
        F.col("msg.model").alias("model_slug"),
        *_usage("msg.usage"),
        F.lit(None).cast(schemas.MONEY).alias("cost_usd"),
        F.coalesce("at", seen, F.timestamp_seconds(F.lit(0))).alias("occurred_at"),
        F.lit(1).alias("version"),
    )


# ---------------------------------------------------------------- dispatch and quality checks


def is_otlp(payload: Column | str) -> Column:
    """Structural test: the top level is an object with a `resourceSpans` key (a text mention is not)."""
    keys = F.json_object_keys(col(payload))
    return F.coalesce(F.array_contains(keys, "resourceSpans"), F.lit(False))


def dispatch(
    envelopes: DataFrame, source: str = "source", payload: str = "payload", ring_source: str = SOURCE_USAGE_RING
) -> DataFrame:
    """Adds `route`: the adapter of the row's source; rows without one are `otlp` or `unknown`.

    Unknown rows are never an error; keep them for the quarantine table.
    """
    routes = (SOURCE_LEDGER, SOURCE_RUN_LOG, SOURCE_TRANSCRIPT, ring_source)
    return envelopes.withColumn(
        "route",
        F.when(F.col(source).isin(*routes), F.col(source))
        .when(F.col(source).isNull() & is_otlp(payload), F.lit("otlp"))
        .otherwise(F.lit("unknown")),
    )


def ledger_profile(ledger: DataFrame) -> DataFrame:
    """Counts behind the expected run number: rows, dropped test rows, sessions, handles reused across
    sessions. Two grouped passes with map-side combine."""
    session = resolve_session("session_id", "handle")
    tagged = ledger.select(
        is_test_handle("handle").alias("is_test"), session.alias("session"), F.col("handle")
    )
    kept = ~F.col("is_test") & F.col("session").isNotNull()
    totals = tagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_test").alias("test_dropped"),
        F.count_distinct(F.when(kept, F.col("session"))).alias("sessions"),
    )
    reused = (
        tagged.where(kept & ~is_blank("handle"))
        .groupBy("handle")
        .agg(F.count_distinct("session").alias("n"))
        .agg(F.count_if(F.col("n") >= 2).alias("reused_handles"))
    )
    return totals.withColumn("reused_handles", reused.scalar())


def redact_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Whitelist redaction of raw event lines: only type, time, session, role, model and the four usage
    counters survive; content becomes `<redacted>`. NUL characters are stripped, bad lines dropped."""
    clean = F.translate(F.col(value), "\x00", "")
    narrow = (
        "type string, timestamp string, sessionId string, "
        f"message struct<role:string,model:string,content:string,usage:{schemas.USAGE}>"
    )
    parsed = F.from_json(clean, narrow + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    m = F.col("_e.message")
    message = F.when(
        m.isNotNull(),
        F.struct(
            m["role"].alias("role"),
            m["model"].alias("model"),
            F.when(m["content"].isNotNull(), F.lit("<redacted>")).alias("content"),
            m["usage"].alias("usage"),
        ),
    )
    safe = F.struct(
        F.col("_e.type").alias("type"),
        F.col("_e.timestamp").alias("timestamp"),
        F.col("_e.sessionId").alias("sessionId"),
        message.alias("message"),
    )
    return (
        lines.withColumn("_e", parsed)
        .where(F.col("_e").isNotNull() & F.col("_e._bad").isNull())
        .withColumn("redacted", F.to_json(safe))
        .drop("_e", value)
    )
