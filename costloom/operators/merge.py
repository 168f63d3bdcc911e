"""Keyed merges (upserts without MERGE) and integrity checks.

State plus new deliveries give the next state. Merges are grouped aggregates wherever the rule allows,
so a key with very many deliveries is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom import schemas
from costloom.operators.skew import HOT_ROWS, running_max_before, with_previous_rows
from costloom.session import stage

RUN_KEY = ["session_id", "agent_id"]
PRICING = ("pricing_status", "cost_usd", "price_multiplier")
STATE_ARRIVAL = -1


def accepted_deliveries(deliveries: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds `applied`: a delivery is taken iff no earlier one of its key ended later.

    The stored end time only ever grows, so "stored" is the running maximum over earlier arrivals and the
    row-by-row rule becomes one window pass. A delivery without an end is taken only while nothing stored
    has one.
    """
    prior = running_max_before(deliveries, RUN_KEY, "arrival", "ended_at", "_prior", hot_rows)
    taken = F.col("_prior").isNull() | F.coalesce(F.col("ended_at") >= F.col("_prior"), F.lit(False))
    return prior.withColumn("applied", taken).drop("_prior")


def merge_runs(
    deliveries: DataFrame, state: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Next state of the runs table, one row per (session_id, agent_id).

    Every field is that of the last accepted delivery, except that pricing freezes at the first accepted
    Priced one and the id is that of the first delivery, for ever: messages and findings refer to it. A stored row takes part as a delivery that arrived before all others. `arrival` must be a
    unique integer per delivery. Deliveries are staged: the search for hot keys and the merge read them, and neither repeats
    what made them.
    """
    rows = deliveries.select(*schemas.columns(schemas.RUNS), "arrival")
    if state is not None:
        rows = rows.unionByName(
            state.select(*schemas.columns(schemas.RUNS)).withColumn("arrival", F.lit(STATE_ARRIVAL).cast("bigint"))
        )
    taken = accepted_deliveries(stage(rows, "deliveries"), hot_rows).where("applied")
    plain = [c for c in schemas.columns(schemas.RUNS) if c not in ("id", *RUN_KEY, *PRICING)]
    priced = F.when(F.col("pricing_status") == "Priced", F.col("arrival"))
    merged = taken.groupBy(*RUN_KEY).agg(
        F.min_by("id", "arrival").alias("id"),
        F.max_by(F.struct(*plain), "arrival").alias("_last"),
        F.max_by(F.struct(*PRICING), "arrival").alias("_last_price"),
        F.min_by(F.struct(*PRICING), priced).alias("_first_price"),
    )
    price = F.coalesce("_first_price", "_last_price")
    out = merged.select(*RUN_KEY, "id", "_last.*", price.alias("_price")).withColumns({c: F.col("_price")[c] for c in PRICING})
    return out.select(*schemas.columns(schemas.RUNS))


def stored_ids(deliveries: DataFrame) -> DataFrame:
    """(id, stored_id) of ids that differ from the id their run is stored under, the first delivery's."""
    firsts = deliveries.groupBy(*RUN_KEY).agg(F.min_by("id", "arrival").alias("stored_id"))
    other = deliveries.groupBy(*RUN_KEY, "id").agg(F.lit(1).alias("_one")).drop("_one")
    return other.join(firsts, RUN_KEY).where("id <> stored_id").select("id", "stored_id")


def latest_by_key(df: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """Last write wins per key, as a grouped arg-max."""
    rest = [c for c in df.columns if c not in (*keys, arrival)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("_row")).select(*keys, "_row.*")


def merge_messages(
    messages: DataFrame, deliveries: DataFrame, state: DataFrame | None = None
) -> DataFrame:
    """Next state of the messages table, last write per (run_id, sequence); surplus rows stay.

    `messages` carry the `arrival` of the delivery they came with; only those of accepted, Priced
    deliveries count. `deliveries` are the output of `accepted_deliveries`.
    """
    cols = schemas.columns(schemas.MESSAGES)
    good = deliveries.where(F.col("applied") & (F.col("pricing_status") == "Priced")).select("arrival")
    rows = messages.join(good, "arrival", "left_semi").select(*cols, "arrival")
    if state is not None:
        rows = rows.unionByName(state.select(*cols).withColumn("arrival", F.lit(STATE_ARRIVAL).cast("bigint")))
    return latest_by_key(rows, ["run_id", "sequence"]).select(*cols)


def merge_findings(state: DataFrame, new: DataFrame) -> DataFrame:
    """Next state of the findings table, keyed (run_id, kind, evidence_hash).

    Severity, cost and evidence follow the newer row; id, detection time and acknowledgement stay.
    """
    key = ["run_id", "kind", "evidence_hash"]
    cols = schemas.columns(schemas.FINDINGS)
    both = state.select(*cols, F.lit(0).alias("_age")).unionByName(new.select(*cols, F.lit(1).alias("_age")))
    # Rank, not only age: a batch may repeat a key, and then any order must give the same row.
    newest = F.struct("_age", "detected_at", "id")
    kept = ("id", "detected_at", "acknowledged_at", "version")
    merged = both.groupBy(*key).agg(
        F.min_by(F.struct(*kept), newest).alias("_first"),
        F.max_by(F.struct("severity", "evidence", "wasted_cost_usd"), newest).alias("_last"),
    )
    return merged.select(*key, "_first.*", "_last.*").select(*cols)


def merge_documents(state: DataFrame | None, new: DataFrame) -> DataFrame:
    """Insert-if-absent on content_hash: returns the new rows with the stored `id` and `applied`.

    Among new rows of one hash the lowest `id` is the one inserted; the rest point at it.
    """
    firsts = new.groupBy("content_hash").agg(F.min("id").alias("_first"))
    if state is None:
        stored = firsts.withColumn("_stored", F.lit(None).cast("bigint"))
    else:
        stored = firsts.join(
            state.select("content_hash", F.col("id").alias("_stored")), "content_hash", "left"
        )
    joined = new.join(stored, "content_hash")
    applied = F.col("_stored").isNull() & (F.col("id") == F.col("_first"))
    return (
        joined.withColumn("applied", applied)
        .withColumn("stored_id", F.coalesce("_stored", "_first"))
        .drop("_stored", "_first")
    )


def merge_chunks(state: DataFrame | None, new: DataFrame) -> DataFrame:
    """Replace on (document_id, ordinal); other chunks stay."""
    key = ["document_id", "ordinal"]
    if state is None:
        return latest_by_key(new.withColumn("arrival", F.lit(0)), key)
    rows = state.withColumn("arrival", F.lit(0)).unionByName(new.withColumn("arrival", F.lit(1)))
    return latest_by_key(rows, key)


def covered_days(runs: DataFrame) -> DataFrame:
    """UTC days that have at least one run with a start time."""
    return runs.where(F.col("started_at").isNotNull()).select(F.to_date("started_at").alias("bucket_day")).distinct()


def refresh_aggregate(state: DataFrame, runs: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Next state of the aggregate: covered days hold exactly the recomputed rows, other days stay."""
    cols = schemas.columns(schemas.AGGREGATE)
    return state.select(*cols).join(covered_days(runs), "bucket_day", "left_anti").unionByName(recomputed.select(*cols))


def acknowledge(findings: DataFrame, acks: DataFrame) -> DataFrame:
    """First acknowledgement wins: `acks` are (id, at); an acknowledged finding never changes."""
    first = acks.groupBy("id").agg(F.min("at").alias("_ack"))
    return (
        findings.join(first, "id", "left")
        .withColumn("acknowledged_at", F.coalesce("acknowledged_at", "_ack"))
        .select(*findings.columns)
    )


# Allowed words of the checked columns.
RUN_STATUS = ("Running", "Completed", "Failed", "Cancelled", "Unknown")
PRICING_STATUS = ("Quarantined", "Priced", "Unpriceable")
FINDING_KIND = ("ContextReplay", "Loop", "CostThreshold")
SEVERITY = ("Minor", "Major", "Critical")
TERMINAL = ("Completed", "Failed", "Cancelled")


def check_integrity(runs: DataFrame, messages: DataFrame, findings: DataFrame) -> DataFrame:
    """(check_name, violations): vocabularies, self-parents, unique keys, dangling references, and runs
    whose message costs no longer add up to the frozen run cost."""

    def bad_words(df: DataFrame, c: str, words: tuple[str, ...]) -> Column:
        return F.count_if(~F.coalesce(F.col(c).isin(*words), F.lit(False)))

    def flags(df: DataFrame, **checks: Column) -> DataFrame:
        row = df.agg(*[v.cast("bigint").alias(k) for k, v in checks.items()])
        pairs = ", ".join(f"'{k}', `{k}`" for k in checks)
        return row.select(F.expr(f"stack({len(checks)}, {pairs}) as (check_name, violations)"))

    def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        return dup.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")

    sums = messages.groupBy("run_id").agg(F.sum("cost_usd").alias("_sum"))
    owners = sums.join(runs.select(F.col("id").alias("run_id"), "cost_usd", "pricing_status"), "run_id", "left")
    return (
        flags(
            runs,
            run_status=bad_words(runs, "status", RUN_STATUS),
            pricing_status=bad_words(runs, "pricing_status", PRICING_STATUS),
            self_parent=F.count_if(F.col("parent_run_id") == F.col("id")),
        )
        .unionByName(
            flags(
                findings,
                finding_kind=bad_words(findings, "kind", FINDING_KIND),
                severity=bad_words(findings, "severity", SEVERITY),
            )
        )
        .unionByName(
            flags(
                owners,
                messages_without_run=F.count_if(F.col("pricing_status").isNull()),
                cost_sum_differs=F.count_if(
                    (F.col("pricing_status") == "Priced") & (F.col("_sum") != F.col("cost_usd"))
                ),
            )
        )
        .unionByName(duplicates(runs, RUN_KEY, "duplicate_run_key"))
        .unionByName(duplicates(messages, ["run_id", "sequence"], "duplicate_message_key"))
        .unionByName(duplicates(findings, ["run_id", "kind", "evidence_hash"], "duplicate_finding_key"))
    )


def transition_violations(deliveries: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Deliveries that move a run out of a terminal status into a different one."""
    cols = [*RUN_KEY, "arrival", "status"]
    placed, _ = with_previous_rows(deliveries.select(*cols), RUN_KEY, "arrival", 1, hot_rows)
    before = F.lag("status").over(Window.partitionBy(*RUN_KEY, "_blk").orderBy("arrival"))
    return (
        placed.withColumn("previous_status", before)
        .where(F.col("_own") & F.col("previous_status").isin(*TERMINAL) & (F.col("status") != F.col("previous_status")))
        .select(*cols, "previous_status")
    )
