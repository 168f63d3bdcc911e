"""Cost summaries, the public aggregate and activity counts: one grouped pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costloom import schemas
from costloom.functions import money

UNKNOWN_KEY = "(unknown)"
UNKNOWN_BUCKET = "__unknown__"
MIN_BUCKET_SIZE = 5
TICKER_DAYS = 30


def in_range(runs: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Closed range on started_at; a given bound drops runs without a start."""
    if start is not None:
        runs = runs.where(F.col("started_at") >= start)
    if end is not None:
        runs = runs.where(F.col("started_at") <= end)
    return runs


def _summary() -> list[Column]:
    total = money.total_tokens()
    priced = F.when(F.col("pricing_status") == "Priced", total).otherwise(F.lit(0))
    coverage = F.try_divide(F.sum(priced).cast("double"), F.sum(total).cast("double"))
    return [
        F.count(F.lit(1)).alias("run_count"),
        *[F.coalesce(F.sum(F.coalesce(F.col(f), F.lit(0))), F.lit(0)).alias(f) for f in money.TOKEN_FIELDS],
        F.sum("cost_usd").cast("decimal(30,10)").alias("cost_usd"),
        F.sum("reported_cost_usd").cast("decimal(30,10)").alias("reported_cost_usd"),
        F.coalesce(coverage, F.lit(0.0)).alias("pricing_coverage"),
    ]


def cost_totals(runs: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row, also on empty input: counts, token sums, costs (null if none) and token coverage."""
    return in_range(runs, start, end).agg(*_summary())


def cost_by(runs: DataFrame, dimension: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Cost per UTC `day` (ascending), or per `model` / `persona` (highest cost first, unknown cost last)."""
    keys = {
        "day": F.to_date("started_at").cast("string"),
        "model": F.col("model_slug"),
        "persona": F.col("persona"),
    }
    key = F.coalesce(keys[dimension], F.lit(UNKNOWN_KEY)).alias("key")
    grouped = in_range(runs, start, end).groupBy(key).agg(*_summary())
    if dimension == "day":
        return grouped.orderBy("key")
    return grouped.orderBy(F.col("cost_usd").desc_nulls_last(), F.col("key"))


def rollup_totals(buckets: DataFrame) -> DataFrame:
    """Totals over buckets: nullable cost sums and coverage weighted by the buckets' tokens."""
    tokens = money.total_tokens()
    weighted = F.try_divide(F.sum(tokens * F.col("pricing_coverage")), F.sum(tokens).cast("double"))
    return buckets.agg(
        F.coalesce(F.sum("run_count"), F.lit(0)).alias("run_count"),
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in money.TOKEN_FIELDS],
        F.sum("cost_usd").cast("decimal(30,10)").alias("cost_usd"),
        F.sum("reported_cost_usd").cast("decimal(30,10)").alias("reported_cost_usd"),
        F.coalesce(weighted, F.lit(0.0)).alias("pricing_coverage"),
    )


def _bucket_key(c: str) -> Column:
    trimmed = F.btrim(F.col(c))
    return F.coalesce(F.when(trimmed != "", trimmed), F.lit(UNKNOWN_BUCKET)).alias(c)


def public_aggregate(runs: DataFrame, messages: DataFrame, min_size: int = MIN_BUCKET_SIZE) -> DataFrame:
    """The privacy-safe aggregate per (UTC day, model, service); buckets below `min_size` runs never appear.

    Messages are counted per run before the join, so the join sees one row per run on both sides. The
    output is exactly the allow-listed columns.
    """
    counts = messages.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("_messages"))
    dated = runs.where(F.col("started_at").isNotNull()).join(counts, "id", "left")
    zero = F.lit(0)
    buckets = dated.groupBy(
        F.to_date("started_at").alias("bucket_day"), _bucket_key("model_slug"), _bucket_key("service")
    ).agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(F.col("pricing_status") == "Priced").alias("priced_run_count"),
        F.sum(F.coalesce("_messages", zero)).alias("message_count"),
        *[F.sum(F.coalesce(F.col(f), zero)).alias(f) for f in money.TOKEN_FIELDS],
        F.sum(F.coalesce("cost_usd", zero.cast(schemas.MONEY))).cast(schemas.MONEY).alias("cost_usd"),
    )
    return buckets.where(F.col("run_count") >= min_size).select(*schemas.columns(schemas.AGGREGATE))


def model_stats(aggregate: DataFrame) -> DataFrame:
    """All-time sums per (model, service), in key order."""
    sums = ("run_count", "priced_run_count", "message_count", *money.TOKEN_FIELDS)
    return (
        aggregate.groupBy("model_slug", "service")
        .agg(*[F.sum(c).alias(c) for c in sums], F.sum("cost_usd").cast("decimal(30,10)").alias("cost_usd"))
        .orderBy("model_slug", "service")
    )


def model_directory(prices: DataFrame) -> DataFrame:
    """Prices in force without an end, in key order."""
    return prices.where(F.col("effective_to").isNull()).orderBy("slug", "service")


def model_detail(directory: DataFrame, stats: DataFrame, slug: str) -> DataFrame:
    """One model's directory entry (slug compared without case) with its usage rows (exact slug)."""
    entry = directory.where(F.lower("slug") == slug.lower())
    used = stats.withColumnRenamed("service", "usage_service").withColumnRenamed("model_slug", "slug")
    return entry.join(used, "slug", "left")


def burn_ticker(runs: DataFrame, now: Column, days: int = TICKER_DAYS) -> DataFrame:
    """Totals of the trailing days up to `now`."""
    return cost_totals(runs, now - F.expr(f"INTERVAL {int(days)} DAYS"), now)


def activity_window(runs: DataFrame, messages: DataFrame, findings: DataFrame, start: Column) -> DataFrame:
    """Runs started, messages occurred and findings detected at or after `start`, in one row."""

    def tagged(df: DataFrame, at: str, tag: str) -> DataFrame:
        return df.where(F.col(at) >= start).select(F.lit(tag).alias("tag"))

    rows = (
        tagged(runs, "started_at", "runs")
        .unionByName(tagged(messages, "occurred_at", "messages"))
        .unionByName(tagged(findings, "detected_at", "findings"))
    )
    return rows.agg(*[F.count_if(F.col("tag") == t).alias(t) for t in ("runs", "messages", "findings")])


def activity_by_window(events: DataFrame, at: str, kind: str = "kind", minutes: int = 60) -> DataFrame:
    """Counts per tumbling window and kind, for the periodic form of `activity_window`."""
    return (
        events.groupBy(F.window(at, f"{int(minutes)} minutes").alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), kind, "n")
    )
