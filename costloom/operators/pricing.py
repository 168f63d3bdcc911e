"""As-of pricing of runs and messages against a versioned price registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom.functions import money
from costloom.functions.text import is_blank, is_test_handle, normalize_slug
from costloom.functions.money import cost_expr, peak_multiplier, token_columns

# A registry side is broadcast only when counted below this many rows; beyond it the join is salted.
MAX_BROADCAST_ROWS = 200_000
SALTS = 32

PRICE_STRUCT = ("slug", "service", *money.PRICE_FIELDS, "context_window")


@dataclass(frozen=True)
class PriceBook:
    """The registry with one row per slug (and per alias): all versions in an array, newest first.

    A lookup is then one equi-join that never multiplies the run side, and picking the version in force is
    an array filter, so pricing needs no shuffle of the runs.
    """

    by_slug: DataFrame
    by_alias: DataFrame
    small: bool


# All versions of a key, newest start first (an open start is the oldest), then by service.
_VERSIONS = f"""sort_array(collect_list(struct(
    -coalesce(unix_micros(effective_from), {-(2**62)}) AS neg_from,
    service AS svc, effective_from, effective_to,
    struct({", ".join(PRICE_STRUCT)}) AS price))) AS versions"""


def price_book(
    prices: DataFrame,
    aliases: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    known_rows: int | None = None,
) -> PriceBook:
    """Folds the registry. It is broadcast only when its size is within the bound: `known_rows` where the
    caller built it from literals, else a count that stops at the bound."""

    def fits(df: DataFrame) -> bool:
        return df.limit(max_rows + 1).count() <= max_rows

    small = known_rows <= max_rows if known_rows is not None else fits(prices) and fits(aliases)
    if small:  # one task folds it without a shuffle
        prices, aliases = prices.coalesce(1), aliases.coalesce(1)
    by_slug = prices.groupBy(F.col("slug").alias("_slug")).agg(F.expr(_VERSIONS))
    via = aliases.withColumnRenamed("alias", "_slug")
    by_alias = via.join(prices, ["slug", "service"]).groupBy("_slug").agg(F.expr(_VERSIONS))
    return PriceBook(by_slug, by_alias, small)


def _attach(df: DataFrame, book: DataFrame, small: bool, out: str) -> DataFrame:
    side = book.select(F.col("_slug"), F.col("versions").alias(out))
    if small:
        return df.join(F.broadcast(side), "_slug", "left")
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = df.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return keyed.join(salted, ["_slug", "_salt"], "left").drop("_salt")


def _in_force(versions: Column, as_of: Column, service: Column | None) -> Column:
    def holds(v: Column) -> Column:
        ok = (v["effective_from"].isNull() | (v["effective_from"] <= as_of)) & (
            v["effective_to"].isNull() | (as_of < v["effective_to"])
        )
        if service is not None:
            ok = ok & (service.isNull() | (v["svc"] == service))
        return ok

    return F.get(F.filter(versions, holds), F.lit(0))["price"]


def as_of_time() -> Column:
    return F.coalesce("started_at", "ended_at")


def asof_price(runs: DataFrame, book: PriceBook, as_of: Column | None = None) -> DataFrame:
    """Adds `price` (struct or null): the newest version of the run's own slug in force at `as_of`."""
    when = as_of_time() if as_of is None else as_of
    keyed = runs.withColumn("_slug", normalize_slug("model_slug"))
    return (
        _attach(keyed, book.by_slug, book.small, "_own")
        .withColumn("price", _in_force(F.col("_own"), when, F.col("service")))
        .drop("_slug", "_own")
    )


def resolve_price(runs: DataFrame, book: PriceBook, as_of: Column | None = None) -> DataFrame:
    """`asof_price`, and where the slug itself has no row in force, the price behind its alias (looked up
    with the alias's own service)."""
    when = as_of_time() if as_of is None else as_of
    keyed = runs.withColumn("_slug", normalize_slug("model_slug"))
    both = _attach(_attach(keyed, book.by_slug, book.small, "_own"), book.by_alias, book.small, "_via")
    return both.withColumn(
        "price",
        F.coalesce(
            _in_force(F.col("_own"), when, F.col("service")), _in_force(F.col("_via"), when, None)
        ),
    ).drop("_slug", "_own", "_via")


def has_no_usage() -> Column:
    """A reported cost without a single token: nothing to recompute it from."""
    idle = F.lit(True)
    for c in token_columns():
        idle = idle & (F.coalesce(c, F.lit(0)) == 0)
    return idle & F.coalesce(F.col("reported_cost_usd") != 0, F.lit(False))


def price_runs(runs: DataFrame, book: PriceBook, keep_price: bool = False) -> DataFrame:
    """Prices ended, quarantined runs whose model resolves; all others pass through unchanged.

    `keep_price` leaves the resolved `price` struct in place for the message pass.
    """
    priced = resolve_price(runs, book)
    mult = peak_multiplier(as_of_time())
    hit = (
        F.col("ended_at").isNotNull()
        & (F.col("pricing_status") == "Quarantined")
        & ~has_no_usage()
        & F.col("price").isNotNull()
    )
    out = (
        priced.withColumn("_hit", hit)
        .withColumn("_cost", cost_expr(token_columns(), F.col("price"), mult))
        .withColumn("pricing_status", F.when(F.col("_hit"), F.lit("Priced")).otherwise(F.col("pricing_status")))
        .withColumn("cost_usd", F.when(F.col("_hit"), F.col("_cost")).otherwise(F.col("cost_usd")))
        .withColumn("price_multiplier", F.when(F.col("_hit"), mult).otherwise(F.col("price_multiplier")))
        .drop("_hit", "_cost")
    )
    return out if keep_price else out.drop("price")


def price_messages(messages: DataFrame, runs: DataFrame, book: PriceBook) -> DataFrame:
    """Message costs at the price row and multiplier of their run, so that they add up to the run's cost.

    Only the run's price columns travel to the join; AQE splits a run that owns many messages.
    """
    usable = F.col("ended_at").isNotNull() & ~has_no_usage()
    side = resolve_price(runs.where(usable), book).select(
        F.col("id").alias("run_id"), "price", peak_multiplier(as_of_time()).alias("_mult")
    )
    joined = messages.join(side, "run_id", "left")
    cost = cost_expr(token_columns(), F.col("price"), F.col("_mult"))
    return joined.withColumn("cost_usd", F.coalesce(cost, F.col("cost_usd"))).drop("price", "_mult")


# ---------------------------------------------------------------- registry and price reports


def quarantine_report(runs: DataFrame) -> DataFrame:
    """Runs left without a price, per model slug: count and tokens."""
    return (
        runs.where(F.col("pricing_status") == "Quarantined")
        .groupBy(F.coalesce("model_slug", F.lit("(unknown)")).alias("model_slug"))
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            F.count_if(F.col("ended_at").isNull()).alias("open_runs"),
            F.sum(money.total_tokens()).alias("tokens"),
        )
    )


def price_overlaps(prices: DataFrame) -> DataFrame:
    """Pairs of neighbouring versions of one (slug, service) whose validity overlaps; must be empty.

    A row overlaps an earlier one exactly when it starts before the latest end seen so far.
    """
    start = F.coalesce(F.unix_micros("effective_from"), F.lit(-(2**62)).cast("bigint"))
    end = F.coalesce(F.unix_micros("effective_to"), F.lit(2**62).cast("bigint"))
    w = Window.partitionBy("slug", "service").orderBy("_start", "_end").rowsBetween(Window.unboundedPreceding, -1)
    return (
        prices.withColumn("_start", start)
        .withColumn("_end", end)
        .withColumn("_prior_end", F.max("_end").over(w))
        .where(F.col("_start") < F.col("_prior_end"))
        .select("slug", "service", "effective_from", "effective_to")
    )


# ---------------------------------------------------------------- reconciliation

PIN_TOLERANCE = "0.000001"


def eligible(ledger: DataFrame) -> DataFrame:
    """Ledger rows fit for reconciliation: no test handle, three token counts and a `peak` flag."""
    needed = ["hit_tokens", "miss_tokens", "output_tokens", "peak"]
    ok = ~is_test_handle("handle")
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    return ledger.where(ok)


def reconcile_runs(runs: DataFrame, off_peak: DataFrame, book: PriceBook) -> DataFrame:
    """Recomputes merged ledger runs at multiplier 1 and compares with what they reported.

    `off_peak` carries (session_id, off_peak): true when every row of the session was off-peak. Adds
    `resolved_slug`, `computed_cost_usd`, `residual`, `off_peak` and `pinned`.
    """
    one = F.lit("1").cast("decimal(6,3)")
    priced = resolve_price(runs, book).join(off_peak, "session_id")
    cost = cost_expr(token_columns(), F.col("price"), one)
    return (
        priced.withColumn("resolved_slug", F.col("price.slug"))
        .withColumn("computed_cost_usd", cost)
        .withColumn("residual", F.abs(cost - F.coalesce("reported_cost_usd", F.lit(0))).cast("decimal(20,10)"))
        .withColumn(
            "pinned",
            F.coalesce(
                F.col("off_peak") & (F.col("residual") <= F.lit(PIN_TOLERANCE).cast("decimal(20,10)")), F.lit(False)
            ),
        )
        .drop("price")
    )


def reconcile_report(compared: DataFrame) -> DataFrame:
    """One row: resolution, peak split, pins, near misses and token coverage."""
    resolved = F.col("resolved_slug").isNotNull()
    off = resolved & F.col("off_peak")
    near = off & ~F.col("pinned")
    tokens = money.total_tokens()
    return compared.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(resolved).alias("resolved"),
        F.count_if(~resolved).alias("unresolved"),
        F.count_if(off).alias("off_peak_candidates"),
        F.count_if(resolved & ~F.col("off_peak")).alias("peak_excluded"),
        F.count_if("pinned").alias("pinned"),
        F.count_if(near).alias("near_miss"),
        F.max(F.when(near, F.col("residual"))).alias("near_miss_max_residual"),
        F.sum(tokens).alias("total_tokens"),
        F.sum(F.when(resolved, tokens)).alias("resolved_tokens"),
        F.sum(F.when(F.col("pinned"), tokens)).alias("pinned_tokens"),
    )


def reconcile_by_model(compared: DataFrame) -> DataFrame:
    """Per resolved model: sessions, pins and the largest residual."""
    return (
        compared.where(F.col("resolved_slug").isNotNull())
        .groupBy("resolved_slug")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.count_if("pinned").alias("pinned"),
            F.max("residual").alias("max_residual"),
        )
    )
