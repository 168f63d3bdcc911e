"""Waste detection over a run's ordered messages: context replay, loops, cost overruns."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom import schemas
from costloom.functions import money
from costloom.functions.text import derived_id
from costloom.operators.pricing import PriceBook, as_of_time, resolve_price
from costloom.operators.skew import HOT_ROWS, with_previous_rows
from costloom.session import stage


@dataclass(frozen=True)
class WasteOptions:
    # Default thresholds.
    replay_min_read_tokens: int = 500_000
    replay_min_write_tokens: int = 100_000
    replay_window: int = 5
    loop_min_input_tokens: int = 10_000
    loop_window: int = 5
    loop_tolerance: Decimal = Decimal("0.05")
    max_run_cost_usd: Decimal = Decimal("1.00")
    major_usd: Decimal = Decimal("0.01")
    critical_usd: Decimal = Decimal("0.10")
    hot_rows: int = HOT_ROWS


def severity(cost: Column, opts: WasteOptions = WasteOptions()) -> Column:
    """Critical / Major by wasted cost, else Minor; an unknown cost is Minor."""
    return (
        F.when(cost >= F.lit(opts.critical_usd), F.lit("Critical"))
        .when(cost >= F.lit(opts.major_usd), F.lit("Major"))
        .otherwise(F.lit("Minor"))
    )


def evidence_hash(evidence: Column) -> Column:
    return F.sha2(evidence, 256)


# ---------------------------------------------------------------- ordered frame

_ROW = ("sequence", "role", "model_slug", *money.TOKEN_FIELDS, "cost_usd")


@dataclass(frozen=True)
class Frame:
    """Messages that take part in a replay or a loop.

    `writes` are the large cache writes within the replay window before a large read, `parent` is the
    nearest earlier repeat (null for none); both are message structs.
    """

    rows: DataFrame
    cut: bool  # some hot run was cut into blocks


def _is_repeat(earlier: str, opts: WasteOptions) -> str:
    """SQL condition: `earlier` has the row's role and model, and every counter within the tolerance.

    The tolerance is compared as a ratio of integers, exactly.
    """
    top, bottom = opts.loop_tolerance.as_integer_ratio()
    near = [
        f"abs({earlier}.{f} - {f}) * {bottom}L <= greatest({earlier}.{f}, {f}) * {top}L" for f in money.TOKEN_FIELDS
    ]
    return " AND ".join([f"{earlier}.role <=> role", f"{earlier}.model_slug <=> model_slug", *near])


def message_frame(messages: DataFrame, opts: WasteOptions = WasteOptions(), check: bool = True) -> Frame:
    """One shuffle and one window over (run, block) for both ordered detectors; most messages drop out here.

    Its groups are bounded even when a single run owns most messages; pass `check` = False only where the
    caller knows that no run has more than `opts.hot_rows` of them.
    """
    span = max(opts.replay_window, opts.loop_window)
    narrow = messages.select("run_id", *_ROW)
    placed, cut = with_previous_rows(narrow, ["run_id"], "sequence", span, opts.hot_rows, check)
    w = Window.partitionBy("run_id", "_blk").orderBy("sequence")
    entry = F.struct(*_ROW, F.col("_own").alias("own"))
    earlier = {f"p{k}": F.lag("_e", k).over(w) for k in range(1, span + 1)}
    framed = placed.withColumn("_e", entry).withColumns(earlier).where("_own")

    big = [f"if(p{k}.cache_write_tokens >= {opts.replay_min_write_tokens}, p{k}, null)" for k in range(1, opts.replay_window + 1)]
    writes = f"if(cache_read_tokens >= {opts.replay_min_read_tokens}, filter(array({', '.join(big)}), x -> x IS NOT NULL), null)"
    repeats = " ".join(
        f"WHEN p{k} IS NOT NULL AND {_is_repeat(f'p{k}', opts)} THEN p{k}" for k in range(1, opts.loop_window + 1)
    )
    parent = f"CASE WHEN input_tokens < {opts.loop_min_input_tokens} THEN null {repeats} END"
    rows = framed.selectExpr(
        "run_id", "_blk", "sequence", "cost_usd", *money.TOKEN_FIELDS, f"{writes} AS writes", f"{parent} AS parent"
    )
    return Frame(rows.where((F.size("writes") > 0) | F.col("parent").isNotNull()), cut)


# ---------------------------------------------------------------- context replay

# Common shape of the ordered detectors' drafts: cost known so far, and the tokens of members without a cost.
_UNKNOWN = tuple(f"unknown_{f}" for f in money.TOKEN_FIELDS)


def replay_pairs(frame: Frame) -> DataFrame:
    """(write, read) message pairs: a large cache write read back within the window."""
    return frame.rows.where(F.size("writes") > 0).select(
        "run_id",
        F.explode("writes").alias("w"),
        F.col("sequence").alias("read_sequence"),
        F.col("cache_read_tokens").alias("read_tokens"),
    )


def _replay_drafts(frame: Frame) -> DataFrame:
    unknown = F.col("w.cost_usd").isNull()
    zero = F.lit(0).cast("bigint")
    counters = F.struct(
        zero.alias("input"), F.col("read_tokens").alias("cacheRead"), F.col("w.cache_write_tokens").alias("cacheWrite"), zero.alias("output")
    )
    return replay_pairs(frame).select(
        "run_id",
        F.lit("ContextReplay").alias("kind"),
        F.coalesce("w.cost_usd", F.lit(0)).cast("decimal(30,10)").alias("known_cost"),
        unknown.alias("any_unknown"),
        *[F.when(unknown, F.col(f"w.{f}")).otherwise(zero).alias(u) for f, u in zip(money.TOKEN_FIELDS, _UNKNOWN, strict=True)],
        F.array("w.sequence", "read_sequence").alias("sequences"),
        F.col("w.model_slug").alias("model_slug"),
        counters.alias("tokens"),
    )


# ---------------------------------------------------------------- loops


def loop_links(frame: Frame) -> DataFrame:
    """Each repeating message linked to its nearest earlier repeat within the window.

    Columns: run_id, _blk, child, parent (sequences), outside (the parent lies in the block before),
    and `c` / `p`: cost and token counters of both ends.
    """
    ends = ("cost_usd", *money.TOKEN_FIELDS)
    return frame.rows.where(F.col("parent").isNotNull()).select(
        "run_id",
        "_blk",
        F.col("sequence").alias("child"),
        F.col("parent.sequence").alias("parent"),
        (~F.col("parent.own")).alias("outside"),
        F.struct(*ends).alias("c"),
        F.struct(*[F.col(f"parent.{e}").alias(e) for e in ends]).alias("p"),
    )


def _resolve_chains(links: DataFrame, keys: list[str], reach: int, carry: tuple[str, ...]) -> DataFrame:
    """Follows child -> parent links to the top of each chain inside every key group.

    A parent that is itself a child sits at most `reach` links back, so its offset is found with lag();
    pointer doubling on the offset array then reaches every top in log2(n) linear passes. Adds `top` (the
    first message of the chain) and `top_outside`.
    """
    w = Window.partitionBy(*keys).orderBy("child")
    hop = F.coalesce(
        *[F.when(F.lag("child", k).over(w) == F.col("parent"), F.lit(k)) for k in range(1, reach + 1)], F.lit(0)
    )
    rows = (
        links.withColumn("hop", hop)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("child", "parent", "outside", "hop", *carry))).alias("ls"))
    )
    start = F.transform("ls", lambda x, i: i + 1 - x["hop"])
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("ls") + F.lit(1))).cast("int"))
    tops = F.reduce(rounds, start, lambda acc, _: F.transform(acc, lambda p: F.element_at(acc, p)))
    solved = rows.select(*keys, "ls", tops.alias("tops"))
    out = F.transform(
        "ls",
        lambda x, i: F.struct(
            x["child"].alias("child"),
            x["parent"].alias("parent"),
            F.get(F.col("ls"), F.get(F.col("tops"), i) - 1)["parent"].alias("top"),
            F.get(F.col("ls"), F.get(F.col("tops"), i) - 1)["outside"].alias("top_outside"),
            *[x[c].alias(c) for c in carry],
        ),
    )
    return solved.select(*keys, F.inline(out))


def loop_members(frame: Frame, opts: WasteOptions = WasteOptions()) -> DataFrame:
    """Links with `root`, the first message of their group.

    Chains are resolved inside blocks; those that enter a block from the one before (only where a hot run
    was cut) are joined up by a second pass over the few boundary messages.
    """
    span = opts.loop_window
    inner = _resolve_chains(loop_links(frame), ["run_id", "_blk"], span, ("c", "p"))
    if not frame.cut:
        return inner.withColumnRenamed("top", "root").drop("top_outside", "_blk")
    inner = stage(inner, "loop-links")
    entries = inner.where("top_outside").select("run_id", F.col("top").alias("child")).distinct()
    boundary = entries.join(
        inner.select("run_id", "child", F.col("top").alias("parent"), F.col("top_outside").alias("outside")),
        ["run_id", "child"],
    )
    outer = _resolve_chains(boundary, ["run_id"], 2 * span, ()).select(
        "run_id", F.col("child").alias("top"), F.col("top").alias("_root")
    )
    return (
        inner.join(outer, ["run_id", "top"], "left")
        .withColumn("root", F.when(F.col("top_outside"), F.coalesce("_root", "top")).otherwise(F.col("top")))
        .drop("_root", "top", "top_outside", "_blk")
    )


def loop_groups(frame: Frame, opts: WasteOptions = WasteOptions()) -> DataFrame:
    """One row per loop: run_id, root, sequences, fingerprint `first`, known cost and unknown tokens."""
    members = loop_members(frame, opts)
    unknown = F.col("c.cost_usd").isNull()
    return members.groupBy("run_id", "root").agg(
        F.sort_array(F.collect_list("child")).alias("repeats"),
        F.min_by("p", F.when(F.col("parent") == F.col("root"), F.col("child"))).alias("first"),
        F.coalesce(F.sum("c.cost_usd"), F.lit(0)).alias("known_cost"),
        F.count_if(unknown).alias("unknown_costs"),
        *[
            F.coalesce(F.sum(F.when(unknown, F.col(f"c.{f}"))), F.lit(0)).alias(f"unknown_{f}")
            for f in money.TOKEN_FIELDS
        ],
    )


def _loop_drafts(frame: Frame, opts: WasteOptions) -> DataFrame:
    root_unknown = F.col("first.cost_usd").isNull()
    zero = F.lit(0).cast("bigint")
    names = ("input", "cacheRead", "cacheWrite", "output")
    return loop_groups(frame, opts).select(
        "run_id",
        F.lit("Loop").alias("kind"),
        (F.col("known_cost") + F.coalesce("first.cost_usd", F.lit(0))).cast("decimal(30,10)").alias("known_cost"),
        ((F.col("unknown_costs") > 0) | root_unknown).alias("any_unknown"),
        *[
            (F.col(u) + F.when(root_unknown, F.col(f"first.{f}")).otherwise(zero)).alias(u)
            for f, u in zip(money.TOKEN_FIELDS, _UNKNOWN, strict=True)
        ],
        F.concat(F.array("root"), F.col("repeats")).alias("sequences"),
        F.lit(None).cast("string").alias("model_slug"),
        F.struct(*[F.col(f"first.{f}").alias(n) for f, n in zip(money.TOKEN_FIELDS, names, strict=True)]).alias("tokens"),
    )


def _finish(drafts: DataFrame, context: DataFrame) -> DataFrame:
    """Joins drafts with their run once: costs of members without one are recomputed (null when the run has
    no price), and the evidence is written out."""
    g = drafts.join(context, "run_id")
    recomputed = money.exact_cost([F.col(u) for u in _UNKNOWN], F.col("price"), F.col("multiplier"))
    wasted = F.when(F.col("any_unknown"), F.col("known_cost") + recomputed).otherwise(F.col("known_cost"))
    replay = F.struct(
        F.col("kind").alias("kind"),
        F.lit("context-replay").alias("rule"),
        F.col("sequences").alias("messageSequences"),
        F.coalesce("model_slug", "run_model").alias("modelSlug"),
        F.col("tokens.cacheWrite").alias("cacheWriteTokens"),
        F.col("tokens.cacheRead").alias("cacheReadTokens"),
        F.struct(
            F.col("run_input").alias("input"),
            F.col("run_cache_read").alias("cacheRead"),
            F.col("run_cache_write").alias("cacheWrite"),
            F.col("run_output").alias("output"),
        ).alias("runTotals"),
    )
    loop = F.struct(
        F.col("kind").alias("kind"),
        F.lit("loop").alias("rule"),
        "sequences",
        F.size("sequences").alias("occurrences"),
        "tokens",
    )
    return g.select(
        "run_id",
        "kind",
        F.when(F.col("kind") == "Loop", F.to_json(loop)).otherwise(F.to_json(replay)).alias("evidence"),
        wasted.cast(schemas.MONEY).alias("wasted_cost_usd"),
    )


def detect_context_replay(frame: Frame, context: DataFrame) -> DataFrame:
    """Drafts (run_id, kind, evidence, wasted_cost_usd) of the replay rule; wasted = cost of the write."""
    return _finish(_replay_drafts(frame), context)


def detect_loops(frame: Frame, context: DataFrame, opts: WasteOptions = WasteOptions()) -> DataFrame:
    """Drafts of the loop rule: one per group of at least two messages; wasted = cost of all members."""
    return _finish(_loop_drafts(frame, opts), context)


# ---------------------------------------------------------------- cost threshold


def detect_cost_threshold(runs: DataFrame, opts: WasteOptions = WasteOptions()) -> DataFrame:
    """Drafts for runs at or over the cost limit; wasted = the overage (0 at equality)."""
    limit = F.lit(opts.max_run_cost_usd).cast(schemas.MONEY)
    over = (F.col("cost_usd") - limit).cast(schemas.MONEY)
    evidence = F.struct(
        F.lit("CostThreshold").alias("kind"),
        F.lit("cost-threshold").alias("rule"),
        F.col("cost_usd").alias("runCostUsd"),
        limit.alias("maxRunCostUsd"),
        over.alias("overageUsd"),
    )
    return runs.where(F.col("cost_usd") >= limit).select(
        F.col("id").alias("run_id"),
        F.lit("CostThreshold").alias("kind"),
        F.to_json(evidence).alias("evidence"),
        over.alias("wasted_cost_usd"),
    )


# ---------------------------------------------------------------- the whole service


def run_context(runs: DataFrame, book: PriceBook) -> DataFrame:
    """Ended runs with what the detectors need: totals, price row (null if unresolved) and multiplier."""
    priced = resolve_price(runs.where(F.col("ended_at").isNotNull()), book)
    mult = F.when(F.col("price").isNotNull(), money.peak_multiplier(as_of_time())).otherwise(
        F.lit("1").cast("decimal(6,3)")
    )
    return priced.select(
        F.col("id").alias("run_id"),
        F.col("model_slug").alias("run_model"),
        F.col("input_tokens").alias("run_input"),
        F.col("cache_read_tokens").alias("run_cache_read"),
        F.col("cache_write_tokens").alias("run_cache_write"),
        F.col("output_tokens").alias("run_output"),
        "price",
        mult.alias("multiplier"),
    )


def to_findings(drafts: DataFrame, detected_at: Column, opts: WasteOptions = WasteOptions()) -> DataFrame:
    """Drafts to findings rows: evidence hash, severity and a key-derived id."""
    hashed = drafts.withColumn("evidence_hash", evidence_hash(F.col("evidence")))
    return hashed.select(
        derived_id("run_id", "kind", "evidence_hash").alias("id"),
        "run_id",
        "kind",
        severity(F.col("wasted_cost_usd"), opts).alias("severity"),
        "evidence",
        "evidence_hash",
        "wasted_cost_usd",
        detected_at.alias("detected_at"),
        F.lit(None).cast("timestamp").alias("acknowledged_at"),
        F.lit(1).alias("version"),
    )


def detect_waste(
    runs: DataFrame,
    messages: DataFrame | Frame,
    book: PriceBook,
    detected_at: Column,
    opts: WasteOptions = WasteOptions(),
) -> DataFrame:
    """All findings of ended runs. Same input gives the same ids and hashes, so reruns merge to nothing.

    The framed messages are written out once for both ordered detectors: that halves the only large
    shuffle, and few messages are left in it.
    """
    frame = messages if isinstance(messages, Frame) else message_frame(messages, opts)
    frame = Frame(stage(frame.rows, "waste-frame"), frame.cut)
    ordered = _finish(_replay_drafts(frame).unionByName(_loop_drafts(frame, opts)), run_context(runs, book))
    drafts = ordered.unionByName(detect_cost_threshold(runs.where(F.col("ended_at").isNotNull()), opts))
    return to_findings(drafts, detected_at, opts)
