"""As-of lookup against a long price history: versions and runs are merged in time order.

`pricing` keeps all versions of a slug in one array, which suits a registry of a few versions. Here no row ever holds a
history: the last version before a run is carried forward over the sorted union of both. The union is cut into stretches of
time; a stretch starts with the version in force when it begins, so that a slug which owns most rows is merged
in many tasks, and a stretch with very many runs is dealt to several copies of its few versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom.functions.text import normalize_slug
from costloom.operators.pricing import MAX_BROADCAST_ROWS, SALTS, as_of_time
from costloom.session import stage

# Bounds of versions that are open on a side, in microseconds.
OPEN_START, OPEN_END = -(2**62), 2**62
# Microseconds of a stretch, and runs of one (slug, service, stretch) above which it is dealt to several groups.
STRETCH = 86_400_000_000
HOT_ROWS = 1_000_000
KEY = ["_slug", "_svc"]


def timeline(prices: DataFrame) -> DataFrame:
    """(_slug, _svc, _from, _to, _since, _price): disjoint stretches of each (slug, service) with the version in force.

    Where versions overlap the newest start wins and an older one returns when it ends; equal starts go to the open or
    earlier end. Versions that end before they start are never in force. `_since` is the version's own start.
    """
    fields = [c for c in prices.columns if c not in ("effective_from", "effective_to")]
    rows = prices.select(
        F.col("slug").alias("_slug"),
        F.col("service").alias("_svc"),
        F.coalesce(F.unix_micros("effective_from"), F.lit(OPEN_START)).alias("_from"),
        F.coalesce(F.unix_micros("effective_to"), F.lit(OPEN_END)).alias("_to"),
        F.unix_micros("effective_to").alias("_ends"),
        F.struct(*fields).alias("_price"),
    ).where("_from < _to")
    before = Window.partitionBy(*KEY).orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEY).orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("_to").over(before)
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("_from") >= reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(upto))
    island = [*KEY, "_island"]
    sized = stage(marked.drop("_new").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*island))), "history-versions")
    plain = sized.where("_n = 1").select(*KEY, "_from", "_to", F.col("_from").alias("_since"), "_price")
    # Versions that overlap: the best one at each of their bounds holds until the next bound.
    tied = sized.where("_n > 1").drop("_n")
    cuts = tied.select(*island, F.explode(F.array("_from", "_to")).alias("_at")).distinct()
    best = F.min_by(F.struct(F.col("_from").alias("since"), "_price"), F.struct(-F.col("_from"), F.col("_ends"), "_price"))
    held = cuts.join(tied, island).where("_from <= _at and _at < _to").groupBy(*island, "_at").agg(best.alias("v"))
    ends = cuts.withColumn("_next", F.lead("_at").over(Window.partitionBy(*island).orderBy("_at")))
    split = held.join(ends, [*island, "_at"]).select(*KEY, F.col("_at").alias("_from"), F.col("_next").alias("_to"), F.col("v.since").alias("_since"), F.col("v._price").alias("_price"))
    return plain.unionAll(split)


def _names(prices: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(_name, _probes): what a slug is looked up as, its own (slug, service) pairs first, then those behind aliases."""
    pairs = prices.select(F.col("slug").alias("_name"), F.lit(0).alias("prio"), "slug", "service").distinct()
    if aliases is not None:
        pairs = pairs.unionAll(aliases.select(F.col("alias").alias("_name"), F.lit(1).alias("prio"), "slug", "service").distinct())
    return pairs.groupBy("_name").agg(F.collect_list(F.struct("prio", "slug", "service")).alias("_probes"))


def _looked_up(runs: DataFrame, names: DataFrame, when: Column, key: str) -> DataFrame:
    """Runs with `_name`, `_t` and one row per pair to look at; one row without a pair where there is none."""
    keyed = runs.select(F.col(key).alias("_key"), F.unix_micros(when).alias("_t"), normalize_slug("model_slug").alias("_name"), F.col("service").alias("_own"))
    names = stage(names, "history-names")
    if names.count() <= MAX_BROADCAST_ROWS:
        met = keyed.join(F.broadcast(names), "_name", "left")
    else:
        salted = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted, ["_name", "_salt"], "left").drop("_salt")
    fits = F.filter("_probes", lambda p: (p["prio"] == 1) | F.col("_own").isNull() | (p["service"] == F.col("_own")))
    return met.withColumn("_p", F.explode_outer(fits)).select("_key", "_t", F.col("_p.prio").alias("_prio"), F.col("_p.slug").alias("_slug"), F.col("_p.service").alias("_svc"))


def _merged(probes: DataFrame, line: DataFrame, stretch: int, hot_rows: int) -> DataFrame:
    """`probes` with a time: (_key, _prio, _svc, _since, _price), the last version before each, where it is in force."""
    block = lambda c: F.expr(f"{c} div {stretch} - if({c} % {stretch} < 0, 1, 0)").alias("_block")
    timed = probes.withColumn("_block", block("_t"))
    place = [*KEY, "_block"]
    need = stage(timed.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")), "history-stretches")
    version = F.struct("_from", "_to", "_since", "_price")
    # The version in force where a stretch begins.
    starts = need.select(*KEY, (F.col("_block") * stretch).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(line.select(version.alias("v")).schema["v"].dataType).alias("_v"))
    both = line.select(*KEY, F.col("_from").alias("_at"), F.lit(0).alias("_kind"), version.alias("_v")).unionAll(starts)
    carry = Window.partitionBy(*KEY).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opening = both.withColumn("_v", F.last("_v", ignorenulls=True).over(carry)).where("_kind = 1 and _v is not null")
    opening = opening.select(*KEY, block("_at"), "_at", "_v")
    inside = line.select(*KEY, block("_from"), F.col("_from").alias("_at"), version.alias("_v"))
    copies = need.select(*place, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_copies"))
    given = opening.unionAll(inside).join(copies, place).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    hot = stage(copies.where("_copies > 1"), "history-hot")
    if hot.isEmpty():
        dealt = timed.withColumn("_salt", F.lit(0))
    else:
        salt = F.pmod(F.xxhash64("_key"), F.coalesce("_copies", F.lit(1))).cast("int")
        dealt = timed.join(hot, place, "left").withColumn("_salt", salt).drop("_copies")
    asked = dealt.select(*place, "_salt", F.col("_t").alias("_at"), F.lit(1).alias("_kind"), "_key", "_prio")
    rows = asked.unionByName(given.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    last = Window.partitionBy(*place, "_salt").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(last)).where("_kind = 1 and _at < _v._to")
    return found.select("_key", "_prio", "_svc", F.col("_v._since").alias("_since"), F.col("_v._price").alias("_price"))


def asof_merge(
    runs: DataFrame,
    prices: DataFrame,
    aliases: DataFrame | None = None,
    as_of: Column | None = None,
    key: str = "id",
    stretch: int = STRETCH,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`runs` with `price`: what `pricing.resolve_price` finds, for histories of any length.

    `key` is a unique column of the runs. The newest version of the run's own slug in force counts (of any service where the run
    names none; ties go to the smaller service), then the one behind an alias, with the alias's own service. A run without a
    time takes only versions open on both sides. `price` holds all columns of `prices` but its two bounds; it is null
    where nothing is in force. Prices of one (slug, service) are sorted in one task: one row for each change of a price.
    """
    when = as_of_time() if as_of is None else as_of
    line = stage(timeline(prices), "history-line")
    probes = _looked_up(runs, _names(prices, aliases), when, key)
    timeless = prices.where("effective_from is null and effective_to is null").select(
        F.col("slug").alias("_slug"), F.col("service").alias("_svc"), F.struct(*[c for c in prices.columns if c not in ("effective_from", "effective_to")]).alias("_price")
    )
    always = timeless.groupBy(*KEY).agg(F.min("_price").alias("_price"))
    untimed = probes.where("_slug is not null and _t is null").join(always, KEY).select("_key", "_prio", "_svc", F.lit(OPEN_START).alias("_since"), "_price")
    found = _merged(probes.where("_slug is not null and _t is not null"), line, stretch, hot_rows).unionByName(untimed)
    # Only keys and prices travel; of several pairs of one run the best.
    chosen = found.groupBy("_key").agg(F.min_by("_price", F.struct("_prio", -F.col("_since"), "_svc")).alias("price"))
    return runs.join(chosen.withColumnRenamed("_key", key), key, "left").select(*runs.columns, "price")
