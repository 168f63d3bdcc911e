"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources share all words by their weights; a source is used at most `MAX_PASSES` times, what it can't give is shared
   among the others by weight.
2. A source is cut into shards of about `SHARD_WORDS` words by a seeded hash of the document ids, so that a source with
   a third of all rows is many shards. Votes of a shard are its part of the source's target.
3. All shards share total / `BLOCK_WORDS` seats by the highest quotients votes / (2k + 1): an integer quota of blocks per shard.
4. A shard's documents stand in seeded order; its words are cut into blocks, and a seeded permutation of the block
   numbers says which of them are taken once more than the others.

Only rows of numbers are shuffled for the plan; one pass over documents measures them.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from costloom.llm.wordhash import as_bytes, released
from costloom.session import stage

# Weights by position of the source, repeating, and the most passes over a source.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 32
SHARD_WORDS = 200_000
SEED = 7
# A prime above any number of blocks of a shard: multiplication by it permutes block numbers.
PRIME = 2**31 - 1
_WORD = re.compile(rb"[^ \t-\r]+")


def n_words(text: Column) -> Column:
    """Matches of [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With sources by rising cap / weight, the level of the first source that does not reach its cap is the level of
    all later ones; earlier ones stay at their caps. One row per source goes through these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    capped = ranked.withColumn("cap", max_passes * F.col("source_size").cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("fill", F.col("source").asc_nulls_last())
    levels = (
        capped.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("used", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("left"))
    )
    first = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "level"))).over(Window.partitionBy())
    return levels.withColumn("at", F.coalesce(first["level"], F.lit(0.0))).select(
        "source", "source_size", F.least("cap", F.col("weight") * F.col("at")).alias("target")
    )


def apportion(units: DataFrame, seats: int, keys: list[str]) -> DataFrame:
    """`units` (keys, votes double) with `quota` long: Sainte-Lague seats, exactly `seats` in all if there are votes.

    A unit holds every quotient votes / (2k + 1) above half a divisor, so floor(votes / divisor + 1/2) of them. One
    aggregate counts the seats of many divisors at once; two such rounds enclose the right divisor closely, and only
    the few quotients between the last two divisors are ranked. Ties go to the first keys.
    """
    votes = units.agg(F.sum("votes"), F.max("votes")).first()
    if seats <= 0 or not votes[0]:
        return units.withColumn("quota", F.lit(0).cast("long"))

    def given(d: float) -> Column:
        return F.floor(F.col("votes") / F.lit(d) + 0.5)

    # Many seats at the low end, none at the high one.
    low, high = votes[0] / (2 * seats + units.count() + 2), 2 * votes[1] + 1
    for _ in range(3):
        steps = [low * (high / low) ** (i / 63) for i in range(64)]
        counts = units.agg(*[F.sum(given(d)).alias(f"c{i}") for i, d in enumerate(steps)]).first()
        at = max(i for i in range(63) if counts[i] >= seats)
        low, high = steps[at], steps[at + 1]
        sure = int(counts[at + 1])
        if counts[at] - sure <= 4096:
            break
    seat = F.explode(F.sequence(given(high), given(low) - 1)).alias("_seat")
    between = units.where(given(low) > given(high)).select(*keys, "votes", seat)
    ranked = between.orderBy((F.col("votes") / (2 * F.col("_seat") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in keys]).limit(seats - sure)
    extra = ranked.groupBy(*[F.col(c).alias(f"x_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("more"))
    same = None
    for c in keys:
        part = F.col(c).eqNullSafe(F.col(f"x_{c}"))
        same = part if same is None else same & part
    return units.join(extra, same, "left").select(*units.columns, (given(high) + F.coalesce("more", F.lit(0))).cast("long").alias("quota"))


# Groups of the rows without words of a shard.
EMPTY_GROUPS = 4096


def plan(docs: DataFrame, carried: list[str], seed: int = SEED) -> DataFrame:
    """`docs` needs source, size and doc_id; adds source_size, target, and of each row its first word's position in
    the shard (`at`), the shard's blocks and quota (`blocks`, `quota`) and the permutation's shift (`shift`)."""
    mixed = F.xxhash64(F.lit(seed), "doc_id")
    narrow = docs.select("doc_id", "source", "size")
    sources = stage(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))), "mixing-sources")
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long")
    # Sources with the same null-safe name; one row per source.
    named = sources.select(F.col("source").alias("s_source"), "source_size", "target", shards_of.alias("n_shards"))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("n_shards"))

    def placed(df: DataFrame) -> DataFrame:
        return df.join(named, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("shard", shard).drop("s_source", "n_shards")

    sizes = placed(narrow).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    votes = F.coalesce(F.col("target") * F.col("shard_size") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    units = stage(sizes.select("source", "shard", "shard_size", votes.alias("votes")), "mixing-shards")
    total = int(units.agg(F.sum("shard_size")).first()[0] or 0)
    quotas = apportion(units, (total + BLOCK_WORDS // 2) // BLOCK_WORDS, ["source", "shard"])
    given = stage(
        quotas.select(
            F.col("source").alias("q_source"),
            F.col("shard").alias("q_shard"),
            F.ceil(F.col("shard_size") / BLOCK_WORDS).cast("long").alias("blocks"),
            "quota",
            F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.lit(PRIME)).alias("shift"),
        ),
        "mixing-quotas",
    )
    # Rows without words take no place; they may be any number in one shard, so they are windowed in groups of their own.
    apart = F.when(F.col("size") == 0, F.pmod(mixed, F.lit(EMPTY_GROUPS))).otherwise(F.lit(-1))
    order = Window.partitionBy("source", "shard", apart).orderBy(mixed, "doc_id", "size", *[c for c in carried if c == "text"])
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return (
        placed(docs)
        .withColumn("at", before)
        .join(given, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
        .drop("q_source", "q_shard", "shard")
    )


def _times(block: Column) -> Column:
    """How often a block of the shard is taken."""
    once_more = F.pmod(block * PRIME + F.col("shift"), F.col("blocks")) < F.col("quota") % F.col("blocks")
    return F.least(F.lit(MAX_PASSES).cast("long"), F.floor(F.col("quota") / F.col("blocks")) + once_more.cast("long"))


def taken() -> Column:
    """Words of a planned row that the mix takes, repeats counted."""
    first, last = F.expr(f"at div {BLOCK_WORDS}"), F.expr(f"(at + size - 1) div {BLOCK_WORDS}")
    overlap = lambda b: F.least(F.col("at") + F.col("size"), (b + 1) * BLOCK_WORDS) - F.greatest(F.col("at"), b * BLOCK_WORDS)
    total = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, b: acc + overlap(b) * _times(b))
    return F.when(F.col("size") > 0, total).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null texts and texts without words have size 0 and give nothing. A null source is a source of its own, last in order. Null
    and repeated ids keep their rows; rows that are alike in id and size may swap results. Reruns agree. An empty table
    gives no rows; extra columns are ignored.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    sized = stage(sized, "mixing-sizes")
    return plan(sized, [], seed).select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def passes_of(text: bytes, at: int, blocks: int, quota: int, shift: int) -> list[bytes]:
    """The text of each pass: whole where all of it is taken, else its taken stretches on lines of their own."""
    words = [m.span() for m in _WORD.finditer(text)]
    if not words or not blocks:
        return []
    times = {}
    for b in range(at // BLOCK_WORDS, (at + len(words) - 1) // BLOCK_WORDS + 1):
        times[b] = min(MAX_PASSES, quota // blocks + ((b * PRIME + shift) % blocks < quota % blocks))
    out = []
    for k in range(1, MAX_PASSES + 1):
        if all(t >= k for t in times.values()):
            out.append(text)
            continue
        parts, open_at = [], None
        for i in range(len(words) + 1):
            on = i < len(words) and times[(at + i) // BLOCK_WORDS] >= k
            if on and open_at is None:
                open_at = words[i][0]
            if not on and open_at is not None:
                parts.append(text[open_at : words[i - 1][1]])
                open_at = None
        if parts:
            out.append(b"\n".join(parts))
    return out


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus: one row per document and pass, with the columns of `docs` (doc_id, text, source and others). The
    text of a pass is what the mix takes of it; n_chars, if there is one, is measured again."""

    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *numbers in batches:
            rows = zip(as_bytes(texts), *(n.to_pylist() for n in numbers), strict=True)
            yield pa.array([[p.decode("utf-8") for p in passes_of(t or b"", *r)] for t, *r in rows], pa.list_(pa.string()))

    names = docs.columns
    clear = docs.select([F.col(c) if c in ("doc_id", "source", "text") else F.col(c).alias(f"_in_{c}") for c in names]).withColumn("size", n_words(F.col("text")))
    planned = plan(clear, ["text"], seed)
    texts = planned.withColumn("_passes", arrow_udf(released(cut), "array<string>")("text", "at", "blocks", "quota", "shift"))
    one = texts.withColumn("_pass", F.explode("_passes"))
    chars = lambda: F.char_length("_pass").cast(docs.schema["n_chars"].dataType)
    return one.select(
        [F.col("_pass").alias(c) if c == "text" else chars().alias(c) if c == "n_chars" else F.col(c) if c in ("doc_id", "source") else F.col(f"_in_{c}").alias(c) for c in names]
    )
