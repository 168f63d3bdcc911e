"""Keeping ordered work bounded when one key holds a large share of all rows.

Aggregates combine map-side and joins are split by AQE, but a window needs all rows of its partition in
one task. The helpers here cut hot keys into blocks of a unique integer order column, so that a group
never holds more than a fixed number of rows, and repair exactly what the cut separates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom.session import stage

# A key above this many rows is hot and goes through the blocked form. A table of N rows has fewer than
# N / HOT_ROWS hot keys: a trillion rows give at most a million ids.
HOT_ROWS = 1_000_000
# The hot list is broadcast only when counted at or below this many keys.
MAX_HOT_KEYS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows; counted with map-side combine over the key columns only."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)


def split_hot(
    df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None). Keys must not be null.

    The check itself is a job over the key columns; in the usual case it finds nothing and the plan stays
    the plain one.
    """
    found = hot_keys(df, keys, hot_rows)
    if found.isEmpty():
        return df, None
    hot = stage(found, "hot-keys")
    if hot.count() <= MAX_HOT_KEYS:
        hot = F.broadcast(hot)
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def block_of(order: str, width: int) -> Column:
    """Block number of a unique integer order column: a (key, block) group holds at most `width` rows."""
    return F.expr(f"cast(`{order}` as bigint) div {int(width)}")


def number_blocked(df: DataFrame, keys: list[str], block: str, order: list[str], out: str) -> DataFrame:
    """1-based position inside each key when rows come cut into ordered blocks of bounded size.

    The position is the row's rank in its block plus the sizes of the key's earlier blocks, so only the
    (small) block table is ever windowed per whole key.
    """
    in_block = Window.partitionBy(*keys, block).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, block)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        df.withColumn("_rn", F.row_number().over(in_block))
        .join(offsets, [*keys, block])
        .withColumn(out, (F.col("_rn") + F.col("_offset")).cast("bigint"))
        .drop("_rn", "_offset")
    )


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: str,
    out: str,
    hot_rows: int = HOT_ROWS,
    parts: tuple[DataFrame, DataFrame | None] | None = None,
) -> DataFrame:
    """row_number() per key by a unique integer column; hot keys are numbered block by block.

    `parts` is the result of `split_hot` where the caller has it already.
    """
    cold, hot = parts or split_hot(df, keys, hot_rows)
    plain = cold.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint")
    )
    if hot is None:
        return plain
    blocked = number_blocked(
        hot.withColumn("_blk", block_of(order, hot_rows)), keys, "_blk", [order], out
    ).drop("_blk")
    return plain.unionByName(blocked)


def with_previous_rows(
    df: DataFrame, keys: list[str], order: str, span: int, hot_rows: int = HOT_ROWS, check: bool = True
) -> tuple[DataFrame, bool]:
    """Adds `_blk` and `_own` so that a window over (keys, _blk) sees the `span` rows before every own row.

    Ordinary keys are one block. Hot keys are cut by position; the last `span` rows of a block are copied
    into the next one with `_own` = false. Keep only own rows after the window. The second result tells
    whether anything was cut. `check` = False skips the hot check where no key is known to be hot.
    """
    cold, hot = split_hot(df, keys, hot_rows) if check else (df, None)
    plain = cold.withColumn("_blk", F.lit(0).cast("bigint")).withColumn("_own", F.lit(True))
    if hot is None:
        return plain, False
    width = max(hot_rows, span)
    placed = number_blocked(
        hot.withColumn("_cut", block_of(order, hot_rows)), keys, "_cut", [order], "_pos"
    )
    blk = F.expr(f"(_pos - 1) div {width}")
    here = F.struct(blk.alias("blk"), F.lit(True).alias("own"))
    nxt = F.struct((blk + 1).alias("blk"), F.lit(False).alias("own"))
    near_end = (F.col("_pos") - 1) % F.lit(width) >= F.lit(width - span)
    copies = (
        placed.withColumn("_to", F.explode(F.when(near_end, F.array(here, nxt)).otherwise(F.array(here))))
        .withColumn("_blk", F.col("_to.blk"))
        .withColumn("_own", F.col("_to.own"))
        .drop("_to", "_cut", "_pos")
    )
    return plain.unionByName(copies), True


def running_max_before(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """max(value) over the key's strictly earlier rows (null for none); hot keys go block by block."""
    cold, hot = split_hot(df, keys, hot_rows)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    plain = cold.withColumn(out, F.max(value).over(before))
    if hot is None:
        return plain

    cut = hot.withColumn("_blk", block_of(order, hot_rows))
    blocks_before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, "_blk")
        .agg(F.max(value).alias("_m"))
        .withColumn("_carried", F.max("_m").over(blocks_before))
        .drop("_m")
    )
    in_block = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocked = (
        cut.withColumn("_in", F.max(value).over(in_block))
        .join(carried, [*keys, "_blk"])
        .withColumn(out, F.greatest("_in", "_carried"))
        .drop("_in", "_carried", "_blk")
    )
    return plain.unionByName(blocked)
