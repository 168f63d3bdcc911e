"""A Merkle manifest of a dataset whose subtrees lie in van Emde Boas order.

Every row becomes a leaf digest. The leaves of a group (a language) ascend by id; every two consecutive nodes become
their parent until one is left, the group's subroot; the subroots, in order of their groups, give the root the same way.

A tree is stored as tiers of aligned blocks. A block holds the subtree over 2^HEIGHT consecutive nodes of its tier as one
array of digests in van Emde Boas order: a subtree of L levels is its upper L // 2 levels, then each subtree below them
from left to right, all laid out by the same rule. The place of a node is arithmetic on its depth and index (`address`);
nothing else is stored, and any path touches few stretches of memory whatever the cache's line size. The roots of the blocks
are the nodes of the next tier, so blocks are built and read independently of each other in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom.session import stage

# Levels of parents in a block: 1024 leaves and 2047 digests, 64 KB.
HEIGHT = 10
DIGEST = 32
# Steps of a path: the node is alone in its run, or its sibling stands to the right or left.
ALONE, RIGHT, LEFT = 0, 1, 2
BLOCK_DDL = "grp string, block long, n int, levels int, root binary, nodes binary"


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes `index` of one depth (0 is the root) in a complete tree of `levels` levels."""
    index = np.asarray(index, np.int64)
    at = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth -= upper
        levels -= upper
        at += (2**upper - 1) + (index >> depth) * (2**levels - 1)
        index = index & (2**depth - 1)
    return at


def parents(nodes: np.ndarray) -> np.ndarray:
    """Digests of every two consecutive rows of an (n, 32) array; a last single row is hashed alone."""
    text = nodes.tobytes().hex().encode()
    step = 4 * DIGEST
    return np.frombuffer(b"".join(sha256(text[i : i + step]).digest() for i in range(0, len(text), step)), np.uint8).reshape(-1, DIGEST)


def lay_out(leaves: np.ndarray, levels: int) -> np.ndarray:
    """The block over `leaves` (n, 32): all digests in van Emde Boas order, zeros where a short block has no node."""
    out = np.zeros((2**levels - 1, DIGEST), np.uint8)
    now = leaves
    for depth in range(levels - 1, -1, -1):
        out[address(depth, np.arange(len(now)), levels)] = now
        if depth:
            now = parents(now)
    return out


def path_of(nodes: np.ndarray, n: int, levels: int, slots: np.ndarray) -> list[bytes]:
    """The steps from each of `slots` to the block's root: a byte and, unless alone, the sibling's digest."""
    out = [b""] * len(slots)
    at, width = np.asarray(slots, np.int64), n
    for depth in range(levels - 1, 0, -1):
        other = at ^ 1
        there = other < width
        found = nodes[address(depth, np.where(there, other, at), levels)].tobytes()
        for i, (has, side) in enumerate(zip(there.tolist(), (at & 1).tolist())):
            out[i] += (b"\x02" if side else b"\x01") + found[i * DIGEST : (i + 1) * DIGEST] if has else b"\x00"
        at, width = at >> 1, (width + 1) >> 1
    return out


def siblings(path: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(path):
        side = path[at]
        at += 1
        if side == ALONE:
            yield side, b""
        else:
            yield side, path[at : at + DIGEST]
            at += DIGEST


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a digest and its path lead to."""
    for side, other in siblings(path):
        pair = digest.hex() + other.hex() if side != LEFT else other.hex() + digest.hex()
        digest = sha256(pair.encode()).digest()
    return digest


def proof_digest(path: bytes) -> str:
    return sha256("".join(other.hex() for _, other in siblings(path)).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(id_: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the fields, each with its length before it."""
    return F.unhex(F.sha2(F.concat(*map(_field, (id_, source, lang, n_chars, text))).cast("binary"), 256))


def group_key(lang: Column) -> Column:
    """A string that orders groups as their names do bytewise, null first."""
    return F.coalesce(F.concat(F.lit("1"), lang.cast("string")), F.lit("0"))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` (staged, with grp) with `rank`, their place in their group by `order`, and `total`, its size.

    One range shuffle sorts all rows; places follow from the starts of the groups in each partition, so a group that owns most
    rows is spread like any other. Rows that are equal in all of `order` are told apart by their place in the files, so that
    repeats of one row don't meet in one task either.
    """
    keys = ["grp", *order, "_mark"]
    ordered = rows.withColumn("_mark", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = stage(ordered.drop("_mark").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    runs = kept.groupBy(part.alias("_part"), "grp").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", "grp", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    placed = kept.withColumn("_part", part).join(runs, ["_part", "grp"])
    return placed.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _build(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks over (grp, rank, total, digest)."""
    size = 2**height

    def work(key: tuple, table: pa.Table) -> pa.Table:
        slot = table["rank"].to_numpy() % size
        digests = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, DIGEST)
        whole = table["total"][0].as_py() > size
        levels = 1 + (height if whole else (len(slot) - 1).bit_length())
        out = lay_out(digests[np.argsort(slot)], levels)
        return pa.table(
            {
                "grp": [key[0].as_py()], "block": [key[1].as_py()], "n": pa.array([len(slot)], pa.int32()),
                "levels": pa.array([levels], pa.int32()), "root": pa.array([out[0].tobytes()], pa.binary()), "nodes": pa.array([out.tobytes()], pa.binary()),
            }
        )

    cut = nodes.select("grp", F.shiftright("rank", height).alias("block"), "rank", "total", "digest")
    return cut.groupBy("grp", "block").applyInArrow(work, BLOCK_DDL)


@dataclass
class Tree:
    """`tiers[0]` are the blocks over the leaves, `tiers[k + 1]` those over the roots of `tiers[k]`; all are staged."""

    tiers: list[DataFrame]
    height: int

    def roots(self) -> DataFrame:
        """(grp, digest) of every group: the root of its only block in its last tier."""
        whole = None
        for tier, above in zip(self.tiers, [*self.tiers[1:], None]):
            own = tier.select("grp", F.col("root").alias("digest"))
            own = own if above is None else own.join(above.select("grp").distinct(), "grp", "left_anti")
            whole = own if whole is None else whole.unionAll(own)
        return whole


def grow(nodes: DataFrame, height: int = HEIGHT) -> Tree:
    """The trees of all groups of (grp, rank, total, digest). Every tier has 2^height times fewer rows than the one below."""
    tiers = []
    while True:
        tier = stage(_build(nodes, height), "merkle-blocks")
        tiers.append(tier)
        nodes = (
            tier.select("grp", F.col("block").alias("rank"), F.col("root").alias("digest"), F.count(F.lit(1)).over(Window.partitionBy("grp")).alias("total"))
            .where("total > 1")
        )
        if nodes.isEmpty():
            return Tree(tiers, height)


def _extend(rows: DataFrame, tier: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """`rows` (grp, rank, ...) with `path` through their block of `tier`, then on through `upper` (grp, block, path)."""
    size = 2**height
    names = rows.columns
    blocks = tier.select("grp", "block", "n", "levels", "nodes").join(upper.withColumnRenamed("path", "above"), ["grp", "block"])

    def work(table: pa.Table, block: pa.Table) -> pa.Table:
        if not block.num_rows or not table.num_rows:
            return table.select(names).append_column("path", pa.nulls(table.num_rows, pa.binary()))
        nodes = np.frombuffer(block["nodes"][0].as_py(), np.uint8).reshape(-1, DIGEST)
        above = block["above"][0].as_py()
        paths = path_of(nodes, block["n"][0].as_py(), block["levels"][0].as_py(), table["rank"].to_numpy() % size)
        return table.select(names).append_column("path", pa.array([p + above for p in paths], pa.binary()))

    ddl = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", path binary"
    cut = rows.withColumn("block", F.shiftright("rank", height))
    return cut.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(work, ddl)


def paths(rows: DataFrame, tree: Tree, above: DataFrame) -> DataFrame:
    """`rows` (grp, rank, ...) with `path`, their siblings up to the group's root and on through `above` (grp, path)."""
    upper = None
    for k in range(len(tree.tiers) - 1, -1, -1):
        tier = tree.tiers[k]
        # Blocks that end their group's tree go on above it, the others through the tier over them.
        last = tier.select("grp", "block").join(above, "grp")
        if upper is not None:
            last = last.join(upper.select("grp").distinct(), "grp", "left_anti").unionAll(upper.select("grp", F.col("rank").alias("block"), "path"))
        if k == 0:
            return _extend(rows, tier, last, tree.height)
        upper = stage(_extend(tree.tiers[k - 1].select("grp", F.col("block").alias("rank")).join(tier.select("grp").distinct(), "grp", "left_semi"), tier, last, tree.height), "merkle-paths")
    raise AssertionError("a tree has a tier")


@dataclass
class Manifest:
    """`rows` are the leaves (grp, rank, total, digest and what else was given), `tree` the groups' trees, `top` the tree over the
    subroots, `groups` (grp, subroot, path) and `root` the digest over all, None for an empty dataset."""

    rows: DataFrame
    tree: Tree
    top: Tree
    groups: DataFrame
    root: bytes | None

    def blocks(self) -> DataFrame:
        """All stored blocks: tree (groups or root), tier, grp, block, n, levels, root, nodes."""
        whole = None
        for tree, name in ((self.tree, "groups"), (self.top, "root")):
            for k, tier in enumerate(tree.tiers):
                own = tier.select(F.lit(name).alias("tree"), F.lit(k).alias("tier"), "*")
                whole = own if whole is None else whole.unionAll(own)
        return whole


def build_manifest(leaves: DataFrame, order: list[str], height: int = HEIGHT) -> Manifest:
    """The manifest of `leaves` (grp, digest and the columns of `order`, staged)."""
    rows = stage(ranked(leaves, order, "merkle-order"), "merkle-leaves")
    tree = grow(rows, height)
    subroots = stage(tree.roots(), "merkle-subroots")
    named = stage(ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"], "merkle-order"), "merkle-groups")
    top = grow(named, height)
    root = top.roots().first()
    nothing = top.roots().select("grp", F.lit(b"").alias("path"))
    groups = stage(paths(named, top, nothing).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "path"), "merkle-tops")
    return Manifest(rows, tree, top, groups, bytes(root.digest) if root else None)


def _folded(start: Column, path: Column) -> Column:
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for starts, ways in batches:
            both = zip(starts.to_pylist(), ways.to_pylist())
            yield pa.array([{"proof": proof_digest(p), "root": fold(s, p).hex()} for s, p in both], pa.struct([("proof", pa.string()), ("root", pa.string())]))

    return F.arrow_udf(work, "proof string, root string")(start, path)


def verify_documents(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `tampered` marks rows (over the columns of `docs`) whose n_chars is taken one higher when the root is recomputed from
    the row and its stored siblings; by default none is.

    Nulls are fields of their own (`-`) and a null lang is a group of its own, before all others; null ids stand first in
    their group. Rows with one id are ordered by their digests; repeated rows are leaves of their own. Texts are hashed whole in
    the JVM and are not shuffled. An empty table gives no rows; extra columns are ignored.
    """
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    fields = [F.col("doc_id"), F.col("source"), F.col("lang")]
    honest = leaf_digest(*fields, F.col("n_chars"), F.col("text"))
    marked = F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull() if tampered is not None else F.lit(False)
    leaves = stage(
        docs.select(
            group_key(F.col("lang")).alias("grp"),
            F.col("doc_id").cast("long").alias("doc_id"),
            honest.alias("digest"),
            F.when(marked, leaf_digest(*fields, more, F.col("text"))).alias("changed"),
        ),
        "merkle-rows",
    )
    whole = build_manifest(leaves, ["doc_id", "digest"], height)
    proven = paths(whole.rows, whole.tree, whole.groups.select("grp", "path"))
    found = proven.select("grp", "doc_id", "digest", _folded(F.coalesce("changed", "digest"), F.col("path")).alias("p"))
    root = F.lit(whole.root.hex() if whole.root else None).cast("string")
    return found.join(whole.groups.select("grp", "subroot"), "grp").select(
        "doc_id",
        F.lower(F.hex("digest")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        root.alias("root"),
        F.col("p.proof").alias("proof_sha256"),
        F.col("p.root").alias("folded_root"),
        (F.col("p.root") == root).alias("verified"),
    )
