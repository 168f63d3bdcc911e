"""The manifest beside a plain tree, in blocks so low that every tree has several tiers."""

import hashlib
import zlib

import numpy as np
from odd import DDL, empty_docs, odd_docs
from pyspark.sql import functions as F

from costloom.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n_chars = None if r.n_chars is None else r.n_chars + more
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n_chars, r.text)))


def plain_tree(leaves):
    """(root, siblings of every leaf with their sides) by levels."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for way, i in zip(ways, at):
            other = i ^ 1
            way.append((i & 1, level[other] if other < len(level) else ""))
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], ways


def plain(rows, marked):
    groups = {}
    for r in rows:
        groups.setdefault(merkle_key(r.lang), []).append(r)
    names, trees = sorted(groups, key=str.encode), {}
    for g in names:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in names])
    for k, g in enumerate(names):
        for r, way in zip(groups[g], trees[g][1]):
            steps = way + tops[k]
            now = leaf(r, int(marked(r)))
            for side, other in steps:
                now = digest(other, now) if side else digest(now, other)
            yield (r.doc_id, leaf(r), trees[g][0], root, digest(*(s for _, s in steps)), now, now == root)


def merkle_key(lang):
    return "0" if lang is None else "1" + lang


def crc_marked(r):
    return r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0


def mark():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def test_addresses_follow_the_split():
    def order(levels):
        """Nodes (depth, index) of a tree in van Emde Boas order, by its definition."""
        if levels == 1:
            return [(0, 0)]
        upper = levels // 2
        return order(upper) + [(d + upper, root * 2**d + i) for root in range(2**upper) for d, i in order(levels - upper)]

    for levels in range(1, 9):
        for at, (d, i) in enumerate(order(levels)):
            assert merkle.address(d, np.array([i]), levels)[0] == at


def test_every_tier_matches_plain_levels(spark):
    rows = [(i * 3 % 101, f"text {i}", ["en", "de", None, "ü"][0 if i < 60 else i % 4], f"s{i % 3}", None if i % 11 == 0 else i) for i in range(100)]
    rows += [(7, "again", "en", "s", 5), (7, "again", "en", "s", 5), (7, "other", "en", "s", 5), (None, "x", "en", None, 1), (5, None, "one", None, 2**63 - 1)]
    docs = spark.createDataFrame(rows, DDL)
    want = sorted(plain(docs.collect(), crc_marked), key=repr)
    for height in (1, 3):
        got = merkle.verify_documents(docs, mark(), height)
        assert sorted(map(tuple, got.collect()), key=repr) == want, height
    assert any(not r[-1] for r in want) and sum(r[-1] for r in want) > 60


def test_order_of_files_does_not_matter(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 > 0, "en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    one = {r.root for r in merkle.verify_documents(docs.orderBy(F.rand(1)), height=4).select("root").distinct().collect()}
    assert one == {r.root for r in merkle.verify_documents(docs.repartition(7), height=4).select("root").distinct().collect()} and len(one) == 1


def test_stored_blocks_are_the_manifest(spark):
    leaves = spark.range(40).select(F.lit("g").alias("grp"), F.col("id").alias("doc_id"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    whole = merkle.build_manifest(leaves, ["doc_id"], height=2)
    blocks = whole.blocks().where("tree = 'groups'").collect()
    assert sorted((b.tier, b.block, b.n) for b in blocks) == [(0, i, 4) for i in range(10)] + [(1, 0, 4), (1, 1, 4), (1, 2, 2), (2, 0, 3)]
    assert all(len(b.nodes) == merkle.DIGEST * (2**b.levels - 1) for b in blocks)


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    got = sorted(map(tuple, merkle.verify_documents(docs, mark(), 2).collect()), key=repr)
    assert got == sorted(plain(docs.collect(), crc_marked), key=repr)
    assert merkle.verify_documents(empty_docs(spark), mark()).count() == 0
