"""Best positions beside scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
from odd import empty_docs, odd_docs

from costloom.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    cut = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in cut), sum(n for _, _, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in cut:
            if n:
                m = 100 - 75 + (75 * n * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
                scored.append((-s, d is None, d, s))
        scored = sorted((x for x in scored if x[3] > 0), key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(scored)]
    return sorted(out, key=repr)


def test_scores_of_a_corpus_in_many_shards(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(n))
    docs = [(i * 7 % 401, text(rng.randrange(1, 60))) for i in range(400)]
    # Ties across shards, repeated rows, odd rows.
    docs += [(i, "Tie, tie-Break ÄÄ") for i in range(500, 560)] + [(500, "Tie, tie-Break ÄÄ"), (None, "tie"), (600, None), (601, ""), (602, "... ---")]
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)] + [(30, "tie tie break"), (31, "nowhere"), (32, None), (33, ""), (34, "ÄÄ"), (30, "t1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    for shard, block in ((ranked.SHARD_POSTINGS, ranked.BLOCK_BYTES), (200, 300)):
        got = sorted(map(tuple, ranked.search(d, b, shard_postings=shard, block_bytes=block).collect()), key=repr)
        assert got == want, shard


def lists_of(rng, n_docs, n_lists):
    out = []
    for _ in range(n_lists):
        docs = np.sort(rng.choice(n_docs, rng.integers(1, n_docs + 1), replace=False))
        out.append(ranked.ImpactList(docs, rng.integers(1, 40, len(docs))))
    return out


def test_best_positions_on_random_lists():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        lists, order = lists_of(rng, n, int(rng.integers(1, 6))), rng.permutation(n)
        weights = rng.integers(1, 9, len(lists)).tolist()
        total = np.zeros(n, np.int64)
        for lst, w in zip(lists, weights):
            total += w * lst.look_up(np.arange(n))
        k = int(rng.integers(1, 12))
        want = [i for i in np.lexsort((order, -total))[:k] if total[i] > 0]
        docs, scores, _ = ranked.best_positions(lists, weights, order, k, first_read=int(rng.integers(1, 9)))
        assert docs.tolist() == want and scores.tolist() == total[want].tolist()


def test_search_stops_early():
    """A list's best position runs past what was read, and lists with a steep top are not read to their ends."""
    n = 100_000
    docs = np.arange(n)
    steep = ranked.ImpactList(docs, np.maximum(1, 10_000 - docs))
    other = ranked.ImpactList(docs, np.maximum(1, 9_000 - docs))
    found, scores, read = ranked.best_positions([steep, other], [2, 3], docs, 10)
    assert found.tolist() == list(range(10)) and scores[0] == 2 * 10_000 + 3 * 9_000 and read < 500


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = spark.createDataFrame([(1, "plain text"), (None, "lorem words"), (3, "漢字 x")], "item_id long, text string")
    got = sorted(map(tuple, ranked.search(docs, items.selectExpr("*", "1 as q", "2 as rank")).collect()), key=repr)
    assert got == plain(rows, [(1, "plain text"), (None, "lorem words"), (3, "漢字 x")])
    assert ranked.search(empty_docs(spark), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0
