"""Operators that bring rows together, beside brute force."""

import collections
import itertools
import re

import numpy as np
import pytest
from odd import ODD, empty_docs, odd_docs
from pyspark.sql import functions as F

from costloom.llm import ann, mixing, neardup, wordhash
from costloom.llm.components import connected_components

# ------------------------------------------------------------------ components


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, 300 + i) for i in range(40)] + [(5, 5), (None, 3)]
    sets = Sets()
    for a, b in edges:
        if a is not None and a != b:
            sets.join(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: sets.find(x) for x in sets.up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 4


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows, k):
    """Components of all pairs at 80 %, ids to least id."""
    sets, out = {}, Sets()
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingle_set(t, k))
            out.find(i)
    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                out.join(a, b)
    return {i: out.find(i) for i in sets}


def near_copies(rng):
    """Copies, near copies at all degrees around the threshold, and chains of small steps."""
    vocab = ["".join(rng.choice(list("abcdefghij"), 3)) for _ in range(400)]
    rows = []
    for base in range(12):
        words = list(rng.choice(vocab, int(rng.integers(12, 90))))
        for edits in (0, 0, 1, 2, 3, 4, 6):
            w = list(words)
            for at in rng.integers(0, len(w), edits):
                w[at] = str(rng.choice(vocab))
            rows.append(" ".join(w))
        if base < 3:  # a chain: each step alone is similar enough, its ends are not
            for _ in range(8):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocab))
                rows.append(" ".join(words))
    return rows + ["one", "one", "ONE", "two words", "two  WORDS"]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_match_all_pairs(spark, words):
    texts = near_copies(np.random.default_rng(words))
    order = np.random.default_rng(9).permutation(len(texts))
    rows = [(int(i) * 3, texts[i]) for i in order]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_groups(rows, words)
    for tile in (neardup.TILE, 4):  # tiles of four rows: every group is cut
        got = {r.doc_id: r for r in neardup.near_duplicates(df, words=words, tile=tile).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
        assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingle_set(t, words)) for i, t in rows}


def test_an_id_on_several_texts_is_one_node_and_loses_none(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b), (5, a), (5, b), (5, ""), (5, a), (6, c), (6, c + " more"), (7, None), (8, c)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars int")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles} == {(3, 3), (5, 3), (6, 6), (8, 6)}
    for parts in (1, 5):
        kept = neardup.keep_one_of_each(docs.repartition(parts, "n_chars"))
        assert kept.columns == docs.columns
        texts = sorted((r.text or "" for r in kept.collect()))
        # One of each group: a, b, one of c and c + more, and the texts without words.
        assert texts in (sorted([a, b, c, "", ""]), sorted([a, b, c + " more", "", ""]))
        assert {r.doc_id for r in kept.collect() if r.text == b} == {3}
        assert rows_of_all(kept) == rows_of_all(neardup.keep_one_of_each(docs.repartition(3)))


def rows_of_all(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_edges_of_a_family_grow_with_its_rows(spark, monkeypatch):
    """Near copies of one text around the threshold: what goes into components grows about in proportion."""
    seen = []
    plain = neardup.connected_components
    monkeypatch.setattr(neardup, "connected_components", lambda edges, *a: (seen.append(edges.count()), plain(edges, *a))[1])
    sizes = {}
    for n in (400, 1600):
        rng = np.random.default_rng(4)
        words = [f"w{i}" for i in range(60)]
        rows = []
        for i in range(n):
            w = list(words)
            for at in rng.integers(0, 60, int(rng.integers(0, 4))):
                w[at] = f"x{rng.integers(10**6)}"
            rows.append((i, " ".join(w)))
        seen.clear()
        neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2, tile=64).count()
        sizes[n] = sum(seen)
    assert sizes[1600] < 4.8 * sizes[400], sizes


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = neardup.near_duplicates(docs, words=2).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, None: None} and all(r.kept for r in got)
    assert {r.n_shingles for r in got if r.doc_id in (2, 3, 5)} == {0}
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0
    one = neardup.keep_one_of_each(docs)
    assert one.columns == docs.columns and sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    mult = neardup.multipliers(1024)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2500], np.unique(rng.integers(0, 2**63, 700).astype(np.uint64))])
    ra, rb = (neardup.truncate(neardup.minima(x, mult)) for x in (a, b))
    both = neardup.truncate(neardup.minima(np.union1d(a, b), mult))
    assert (neardup.merge(ra, rb) == both).all()
    n = [np.array([float(len(x))]) for x in (a, b)]
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    found = neardup.likely_jaccard(ra[None], rb[None], *n)[0]
    assert abs(found - true) < 0.06
    for j in (found - 0.02, found + 0.02):
        assert neardup.reaches(ra[None], rb[None], *n, j)[0] == (j < found)
    assert wordhash.shingles(np.arange(3, dtype=np.uint64), 5).shape == (1,)


# ------------------------------------------------------------------ 2


def brute_nearest(rows, k):
    """Rows (id, vector) -> query id -> [(id, score)], over distinct rows."""
    good = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and None not in v) if np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 50 == 0:
            found = collections.defaultdict(lambda: -2.0)
            for i, y in good:
                if i != q and len(y) == len(x):
                    found[i] = max(found[i], float(ann.cosine(x, y)))
            out[q] = sorted(found.items(), key=lambda r: (-r[1], r[0]))[:k]
    return out


def vectors(rng, n):
    centres = rng.normal(size=(10, 16))
    rows = [(i, (centres[i % 10] + 0.8 * rng.normal(size=16)).round(4).tolist()) for i in range(n)]
    same = rows[3][1]
    return rows + [(n + i, same) for i in range(40)] + [(n + 40, [2 * x for x in same])]


def test_nearest_recall_ties_and_copies(spark):
    rows = vectors(np.random.default_rng(6), 1500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    want = brute_nearest(rows, 5)
    for tile in (ann.TILE, 64):
        got = collections.defaultdict(list)
        for r in sorted(ann.nearest(df, F.col("vec_id") % 50 == 0, tile=tile).collect(), key=lambda r: (r.query_id, r["rank"])):
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == set(want)
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        for q, found in got.items():
            assert len(found) == 5 and found == sorted(found, key=lambda r: (-r[1], r[0]))
    # A query among its copies finds the copies with the least ids.
    assert 1500 in want and got[1500][:5] == [(3, got[1500][0][1]), *[(1501 + i, got[1500][0][1]) for i in range(4)]]


def test_nearest_of_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0]), (8, None), (9, []), (10, [0.0, 0.0]), (11, [1.0, None]), (12, [nan, 1.0]), (100, [inf, 1.0]), (None, [1.0, 1.0]), (150, [1.0, 2.0, 3.0]), (13, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id): r.score for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert set(got) == {(0, 1, 7), (0, 2, 13), (0, 3, 50), (50, 1, 7), (50, 2, 13), (50, 3, 0)}
    assert got[(0, 3, 50)] == 0 and abs(got[(0, 1, 7)] - 0.5**0.5) < 1e-15
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_probes_come_in_falling_order_of_success():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for row, own in zip(ann.probes(x, 0, 0.98), ann.bucket(ann.cells(x, 0), 0), strict=True):
        assert own in row[:2] and len(set(row.tolist())) == len(row)
    assert all(len(a) < len(b) for a, b in zip(ann.probes(x, 0, 0.9), ann.probes(x, 0, 0.2), strict=True))


# ------------------------------------------------------------------ 7


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        for s in free - over:
            target[s] = weight[s] * level
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def mixed_docs(spark, rng):
    rows = []
    for i in range(600):
        source = None if i % 17 == 0 else "big" if i % 3 else f"é{i % 7}" if i % 5 else "tiny" if i % 50 == 0 else "Z"
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 400))), "en", source, 0))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("x")).repartition(5)


def test_mix_reaches_its_targets(spark, monkeypatch):
    rows, df = mixed_docs(spark, np.random.default_rng(7))
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    sizes = collections.Counter()
    for i, t, _, s, _ in rows:
        sizes[s] += len(t.split())
        assert got[i].size == len(t.split())
    want = plain_targets(sizes)
    taken = collections.Counter()
    for i, _, _, s, _ in rows:
        taken[s] += got[i].taken
        assert got[i].source_size == sizes[s] and abs(got[i].target - want[s]) < 1e-6 and 0 <= got[i].taken <= 3 * got[i].size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK_WORDS * (1 + sizes[s] // 4000) + 0.01 * t, (s, taken[s], t)
    again = {r.doc_id: r for r in mixing.mix(df.repartition(3)).collect()}
    assert again == got
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.size == "x" and r.n_chars == len(r.text)
    assert {i: n for i, n in words.items() if n} == {i: r.taken for i, r in got.items() if r.taken}


def test_apportionment_is_sainte_lague(spark):
    rng = np.random.default_rng(10)
    for seats in (1, 7, 1000):
        votes = {i: float(v) for i, v in enumerate(rng.integers(0, 1000, 12))} | {90: 500.0, 91: 500.0}
        got = mixing.apportion(spark.createDataFrame(list(votes.items()), "k long, votes double"), seats, ["k"])
        best = sorted(((v / (2 * n + 1), -k) for k, v in votes.items() for n in range(seats) if v), reverse=True)[:seats]
        want = collections.Counter(-k for _, k in best)
        assert {r.k: r.quota for r in got.collect()} == {k: want[k] for k in votes}
    none = mixing.apportion(spark.createDataFrame([(1, 0.0)], "k long, votes double"), 5, ["k"])
    assert [r.quota for r in none.collect()] == [0]


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got) and {r.taken for r in got if r.doc_id in (2, 3, 5)} == {0}
    assert mixing.mix(empty_docs(spark)).count() == 0 and mixing.mix_documents(empty_docs(spark)).count() == 0
    assert mixing.passes_of(b"a b", 0, 1, 3, 0) == [b"a b"] * 3 and mixing.passes_of(b" ", 0, 1, 3, 0) == []
    text = " ".join(f"w{i}" for i in range(100)).encode()
    parts = mixing.passes_of(text, 10, 5, 3, 1)
    assert sum(len(re.findall(rb"\S+", p)) for p in parts) < 100
