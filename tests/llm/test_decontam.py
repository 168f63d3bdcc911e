"""Winnowed decontamination beside a search for every window at every place."""

import hashlib
import random
import re

from odd import empty_docs, odd_docs
from pyspark.sql import functions as F

from costloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = cut(text)
        k = min(len(w), decontam.SPAN)
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                own = windows.get(tuple(w[i : i + k]))
                if own is not None:
                    hit |= set(range(i, i + k))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontam.contamination(d, b).collect()), key=repr)
    assert got == plain(docs, items)
    return got


def test_every_shared_span_is_found(spark):
    rng = random.Random(5)
    # A small vocabulary: grams repeat, tie and overlap.
    text = lambda n, v=12: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 14, 30]), 40)) for i in range(12)]
    items += [(50, "same same same same same same same same same same same same"), (51, text(9)), (52, "Ünï wörd"), (53, "solo"), (54, ""), (55, None), (56, "!?"), (7, text(12))]
    docs = []
    for d in range(60):
        words = cut(text(rng.randrange(0, 80), 40))
        for _ in range(rng.randrange(3)):
            src = cut(rng.choice(items)[1])
            a = rng.randrange(len(src)) if src else 0
            piece = src[a : a + rng.choice([3, 9, 10, 11, 40])]
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece
        docs.append((d, rng.choice([" ", ", ", "\n", "--"]).join(words).title()))
    docs += [(100, "same " * 300), (101, "Solo, ÜNÏ wörd; ünï wörd."), (102, None), (103, "")]
    got = check(spark, docs, items)
    assert sum(r[5] for r in got) > 20 and any(not r[5] for r in got)


def test_spans_at_both_ends_and_of_the_shortest_length(spark):
    item = [f"a{i}" for i in range(10)]
    docs = [(1, " ".join(item)), (2, " ".join(["x", *item])), (3, " ".join([*item, "x"])), (4, " ".join(item[:9])), (5, " ".join([*item[:9], "x", item[9]]))]
    assert [r[2] for r in check(spark, docs, [(1, " ".join(item))])] == [10, 10, 10, 0, 0]


def test_a_passage_of_all_documents_and_items(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(i, f"d{i} {passage} e{i}") for i in range(300)]
    got = check(spark, docs, [(i, f"{passage} tail{i}") for i in range(30)])
    assert all(r[2] == 14 and r[3] == 30 for r in got)


def test_bitmap_lets_no_hash_go(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = decontam.Bitmap(rows)
    assert rows.where(bits.may_hold(F.col("h"))).count() == 3000
    assert spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h")).where(bits.may_hold(F.col("h"))).count() < 200


def test_lists_too_long_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    check(spark, [(1, " ".join(f"a{i}" for i in range(20))), (2, "solo a1")], [(1, " ".join(f"a{i}" for i in range(3, 15))), (2, "solo")])


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    out = decontam.contamination(docs, docs.withColumnRenamed("doc_id", "item_id"))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    bench = docs.withColumnRenamed("doc_id", "item_id").where("item_id is null or item_id <> 4")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r)[:6] for r in decontam.contamination(docs, bench).collect()), key=repr)
    assert got == plain(rows, [(r.item_id, r.text) for r in bench.collect()])
    assert decontam.contamination(empty_docs(spark), bench).count() == 0
    none = decontam.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)
