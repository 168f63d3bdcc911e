import math
import random
import re

import numpy as np
import pytest
from helpers import T0, at, messages_df, rows_of, runs_df
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from costloom.functions import redaction
from costloom.operators import admission, context, documents, search


def brute_chunks(text, max_tokens, per):
    """Plain greedy packing."""
    budget = max_tokens * per
    paras = [p.strip() for p in text.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")]
    out, pack = [], []

    def flush():
        if pack:
            out.append("\n\n".join(pack))
            pack.clear()

    for p in filter(None, paras):
        if len(p) <= budget:
            if pack and len("\n\n".join([*pack, p])) > budget:
                flush()
            pack.append(p)
            continue
        flush()
        words = []
        for w in filter(None, p.split(" ")):
            if len(w) > budget:
                if words:
                    out.append(" ".join(words))
                    words = []
                out += [w[i : i + budget] for i in range(0, len(w), budget)]
                continue
            if words and len(" ".join([*words, w])) > budget:
                out.append(" ".join(words))
                words = []
            words.append(w)
        if words:
            out.append(" ".join(words))
    flush()
    return out


def test_chunks_match_plain_packing(spark):
    rnd = random.Random(5)
    texts = ["A.\n\nB.\n\nC.\n\nD.", "", " \r\n\r\n ", "x" * 95, "word " * 40]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 9)):
            parts.append(" ".join("w" * rnd.choice([1, 3, 8, 8, 45, 90]) for _ in range(rnd.randint(1, 9))))
        texts.append(rnd.choice(["\n\n", "\r\n\r\n", "\r\r", "\n\n \n\n"]).join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in documents.chunk_documents(df, max_tokens=10, chars_per_token=4).orderBy("document_id", "ordinal").collect():
        got.setdefault(r.document_id, []).append(r.chunk_text)
        assert r.token_count == math.ceil(len(r.chunk_text) / 4) <= 10 and r.chunk_id == f"{r.document_id}:{r.ordinal}"
    assert got == {i: c for i, t in enumerate(texts) if (c := brute_chunks(t, 10, 4))}
    with pytest.raises(ValueError):
        documents.chunk_documents(df, max_tokens=0)


def test_oversized_paragraph_leaves_the_tail_alone(spark):
    text = "tiny\n\n" + "word " * 12 + "\n\ntail"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = [r.chunk_text for r in documents.chunk_documents(df, max_tokens=10).orderBy("ordinal").collect()]
    assert got[0] == "tiny" and got[-1] == "tail" and len(got) == 4


def test_dedupe_and_missing_chunks(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "doc_id bigint, text string")
    assert rows_of(documents.dedupe_documents(df), "doc_id") == [(1,), (2,)]
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "document_id bigint, ordinal int")
    indexed = spark.createDataFrame([(1, 0), (2, 0)], "document_id bigint, ordinal int")
    assert rows_of(documents.missing_chunks(chunks, indexed), "document_id", "ordinal") == [(1, 0), (1, 1)]


def test_redaction(spark):
    key = "sk-abcDEF123456"
    cases = {
        f"use {key} now": "use [REDACTED] now",
        "API_KEY = hunter2 ok": "[REDACTED] ok",
        "h " + "a1" * 16: "h [REDACTED]",
        "b " + "Zz9+" * 11 + "A": "b [REDACTED]",
        "see /home/me/x.txt and ~/notes or C:\\temp\\x|y": "see [REDACTED] and [REDACTED] or [REDACTED]|y",
        "/single stays": "/single stays",
        "in acme-ws.run by h.1": "in [REDACTED]run by h.1",
        "  ": "",
    }
    df = spark.createDataFrame([(k, "acme-ws.") for k in cases], "t string, w string")
    got = {r.t: r.o for r in df.select("t", redaction.redact("t", ["w", F.lit(None).cast("string")]).alias("o")).collect()}
    assert got == cases
    long = spark.createDataFrame([("é😀" * 300,)], "t string").select(redaction.redact("t").alias("o")).first().o
    assert long == ("é😀" * 300)[:500]


def test_context_never_leaks(spark):
    probe = {"workspace": "probe-workspace", "external_id": "probe-external", "session_id": "s1", "input_tokens": 2, "output_tokens": 3}
    runs = search.run_documents(runs_df(spark, [{**probe, "id": "a", "started_at": at(0.25), "cost_usd": "0.0000000001"}, {**probe, "id": "b"}]))
    hits = context.redact_runs(runs).withColumn("question_id", F.lit(1)).withColumn("rank", F.when(F.col("run_id") == "a", 2).otherwise(1))
    chunks = context.redact_chunks(
        spark.createDataFrame([("/secret/uri/x.md", "x.md", 0, "body of /secret/uri/x.md")], "uri string, title string, ordinal int, chunk_text string")
    ).withColumn("question_id", F.lit(1)).withColumn("rank", F.lit(1))
    q = spark.createDataFrame([(1, "why?"), (2, "none?")], "question_id int, question string")
    got = dict(rows_of(context.assemble_context(q, hits, chunks)))
    assert got[2] == "Question: none?\n\n"
    lines = got[1].split("\n")
    assert lines[:3] == ["Question: why?", "", "Trace citations:"] and lines[5] == "Document citations:"
    assert lines[3].startswith("- run_id: b | session_id: s1 | persona: unknown | model: unknown | status: Completed | started_at: unknown | tokens: 5 | cost: 0 |")
    assert "started_at: 2026-01-01T12:00:00.2500000+00:00 | tokens: 5 | cost: 0.0000000001 |" in lines[4]
    assert lines[6] == "- title: x.md | ordinal: 0 | excerpt: body of [REDACTED]"
    assert "probe" not in got[1] and "uri" not in got[1]


def test_searchable_text_keeps_empty_slots(spark):
    runs = runs_df(spark, [{"session_id": "s", "persona": "p"}])
    assert search.run_documents(runs).first().searchable_text == " p  s"


def test_keyword_search_total_is_stable(spark):
    docs = runs_df(spark, [{"id": f"{i:02d}", "started_at": at(i) if i % 3 else None} for i in range(9)]).withColumn(
        "searchable_text", F.when(F.col("id") != "04", F.lit("Alpha, beta")).otherwise(F.lit("alphabet"))
    )
    rows = search.search_keyword(docs, "ALPHA zzz", 4).collect()
    assert [r.id for r in rows] == ["08", "07", "05", "02", "01"] and {r.total for r in rows} == {8}
    from costloom.operators.listing import Cursor

    tail = search.search_keyword(docs, "alpha", 4, Cursor(None, "06")).collect()
    assert [r.id for r in tail] == ["03", "00"] and {r.total for r in tail} == {8}
    assert search.search_keyword(docs, " ,. ", 4).count() == 0


def test_bm25_and_cosine_against_numpy(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["red", "green", "blue", "sky"]) for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    docs = spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(texts)], "id string, searchable_text string")
    words = [t.split() for t in texts]
    avg = sum(map(len, words)) / len(words)
    want = {}
    for i, ws in enumerate(words):
        s = 0.0
        for t in ("red", "sky"):
            df = sum(t in w for w in words)
            tf = ws.count(t)
            s += math.log(1 + (40 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
        if "red" in ws or "sky" in ws:
            want[f"{i:02d}"] = round(s, 6)
    got = search.keyword_leg(docs, "Red sky", 10).orderBy("rank").collect()
    assert [r.id for r in got] == sorted(want, key=lambda k: (want[k], k), reverse=True)[:10]
    assert all(abs(r.score - want[r.id]) < 2e-6 for r in got)
    vecs = np.random.default_rng(2).normal(size=(30, 8)).astype("float32")
    q = [float(x) for x in range(1, 9)]
    vdf = spark.createDataFrame([(f"{i:02d}", v.tolist()) for i, v in enumerate(vecs)] + [("zz", None), ("zy", [1.0])], "id string, embedding array<float>")
    cos = vecs.astype(float) @ np.array(q) / np.linalg.norm(vecs.astype(float), axis=1) / np.linalg.norm(q)
    assert [r.id for r in search.vector_leg(vdf, q, 5).orderBy("rank").collect()] == [f"{i:02d}" for i in np.argsort(-cos)[:5]]


def leg(spark, ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")


def test_fusion(spark):
    got = [(r.id, r.score) for r in search.rrf([leg(spark, "abc"), leg(spark, "cb")]).collect()]
    assert got == [("c", 1 / 63 + 1 / 61), ("b", 1 / 62 + 1 / 62), ("a", 1 / 61)]
    ties = search.rrf([leg(spark, "ab"), leg(spark, "ba")])
    assert [r.id for r in ties.collect()] == ["b", "a"]
    first = search.fused_page(ties, 1).first()
    rest = search.fused_page(ties, 1, (first.score, first.id)).collect()
    assert [r.id for r in rest] == ["a"] and rest[0].total == 2


def test_hybrid_degrades_to_keywords(spark):
    docs = spark.createDataFrame([("a", "red"), ("b", "blue")], "id string, searchable_text string")
    vecs = spark.createDataFrame([("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    assert [r.id for r in search.search_hybrid(docs, vecs, "red", None).collect()] == ["a"]
    both = search.search_hybrid(docs, vecs, "red", [1.0, 0.0]).collect()
    assert [r.id for r in both] == ["b", "a", "c"] and both[0].total == 3


def test_highlight(spark):
    text = "x " * 100 + "Red-hot and RED. redder" + " y" * 100
    df = spark.createDataFrame([(text,), ("nothing",)], "t string")
    got = [r[0] for r in df.select(search.highlight("t", "red")).collect()]
    assert len(got[0]) == 1 and "<em>Red</em>-hot and <em>RED</em>. redder" in got[0][0]
    assert re.sub("</?em>", "", got[0][0]) == text[151:301] and got[1] == []
    # A word on a cut is neither lost nor split into a false hit.
    cut = spark.createDataFrame([("q" * 148 + " eden tail",), ("q" * 146 + " handle",)], "t string")
    assert [len(r[0]) for r in cut.select(search.highlight("t", "eden")).collect()] == [1, 0]
    assert cut.select(search.highlight("t", "hand")).collect()[1][0] == []


def test_embedding_text(spark):
    docs = spark.createDataFrame([("r", "fallback"), ("n", "only searchable"), ("e", None)], "id string, searchable_text string")
    msgs = messages_df(spark, [{"sequence": 2, "role": "assistant", "content": "hi"}, {"sequence": 1, "role": "user", "content": "hello"},
                               {"sequence": 3, "content": "  "}, {"sequence": 4, "content": None}])
    assert dict(rows_of(search.embedding_text(msgs, docs))) == {"r": "user: hello\nassistant: hi", "n": "only searchable", "e": ""}
    assert dict(rows_of(search.embedding_text(msgs, docs, 8)))["r"] == "user: he"
    many = messages_df(spark, [{"sequence": i, "role": "", "content": "x"} for i in range(1, 40)])
    whole = "\n".join([": x"] * 39)
    assert dict(rows_of(search.embedding_text(many, docs, 20)))["r"] == whole[:20]


def test_embed_checks_width_and_touches_only_its_fields(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "z")], "id string, searchable_text string")
    texts = docs.select("id", F.col("searchable_text").alias("embedding_text")).where("id = 'a'")
    out = search.attach_vectors(docs, search.embed(texts, "embedding_text", search.hashed_words(16), dims=16))
    got = {r.id: r for r in out.collect()}
    assert abs(np.linalg.norm(got["a"].embedding) - 1) < 1e-6 and got["b"].embedding is None and got["a"].searchable_text == "x y"
    with pytest.raises(PySparkException):
        search.embed(texts, "embedding_text", lambda ts: np.zeros((len(ts), 3)), dims=16).collect()


def test_coverage_of_nothing_is_zero(spark):
    runs = runs_df(spark, [{"pricing_status": "Priced"}, {}])
    assert search.hit_coverage(runs).first()[0] == 0.5 and search.hit_coverage(runs.limit(0)).first()[0] == 0


def brute_admit(rows, limit, seconds):
    out, taken = [], {}
    for who, n, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        live = [x for x in taken.get(who, []) if (t - x).total_seconds() < seconds]
        ok = len(live) < limit
        taken[who] = [*live, t] if ok else live
        out.append((who, n, ok))
    return sorted(out, key=repr)


def test_admission_matches_one_by_one(spark):
    rnd = random.Random(9)
    rows = []
    for who, gap in (("busy", 40), ("mixed", 900), ("calm", 5000)):
        t = 0
        for _ in range(150):
            t += rnd.choice([0, gap, gap, 2 * gap, 20 * gap if rnd.random() < 0.1 else gap])
            rows.append((who, len(rows), at(t)))
    df = spark.createDataFrame(rows, "principal string, arrival bigint, at timestamp")
    for limit, seconds in ((4, 3600), (20, 3600), (1, 60)):
        got = rows_of(admission.admit(df, limit, seconds), "principal", "arrival", "accepted")
        assert got == brute_admit(rows, limit, seconds)
    # an accepted request leaves the window after exactly its width
    edge = spark.createDataFrame([("p", 1, T0), ("p", 2, at(3599)), ("p", 3, at(3600))], "principal string, arrival bigint, at timestamp")
    assert rows_of(admission.admit(edge, 1, 3600), "arrival", "accepted") == [(1, True), (2, False), (3, True)]


def test_chunks_keep_columns_of_their_document(spark):
    docs = spark.createDataFrame([(1, "/u/1", "a b\n\nc"), (2, "/u/2", None)], "doc_id bigint, uri string, text string")
    kept = documents.chunk_documents(docs, max_tokens=1, keep=("uri",))
    assert rows_of(kept, "chunk_id", "uri", "chunk_text") == [("1:0", "/u/1", "a b"), ("1:1", "/u/1", "c")]


def test_one_question_reads_events_and_texts_once(spark):
    from costloom.plans import catalogue, feeds

    plan = feeds.fresh(catalogue.ask_context)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "event_type" not in plan and "regexp_extract_all" not in plan
