"""The pipeline on a small corpus beside a plain version, and the registered queries on the smallest tables."""

import collections
import os
import re

import pytest
from odd import odd_docs
from pyspark.sql import functions as F
from test_tables import brute_groups

import __spark_entry__ as entry
import corpus_pipeline
from costloom.llm import mixing, quality, secretscan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    chain = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}

    def keeps(text):
        n, _, _, _, repeated = counts = quality.base_counts(text.encode(), quality.wordhash.WordIds())
        if n < 20 or 100 * repeated > 30 * n:
            return False
        lines, words = quality.measures(text.encode())
        return chain is None or (chain.viterbi(quality.features(lines)) * words).sum() / counts[0] >= quality.LEAST_SHARE

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        got = out.collect()
        if k < 4:
            assert out.columns == columns, name
        if k == 0:
            rows = {i: r.text for i, r in rows.items() if keeps(r.text or "")}
            assert {r.doc_id: r.text for r in got} == rows
        elif k == 1:
            groups = brute_groups(list(rows.items()), 5)
            rows = {i: t for i, t in rows.items() if groups[i] == i}
            assert {r.doc_id: r.text for r in got} == rows
        elif k == 2:
            words = secretscan.fit_lexicon(docs, corpus_pipeline.VOCABULARIES)
            rows = {i: secretscan.mask(t.encode(), words).decode() for i, t in rows.items()}
            assert {r.doc_id: r.text for r in got} == rows and all(r.n_chars == len(r.text) for r in got)
        elif k == 3:
            due = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
            words = collections.Counter()
            for r in got:
                words[r.doc_id] += len(re.findall(r"[^ \t-\r]+", r.text))
            assert words == due
        else:
            assert len(got) == docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
        docs = out


def test_pipeline_takes_odd_and_empty_tables(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(30))
    docs = odd_docs(spark)
    more = docs.where("doc_id = 6").withColumn("text", F.lit(good))
    docs = docs.unionByName(more).unionByName(more).unionByName(more.withColumn("doc_id", F.lit(9).cast("long")))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            assert set(start.columns) <= set(now.columns), name
        # Only one row of `good` has enough words and repeats none; the mix may take it whole, in part or again.
        left = [r.text for r in now.select("text").collect()]
        assert all(t and good.startswith(t) for t in left) and bool(left) == (start is docs)


def test_every_registered_query_runs(spark):
    names = [n for n in entry.queries() if re.match(r"op\d", n)]
    assert len(names) == 13 and "pipeline" in entry.queries()
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for n in names:
        out = entry.queries()[n](spark, SF)
        count = out.count()
        if "doc_id" in out.columns and "rank" not in out.columns:
            assert count == rows["documents"], n
        elif "page_id" in out.columns:
            assert count == rows["pages"], n
        else:
            assert count > 0, n
    assert F is not None
