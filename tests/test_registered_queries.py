"""Registered queries beside their SQL on the smallest tables, and plan checks."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, rows_of  # noqa: E402
from costloom import schemas  # noqa: E402
from costloom.operators import normalize  # noqa: E402
from costloom.plans import ingest  # noqa: E402
from costloom.sources import files  # noqa: E402

SOME = [
    "session_merge", "run_cost", "merge_runs", "loops", "waste_all", "cost_by_model", "public_aggregate", "runs_page1",
    "bm25_leg", "hybrid_search", "redact_text", "chunk_rows", "admission_budget", "otlp_normalize", "transcript_messages",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    library = {k for k in entry.queries() if not k.startswith("op") or not k[2:3].isdigit()} - {"pipeline"}
    assert library <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 7


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == want and want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cross_source_matches_sql(spark, con):
    test_matches_sql(spark, con, "cross_source")


def test_lines_are_made_and_parsed_once_after_dealing(spark):
    ledger = normalize.normalize_ledger(ingest._ledger(spark, SF))
    ring = normalize.normalize_usage_ring(files.parse_json(ingest._ring_lines(spark, SF), schemas.USAGE_RING))
    for rows in (ledger, ring):
        optimized = rows._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count("from_json(") == 1 and optimized.count("StructsToJsonEvaluator(") == 1
        # Nothing but the scan lies below the shuffle: no filter on parsed fields, no making of spans.
        assert "json" not in optimized.split("RepartitionByExpression")[1]


def test_every_line_gives_one_row(spark):
    lines = ['{"handle": "h", "hit_tokens": 3}', "{broken", "[1]", "", None, '{"hit_tokens": "x"}']
    parsed = files.parse_json(spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "ord bigint, value string"), schemas.LEDGER)
    got = {r.ord: (r.handle, r.hit_tokens, r[files.BAD]) for r in parsed.collect()}
    assert got == {0: ("h", 3, None), 1: (None, None, "{broken"), 2: (None, None, "[1]"), 3: (None, None, ""), 4: (None, None, ""), 5: (None, None, lines[5])}


def test_scans_are_pruned_and_filtered(spark):
    page = plan(entry.queries()["orders_page"](spark, SF))
    pushed = page.split("PushedFilters: [")[1].split("]")[0]
    assert "o_orderdate" in pushed and "TakeOrderedAndProject" in page
    assert "o_custkey" not in page.split("ReadSchema")[1]
    by_day = plan(entry.queries()["cost_by_day"](spark, SF))
    assert "CartesianProduct" not in by_day and "BroadcastNestedLoopJoin" not in by_day


def test_no_plan_crosses_tables(spark):
    for name in ("waste_all", "hybrid_search", "keyword_search", "merge_runs", "public_aggregate", "content_dedupe"):
        p = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_hybrid_search_scans_each_input_once_and_texts_once_more(spark):
    assert plan(entry.queries()["hybrid_search"](spark, SF)).count("FileScan parquet") <= 3


def test_first_lines_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["embedding_text"](spark, SF))
