from datetime import timedelta
from decimal import Decimal

import pytest
from helpers import T0, at, messages_df, rows_of, runs_df
from pyspark.sql import functions as F

from costloom import schemas
from costloom.operators import listing, reports


def test_totals_and_coverage(spark):
    runs = runs_df(spark, [{"started_at": T0, "input_tokens": 1000, "pricing_status": "Priced", "cost_usd": "0.5"},
                           {"started_at": T0, "input_tokens": 3000, "pricing_status": "Unpriceable", "input_tokens": 3000},
                           {"started_at": None, "input_tokens": 8, "output_tokens": None}])
    r = reports.cost_totals(runs).first()
    assert (r.run_count, r.input_tokens, r.output_tokens, r.cost_usd, r.reported_cost_usd) == (3, 4008, 0, Decimal("0.5"), None)
    bounded = reports.cost_totals(runs, F.lit(T0), F.lit(T0)).first()
    assert bounded.run_count == 2 and bounded.pricing_coverage == 0.25
    empty = reports.cost_totals(runs.limit(0)).collect()
    assert len(empty) == 1 and empty[0].run_count == 0 and empty[0].cost_usd is None and empty[0].pricing_coverage == 0


def test_buckets(spark):
    late = T0.replace(hour=23)
    runs = runs_df(spark, [{"started_at": late, "model_slug": "a", "cost_usd": "1"}, {"started_at": late + timedelta(hours=2), "model_slug": "b", "cost_usd": "2"},
                           {"started_at": None, "model_slug": None, "persona": "p"}])
    assert [r.key for r in reports.cost_by(runs, "day").collect()] == ["(unknown)", "2026-01-01", "2026-01-02"]
    assert [r.key for r in reports.cost_by(runs, "model").collect()] == ["b", "a", "(unknown)"]
    assert [r.key for r in reports.cost_by(runs, "persona").collect()] == ["(unknown)", "p"]
    total, rolled = reports.cost_totals(runs).first(), reports.rollup_totals(reports.cost_by(runs, "model")).first()
    assert total.asDict() == rolled.asDict()


def test_public_aggregate(spark):
    base = {"started_at": T0, "model_slug": " m ", "service": "s", "input_tokens": 1000, "cache_read_tokens": 100,
            "cache_write_tokens": 200, "output_tokens": 300, "workspace": "probe-workspace", "persona": "probe-persona"}
    rows = [{**base, "id": f"r{i}", "cost_usd": c, "pricing_status": "Priced" if c else "Quarantined"} for i, c in enumerate((".01", ".02", ".03", None))]
    rows += [{**base, "model_slug": m, "service": sv} for m, sv in ((None, ""), ("", None), (" ", " "), (None, None))]
    rows += [{**base, "started_at": None}, {**base, "model_slug": "small"}]
    msgs = messages_df(spark, [{"run_id": "r0", "sequence": 1}, {"run_id": "r0", "sequence": 2}, {"run_id": "r2", "sequence": 1}])
    out = reports.public_aggregate(runs_df(spark, rows), msgs, 4)
    assert out.columns == schemas.columns(schemas.AGGREGATE)
    got = {r.model_slug: r for r in out.collect()}
    assert set(got) == {"m", "__unknown__"}
    m = got["m"]
    assert (m.run_count, m.priced_run_count, m.message_count) == (4, 3, 3)
    assert (m.input_tokens, m.cache_read_tokens, m.cache_write_tokens, m.output_tokens) == (4000, 400, 800, 1200)
    assert m.cost_usd == Decimal("0.06")
    assert "probe" not in str(out.collect())
    assert reports.public_aggregate(runs_df(spark, rows), msgs).count() == 0  # default floor of five
    stats = reports.model_stats(out).collect()
    assert [(s.model_slug, s.run_count) for s in stats] == [("__unknown__", 4), ("m", 4)]


def test_ticker_and_activity(spark):
    runs = runs_df(spark, [{"started_at": T0}, {"started_at": T0 - timedelta(days=30)}, {"started_at": T0 - timedelta(days=31)}])
    assert reports.burn_ticker(runs, F.lit(T0)).first().run_count == 2
    msgs = messages_df(spark, [{"sequence": 1}, {"sequence": 2, "occurred_at": at(-1)}])
    finds = spark.createDataFrame([], schemas.FINDINGS)
    assert tuple(reports.activity_window(runs, msgs, finds, F.lit(T0)).first()) == (1, 1, 0)


@pytest.fixture(scope="module")
def listed(spark):
    times = [at(5), at(5), at(5), at(9), None, None, at(1), None]
    return runs_df(spark, [{"id": f"{i:02d}", "started_at": t, "cost_usd": str(i)} for i, t in enumerate(times)])


def test_walking_all_pages_including_the_null_tail(listed):
    seen, cursor = [], None
    while True:
        rows = listing.list_runs(listed, 3, cursor).collect()
        seen += [r.id for r in rows[:3]]
        if len(rows) <= 3:
            break
        cursor = listing.Cursor(rows[2].started_at, rows[2].id)
    assert seen == ["03", "02", "01", "00", "06", "07", "05", "04"]


def test_filters_and_plan(listed):
    assert [r.id for r in listing.list_runs(listed, 10, min_cost="6").collect()] == ["06", "07"]
    assert [r.id for r in listing.list_runs(listed, 10, start=at(5), end=at(5)).collect()] == ["02", "01", "00"]
    plan = listing.list_runs(listed, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_findings_listing_and_detail(spark, listed):
    rows = [(f"f{i}", "03", k, s, "{}", str(i), Decimal(i), at(i % 2), ack, 1)
            for i, (k, s, ack) in enumerate([("Loop", "Minor", None), ("Loop", "Major", T0), ("CostThreshold", "Major", None)])]
    f = spark.createDataFrame(rows, schemas.FINDINGS)
    assert [r.id for r in listing.list_findings(f).collect()] == ["f1", "f2", "f0"]
    assert [r.id for r in listing.list_findings(f, acknowledged=False).collect()] == ["f2", "f0"]
    assert [r.id for r in listing.list_findings(f, kind="Loop", severity="Minor").collect()] == ["f0"]
    assert [r.id for r in listing.list_findings(f, cursor=listing.Cursor(at(0), "f2")).collect()] == ["f0"]
    with pytest.raises(ValueError):
        listing.list_findings(f, cursor=listing.Cursor(None, "f2"))
    assert [r.finding_id for r in listing.run_detail(listed, f, "03").collect()] == ["f1", "f2", "f0"]
    assert [r.finding_id for r in listing.run_detail(listed, f, "02").collect()] == [None]
