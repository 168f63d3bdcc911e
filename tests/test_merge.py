import random
from decimal import Decimal

import pytest
from helpers import T0, at, messages_df, rows_of, runs_df
from pyspark.sql import functions as F

from costloom import schemas
from costloom.operators import merge


def sequential_merge(deliveries):
    """The upsert rule, one delivery at a time."""
    stored, taken = {}, []
    for d in sorted(deliveries, key=lambda d: d["arrival"]):
        s = stored.get(d["session_id"])
        ok = s is None or s["ended_at"] is None or (d["ended_at"] is not None and d["ended_at"] >= s["ended_at"])
        taken.append((d["arrival"], ok))
        if not ok:
            continue
        new = dict(d)
        if s is not None and s["pricing_status"] == "Priced":
            for c in ("pricing_status", "cost_usd"):
                new[c] = s[c]
        stored[d["session_id"]] = new
    return stored, taken


@pytest.fixture(scope="module")
def history():
    rnd = random.Random(3)
    out = []
    for n in range(160):
        session = rnd.choice(["hot"] * 6 + ["a", "b", "c"])
        end = rnd.choice([None, None, *(at(60 * rnd.randint(0, 9) + n * 10) for _ in range(6))])
        priced = end is not None and rnd.random() < 0.3
        out.append({"session_id": session, "id": session, "ended_at": end, "external_id": f"d{n}", "arrival": n,
                    "pricing_status": "Priced" if priced else "Quarantined", "cost_usd": f"{n}.5" if priced else None})
    return out


KEEP = ("session_id", "external_id", "ended_at", "pricing_status", "cost_usd")


def as_rows(stored):
    return sorted(
        ((*(s[c] for c in KEEP[:-1]), None if s["cost_usd"] is None else Decimal(s["cost_usd"])) for s in stored.values()), key=repr
    )


@pytest.mark.parametrize("hot", [10, 10_000])
def test_merge_equals_one_by_one(spark, history, hot):
    stored, taken = sequential_merge(history)
    df = runs_df(spark, history)
    assert rows_of(merge.accepted_deliveries(df, hot), "arrival", "applied") == sorted(taken, key=repr)
    got = sorted(((*r[:-1], r[-1]) for r in rows_of(merge.merge_runs(df, hot_rows=hot), *KEEP)), key=repr)
    assert [(*r[:-1], None if r[-1] is None else r[-1].normalize()) for r in got] == [
        (*r[:-1], None if r[-1] is None else r[-1].normalize()) for r in as_rows(stored)
    ]


def test_merging_in_pieces_equals_merging_at_once(spark, history):
    df = runs_df(spark, history)
    whole = rows_of(merge.merge_runs(df))
    for cut in (1, 57, 120):
        first = merge.merge_runs(df.where(F.col("arrival") < cut))
        assert rows_of(merge.merge_runs(df.where(F.col("arrival") >= cut), first)) == whole


def test_older_redelivery_is_rejected_equal_one_wins(spark):
    base = {"session_id": "s", "id": "x", "pricing_status": "Priced"}
    rows = [{**base, "ended_at": at(10), "cost_usd": "1", "external_id": "one", "arrival": 1},
            {**base, "ended_at": at(5), "cost_usd": "2", "external_id": "late", "arrival": 2},
            {**base, "ended_at": at(10), "cost_usd": "3", "external_id": "equal", "pricing_status": "Quarantined", "arrival": 3},
            {**base, "ended_at": None, "external_id": "running", "arrival": 4}]
    row = merge.merge_runs(runs_df(spark, rows)).first()
    assert (row.external_id, row.pricing_status, row.cost_usd) == ("equal", "Priced", 1)


def test_messages_follow_accepted_priced_deliveries(spark):
    base = {"session_id": "s", "id": "r", "ended_at": at(10), "pricing_status": "Priced"}
    dels = runs_df(spark, [{**base, "arrival": 1}, {**base, "ended_at": at(5), "arrival": 2},
                           {**base, "pricing_status": "Quarantined", "arrival": 3}, {**base, "ended_at": at(11), "arrival": 4}])
    msgs = [{"sequence": s, "content": f"{a}"} for a in (1, 2, 3) for s in (1, 2, 3)] + [{"sequence": 1, "content": "4"}]
    arrivals = [a for a in (1, 2, 3) for _ in range(3)] + [4]
    df = messages_df(spark, msgs)
    pairs = spark.createDataFrame([(m["sequence"], m["content"], a) for m, a in zip(msgs, arrivals, strict=True)], "sequence int, content string, arrival bigint")
    tagged = df.join(pairs, ["sequence", "content"]).select(*schemas.columns(schemas.MESSAGES), "arrival")
    out = merge.merge_messages(tagged, merge.accepted_deliveries(dels))
    assert rows_of(out, "sequence", "content") == [(1, "4"), (2, "1"), (3, "1")]


def finding(i, **kw):
    base = {"id": f"f{i}", "run_id": "r", "kind": "Loop", "severity": "Minor", "evidence": "{}", "evidence_hash": "h",
            "wasted_cost_usd": Decimal(i), "detected_at": at(i), "acknowledged_at": None, "version": 1}
    return tuple({**base, **kw}[c] for c in schemas.columns(schemas.FINDINGS))


def test_findings_keep_identity_and_take_new_values(spark):
    old = spark.createDataFrame([finding(1, acknowledged_at=T0), finding(2, evidence_hash="keep")], schemas.FINDINGS)
    new = spark.createDataFrame([finding(5, severity="Major"), finding(6, evidence_hash="new")], schemas.FINDINGS)
    got = {r.evidence_hash: r for r in merge.merge_findings(old, new).collect()}
    assert set(got) == {"h", "keep", "new"}
    h = got["h"]
    assert (h.id, h.detected_at, h.acknowledged_at, h.severity, h.wasted_cost_usd) == ("f1", at(1), T0, "Major", 5)
    again = merge.merge_findings(merge.merge_findings(old, new), new)
    assert rows_of(again) == rows_of(merge.merge_findings(old, new))


def test_first_acknowledgement_wins(spark):
    f = spark.createDataFrame([finding(1), finding(2, acknowledged_at=T0), finding(3)], schemas.FINDINGS)
    acks = spark.createDataFrame([("f1", at(9)), ("f1", at(4)), ("f2", at(1))], "id string, at timestamp")
    assert dict(rows_of(merge.acknowledge(f, acks), "id", "acknowledged_at")) == {"f1": at(4), "f2": T0, "f3": None}


def test_documents_insert_if_absent(spark):
    state = spark.createDataFrame([("h1", 7)], "content_hash string, id bigint")
    new = spark.createDataFrame([("h1", 10), ("h2", 12), ("h2", 11)], "content_hash string, id bigint")
    got = rows_of(merge.merge_documents(state, new), "id", "stored_id", "applied")
    assert got == [(10, 7, False), (11, 11, True), (12, 11, False)]


def test_refresh_touches_only_covered_days(spark):
    names = schemas.columns(schemas.AGGREGATE)

    def bucket(day, model, n):
        from datetime import date

        return tuple({"bucket_day": date.fromisoformat(day), "model_slug": model, "service": "s", "cost_usd": Decimal(n)}.get(c, n) for c in names)

    state = spark.createDataFrame([bucket("2026-01-01", "m", 9), bucket("2026-01-01", "gone", 9), bucket("2025-12-31", "m", 9)], schemas.AGGREGATE)
    runs = runs_df(spark, [{"started_at": T0}, {"started_at": None}])
    fresh = spark.createDataFrame([bucket("2026-01-01", "m", 3)], schemas.AGGREGATE)
    out = merge.refresh_aggregate(state, runs, fresh)
    assert [(str(r[0]), *r[1:]) for r in rows_of(out, "bucket_day", "model_slug", "run_count")] == [("2025-12-31", "m", 9), ("2026-01-01", "m", 3)]
    assert rows_of(merge.refresh_aggregate(out, runs, fresh)) == rows_of(out)
    assert merge.refresh_aggregate(out, runs, fresh.limit(0)).count() == 1


def test_integrity_and_transitions(spark):
    runs = runs_df(spark, [{"id": "a", "session_id": "s", "status": "Done", "pricing_status": "Unpriceable", "parent_run_id": "a"},
                           {"id": "b", "session_id": "s"}])
    msgs = messages_df(spark, [{"run_id": "zz", "sequence": 1}, {"run_id": "a", "sequence": 1}, {"run_id": "a", "sequence": 1}])
    finds = spark.createDataFrame([finding(1, kind="Odd"), finding(2)], schemas.FINDINGS)
    got = dict(rows_of(merge.check_integrity(runs, msgs, finds)))
    assert got == {"run_status": 1, "pricing_status": 0, "self_parent": 1, "finding_kind": 1, "severity": 0, "messages_without_run": 1,
                   "cost_sum_differs": 0, "duplicate_run_key": 1, "duplicate_message_key": 1, "duplicate_finding_key": 0}
    moves = runs_df(spark, [{"session_id": "s", "status": st, "arrival": i} for i, st in enumerate(["Running", "Failed", "Failed", "Completed", "Unknown"])])
    want = [(3, "Failed"), (4, "Completed")]
    for hot in (2, 1000):
        assert rows_of(merge.transition_violations(moves, hot), "arrival", "previous_status") == want


def test_a_run_keeps_the_id_it_was_stored_under(spark):
    state = runs_df(spark, [{"id": "stored-id", "session_id": "s", "ended_at": at(1)}])
    new = runs_df(spark, [{"id": "new-id", "session_id": "s", "ended_at": at(2), "arrival": 5}])
    merged = merge.merge_runs(new, state).collect()
    assert [(r.id, r.ended_at) for r in merged] == [("stored-id", at(2))]
    both = new.unionByName(state.withColumn("arrival", F.lit(-1).cast("bigint")))
    assert rows_of(merge.stored_ids(both)) == [("new-id", "stored-id")]
