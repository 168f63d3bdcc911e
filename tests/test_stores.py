"""Stores of streams: whole days, open deliveries, hashes seen, fenced replacements; and admission in event-time order."""

import json
import os
import random
from datetime import date, timedelta

import pytest
from helpers import T0, at, rows_of, runs_df
from pyspark.sql import functions as F
from test_documents_and_search import brute_admit
from test_sources_and_adapters import big_ledger

from costloom import schemas
from costloom.operators import merge
from costloom.sources import envelopes
from costloom.session import STATE_KEY, rocksdb_state
from costloom.streaming import jobs, stores


def buckets(spark, rows):
    names = schemas.columns(schemas.AGGREGATE)
    out = [tuple({"bucket_day": d, "model_slug": m, "service": "s", "cost_usd": None}.get(c, n) for c in names) for d, m, n in rows]
    return spark.createDataFrame(out, schemas.AGGREGATE)


def files_below(path):
    return {os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_a_refresh_replaces_whole_days_only(spark, tmp_path):
    day = lambda n: date(2026, 1, n)
    table = stores.DayTable(spark, str(tmp_path / "agg"))
    assert table.read().count() == 0
    old = buckets(spark, [(day(1), "a", 1), (day(2), "a", 1), (day(2), "gone", 1), (day(3), "a", 1), (day(4), "a", 1)])
    table.put(old)
    untouched = {f for f in files_below(tmp_path) if "=2026-01-01" in f or "=2026-01-04" in f}
    runs = runs_df(spark, [{"started_at": at(86_400 * (n - 1) - 43_200 + 60)} for n in (2, 3)] + [{"started_at": None}])
    new = buckets(spark, [(day(2), "a", 5), (day(2), "b", 6)])
    want = rows_of(merge.refresh_aggregate(old, runs, new))
    for _ in range(2):
        table.refresh(runs, new)
        assert rows_of(table.read()) == want and [r[0] for r in rows_of(table.read().select("bucket_day", "model_slug", "run_count"))] == [day(1), day(2), day(2), day(4)]
        assert untouched <= files_below(tmp_path)
    table.refresh(runs.limit(0), new.limit(0))
    assert rows_of(table.read()) == want


def test_open_deliveries_hold_nothing_that_is_settled(spark, tmp_path):
    ledger = big_ledger(spark, tmp_path / "l.jsonl", price=lambda i: 0.5)
    parts = [r.payload for r in envelopes.encode_ledger_parts(ledger, part_spans=4).where("session_id = 'big'").collect()]
    delivery = json.dumps(json.loads(parts[0])["resourceSpans"][0]["resource"]["attributes"])
    assert len(parts) >= 3 and ".delivery" in delivery
    pending = stores.PendingParts(spark, str(tmp_path), "w")
    own = next(a for a in json.loads(delivery) if a["key"].endswith(".delivery"))["value"]["stringValue"]
    n = 0

    def settle(payloads, retry=False):
        nonlocal n
        n += not retry
        rows = [(p, f"h{hash(p)}", n) for p in payloads]
        return [r.payload for r in pending.settle(spark.createDataFrame(rows, "payload string, content_hash string, arrival bigint"), n).collect()]

    sizes = []
    for k in range(6):
        mine = [p.replace(own, f"delivery-{k}") for p in parts]
        assert settle(mine[:1]) == []
        assert settle([*mine[1:-1], '{"resourceSpans":[]}']) == ['{"resourceSpans":[]}']
        for retry in (False, True):  # a retry gives the same again
            assert sorted(settle(mine[-1:], retry)) == sorted(mine)
        folders = sorted(pending.held.values("batch_id"), key=int)
        sizes.append((len(folders), len(pending.waiting.folders.values("batch_id")), pending.waiting.before(n + 1)[1].count()))
    assert len(set(sizes[1:])) == 1 and sizes[-1][2] == 0, sizes
    # What is settled is not read again: without any of the earlier folders the next delivery goes through all the same.
    for v in pending.held.values("batch_id"):
        pending.held.drop("batch_id", v)
    mine = [p.replace(own, "last") for p in parts]
    assert settle(mine[:2]) == [] and sorted(settle(mine[2:])) == sorted(mine)


def test_hashes_seen_are_exact_and_filters_stay_flat(spark, tmp_path):
    rng = random.Random(1)
    seen = stores.SeenHashes(spark, str(tmp_path), "w", buckets=4, words=8)  # so small that filters fill up
    known, sizes = set(), []
    for n in range(1, 7):
        batch = [(f"{rng.randrange(400)}", f"p{i}", i) for i in range(200)]
        df = spark.createDataFrame(batch, "content_hash string, payload string, arrival bigint")
        first = {}
        for h, p, i in batch:
            if h not in known:
                first.setdefault(h, (h, p, i))
        for _ in range(2):
            assert rows_of(seen.first(df, n)) == sorted(first.values(), key=repr)
        known |= set(first)
        _, filters = seen.filters.before(n + 1)
        sizes.append((filters.count(), {r.n for r in filters.select(F.size("bits").alias("n")).collect()}, len(seen.filters.folders.values("batch_id"))))
    assert sizes[-1] == sizes[-2] == (4, {8}, 2)
    assert seen.first(df.limit(0), 9).count() == 0


def aggregate(spark, rows):
    names = schemas.columns(schemas.AGGREGATE)
    out = [tuple({"bucket_day": date(2026, 1, 1), "model_slug": m, "service": "s", "cost_usd": None}.get(c, n) for c in names) + (v,) for m, n, v in rows]
    return spark.createDataFrame(out, f"{schemas.AGGREGATE}, offset bigint")


def test_replacement_and_topic_converge_in_either_order(spark, tmp_path):
    durable = lambda rows: aggregate(spark, [(m, n, 0) for m, n in rows]).drop("offset")
    results = []
    for order in ("topic first", "replacement first"):
        table = jobs.Lake(spark, str(tmp_path / order.replace(" ", "-"))).aggregates
        assert table.newest() == -1 and table.current().count() == 0
        table.write(aggregate(spark, [("m", 1, 1), ("withdrawn", 5, 2)]), 1)
        fence = table.newest()
        steps = [lambda: table.write(aggregate(spark, [("m", 9, 4), ("new", 3, 3)]), 2), lambda: table.replace(durable([("m", 7), ("other", 2)]), 3, fence)]  # noqa: B023
        for step in steps if order == "topic first" else steps[::-1]:
            step()
        results.append(rows_of(table.current(), "model_slug", "run_count"))
    assert results[0] == results[1] == [("m", 9), ("new", 3), ("other", 2)]


def test_reconcile_needs_no_topic_message(spark, tmp_path):
    lake = jobs.Lake(spark, str(tmp_path / "t"))
    lake.aggregates.write(aggregate(spark, [("m", 1, 1), ("withdrawn", 5, 2)]), lake.numbers.of("topic", 0))
    state = aggregate(spark, [("m", 2, 0)]).drop("offset")
    assert jobs.stream_reconcile(lake, lambda: state, str(tmp_path / "c"), available_now=True).awaitTermination(60)
    assert rows_of(lake.aggregates.current(), "model_slug", "run_count") == [("m", 2)]
    lake.aggregates.write(aggregate(spark, [("late", 4, 3)]), lake.numbers.of("topic", 1))
    assert rows_of(lake.aggregates.current(), "model_slug", "run_count") == [("late", 4), ("m", 2)]


@pytest.mark.parametrize("seed", [1])
def test_requests_in_any_order_are_decided_in_time_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"p{rng.randrange(3)}", i, T0 + timedelta(seconds=rng.randrange(20_000), microseconds=rng.randrange(3))) for i in range(120)]
    shuffled = rng.sample(rows, len(rows))
    ddl, src = "principal string, arrival bigint, at timestamp", str(tmp_path / "in")
    for i in range(5):
        spark.createDataFrame(shuffled[i * 24 : i * 24 + 24], ddl).coalesce(1).write.mode("append").parquet(src)
    for n in range(3):  # far later requests of somebody else move the watermark
        spark.createDataFrame([("clock", -1, T0 + timedelta(days=10 + n))], ddl).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", "1").parquet(src)
    out = jobs.stream_admission_ordered(stream, 3, 1800, delay="6 hours")
    q = out.writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = rows_of(spark.table("ordered").where("arrival >= 0"), "principal", "arrival", "accepted")
    assert got == brute_admit(rows, 3, 1800) and not all(r[2] for r in got)
    # All windows are over: only the clock's own last requests are still held.
    state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "taken").load()
    assert {r[0] for r in state.select("key.principal").collect()} <= {"clock"}


def test_ordered_admission_runs_in_a_session_with_the_default_state_store(spark, tmp_path):
    heap = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    own = spark.conf.get(STATE_KEY)
    spark.conf.set(STATE_KEY, heap)
    try:
        ddl, src = "principal string, arrival bigint, at timestamp", str(tmp_path / "in")
        for rows in ([("p", i, T0 + timedelta(seconds=i)) for i in range(5)], [("clock", -1, T0 + timedelta(days=9))]):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", "1").parquet(src)
        out = jobs.stream_admission_ordered(stream, 3, 1800)
        with rocksdb_state(spark):
            q = jobs._start(out.writeStream.format("memory").queryName("ordered_default"), str(tmp_path / "c"), True)
        assert spark.conf.get(STATE_KEY) == heap
        assert q.awaitTermination(240)
        got = rows_of(spark.table("ordered_default").where("arrival >= 0"), "arrival", "accepted")
        assert got == [(i, i < 3) for i in range(5)]
    finally:
        spark.conf.set(STATE_KEY, own)
