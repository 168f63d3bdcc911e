"""Keyed JSON topics: camelCase names, nulls left out, enum words in camelCase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costloom import schemas
from costloom.operators.normalize import RUN_COLUMNS

TIME_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

# Topic contracts: flat DDL of the value, and which columns are enum words.
PRICED = schemas.RUNS
INDEXED = "run_id string, session_id string"
PUBLIC_AGGREGATE = schemas.AGGREGATE
ENUM_COLUMNS = ("status", "pricing_status")


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def to_topic(df: DataFrame, key: Column | str, contract: str) -> DataFrame:
    """(key, value) rows of the contract's columns."""
    fields = []
    for c in schemas.columns(contract):
        value = F.col(c)
        if c in ENUM_COLUMNS:
            value = F.concat(F.lower(F.left(value, F.lit(1))), F.substring(value, 2, 100))
        fields.append(value.alias(camel(c)))
    k = F.col(key) if isinstance(key, str) else key
    extra = [c for c in ("offset",) if c in df.columns]
    return df.select(k.cast("string").alias("key"), F.to_json(F.struct(*fields), TIME_FORMAT).alias("value"), *extra)


def from_topic(topic: DataFrame, contract: str) -> DataFrame:
    """Typed rows of a topic; `offset` is kept where the source has one."""
    names = schemas.columns(contract)
    ddl = contract
    for c in names:
        ddl = (", " + ddl).replace(f", {c} ", f", {camel(c)} ")[2:]
    body = F.from_json(F.col("value").cast("string"), ddl, TIME_FORMAT)
    out = []
    for c in names:
        value = F.col(f"_v.{camel(c)}")
        if c in ENUM_COLUMNS:
            value = F.concat(F.upper(F.left(value, F.lit(1))), F.substring(value, 2, 100))
        out.append(value.alias(c))
    extra = [c for c in ("offset", "batch_id") if c in topic.columns]
    return topic.withColumn("_v", body).select(*out, *extra)


def priced_topic(runs: DataFrame) -> DataFrame:
    return to_topic(runs, "session_id", PRICED)


def aggregate_topic(buckets: DataFrame) -> DataFrame:
    return to_topic(buckets, F.date_format("bucket_day", "yyyy-MM-dd"), PUBLIC_AGGREGATE)


def replay_runs(runs: DataFrame) -> DataFrame:
    """Every stored run as a priced-topic row, oldest start first, runs without a start last, then by id.

    The global order is a range partitioning on a unique key, so no task gets more than its share.
    """
    ordered = runs.orderBy(F.col("started_at").asc_nulls_last(), F.col("id").asc())
    return priced_topic(ordered.select(*RUN_COLUMNS))
