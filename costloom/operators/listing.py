"""Keyset-paged listings: the cursor is a pushed-down predicate, the page a TakeOrderedAndProject."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Cursor:
    """Key of the last row of the page before: the sort time (None in the null tail) and the id."""

    at: datetime | None
    id: str


def _ts(df: DataFrame, at: str, value: datetime | str) -> Column:
    """The bound in the column's own type: a cast column would keep the predicate from reaching the scan."""
    return F.lit(str(value)).cast(df.schema[at].dataType)


def after_cursor(df: DataFrame, cursor: Cursor | None, at: str = "started_at") -> DataFrame:
    """Rows strictly after the cursor in (at desc nulls last, id desc) order."""
    if cursor is None:
        return df
    lower_id = F.col("id") < F.lit(cursor.id)
    if cursor.at is None:
        return df.where(F.col(at).isNull() & lower_id)
    key = _ts(df, at, cursor.at)
    return df.where(F.col(at).isNull() | (F.col(at) < key) | ((F.col(at) == key) & lower_id))


def page(df: DataFrame, limit: int, at: str = "started_at") -> DataFrame:
    """Up to limit + 1 rows: the extra one only says that more follow."""
    return df.orderBy(F.col(at).desc_nulls_last(), F.col("id").desc()).limit(limit + 1)


def has_more(rows: DataFrame, limit: int) -> DataFrame:
    """The page as (returned rows, has_more flag)."""
    return rows.agg(
        F.least(F.count(F.lit(1)), F.lit(limit)).alias("returned"),
        (F.count(F.lit(1)) > limit).alias("has_more"),
    )


def list_runs(
    runs: DataFrame,
    limit: int = 30,
    cursor: Cursor | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    model: str | None = None,
    persona: str | None = None,
    source: str | None = None,
    min_cost: Decimal | str | None = None,
) -> DataFrame:
    out = runs
    if start is not None:
        out = out.where(F.col("started_at") >= _ts(runs, "started_at", start))
    if end is not None:
        out = out.where(F.col("started_at") <= _ts(runs, "started_at", end))
    for column, value in (("model_slug", model), ("persona", persona), ("source", source)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if min_cost is not None:
        out = out.where(F.col("cost_usd") >= F.lit(str(min_cost)).cast("decimal(20,10)"))
    return page(after_cursor(out, cursor), limit)


def list_findings(
    findings: DataFrame,
    limit: int = 30,
    cursor: Cursor | None = None,
    kind: str | None = None,
    severity: str | None = None,
    acknowledged: bool | None = None,
) -> DataFrame:
    if cursor is not None and cursor.at is None:
        raise ValueError("a finding cursor needs its detection time")
    out = findings
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    if acknowledged is not None:
        out = out.where(F.col("acknowledged_at").isNotNull() if acknowledged else F.col("acknowledged_at").isNull())
    return page(after_cursor(out, cursor, "detected_at"), limit, "detected_at")


def run_detail(runs: DataFrame, findings: DataFrame, run_id: str) -> DataFrame:
    """One run with its findings, newest first, one row per finding (the run alone when it has none)."""
    mine = findings.where(F.col("run_id") == run_id).select(
        F.col("run_id").alias("id"),
        F.col("id").alias("finding_id"),
        "kind",
        "severity",
        "wasted_cost_usd",
        "detected_at",
        "acknowledged_at",
    )
    one = runs.where(F.col("id") == run_id)
    return one.join(mine, "id", "left").orderBy(F.col("detected_at").desc_nulls_last(), F.col("finding_id").desc())
