"""Small builders for test rows."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from costloom import schemas

T0 = datetime(2026, 1, 1, 12, 0, 0)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def runs_df(spark, rows):
    """Rows as dicts over run defaults."""
    names = schemas.columns(schemas.RUNS)
    base = dict.fromkeys(names)
    base |= {
        "agent_id": "", "source": "delegate-ledger", "status": "Completed", "pricing_status": "Quarantined",
        "input_tokens": 0, "cache_read_tokens": 0, "cache_write_tokens": 0, "output_tokens": 0, "version": 1,
    }
    out = []
    for i, r in enumerate(rows):
        row = {**base, "id": f"{i:032x}", "session_id": f"s{i}", **r}
        for c in ("cost_usd", "reported_cost_usd", "price_multiplier"):
            row[c] = None if row[c] is None else Decimal(str(row[c]))
        out.append(row)
    extra = [k for k in (rows[0] if rows else {}) if k not in names]
    ddl = schemas.RUNS + "".join(f", {k} bigint" for k in extra)
    return spark.createDataFrame([tuple(r[n] for n in [*names, *extra]) for r in out], ddl)


def messages_df(spark, rows):
    names = schemas.columns(schemas.MESSAGES)
    base = dict.fromkeys(names)
    base |= {
        "run_id": "r", "role": "assistant", "input_tokens": 0, "cache_read_tokens": 0,
        "cache_write_tokens": 0, "output_tokens": 0, "occurred_at": T0, "version": 1,
    }
    out = []
    for r in rows:
        row = {**base, **r}
        row["id"] = row["id"] or f"{row['run_id']}-{row['sequence']}"
        row["cost_usd"] = None if row["cost_usd"] is None else Decimal(str(row["cost_usd"]))
        out.append(tuple(row[n] for n in names))
    return spark.createDataFrame(out, schemas.MESSAGES)


def rows_of(df, *cols):
    d = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in d.collect()), key=repr)
