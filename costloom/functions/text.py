"""String expressions: blanks, ids, hashes, slugs, status vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ledger status words and the run status each one means (compared trimmed, in lower case).
LEDGER_STATUS = {
    "ok": "Completed",
    "error": "Failed",
    "timeout": "Failed",
    "stopped": "Cancelled",
    "orphaned": "Unknown",
    "needs_input": "Unknown",
}
# Last transcript event types that end a run.
TERMINAL_FAILED = ("error", "abort")
TERMINAL_COMPLETED = ("result", "summary")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """Null, empty or only (Unicode) white space."""
    return ~F.coalesce(col(c).rlike(r"(?U)\S"), F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.when(~is_blank(c), col(c))


def trim_all(c: Column | str) -> Column:
    """Without (Unicode) white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def run_id(session_id: Column | str, agent_id: Column | str = "") -> Column:
    """Deterministic run id of a (session, agent) key, so replays agree without a lookup."""
    agent = F.lit("") if isinstance(agent_id, str) and agent_id == "" else col(agent_id)
    return F.left(F.sha2(F.concat(col(session_id), F.lit("\x1f"), agent), 256), F.lit(32))


def derived_id(*parts: Column | str) -> Column:
    """32 hex digits over the given key parts (message, finding, document and chunk ids)."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[col(p).cast("string") for p in parts]), 256), F.lit(32))


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def normalize_slug(c: Column | str) -> Column:
    """Blank becomes ''; one trailing `[1m]` is dropped; nothing else changes."""
    return F.when(is_blank(c), F.lit("")).otherwise(F.regexp_replace(col(c), r"\[1m\]$", ""))


def is_test_handle(c: Column | str) -> Column:
    low = F.lower(col(c))
    return F.coalesce((low == "test") | low.startswith("test-"), F.lit(False))


def resolve_session(session_id: Column | str, handle: Column | str) -> Column:
    """Session id, else handle, else null (such rows must not be keyed at all)."""
    return F.coalesce(blank_to_null(session_id), blank_to_null(handle))


def ledger_status(c: Column | str) -> Column:
    word = F.lower(trim_all(c))
    out = F.lit("Unknown")
    for status in sorted(set(LEDGER_STATUS.values())):
        words = [w for w, s in LEDGER_STATUS.items() if s == status]
        out = F.when(word.isin(words), F.lit(status)).otherwise(out)
    return out


def terminal_status(c: Column | str) -> Column:
    return (
        F.when(col(c).isin(*TERMINAL_FAILED), F.lit("Failed"))
        .when(col(c).isin(*TERMINAL_COMPLETED), F.lit("Completed"))
        .otherwise(F.lit("Running"))
    )
