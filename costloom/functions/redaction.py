"""Redaction of excerpts: denied literals, secret shapes, absolute paths; all inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from costloom.functions.text import col, is_blank

MARKER = "[REDACTED]"
MAX_EXCERPT_CHARS = 500
# Secret shapes (matched without case) and absolute-path shapes.
SECRET_PATTERNS = (
    r"sk-[A-Za-z0-9_-]{8,}",
    r"api[_-]?key\s*[:=]\s*\S+",
    r"\b[0-9a-fA-F]{32,}\b",
    r"\b[A-Za-z0-9+/]{40,}={0,2}\b",
)
PATH_PATTERNS = (
    r"/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+",
    r"[A-Za-z]:\\[^\s|]+",
    r"~/[^\s|]+",
)

# Cheap necessary conditions: a text without one of these has no match of its pattern, so the costly Unicode-aware pattern is not
# run on it. (Without case, s, k and i also stand for the long s, the Kelvin sign and the two Turkish i.)
NEEDS: dict[str, Callable[[Column], Column]] = {
    SECRET_PATTERNS[0]: lambda c: c.contains("-"),
    SECRET_PATTERNS[1]: lambda c: c.contains(":") | c.contains("="),
    SECRET_PATTERNS[2]: lambda c: c.rlike("[0-9a-fA-F]{32}"),
    SECRET_PATTERNS[3]: lambda c: c.rlike("[A-Za-z0-9+/\u017f\u212a\u0130\u0131]{40}"),
    PATH_PATTERNS[0]: lambda c: c.contains("/"),
    PATH_PATTERNS[1]: lambda c: c.contains(":\\"),
    PATH_PATTERNS[2]: lambda c: c.contains("~/"),
}


def _replaced(value: Column, pattern: str, flags: str) -> Column:
    """`value` without matches. A lambda names the value, which would else stand in the plan three times per pattern."""
    done = lambda c: F.regexp_replace(c, flags + pattern, MARKER)
    need = NEEDS.get(pattern)
    if need is None:
        return done(value)
    return F.get(F.transform(F.array(value), lambda c: F.when(need(c), done(c)).otherwise(c)), F.lit(0))


def redact(
    c: Column | str,
    denied: list[Column | str] | None = None,
    secrets: tuple[str, ...] = SECRET_PATTERNS,
    max_chars: int | None = MAX_EXCERPT_CHARS,
) -> Column:
    """The excerpt without denied values, secrets and paths, then cut to `max_chars` code points.

    Denied values go first and literally; blank text gives ''.
    """
    out = col(c)
    for d in denied or []:
        out = F.when(is_blank(d), out).otherwise(F.replace(out, col(d), F.lit(MARKER)))
    for pattern in secrets:
        out = _replaced(out, pattern, "(?iU)")
    for pattern in PATH_PATTERNS:
        out = _replaced(out, pattern, "(?U)")
    if max_chars is not None:
        out = F.left(out, F.lit(max_chars))
    return F.when(is_blank(c), F.lit("")).otherwise(out)
