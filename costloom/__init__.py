"""costloom: agent-run cost and waste analytics as Spark jobs over tables."""

from costloom.session import build_session, pin_utc

__all__ = ["build_session", "pin_utc"]
