"""Exact price arithmetic.

Plain `bigint * decimal(20,10)` makes Spark drop scale to fit 38 digits. The widths below are chosen so
that the four-term product sum times the multiplier is exactly decimal(38,16): nothing is rounded
before the one final cast to decimal(20,10). Good for per-field tokens < 1e17 and prices < 1e6 per million.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from costloom.functions.text import col

TOKEN_FIELDS = ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens")
PRICE_FIELDS = ("input_per_mtok", "cache_read_per_mtok", "cache_write_per_mtok", "output_per_mtok")

# The local zone of the peak tariff, its half-open hour windows and the factor inside them.
PEAK_ZONE = "Asia/Shanghai"
PEAK_HOURS = ((9, 12), (14, 18))
PEAK_FACTOR = "2"


def peak_multiplier(ts: Column | str) -> Column:
    """2.000 inside the peak windows, else 1.000 (decimal(6,3)); null time gives null. Needs a UTC session."""
    local = F.from_utc_timestamp(col(ts), PEAK_ZONE)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    peak = F.lit(False)
    for start, end in PEAK_HOURS:
        peak = peak | ((second >= start * 3600) & (second < end * 3600))
    return F.when(
        col(ts).isNotNull(), F.when(peak, F.lit(PEAK_FACTOR)).otherwise(F.lit("1")).cast("decimal(6,3)")
    )


def price_per_token(price_per_mtok: Column) -> Column:
    return (price_per_mtok * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(16,16)")


def exact_cost(tokens: list[Column], price: Column, multiplier: Column) -> Column:
    """Unrounded decimal(38,16) cost of four token counts at one price struct; null price gives null."""
    terms = [
        F.coalesce(t, F.lit(0)).cast("decimal(17,0)") * price_per_token(price[f])
        for t, f in zip(tokens, PRICE_FIELDS, strict=True)
    ]
    return ((terms[0] + terms[1]) + (terms[2] + terms[3])) * multiplier.cast("decimal(1,0)")


def cost_expr(tokens: list[Column], price: Column, multiplier: Column) -> Column:
    return exact_cost(tokens, price, multiplier).cast("decimal(20,10)")


def token_columns(prefix: str = "") -> list[Column]:
    return [F.col(prefix + f) for f in TOKEN_FIELDS]


def total_tokens(prefix: str = "") -> Column:
    out = F.lit(0).cast("bigint")
    for c in token_columns(prefix):
        out = out + F.coalesce(c, F.lit(0))
    return out
