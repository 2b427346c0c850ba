"""Exact decimal numbers as counts of 1e-8, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.types import SCALE

DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def idiv(a: Column, b: int) -> Column:
    """Integer quotient, cut toward zero."""
    return F.call_function("div", a, F.lit(b))


def parse(text: Column) -> Column:
    """Count of 1e-8 in a decimal string, digits after the eighth cut off; null for anything else and out of range."""
    body = F.ltrim(text, F.lit("+-"))
    part = F.rpad(F.substring(F.split_part(body, F.lit("."), F.lit(2)), 1, 8), 8, "0")
    size = F.concat(F.substring_index(body, ".", 1), part).try_cast("bigint")
    return F.when(text.rlike(DECIMAL), F.when(text.startswith("-"), -size).otherwise(size))


def render(raw: Column) -> Column:
    """Shortest decimal string of a count of 1e-8."""
    size = F.abs(raw.cast("decimal(20,0)"))
    whole = F.floor(size / F.lit(SCALE)).cast("string")
    part = F.rtrim(F.lpad((size % F.lit(SCALE)).cast("bigint").cast("string"), 8, "0"), F.lit("0"))
    return F.concat(F.when(raw < 0, F.lit("-")).otherwise(F.lit("")), whole, F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))


def real(raw: Column) -> Column:
    return raw.cast("double") / F.lit(float(SCALE))


def notional(price: Column, qty: Column) -> Column:
    """Product of two counts, each first cut to 1e-4 so that it stays in range."""
    return idiv(price, 10_000) * idiv(qty, 10_000)


def round4(x: Column) -> Column:
    """To four places, halves away from zero; NaN and infinities become 0."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(F.round(x * 1e4, 0) / 1e4)


def round2(x: Column) -> Column:
    """To two places, halves up; for numbers that aren't negative."""
    return F.floor(x * 100 + 0.5) / 100


def bps(a: Column, b: Column) -> Column:
    """(a - b) / b in basis points, 0 if b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise((a - b) / F.when(b == 0, F.lit(None)).otherwise(b) * 1e4)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
