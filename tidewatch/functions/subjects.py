"""Dotted subjects: ``*`` stands for one token, a last ``>`` for one or more."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def market(symbol: Column) -> Column:
    return F.concat(F.lit("md."), F.upper(symbol))


def features(symbol: Column) -> Column:
    return F.concat(F.lit("features."), F.upper(symbol))


def pattern_regex(pattern: str) -> str:
    """Anchored regular expression of a pattern; what follows a ``>`` has no effect."""
    out = []
    for k, token in enumerate(pattern.split(".")):
        dot = r"\." if k else ""
        if token == ">":
            return f"^{''.join(out)}{dot}.*$" if k else "^.*$"
        out.append(dot + ("[^.]*" if token == "*" else re.escape(token)))
    return f"^{''.join(out)}$"


def matches(subject: Column, pattern: str) -> Column:
    return (subject == pattern) | subject.rlike(pattern_regex(pattern))


def only(tape: DataFrame, pattern: str) -> DataFrame:
    """The symbols of a tape that a market pattern such as ``md.BTCUSDT`` takes; Spark prunes partitions where it can."""
    return tape.where(matches(market(F.col("symbol")), pattern))


def with_prefix(tape: DataFrame, prefix: str) -> DataFrame:
    """Symbols by prefix, which tokens can't express."""
    return tape.where(F.upper("symbol").startswith(prefix.upper()))


def symbol_list(text: Column, default: str) -> Column:
    """Symbols of a comma-separated list, trimmed and in upper case."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(default)))


def stream_names(symbol: Column) -> Column:
    """Depth and trade stream of a symbol, joined as a venue's combined stream wants them."""
    return F.concat(F.lower(symbol), F.lit("@depth@100ms/"), F.lower(symbol), F.lit("@trade"))
