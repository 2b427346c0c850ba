"""Summaries of alerts and markets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fixedpoint import real, round2
from tidewatch.operators.rules import trades
from tidewatch.operators.sync import synced
from tidewatch.types import LATENCY_BOUNDS

#: Alerts that are remembered, and shown unless asked otherwise.
RECENT, SHOWN, FEED = 500, 100, 300


def by_detector(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


def by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity_label").agg(F.count(F.lit(1)).alias("n"))


def totals(alerts: DataFrame) -> DataFrame:
    """Alerts by detector, by severity and in all, in one pass: detector, severity_label, n."""
    return alerts.groupingSets([["detector"], ["severity_label"], []], "detector", "severity_label").agg(F.count(F.lit(1)).alias("n"))


def page_size(limit: str | int | None) -> int:
    """The number asked for; ``SHOWN`` if it is none, zero or not a number."""
    text = str(limit or "")
    return int(text) if text.isascii() and text.isdigit() and int(text) else SHOWN


def recent(alerts: DataFrame, limit: str | int | None = None, keep: int = RECENT) -> DataFrame:
    """The newest alerts first, of the last ``keep``."""
    return alerts.orderBy(F.desc("n")).limit(min(page_size(limit), keep))


def feed(alerts: DataFrame, cap: int = FEED) -> DataFrame:
    """What a live list holds: the newest ``cap`` alerts, newest first."""
    return alerts.orderBy(F.desc("n")).limit(cap)


def tiles(tape: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per symbol, in the order of symbols, the last trade and the last features; either may be missing."""
    t = trades(tape).groupBy("symbol").agg(F.max_by(F.struct("price_raw", "ts_ns"), "seq").alias("t"))
    v = vectors.groupBy("symbol").agg(F.max_by(F.struct("spread_bps", "ofi", "trade_intensity", "cancel_ratio", "ts_ns"), "seq").alias("v"))
    return t.join(v, "symbol", "full_outer").select("symbol", real(F.col("t.price_raw")).alias("last_price"), F.col("t.ts_ns").alias("last_trade_ts_ns"), "v.spread_bps", "v.ofi", "v.trade_intensity", "v.cancel_ratio", F.col("v.ts_ns").alias("feature_ts_ns")).orderBy("symbol")


def stats(alerts: DataFrame, uptime_s: float) -> DataFrame:
    """One row: total, alerts a minute, and those that are critical or high."""
    a = alerts.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("severity_label").isin("critical", "high").cast("bigint")), F.lit(0)).alias("urgent"))
    return a.select("total", "urgent", (round2(F.col("total") / uptime_s * 60) if uptime_s > 0 else F.lit(0.0)).alias("alerts_per_min"))


def latency_histogram(alerts: DataFrame, column: str = "detect_latency_us") -> DataFrame:
    """Cumulative counts by upper bound, the last one infinite: le, n."""
    sums = alerts.agg(*[F.coalesce(F.sum((F.col(column) <= b).cast("bigint")), F.lit(0)).alias(str(b)) for b in LATENCY_BOUNDS], F.count(column).alias("+Inf"))
    names = [str(b) for b in LATENCY_BOUNDS] + ["+Inf"]
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select("x.le", "x.n")


def counters(tape: DataFrame) -> DataFrame:
    """Events taken in, by venue: received, trades, depth, snapshots."""
    count = lambda c: F.sum(F.expr(c).cast("bigint"))
    return tape.groupBy("exchange").agg(F.count(F.lit(1)).alias("received"), count("kind = 'trade'").alias("trades"), count("kind = 'depth' AND NOT is_snapshot").alias("depth"), count("kind = 'depth' AND is_snapshot").alias("snapshots"))


def ingest_stats(tape: DataFrame) -> DataFrame:
    """Counters by venue with what the sequence check made of its depth messages: applied, stale, buffered, gaps (each asks for a new
    snapshot), snapshots that had to be asked for again, and diffs dropped from full buffers."""
    s = synced(tape).join(tape.where("kind = 'depth'").select("symbol", "seq", "exchange"), ["symbol", "seq"])
    count = lambda *w: F.sum(F.col("outcome").isin(*w).cast("bigint"))
    by_book = s.groupBy("exchange", "symbol").agg(count("apply", "synced").alias("applied"), count("stale").alias("stale"), count("buffered", "gap").alias("buffered"), count("gap").alias("gaps"), count("again").alias("again"), F.max("dropped").alias("dropped"))
    total = by_book.groupBy("exchange").agg(*[F.sum(c).alias(c) for c in ("applied", "stale", "buffered", "gaps", "again", "dropped")])
    return counters(tape).join(total, "exchange", "left").na.fill(0)
