"""Feature vectors of a symbol's order flow, one at every k-th event."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.fixedpoint import idiv
from tidewatch.operators import book
from tidewatch.operators.fold import fold
from tidewatch.operators.rules import trades
from tidewatch.operators.scan import STRETCH
from tidewatch.operators.windows import sliding
from tidewatch.types import BUY, FEATURES, SCALE, SEC, SELL, Config


def flow_windows(tape: DataFrame, length: int) -> DataFrame:
    """Every event with the trades, their signed volume, the level changes and the removals of its window, itself included."""
    zero = lambda c: F.lit(0).cast("bigint").alias(c)
    signed = F.when(F.col("side") == SELL, -F.col("qty_raw")).otherwise(F.col("qty_raw"))
    t = trades(tape).select("seq", "ts_ns", "symbol", zero("pos"), F.lit(1).cast("bigint").alias("trade"), signed.alias("signed_raw"), zero("change"), zero("removal"))
    d = book.deltas(tape).select("seq", "ts_ns", "symbol", F.col("pos").cast("bigint").alias("pos"), zero("trade"), zero("signed_raw"), F.lit(1).cast("bigint").alias("change"), (~F.col("added")).cast("bigint").alias("removal"))
    last = tape.select("seq", "ts_ns", "symbol", F.lit(1 << 40).cast("bigint").alias("pos"), zero("trade"), zero("signed_raw"), zero("change"), zero("removal"))
    total = lambda c: lambda w: F.sum(c).over(w)
    every = sliding(t.unionByName(d).unionByName(last), length, ["seq", "pos"], {"trades": total("trade"), "volume_raw": total("signed_raw"), "changes": total("change"), "removals": total("removal")})
    return every.where(F.col("pos") == 1 << 40).select("seq", "ts_ns", "symbol", "trades", "volume_raw", "changes", "removals")


class Flow:
    """A book, and what came in a window that ends now."""

    def __init__(self) -> None:
        self.ladder, self.n = book.Ladder(), 0
        self.trades: deque[tuple[int, int]] = deque()
        self.changes: deque[tuple[int, int, int]] = deque()
        self.volume = self.changed = self.removed = 0

    def drop(self, before: int) -> None:
        while self.trades and self.trades[0][0] < before:
            self.volume -= self.trades.popleft()[1]
        while self.changes and self.changes[0][0] < before:
            _, n, removed = self.changes.popleft()
            self.changed -= n
            self.removed -= removed

    def vector(self, cfg: Config) -> tuple | None:
        mid = self.ladder.mid()
        if not mid:
            return None
        bids, asks = self.ladder.top(BUY, cfg.feature_levels), self.ladder.top(SELL, cfg.feature_levels)
        (bid, bq), (ask, aq) = ((p / SCALE, q / SCALE) for p, q in (bids[0], asks[0]))
        b, a = sum(q for _, q in bids), sum(q for _, q in asks)
        micro = (bid * aq + ask * bq) / (bq + aq) if bq + aq else mid
        return (
            (asks[0][0] - bids[0][0]) / SCALE / mid * 1e4, (b / SCALE - a / SCALE) / (b / SCALE + a / SCALE) if b + a > 0 else 0.0, (micro - mid) / mid * 1e4, len(self.trades) / (cfg.feature_window / SEC),
            self.volume / SCALE, self.removed / self.changed if self.changed else 0.0, float(len(self.ladder.prices[BUY])), float(len(self.ladder.prices[SELL])),
        )


def _vectors(cfg: Config):
    def step(f: Flow, row: tuple) -> list[tuple]:
        seq, ts, kind, snapshot, own, side, qty, bids, asks = row
        if kind == "count":
            f.n = qty
        elif kind == "trade":
            signed = -qty if side == SELL else qty
            f.trades.append((ts, signed))
            f.volume += signed
        elif changed := f.ladder.apply(snapshot, book._pairs(bids, asks)):
            removed = sum(new < old for _, _, _, old, new in changed)
            f.changes.append((ts, len(changed), removed))
            f.changed += len(changed)
            f.removed += removed
        if not own:
            return []
        f.n += 1
        if f.n % cfg.feature_every:
            return []
        f.drop(ts - cfg.feature_window)
        v = f.vector(cfg)
        return [] if v is None else [(seq, ts, *v)]

    return step


def vectors(tape: DataFrame, cfg: Config, stretch: int = STRETCH) -> DataFrame:
    """symbol, seq, ts_ns and the eight features at every ``cfg.feature_every``-th event of a symbol whose book has two sides.

    One fold a stretch: it begins with the book a window before the stretch and the number of events so far.
    """
    t = tape.select("symbol", "seq", "ts_ns", "kind", "is_snapshot", "side", "qty_raw", "bids", "asks")
    count = t.groupBy("symbol", idiv(F.col("ts_ns"), stretch).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(W.partitionBy("symbol").orderBy("k").rowsBetween(W.unboundedPreceding, -1))  # one row a stretch
    count = count.select("symbol", "k", F.lit("count").alias("kind"), F.lit(False).alias("own"), F.coalesce(so_far, F.lit(0)).cast("bigint").alias("qty_raw"))
    rows = book.by_stretch(t, cfg.feature_window, stretch).unionByName(count, allowMissingColumns=True)
    return fold(rows, ["seq"], ["seq", "ts_ns", "kind", "is_snapshot", "own", "side", "qty_raw", "bids", "asks"], Flow, _vectors(cfg), "seq bigint, ts_ns bigint, " + ", ".join(f"{f} double" for f in FEATURES), by=("symbol", "k"))


def as_map(v: DataFrame) -> DataFrame:
    """The wire form: symbol, ts_ns and a map of features."""
    return v.select("symbol", "ts_ns", F.create_map(*[x for c in FEATURES for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0.0)))]).alias("features"))


def vectorized(v: DataFrame) -> DataFrame:
    """Features as an array in fixed order, what is missing as 0; from the wire form or from columns."""
    at = (lambda c: F.col("features")[c]) if "features" in v.columns else F.col
    return v.withColumn("vector", F.array(*[F.coalesce(at(c).cast("double"), F.lit(0.0)) for c in FEATURES]))
