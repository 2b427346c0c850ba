"""The five rules as plans over a tape, and the alerts they give."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.functions.fixedpoint import bps, clamp01, idiv, real, render, round4
from tidewatch.operators import book
from tidewatch.operators.fold import batch_of, fold, keys_of, values
from tidewatch.operators.scan import STRETCH, overlapping, recent, running
from tidewatch.operators.windows import cooldown, cooldown_by_stretch, numbered, sliding
from tidewatch.shipping import ship
from tidewatch.types import BUY, DESCRIPTIONS, EMA_ALPHA, MS, RULES, SCALE, SELL, SEVERITIES, SEVERITY, Config


_NUMBERED = 1 << 20  # alerts are numbered in stretches of so many seqs
WASH_NOTE = "footprint only: ownership is unknown"


def trades(tape: DataFrame, *keep: str) -> DataFrame:
    return tape.where("kind = 'trade'").select("seq", "ts_ns", "symbol", "side", "price_raw", "qty_raw", *keep)


def side_name(side: Column) -> Column:
    return F.when(side == BUY, "buy").otherwise("sell")


def wash_windows(tape: DataFrame, cfg: Config, *keep: str) -> DataFrame:
    """Every trade, with the columns ``keep`` of the tape, with count, band, volume and the smaller side's share of the volume in its window."""
    vol = lambda side, w: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("qty_raw"))).over(w), F.lit(0)).cast("bigint")
    t = sliding(trades(tape, *keep), cfg.wash_window, ["seq"], {
        "n": lambda w: F.count(F.lit(1)).over(w), "hi_raw": lambda w: F.max("price_raw").over(w), "lo_raw": lambda w: F.min("price_raw").over(w),
        "buy_raw": lambda w: vol(BUY, w), "sell_raw": lambda w: vol(SELL, w),
    })
    hi, lo, volume = real(F.col("hi_raw")), real(F.col("lo_raw")), real(F.col("buy_raw") + F.col("sell_raw"))
    t = t.withColumn("band_bps", F.when(hi + lo != 0, (hi - lo) / F.when(hi + lo != 0, (hi + lo) / 2) * 1e4)).withColumn("volume", volume)
    return t.withColumn("balance", F.when(volume > 0, real(F.least("buy_raw", "sell_raw")) / F.when(volume > 0, volume)).otherwise(F.lit(0.0)))


def wash_candidates(tape: DataFrame, cfg: Config, *keep: str) -> DataFrame:
    t = wash_windows(tape, cfg, *keep)
    return t.where((F.col("n") >= cfg.wash_min_trades) & (F.col("band_bps") <= cfg.wash_band_bps) & (F.col("balance") >= cfg.wash_balance) & (F.col("volume") >= cfg.wash_min_volume))


def wash_trades(tape: DataFrame, cfg: Config, *keep: str) -> DataFrame:
    c = wash_candidates(tape, cfg, *keep).select("seq", "ts_ns", "symbol", "n", "band_bps", "volume", "balance", *keep)
    return cooldown_by_stretch(c, cfg.wash_cooldown, ["seq"])


def stuffing_windows(tape: DataFrame, cfg: Config) -> DataFrame:
    """Every depth message but snapshots with the level changes and the trades in its window.

    A message that changes nothing sees the count as it was at the last change, however long ago.
    """
    d = book.deltas(tape).select("seq", "ts_ns", "symbol", "pos")
    churn = sliding(d, cfg.stuff_window, ["seq", "pos"], {"churn": lambda w: F.count(F.lit(1)).over(w)})
    churn = churn.groupBy("symbol", "seq").agg(F.max_by("churn", "pos").alias("churn"))
    m = _with_trades(tape, tape.where("kind = 'depth' AND NOT is_snapshot").select("seq", "ts_ns", "symbol"), cfg)
    m = m.join(churn.withColumnRenamed("churn", "here"), ["symbol", "seq"], "left")
    m = running(m, ["symbol"], ["seq"], {"churn": ("last", F.col("here"))})
    return m.drop("here").withColumn("churn", F.coalesce("churn", F.lit(0)))


def _with_trades(tape: DataFrame, messages: DataFrame, cfg: Config) -> DataFrame:
    """Messages with the number of trades in the window that ends at each."""
    t = trades(tape).select("seq", "ts_ns", "symbol", F.lit(1).alias("trade"))
    both = t.unionByName(messages.withColumn("trade", F.lit(0)), allowMissingColumns=True)
    return sliding(both, cfg.stuff_window, ["seq"], {"n_trades": lambda w: F.coalesce(F.sum("trade").over(w), F.lit(0))}).where("trade = 0").drop("trade")


def quote_stuffing(tape: DataFrame, cfg: Config, *keep: str, seen: DataFrame | None = None) -> DataFrame:
    """Only messages with enough level changes need a window of trades: ``seen``, from ``quotes``, tells them."""
    busy = (quotes(tape, cfg, *keep) if seen is None else seen).where("churn IS NOT NULL")
    m = _with_trades(tape, busy.select("seq", "ts_ns", "symbol", "churn", *keep), cfg)
    c = m.where((F.col("churn") >= cfg.stuff_churn) & (F.col("n_trades") <= cfg.stuff_max_trades))
    return cooldown(c.select("seq", "ts_ns", "symbol", "churn", "n_trades", *keep), cfg.stuff_cooldown, ["seq"])


def momentum_windows(tape: DataFrame, cfg: Config, *keep: str) -> DataFrame:
    """Every trade with the oldest, highest and lowest price and the signed volume of its window."""
    return sliding(trades(tape, *keep), cfg.ignite_window, ["seq"], {
        "start_raw": lambda w: F.first("price_raw").over(w), "hi_raw": lambda w: F.max("price_raw").over(w), "lo_raw": lambda w: F.min("price_raw").over(w),
        "net_raw": lambda w: F.sum(F.when(F.col("side") == BUY, F.col("qty_raw")).otherwise(-F.col("qty_raw"))).over(w),
    })


class Leg:
    """A leg that is watched for its reversal."""

    def __init__(self) -> None:
        self.side: int | None = None
        self.start = self.peak = 0.0
        self.since = 0

    def trade(self, cfg: Config, ts: int, price: float, start: float, hi: float, lo: float, net: float) -> tuple | None:
        """Take in a trade; (side, start, peak) of a leg that it reverses. A leg that has timed out ends without a look for a new one."""
        if self.side is None:
            up, down = (hi - start) / start * 1e4 if start else 0.0, -((lo - start) / start * 1e4) if start else 0.0
            if start and up >= cfg.ignite_bps and net >= cfg.ignite_volume:
                self.side, self.start, self.peak, self.since = BUY, start, hi, ts
            elif start and down >= cfg.ignite_bps and -net >= cfg.ignite_volume:
                self.side, self.start, self.peak, self.since = SELL, start, lo, ts
            return None
        if ts - self.since > cfg.reverse_window:
            self.side = None
            return None
        if (price > self.peak) if self.side == BUY else (price < self.peak):
            self.peak, self.since = price, ts
        back = self.peak - cfg.reverse_share * (self.peak - self.start)
        if (price <= back) if self.side == BUY else (price >= back):
            out = (self.side, self.start, self.peak)
            self.side = None
            return out
        return None


def _legs(cfg: Config, keep: Sequence[str], schema: T.StructType):
    """Reversed legs of each symbol, whose trades come in order. Without a leg only trades that may begin one are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        symbol, leg = object(), Leg()
        for b in batches:
            names = [name for name, in keys_of(b, ["symbol"])]
            times = values(b.column("ts_ns"))
            price, start, hi, lo, net = (b.column(c).to_numpy() / SCALE for c in ("price_raw", "start_raw", "hi_raw", "lo_raw", "net_raw"))
            with np.errstate(divide="ignore", invalid="ignore"):
                may = (start != 0) & (((hi - start) / start * 1e4 >= cfg.ignite_bps) & (net >= cfg.ignite_volume) | (-((lo - start) / start * 1e4) >= cfg.ignite_bps) & (-net >= cfg.ignite_volume))
            begins = np.flatnonzero(may).tolist()
            rows = list(zip(*(x.tolist() for x in (price, start, hi, lo, net)), strict=True))
            edges = [k for k in range(1, len(names)) if names[k] != names[k - 1]] if names and names[0] != names[-1] else []
            out = []
            for at, to in zip([0, *edges], [*edges, len(names)], strict=True):
                if at == to:
                    continue
                if names[at] != symbol:
                    symbol, leg = names[at], Leg()
                k = at
                while k < to:
                    if leg.side is None:
                        nearest = bisect_left(begins, k)
                        if nearest == len(begins) or begins[nearest] >= to:
                            break
                        k = begins[nearest]
                    found = leg.trade(cfg, times[k], *rows[k])
                    if found:
                        out.append((symbol, b.column("seq")[k].as_py(), times[k], *found, rows[k][0], *(b.column(c)[k].as_py() for c in keep)))
                    k += 1
            if out:
                yield batch_of(out, arrow)

    return run


def _ddl(tape: DataFrame, keep: Collection[str]) -> str:
    kinds = dict(tape.dtypes)
    return "".join(f", {c} {kinds[c]}" for c in keep)


def momentum_ignition(tape: DataFrame, cfg: Config, *keep: str) -> DataFrame:
    ship(tape.sparkSession)
    t = momentum_windows(tape, cfg, *keep).select("symbol", "seq", "ts_ns", "price_raw", "start_raw", "hi_raw", "lo_raw", "net_raw", *keep)
    schema = T.StructType.fromDDL("symbol string, seq bigint, ts_ns bigint, side int, leg_start double, leg_peak double, price double" + _ddl(tape, keep))
    found = t.repartition("symbol").sortWithinPartitions("symbol", "seq").mapInArrow(_legs(cfg, keep, schema), schema)
    return found.withColumn("leg_bps", bps(F.col("leg_peak"), F.col("leg_start"))).withColumn("retrace_bps", bps(F.col("price"), F.col("leg_peak")))


def near_mid(cfg: Config, price: float, mid: float | None) -> bool:
    return mid is not None and abs((price - mid) / mid * 1e4) <= cfg.spoof_max_bps


class Typical:
    """Moving average of ordinary sizes."""

    def __init__(self) -> None:
        self.mean = 0.0
        self.samples = 0

    def add(self, cfg: Config, size: float, price: float, mid: float | None) -> bool:
        """Take in an added size; whether it is suspiciously large, in which case the average ignores it."""
        return self.take(cfg, size, near_mid(cfg, price, mid))

    def take(self, cfg: Config, size: float, near: bool) -> bool:
        if near and self.samples >= cfg.spoof_min_samples and size >= cfg.spoof_multiple * self.mean:
            return True
        self.mean = self.mean + EMA_ALPHA * (size - self.mean) if self.samples else size
        self.samples += 1
        return False


_PIECE = 2000  # rows of a stretch that travel as one

_SEEN = ("seq bigint", "ts_ns bigint", "pos int", "side int", "price_raw bigint", "new_raw bigint", "added boolean")


class Quotes:
    """A stretch's book, the times of its latest changes, and the rows that are not given away yet, with sizes and nearness of the adds."""

    def __init__(self) -> None:
        self.ladder, self.times, self.churn = book.Ladder(), deque(), None
        self.k, self.piece, self.rows, self.sizes, self.near = None, 0, [], [], []

    def changed(self, now: int, n: int, length: int) -> int:
        self.times.extend([now] * n)
        while self.times[0] < now - length:
            self.times.popleft()
        return len(self.times)

    def give(self) -> list[tuple]:
        if not self.rows:
            return []
        out = (self.k, self.piece, *map(list, zip(*self.rows, strict=True)), self.sizes, self.near, self.churn)
        self.piece, self.rows, self.sizes, self.near = self.piece + 1, [], [], []
        return [out]


def _pieces(cfg: Config, piece: int):
    def step(q: Quotes, row: tuple) -> list[tuple]:
        q.k, own, seq, ts, snapshot, bids, asks, *kept = row
        changed = q.ladder.apply(snapshot, book._pairs(bids, asks))
        if changed:
            churn = q.changed(ts, len(changed), cfg.stuff_window)
        if not own:
            return []
        if changed:
            q.churn, mid = churn, q.ladder.mid()
            for pos, side, price, old, new in changed:
                q.rows.append((seq, ts, pos, side, price, new, new > old, None, *kept))
                if new > old:
                    q.sizes.append(new / SCALE)
                    q.near.append(near_mid(cfg, price / SCALE, mid))
        # Before the first change of a stretch, only the stretches before it tell.
        if not snapshot and (q.churn is None or q.churn >= cfg.stuff_churn):
            q.rows.append((seq, ts, None, None, None, None, None, q.churn, *kept))
        return q.give() if len(q.rows) >= piece else []

    return step


class Entry:
    """What a symbol's rows so far leave for the next: the average of ordinary sizes, and the churn at the last change."""

    def __init__(self) -> None:
        self.typical, self.churn = Typical(), 0


def _entry(cfg: Config):
    def step(e: Entry, row: tuple) -> list[tuple]:
        k, piece, sizes, near, churn = row
        out = (k, piece, e.typical.mean, e.typical.samples, e.churn)
        take = e.typical.take
        for x in zip(sizes, near, strict=True):
            take(cfg, *x)
        e.churn = e.churn if churn is None else churn
        return [out]

    return step


def _seen(cfg: Config, schema: T.StructType):
    """Rows of pieces, each with the average after it, from what the rows before the piece leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        flat = [f.name for f in schema if f.name not in ("symbol", "flagged", "typical", "samples", "churn")]
        for b in batches:
            lengths = b.column("seq").value_lengths().to_numpy()
            piece = np.repeat(np.arange(b.num_rows), lengths)
            columns = {c: b.column(c).flatten() for c in flat} | {"symbol": b.column("symbol").take(pa.array(piece))}
            message = columns["added"].is_null().to_numpy(zero_copy_only=False)
            adds = columns["added"].fill_null(False).to_numpy(zero_copy_only=False)
            flagged, typical, samples = [], [], []  # as each piece begins, and after each of its adds
            for mean, count, sizes, near in zip(*(values(b.column(c)) for c in ("__mean", "__samples", "sizes", "near")), strict=True):
                t = Typical()
                t.mean, t.samples = mean, count
                flagged.append(False), typical.append(mean), samples.append(count)
                for x in zip(sizes, near, strict=True):
                    flagged.append(t.take(cfg, *x)), typical.append(t.mean), samples.append(t.samples)
            at = np.cumsum(adds) + piece
            churn = pc.coalesce(b.column("churn").flatten(), b.column("__churn").take(pa.array(piece))).to_numpy()
            columns |= {"flagged": pa.array(np.array(flagged, bool)[at] & adds, mask=message), "typical": pa.array(np.array(typical, float)[at], mask=message)}
            columns |= {"samples": pa.array(np.array(samples, np.int64)[at], mask=message), "churn": pa.array(churn, mask=~message)}
            out = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)
            yield out.filter(pa.array(~message | (churn >= cfg.stuff_churn)))

    return run


def quotes(tape: DataFrame, cfg: Config, *keep: str, stretch: int = STRETCH, piece: int = _PIECE) -> DataFrame:
    """What the rules on quotes need of a symbol's depth messages: the rows of ``size_flags``, and rows without a position, but with
    churn, for messages at which the window of the latest change holds enough changes for quote stuffing.

    Stretches are folded apart, each from its carried book, and give their rows in pieces. Only the average of ordinary sizes goes through
    a symbol's rows one after another: over the sizes that pieces hold, to what each piece begins with. Then pieces are settled apart.
    """
    ship(tape.sparkSession)
    d = book.by_stretch(tape.where("kind = 'depth'").select("seq", "ts_ns", "symbol", "kind", "is_snapshot", "bids", "asks", *keep), cfg.stuff_window, stretch)
    kinds = dict(tape.dtypes)
    lists = ", ".join(f"{c} array<{kind}>" for c, kind in [*(x.split() for x in _SEEN), ("churn", "bigint"), *((c, kinds[c]) for c in keep), ("sizes", "double"), ("near", "boolean")])
    pieces = fold(d, ["seq"], ["k", "own", "seq", "ts_ns", "is_snapshot", "bids", "asks", *keep], Quotes, _pieces(cfg, piece), f"k bigint, piece bigint, {lists}, last_churn bigint", by=("symbol", "k"), end=Quotes.give)
    at = ["symbol", "k", "piece"]
    dealt = pieces.repartition(*at)
    # Both read one shuffle: Arrow takes all columns of it.
    held = dealt.mapInArrow(_held, "symbol string, k bigint, piece bigint, sizes array<double>, near array<boolean>, last_churn bigint")
    entries = fold(held, ["k", "piece"], ["k", "piece", "sizes", "near", "last_churn"], Entry, _entry(cfg), "k bigint, piece bigint, __mean double, __samples bigint, __churn bigint")
    entries = entries.select(*[F.col(c).alias(f"__e{i}") for i, c in enumerate(at)], "__mean", "__samples", "__churn")
    both = dealt.join(entries, [F.col(c).eqNullSafe(F.col(f"__e{i}")) for i, c in enumerate(at)])
    schema = T.StructType.fromDDL(", ".join(["symbol string", *_SEEN, "flagged boolean, typical double, samples bigint, churn bigint"]) + _ddl(tape, keep))
    return both.mapInArrow(_seen(cfg, schema), schema)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["symbol", "k", "piece", "sizes", "near", "last_churn"])


def size_flags(tape: DataFrame, cfg: Config, seen: DataFrame | None = None) -> DataFrame:
    """Level changes with the average of ordinary sizes after each, and whether an add is suspiciously large near the mid."""
    return (quotes(tape, cfg) if seen is None else seen).where("pos IS NOT NULL").drop("churn")


def _traded(pulled: DataFrame, tape: DataFrame, within: int) -> DataFrame:
    """Pulls with what was traded at their price since their flag, which is at most ``within`` ago: the difference of two places of a
    running volume by symbol, price and stretch, so nothing is joined with all trades of a busy price."""
    zero = F.lit(0).cast("bigint")
    ends = F.explode(F.array(F.struct(F.col("flag_seq").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("seq").alias("at"), F.lit(1).alias("sign"))))
    points = pulled.select("symbol", "price_raw", F.struct(*pulled.columns).alias("pull"), idiv(F.col("ts_ns"), STRETCH).alias("k"), ends.alias("e")).select("symbol", "price_raw", "pull", "k", "e.at", "e.sign", zero.alias("q"))
    t = overlapping(trades(tape).select("symbol", "price_raw", "ts_ns", F.col("seq").alias("at"), F.col("qty_raw").alias("q")), within, name="k").drop("ts_ns", "own")
    upto = F.sum("q").over(W.partitionBy("symbol", "price_raw", "k").orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    both = points.unionByName(t, allowMissingColumns=True).withColumn("volume", upto).where("pull IS NOT NULL")
    both = both.groupBy("symbol", "price_raw", "pull.seq", "pull.pos", "pull.side").agg(F.first("pull").alias("pull"), F.sum(F.col("sign") * F.col("volume")).cast("bigint").alias("traded_raw"))
    return both.select("pull.*", "traded_raw")


def pulls(tape: DataFrame, cfg: Config, flags: DataFrame | None = None) -> DataFrame:
    """Flagged adds that were pulled in time and hardly traded, one row for each, at the change that pulls them."""
    flags = size_flags(tape, cfg) if flags is None else flags
    kept = [c for c in flags.columns if c == "ingest_ns"]
    flag = F.when(F.col("flagged"), F.struct("seq", "pos", "ts_ns", F.col("new_raw").alias("qty_raw")))
    r = recent(flags, ["symbol", "side", "price_raw"], ["seq", "pos"], flag, cfg.spoof_window, name="flag").where("NOT added AND flag IS NOT NULL")
    r = r.where(real(F.col("new_raw")) <= (1 - cfg.spoof_pull) * real(F.col("flag.qty_raw")))
    first = F.row_number().over(W.partitionBy("symbol", "side", "price_raw", "flag").orderBy("seq", "pos"))
    r = r.withColumn("k", first).where("k = 1").select("symbol", "seq", "ts_ns", "pos", "side", "price_raw", "typical", F.col("flag.seq").alias("flag_seq"), F.col("flag.ts_ns").alias("flag_ts"), F.col("flag.qty_raw").alias("flag_raw"), *kept)
    r = _traded(r, tape, cfg.spoof_window)
    return r.where(real(F.col("traded_raw")) <= cfg.spoof_max_traded * real(F.col("flag_raw"))).select(*[c for c in r.columns if c not in kept], *kept)


def spoofing(tape: DataFrame, cfg: Config, pulled: DataFrame | None = None) -> DataFrame:
    return cooldown(pulls(tape, cfg) if pulled is None else pulled, cfg.spoof_cooldown, ["seq", "pos"])


def layering(tape: DataFrame, cfg: Config, pulled: DataFrame | None = None) -> DataFrame:
    p = (pulls(tape, cfg) if pulled is None else pulled).select("symbol", "seq", "ts_ns", "pos", "side", "price_raw")
    p = sliding(p, cfg.layering_window, ["seq", "pos"], {"near": lambda w: F.collect_set(F.struct("side", "price_raw")).over(w)})
    p = p.withColumn("n_levels", F.size(F.filter("near", lambda x: x["side"] == F.col("side"))))
    return cooldown(p.where(F.col("n_levels") >= cfg.layering_levels).drop("near"), cfg.layering_cooldown, ["seq", "pos"])


def spoofing_and_layering(tape: DataFrame, cfg: Config, flags: DataFrame | None = None) -> DataFrame:
    """Both rules' alerts from one pass over the pulls, each with its own cooldown."""
    p = sliding(pulls(tape, cfg, flags), cfg.layering_window, ["seq", "pos"], {"near": lambda w: F.collect_set(F.struct("side", "price_raw")).over(w)})
    p = p.withColumn("n_levels", F.size(F.filter("near", lambda x: x["side"] == F.col("side"))))
    read = ["seq", "ts_ns", "pos", "side", "price_raw", "typical", "flag_ts", "flag_raw", "traded_raw", *[c for c in (flags.columns if flags is not None else ()) if c == "ingest_ns"], "n_levels"]
    ready = F.when(F.col("n_levels") >= cfg.layering_levels, F.array(F.lit("spoofing"), F.lit("layering"))).otherwise(F.array(F.lit("spoofing")))
    p = p.select("symbol", F.explode(ready).alias("detector"), *read)
    wait = F.when(F.col("detector") == "spoofing", cfg.spoof_cooldown).otherwise(cfg.layering_cooldown)
    return cooldown(p, wait, ["seq", "pos"], keys=("symbol", "detector"))


class Rule(NamedTuple):
    """A rule of one's own: ``find(tape, cfg)`` gives seq, ts_ns, symbol, score and evidence (JSON)."""

    find: Callable[[DataFrame, Config], DataFrame]
    severity: int
    description: str


def alerts(tape: DataFrame, cfg: Config, latency: bool = True, only: Collection[str] = RULES, extra: Mapping[str, Rule] | None = None, ordered: bool = True) -> DataFrame:
    """Alerts of the rules ``only`` and ``extra`` in the order of events, rules and changes, numbered over all symbols.

    id, n, seq, ts_ns, detector, symbol, severity, severity_label, score, description, detect_latency_us, evidence (JSON).
    Nothing runs until the result is asked for. The pass over depth messages that three rules read, and the alerts without their numbers,
    are kept on disk from their first use (``spark.catalog.clearCache`` lets them go); what is lost is made again. Without ``ordered``
    there is no id and no n, and only columns that are asked for are made: for counts.
    """
    # Scores and evidence of what a pass by symbol finds are made elsewhere, not in the few tasks of that pass.
    spread = lambda d: d.repartition("symbol", "seq") if ordered else d
    shown = lambda d: _shown(d, cfg)[0]
    told = lambda d: F.to_json(F.struct(*_shown(d, cfg)[1]))
    # A spoof and the layering that it completes belong to one change; other rules follow in their order.
    spoof = F.col("detector") == "spoofing"
    nought = F.lit(0)
    keep = ("ingest_ns",) if latency else ()
    parts = []
    seen = quotes(tape, cfg, *keep) if {"spoofing", "layering", "quote_stuffing"} & set(only) else None
    if seen is not None and "quote_stuffing" in only and {"spoofing", "layering"} & set(only):
        seen = seen.persist(StorageLevel.DISK_ONLY)
    if {"spoofing", "layering"} & set(only):
        parts.append(spread(spoofing_and_layering(tape, cfg, size_flags(tape, cfg, seen)).where(F.col("detector").isin(*only))).select(
            "seq", "ts_ns", "symbol", "detector", nought.alias("rule"), "pos", (~spoof).cast("int").alias("last"),
            F.when(spoof, shown("spoofing")).otherwise(shown("layering")).alias("score"), F.when(spoof, told("spoofing")).otherwise(told("layering")).alias("evidence"), *keep,
        ))
    for detector, find in (("momentum_ignition", momentum_ignition), ("quote_stuffing", lambda t, c, *k: quote_stuffing(t, c, *k, seen=seen)), ("wash_trade", wash_trades)):
        if detector in only:
            parts.append((find(tape, cfg, *keep) if detector == "wash_trade" else spread(find(tape, cfg, *keep))).select("seq", "ts_ns", "symbol", F.lit(detector).alias("detector"), F.lit(RULES.index(detector)).alias("rule"), nought.alias("pos"), nought.alias("last"), shown(detector).alias("score"), told(detector).alias("evidence"), *keep))
    extra = dict(extra or {})
    for k, (detector, rule) in enumerate(extra.items()):
        found = rule.find(tape, cfg).select("seq", "ts_ns", "symbol", F.lit(detector).alias("detector"), F.lit(len(RULES) + k).alias("rule"), nought.alias("pos"), nought.alias("last"), "score", "evidence")
        parts.append(found.join(tape.select("symbol", "seq", *keep), ["symbol", "seq"]).select(*found.columns, *keep) if keep else found)
    out = reduce(DataFrame.unionByName, parts)
    if ordered:  # counted by stretches, then numbered
        out = numbered(out.persist(StorageLevel.DISK_ONLY), ["seq", "rule", "pos", "last"], idiv(F.col("seq"), _NUMBERED))
    if latency:
        out = out.withColumn("detect_latency_us", F.greatest(F.lit(0), idiv(F.col("ts_ns") - F.col("ingest_ns"), 1000)))
    severity = F.create_map(*[F.lit(x) for k, v in (SEVERITY | {k: r.severity for k, r in extra.items()}).items() for x in (k, v)])[F.col("detector")]
    label = F.create_map(*[F.lit(x) for k, v in SEVERITIES.items() for x in (k, v)])[severity]
    text = F.create_map(*[F.lit(x) for k, v in (DESCRIPTIONS | {k: r.description for k, r in extra.items()}).items() for x in (k, v)])[F.col("detector")]
    wanted = ["detect_latency_us"] if latency else []
    told_by = [F.concat_ws("-", "symbol", "detector", F.col("n").cast("string")).alias("id"), "n"] if ordered else []
    return out.select(*told_by, "seq", "ts_ns", "detector", "symbol", severity.alias("severity"), label.alias("severity_label"), "score", text.alias("description"), *wanted, "evidence")


def _shown(detector: str, cfg: Config) -> tuple[Column, list[Column]]:
    """Score and evidence of a rule's rows."""
    c = F.col
    if detector == "spoofing":
        size = real(c("flag_raw"))
        return clamp01(size / (cfg.spoof_multiple * c("typical")) / 3), [
            side_name(c("side")).alias("side"), render(c("price_raw")).alias("price"), render(c("flag_raw")).alias("flagged_qty"), round4(c("typical")).alias("typical_qty"),
            round4(size / c("typical")).alias("size_multiple"), round4((c("ts_ns") - c("flag_ts")) / 1e6).alias("lifetime_ms"), render(c("traded_raw")).alias("traded_qty"),
        ]
    if detector == "layering":
        return clamp01(c("n_levels") / float(cfg.layering_levels) / 2), [side_name(c("side")).alias("side"), c("n_levels").alias("levels_pulled"), F.lit(cfg.layering_window / MS).alias("window_ms")]
    if detector == "momentum_ignition":
        return clamp01(F.abs(c("leg_bps")) / (2 * cfg.ignite_bps)), [
            side_name(c("side")).alias("direction"), round4(c("leg_bps")).alias("leg_bps"), round4(c("retrace_bps")).alias("retrace_bps"),
            round4(c("leg_start")).alias("leg_start"), round4(c("leg_peak")).alias("leg_peak"), round4(c("price")).alias("reverse_price"),
        ]
    if detector == "quote_stuffing":
        return clamp01(c("churn") / float(2 * cfg.stuff_churn)), [c("churn").alias("updates_in_window"), c("n_trades").alias("trades_in_window"), F.lit(cfg.stuff_window / MS).alias("window_ms")]
    return clamp01(c("balance")), [c("n").alias("trades"), round4(c("band_bps")).alias("band_bps"), round4(c("volume")).alias("volume"), round4(c("balance")).alias("side_balance"), F.lit(WASH_NOTE).alias("note")]
