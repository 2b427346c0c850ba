"""The same rules on a stream: keyed state a symbol, fed with micro-batches of a tape in order.

State is what the rules must remember and no more: the ladder, the windows' rows, the average size, flags, the watched leg and the
cooldowns. The step is plain Python, so tests can also run it over a list and hold the batch plans against it. Between batches the
state lies in keyed variables (``Keeper``), of which a batch writes only those that it touches.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.operators.audit import MARK
from tidewatch.operators.book import Ladder, _pairs
from tidewatch.operators.rules import WASH_NOTE, Leg, Typical, near_mid
from tidewatch.shipping import by_value, ship
from tidewatch.streaming.ladder import BucketLadder, Store
from tidewatch.streaming.metrics import observed
from tidewatch.types import BUY, MS, SCALE, SEC, SELL, SEVERITIES, SEVERITY, SIDES, Config

OUT = "symbol string, seq bigint, ts_ns bigint, kind string, detector string, severity int, severity_label string, score double, detect_latency_us bigint, body string"


def _text(raw: int) -> str:
    """Shortest decimal string of a count of 1e-8."""
    whole, part = divmod(abs(raw), SCALE)
    return f"{'-' * (raw < 0)}{whole}{f'.{part:08d}'.rstrip('0').rstrip('.')}"


def _round4(x: float) -> float:
    return math.copysign(math.floor(abs(x) * 1e4 + 0.5) / 1e4, x) if math.isfinite(x) else 0.0


def _packed(levels: str) -> Column:
    """Levels as text: structs in lists cost a worker many times what the rules do with them."""
    return F.array_join(F.transform(levels, lambda x: F.concat(x["p"].cast("string"), F.lit(","), x["q"].cast("string"))), ";")


def _unpacked(levels) -> list[tuple[int, int]]:
    if not levels:
        return []
    if isinstance(levels, str):
        return [(int(p), int(q)) for p, _, q in (x.partition(",") for x in levels.split(";"))]
    return [(x["p"], x["q"]) for x in levels]


_BLOCK = 50_000  # rows of a task that are packed at once
_SLICE = 10_000  # rows of a symbol that are Python's objects at once


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a symbol, in order, as one value in Arrow's format. Row by row the way to a keyed state costs more than the rules do."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t, [("symbol", "ascending"), ("seq", "ascending")]))
        runs = pc.run_end_encode(t.column("symbol").combine_chunks())
        rest, at, out = t.drop_columns("symbol"), 0, []
        for to in runs.run_ends.to_pylist():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest.slice(at, to - at))
            out.append(sink.getvalue().to_pybytes())
            at = to
        return pa.RecordBatch.from_arrays([runs.values, pa.array(out, pa.binary())], ["symbol", "rows"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _BLOCK:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _in_order(blocks: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of a symbol and one micro-batch by seq, some at a time."""
    seqs = lambda t: t.column("seq").fill_null((1 << 63) - 1).to_numpy()
    given = pa.concat_tables(sorted((pa.ipc.open_stream(pa.py_buffer(x)).read_all() for x in blocks), key=lambda t: seqs(t)[0]))
    seq = seqs(given)
    if (seq[1:] < seq[:-1]).any():  # blocks of one file have ranges of their own, but those of several may overlap
        given = given.take(pc.sort_indices(given, [("seq", "ascending")]))
    for at in range(0, given.num_rows, _SLICE):
        yield from given.slice(at, _SLICE).combine_chunks().to_batches()


def _objects(b: pa.RecordBatch) -> Iterator[tuple]:
    """What ``SymbolState.take`` takes of each row, by way of NumPy, which would make inexact floats of numbers beside nulls. A null that
    it does not look at is nought."""
    trade = pc.equal(b.column("kind"), "trade").fill_null(False)
    for c in ("side", "price_raw", "qty_raw"):
        if b.column(c).filter(trade).null_count:
            raise ValueError(f"a trade without {c}")
    of = lambda c: c.to_numpy(zero_copy_only=False).tolist()
    numbers = [of(b.column(c).fill_null(0)) for c in ("side", "price_raw", "qty_raw")]
    times = [[math.nan if x is None else x for x in c.to_pylist()] if c.null_count else of(c) for c in map(b.column, ("seq", "ts_ns", "ingest_ns"))]
    return zip(*times, of(trade), of(b.column("is_snapshot").fill_null(False)), *numbers, of(b.column("bids")), of(b.column("asks")), strict=True)


class Recent:
    """Rows of the last ``length`` nanoseconds."""

    def __init__(self, length: int) -> None:
        self.length, self.rows = length, deque()

    def add(self, now: int, row=None) -> None:
        rows, first = self.rows, now - self.length
        rows.append((now, row))
        while rows[0][0] < first:
            rows.popleft()

    def drop(self, now: int) -> None:
        while self.rows and self.rows[0][0] < now - self.length:
            self.rows.popleft()

    def __iter__(self):
        return (row for _, row in self.rows)

    def __len__(self) -> int:
        return len(self.rows)


class Traded(Recent):
    """Recent trades (side, price, size), with the sums of their sizes."""

    def __init__(self, length: int) -> None:
        super().__init__(length)
        self.sums = [0, 0]

    def add(self, now: int, row=None) -> None:
        self.rows.append((now, row))
        self.sums[row[0]] += row[2]
        self.drop(now)

    def drop(self, now: int) -> None:
        rows, first = self.rows, now - self.length
        while rows and rows[0][0] < first:
            side, _, qty = rows.popleft()[1]
            self.sums[side] -= qty


class StreamRule:
    """A rule of one's own on a stream. ``start`` gives its state for a symbol, something that JSON can hold; the others may change it
    in place and return (score, evidence) of alerts. ``view`` is the symbol's state after the event: its book and windows.

    Own rules see an event after the built-in ones, in their order.
    """

    name = "rule"
    severity = 1

    def start(self) -> dict:
        return {}

    def on_trade(self, state: dict, view: SymbolState, ts: int, side: int, price: int, qty: int) -> list[tuple[float, dict]]:
        return []

    def on_depth(self, state: dict, view: SymbolState, ts: int, snapshot: bool, changes: list[tuple[int, int, int, int, int]]) -> list[tuple[float, dict]]:
        return []


class SymbolState:
    """Everything known of one symbol. ``trade`` and ``depth`` return (detector, score, evidence) of alerts, in order.

    ``log`` gathers what the windows took in, for whoever keeps the state.
    """

    def __init__(self, cfg: Config, rules: Sequence[StreamRule] = (), book: Ladder | BucketLadder | None = None) -> None:
        self.cfg, self.book, self.typical, self.leg = cfg, Ladder() if book is None else book, Typical(), Leg()
        self.rules, self.own = rules, {r.name: r.start() for r in rules}
        self.severity = SEVERITY | {r.name: r.severity for r in rules}
        self.log: dict[str, list[tuple[int, int, int, int]]] = {"trades": [], "changes": [], "pulls": []}
        self.pending: dict[tuple[int, int], list[int]] = {}  # (side, price) -> [size, time, traded]
        self.pulls, self.ignite, self.wash = Recent(cfg.layering_window), Traded(cfg.ignite_window), Traded(cfg.wash_window)
        self.churn, self.quiet = Recent(cfg.stuff_window), Recent(cfg.stuff_window)
        self.flow, self.changes = Recent(cfg.feature_window), Recent(cfg.feature_window)
        self.fired: dict[str, int] = {}
        self.events = 0

    def _free(self, rule: str, now: int, wait: int) -> bool:
        if now - self.fired.get(rule, 0) < wait:
            return False
        self.fired[rule] = now
        return True

    def saw_trade(self, now: int, side: int, price: int, qty: int) -> None:
        """Into the windows."""
        row = (side, price, qty)
        self.ignite.add(now, row)
        self.wash.add(now, row)
        self.quiet.add(now)
        self.flow.add(now, qty if side == BUY else -qty)

    def saw_changes(self, now: int, removed: int, n: int) -> None:
        for _ in range(n):
            self.churn.add(now)
            self.changes.add(now, bool(removed))

    def core(self) -> dict:
        """The part of fixed size."""
        return {"typical": [self.typical.mean, self.typical.samples], "leg": [self.leg.side, self.leg.start, self.leg.peak, self.leg.since], "fired": self.fired, "events": self.events}

    def restore(self, core: dict) -> None:
        (self.typical.mean, self.typical.samples), self.fired, self.events = core["typical"], core["fired"], core["events"]
        self.leg.side, self.leg.start, self.leg.peak, self.leg.since = core["leg"]

    def trade(self, now: int, side: int, price: int, qty: int) -> list[tuple[str, float, dict]]:
        cfg, out = self.cfg, []
        if self.pending:
            for s in (BUY, SELL):
                if (s, price) in self.pending:
                    self.pending[s, price][2] += qty
        self.saw_trade(now, side, price, qty)
        self.log["trades"].append((now, side, price, qty))
        # A leg's beginning needs the volume, and only that looks at the window.
        found = None
        net = (self.ignite.sums[BUY] - self.ignite.sums[SELL]) / SCALE
        if self.leg.side is not None:
            found = self.leg.trade(cfg, now, price / SCALE, 0.0, 0.0, 0.0, net)
        elif abs(net) >= cfg.ignite_volume:
            prices = [p / SCALE for _, p, _ in self.ignite]
            self.leg.trade(cfg, now, price / SCALE, prices[0], max(prices), min(prices), net)
        if found:
            leg_bps = (found[2] - found[1]) / found[1] * 1e4
            retrace = (price / SCALE - found[2]) / found[2] * 1e4 if found[2] else 0.0
            told = {"direction": SIDES[found[0]], "leg_bps": _round4(leg_bps), "retrace_bps": _round4(retrace), "leg_start": _round4(found[1]), "leg_peak": _round4(found[2]), "reverse_price": _round4(price / SCALE)}
            out.append(("momentum_ignition", min(1.0, abs(leg_bps) / (2 * cfg.ignite_bps)), told))
        if len(self.wash.rows) >= cfg.wash_min_trades and now - self.fired.get("wash_trade", 0) >= cfg.wash_cooldown:
            buys, sells = self.wash.sums
            volume = (buys + sells) / SCALE
            balance = min(buys, sells) / SCALE / volume if volume > 0 else 0.0
            if balance >= cfg.wash_balance and volume >= cfg.wash_min_volume:
                prices = [p for _, p, _ in self.wash]
                hi, lo = max(prices) / SCALE, min(prices) / SCALE
                band = (hi - lo) / ((hi + lo) / 2) * 1e4 if hi + lo else None
                if band is not None and band <= cfg.wash_band_bps:
                    self.fired["wash_trade"] = now
                    out.append(("wash_trade", min(1.0, balance), {"trades": len(prices), "band_bps": _round4(band), "volume": _round4(volume), "side_balance": _round4(balance), "note": WASH_NOTE}))
        for rule in self.rules:
            out += [(rule.name, *x) for x in rule.on_trade(self.own[rule.name], self, now, side, price, qty)]
        return out

    def depth(self, now: int, snapshot: bool, changes: list[tuple[int, int, int]]) -> list[tuple[str, float, dict]]:
        cfg, out = self.cfg, []
        deltas = self.book.apply(snapshot, changes)
        if not snapshot:
            for p in self.pending.values():
                if now - p[1] > cfg.spoof_window:
                    self.pending = {k: v for k, v in self.pending.items() if now - v[1] <= cfg.spoof_window}
                    break
            if deltas:
                mid, added = None, 0
                for _, side, price, old, new in deltas:
                    if new > old:
                        if not added:
                            mid = self.book.mid()
                        added += 1
                        if self.typical.take(cfg, new / SCALE, near_mid(cfg, price / SCALE, mid)):
                            self.pending[side, price] = [new, now, 0]
                    elif (side, price) in self.pending:
                        out += self._pulled(now, side, price, new)
                for removed, n in ((0, added), (1, len(deltas) - added)):
                    if n:
                        self.saw_changes(now, removed, n)
                        self.log["changes"].append((now, removed, n, 0))
            self.quiet.drop(now)
            if len(self.churn.rows) >= cfg.stuff_churn and len(self.quiet.rows) <= cfg.stuff_max_trades and self._free("quote_stuffing", now, cfg.stuff_cooldown):
                out.append(("quote_stuffing", min(1.0, len(self.churn) / (2 * cfg.stuff_churn)), {"updates_in_window": len(self.churn), "trades_in_window": len(self.quiet), "window_ms": cfg.stuff_window / MS}))
        for rule in self.rules:
            out += [(rule.name, *x) for x in rule.on_depth(self.own[rule.name], self, now, snapshot, deltas)]
        return out

    def _pulled(self, now: int, side: int, price: int, new: int) -> list[tuple[str, float, dict]]:
        cfg, p = self.cfg, self.pending[side, price]
        if new / SCALE > (1 - cfg.spoof_pull) * (p[0] / SCALE):
            return []
        del self.pending[side, price]
        if p[2] / SCALE > cfg.spoof_max_traded * (p[0] / SCALE):
            return []
        out = []
        self.pulls.add(now, (side, price))
        self.log["pulls"].append((now, side, price, 0))
        if self._free("spoofing", now, cfg.spoof_cooldown):
            size, typical = p[0] / SCALE, self.typical.mean
            told = {"side": SIDES[side], "price": _text(price), "flagged_qty": _text(p[0]), "typical_qty": _round4(typical), "size_multiple": _round4(size / typical), "lifetime_ms": _round4((now - p[1]) / 1e6), "traded_qty": _text(p[2])}
            out.append(("spoofing", min(1.0, size / (cfg.spoof_multiple * typical) / 3), told))
        n = len({x for s, x in self.pulls if s == side})
        if n >= cfg.layering_levels and self._free("layering", now, cfg.layering_cooldown):
            out.append(("layering", min(1.0, n / cfg.layering_levels / 2), {"side": SIDES[side], "levels_pulled": n, "window_ms": cfg.layering_window / MS}))
        return out

    def vector(self, now: int) -> dict[str, float] | None:
        """Features of now."""
        mid = self.book.mid()
        if not mid:
            return None
        bids, asks = self.book.top(BUY, self.cfg.feature_levels), self.book.top(SELL, self.cfg.feature_levels)
        (bid, bq), (ask, aq) = ((p / SCALE, q / SCALE) for p, q in (bids[0], asks[0]))
        b, a = sum(q for _, q in bids) / SCALE, sum(q for _, q in asks) / SCALE
        micro = (bid * aq + ask * bq) / (bq + aq) if bq + aq else mid
        self.flow.drop(now)
        self.changes.drop(now)
        return {
            "spread_bps": (asks[0][0] - bids[0][0]) / SCALE / mid * 1e4, "ofi": (b - a) / (b + a) if b + a > 0 else 0.0, "microprice_dev_bps": (micro - mid) / mid * 1e4,
            "trade_intensity": len(self.flow) / (self.cfg.feature_window / SEC), "signed_vol": sum(self.flow) / SCALE, "cancel_ratio": sum(self.changes) / len(self.changes) if self.changes else 0.0,
            "bid_depth": float(self.book.depth(BUY)), "ask_depth": float(self.book.depth(SELL)),
        }

    def event(self, row) -> list[tuple]:
        """Output rows (without the symbol) of a tape row."""
        return self.take(row.seq, row.ts_ns, row.ingest_ns, row.kind == "trade", row.is_snapshot, row.side, row.price_raw, row.qty_raw, row.bids, row.asks)

    def take(self, seq: int, now: int, ingest: int, trade: bool, snapshot: bool | None, side: int | None, price: int | None, qty: int | None, bids, asks) -> list[tuple]:
        """``event`` of a row taken apart."""
        if trade:
            found = self.trade(now, int(side), int(price), int(qty))
        else:
            found = self.depth(now, bool(snapshot), _pairs(_unpacked(bids), _unpacked(asks)))
        out = []
        if found:
            late = max(0, (now - int(ingest)) // 1000)
            out = [(seq, now, "alert", d, severity := self.severity[d], SEVERITIES[severity], max(0.0, s), late, json.dumps(e)) for d, s, e in found]
        self.events += 1
        if self.events % self.cfg.feature_every == 0 and (v := self.vector(now)) is not None:
            out.append((seq, now, "features", None, None, None, None, None, json.dumps(v)))
        return out


SLOT = 1 * SEC  # rows of a window are kept together by time


class Keeper:
    """One symbol's state in stores (maps of keyed variables), of which ``save`` writes only what a batch has changed.

    levels (side, bucket) -> levels; index (side) -> buckets; recent (kind, slot) -> rows of windows; pending (side, price) -> (size,
    time, traded); own (rule) -> JSON; core () -> JSON of the rest, which has a fixed size.
    """

    def __init__(self, stores: dict[str, Store], cfg: Config, rules: Sequence[StreamRule] = ()) -> None:
        self.stores, self.cfg, self.rules = stores, cfg, rules
        self.reach = {"trades": max(cfg.ignite_window, cfg.wash_window, cfg.stuff_window, cfg.feature_window), "changes": max(cfg.stuff_window, cfg.feature_window), "pulls": cfg.layering_window}

    def load(self) -> SymbolState:
        at = self.stores
        core = at["core"].get(())
        core = json.loads(core[0]) if core else None
        state = SymbolState(self.cfg, self.rules, BucketLadder(at["levels"], at["index"], core and core["book"]))
        self.slots: dict[tuple[str, int], list[tuple]] = {}
        self.stored: set[tuple[str, int]] = set()
        self.touched: set[tuple[str, int]] = set()
        self.was_pending: dict[tuple, tuple] = {}
        self.was_own: dict[str, str] = {}
        if core is None:
            return state
        state.restore(core)
        self.slots = {tuple(k): list(map(tuple, v[0])) for k, v in at["recent"].items()}
        self.stored = set(self.slots)
        for (kind, _), rows in sorted(self.slots.items()):
            for row in rows:
                if kind == "trades":
                    state.saw_trade(*row)
                elif kind == "changes":
                    state.saw_changes(*row[:3])
                else:
                    state.pulls.add(row[0], row[1:3])
        self.was_pending = {tuple(k): tuple(v) for k, v in at["pending"].items()}
        state.pending = {k: list(v) for k, v in self.was_pending.items()}
        for rule in self.rules:
            if (kept := at["own"].get((rule.name,))) is not None:
                self.was_own[rule.name] = kept[0]
                state.own[rule.name] = json.loads(kept[0])
        return state

    def gather(self, state: SymbolState) -> None:
        """Keep of the log what windows can still reach; between saves as well, so that it does not grow with the batch."""
        for kind, rows in state.log.items():
            if not rows:
                continue
            first = (rows[-1][0] - self.reach[kind]) // SLOT
            for row in rows:
                if (slot := row[0] // SLOT) >= first:
                    self.slots.setdefault((kind, slot), []).append(row)
                    self.touched.add((kind, slot))
            for key in [k for k in self.slots if k[0] == kind and k[1] < first]:
                del self.slots[key]
            rows.clear()

    def save(self, state: SymbolState) -> None:
        at = self.stores
        state.book.flush()
        at["core"].put((), (json.dumps(state.core() | {"book": state.book.head()}),))
        self.gather(state)
        for key in self.stored - self.slots.keys():
            at["recent"].remove(key)
        for key in self.touched & self.slots.keys():
            at["recent"].put(key, (self.slots[key],))
        self.stored, self.touched = set(self.slots), set()
        for key, p in state.pending.items():
            if self.was_pending.get(key) != tuple(p):
                at["pending"].put(key, tuple(p))
        for key in self.was_pending.keys() - state.pending.keys():
            at["pending"].remove(key)
        self.was_pending = {k: tuple(v) for k, v in state.pending.items()}
        for name, own in state.own.items():
            if self.was_own.get(name) != (text := json.dumps(own)):
                at["own"].put((name,), (text,))
                self.was_own[name] = text


class _Map:
    """A store over a map of keyed variables."""

    def __init__(self, state) -> None:
        self.state = state

    def get(self, key: tuple) -> tuple | None:
        return self.state.getValue(key) if self.state.containsKey(key) else None

    def put(self, key: tuple, value: tuple) -> None:
        self.state.updateValue(key, value)

    def remove(self, key: tuple) -> None:
        self.state.removeKey(key)

    def items(self) -> list[tuple[tuple, tuple]]:
        return list(self.state.iterator())

    def clear(self) -> None:
        self.state.clear()


class _Value:
    """A store of one value."""

    def __init__(self, state) -> None:
        self.state = state

    def get(self, key: tuple) -> tuple | None:
        return self.state.get() if self.state.exists() else None

    def put(self, key: tuple, value: tuple) -> None:
        self.state.update(value)


class _Detector(StatefulProcessor):
    def __init__(self, cfg: Config, rules: Sequence[StreamRule]) -> None:
        self.cfg, self.rules = cfg, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        rows = "rows array<struct<{}>>".format
        self.keeper = Keeper({
            "core": _Value(handle.getValueState("core", "body string")),
            "levels": _Map(handle.getMapState("levels", "side int, bucket bigint", rows("p:bigint,q:bigint"))),
            "index": _Map(handle.getMapState("index", "side int", "buckets array<bigint>")),
            "recent": _Map(handle.getMapState("recent", "kind string, slot bigint", rows("ts:bigint,a:bigint,b:bigint,c:bigint"))),
            "pending": _Map(handle.getMapState("pending", "side int, price bigint", "size bigint, ts bigint, traded bigint")),
            "own": _Map(handle.getMapState("own", "rule string", "body string")),
        }, self.cfg, self.rules)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, out = self.keeper.load(), []
        frame = lambda: pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        for b in _in_order(x for part in rows for x in part["rows"]):
            if len(out) >= _SLICE:
                yield frame()
                out = []
            for row in _objects(b):
                for x in known.take(*row):
                    out.append((key[0], *x))
            self.keeper.gather(known)
        self.keeper.save(known)
        yield frame()

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def detect(tape: DataFrame, cfg: Config | None = None, rules: Sequence[StreamRule] = ()) -> DataFrame:
    """Alerts and feature vectors of a streaming tape. Order within a symbol is by seq inside each micro-batch; files must come in order.

    Keyed variables need RocksDB, which the session is told to use unless it names a store already.
    """
    spark = ship(tape.sparkSession)
    if "HDFSBacked" in (spark.conf.get(_PROVIDER, None) or "HDFSBacked"):
        spark.conf.set(_PROVIDER, _ROCKS)
    read = tape.select("symbol", "seq", "ts_ns", "ingest_ns", "kind", "is_snapshot", "side", "price_raw", "qty_raw", _packed("bids").alias("bids"), _packed("asks").alias("asks"))
    with by_value():
        return read.mapInArrow(_blocks, "symbol string, rows binary").groupBy("symbol").transformWithStateInPandas(_Detector(cfg or Config(), rules), OUT, "append", "none")


def watermarked(tape: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Extension: an event-time column with a watermark, for windowed totals that drop late rows."""
    return tape.withColumn("event_time", F.timestamp_micros(F.floor(F.col("ingest_ns") / 1000))).withWatermark("event_time", delay)


def volume_by_window(tape: DataFrame, delay: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Extension: traded volume by symbol and tumbling window."""
    t = watermarked(tape, delay).where("kind = 'trade'")
    return t.groupBy("symbol", F.window("event_time", width)).agg(F.sum("qty_raw").alias("qty_raw"), F.count(F.lit(1)).alias("n"))


def sink(append: Callable[[list[str], int], list[dict] | None] | None, alerts_path: str, features_path: str, checkpoints_path: str | None = None, observe: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: alerts first go to the audit trail, then to their table; a batch that comes again replaces itself.

    ``append(payloads, batch_id)`` must ignore a batch that it has seen, as ``audit.Trail.append_batch`` does; the checkpoints that it
    returns go to a table of their own in the same batch. ``observe(features, batch_id)`` comes last, as ``models.Scorer.observe`` does.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        alerts = batch.where("kind = 'alert'").drop("kind")
        if append is not None:
            marks = append([r.payload for r in alerts.orderBy("seq").select(F.to_json(F.struct("*")).alias("payload")).toLocalIterator()], batch_id)
            if checkpoints_path is not None and marks:
                batch.sparkSession.createDataFrame([tuple(m[c.split()[0]] for c in MARK.split(", ")) for m in marks], MARK).coalesce(1).write.mode("overwrite").parquet(f"{checkpoints_path}/batch={batch_id}")
        alerts.write.mode("overwrite").parquet(f"{alerts_path}/batch={batch_id}")
        features = batch.where("kind = 'features'").select("symbol", "seq", "ts_ns", "body")
        features.write.mode("overwrite").parquet(f"{features_path}/batch={batch_id}")
        if observe is not None:
            observe(features, batch_id)
        batch.unpersist()

    return write


_STORES = 4  # for each core


@contextmanager
def _stores(spark: SparkSession) -> Iterator[None]:
    """Queries that start meanwhile keep their state in some stores a core: each is opened and written by every batch, with rows or without."""
    key = "spark.sql.shuffle.partitions"
    given = spark.conf.get(key)
    spark.conf.set(key, str(min(int(given), _STORES * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, given)


def start(tape: DataFrame, checkpoint: str, alerts_path: str, features_path: str, cfg: Config | None = None, append=None, rules: Sequence[StreamRule] = (), checkpoints_path: str | None = None, observe=None) -> StreamingQuery:
    """Run over what there is. Counts of each batch travel with its progress (``metrics.Metrics``)."""
    out = observed(detect(tape, cfg, rules), tuple(r.name for r in rules)).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    with _stores(tape.sparkSession):
        return out.foreachBatch(sink(append, alerts_path, features_path, checkpoints_path, observe)).trigger(availableNow=True).start()
