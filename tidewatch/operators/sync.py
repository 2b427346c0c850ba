"""Sequence checks that keep a book whole: buffering until a snapshot, gaps, stale repeats, checksums."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.fold import fold
from tidewatch.operators.scan import running
from tidewatch.types import BUY

#: Fixed values.
BUFFER = 4096
CHECKSUM_LEVELS = 25


class Held:
    """Diffs that wait, oldest first; a value: adding one gives another. They share one list, so adding takes the same time however
    many wait."""

    __slots__ = ("items", "first", "end")

    def __init__(self, items: list | None = None, first: int = 0, end: int = 0) -> None:
        self.items, self.first, self.end = [] if items is None else items, first, end

    def add(self, diff: tuple[int, int, Any], limit: int) -> tuple[Held, int]:
        """With one more, and how many of the oldest were dropped for it."""
        items, first, end = self.items, self.first, self.end
        if end != len(items) or first > 2 * max(limit, 16):  # another value has gone on from here, or most of the list is dropped
            items, first, end = items[first:end], 0, end - first
        items.append(diff)
        over = max(0, end + 1 - first - max(1, limit))
        return Held(items, first + over, end + 1), over

    def __iter__(self):
        return iter(self.items[self.first : self.end])

    def __len__(self) -> int:
        return self.end - self.first


class Feed(NamedTuple):
    """What is known of one book's sequence. ``at``: id up to which messages were released, none while a snapshot is awaited;
    ``joined``: a diff was released since the snapshot; ``held``: (first id, final id, item) that await it."""

    at: int | None = None
    joined: bool = False
    held: Held = Held()
    resyncs: int = 0
    dropped: int = 0


def _release(feed: Feed, diffs: Iterable[tuple[int, int, Any]]) -> tuple[Feed, list, tuple | None]:
    """Let diffs through in order: (feed, items, the diff that leaves a hole and ends it, if any). Those that end before ``at`` are old
    news; the one that joins a snapshot may overlap it, all others must follow on."""
    out = []
    for first, final, item in diffs:
        if final <= feed.at:
            continue
        if first > feed.at + 1 or (feed.joined and first <= feed.at):
            return feed._replace(at=None, joined=False, held=Held(), resyncs=feed.resyncs + 1), out, (first, final, item)
        feed = feed._replace(at=final, joined=True)
        out.append(item)
    return feed, out, None


def _hold(feed: Feed, diff: tuple[int, int, Any], limit: int) -> Feed:
    held, over = feed.held.add(diff, limit)
    return feed._replace(held=held, dropped=feed.dropped + over)


def advance(feed: Feed, snapshot: bool, first: int | None, final: int, item: Any = None, limit: int = BUFFER) -> tuple[Feed, str, list]:
    """The feed after a message, what came of it, and the items to pass on.

    Snapshots are synced, or asked for again if the diffs that were held leave a hole behind them. Diffs are buffered while a snapshot
    is awaited, else applied, stale, or a gap, after which they are the first to be held.
    """
    if snapshot:
        after, out, hole = _release(feed._replace(at=final, joined=False, held=Held()), feed.held)
        return after, "again" if hole else "synced", [] if hole else [item, *out]
    if feed.at is None:
        return _hold(feed, (first, final, item), limit), "buffered", []
    after, out, hole = _release(feed, [(first, final, item)])
    if hole:
        return _hold(after, hole, limit), "gap", []
    return after, "apply" if out else "stale", out


def _synced(box: list[Feed], row: tuple) -> list[tuple]:
    seq, snapshot, first, final = row
    box[0], what, out = advance(box[0], snapshot, first, final, seq)
    return [(seq, what, [x for x in out if x is not None], box[0].resyncs, box[0].dropped)]


def synced(tape: DataFrame) -> DataFrame:
    """Every depth message with its outcome, the messages (by seq) that it lets pass in order, and the counters so far."""
    d = tape.where("kind = 'depth'")
    return fold(d, ["seq"], ["seq", "is_snapshot", "first_id", "final_id"], lambda: [Feed()], _synced, "seq bigint, outcome string, passed array<bigint>, resyncs bigint, dropped bigint")


def applied(tape: DataFrame) -> DataFrame:
    """The rows that reach the books: trades as they are, depth messages when the sequence lets them pass.

    ``release_seq`` and ``release_pos`` give the order: what waited for a snapshot follows it.
    """
    s = synced(tape).select("symbol", F.col("seq").alias("release_seq"), F.posexplode("passed").alias("release_pos", "seq"))
    trades = tape.where("kind = 'trade'").withColumns({"release_seq": F.col("seq"), "release_pos": F.lit(0)})
    return tape.where("kind = 'depth'").join(s, ["symbol", "seq"]).unionByName(trades)


def released(tape: DataFrame) -> DataFrame:
    """The tape in the order in which messages pass, for books and rules: numbered anew by release, and what waited has the time of
    the message that let it pass. ``origin_seq`` is the number before."""
    a = applied(tape)
    passed = tape.select("symbol", F.col("seq").alias("release_seq"), F.col("ts_ns").alias("release_ts"))
    a = a.join(passed, ["symbol", "release_seq"]).withColumns({"origin_seq": F.col("seq"), "seq": F.col("release_seq") * (2 * BUFFER) + F.col("release_pos"), "ts_ns": F.greatest("ts_ns", "release_ts")})
    return a.select(*tape.columns, "origin_seq")


def gaps(tape: DataFrame) -> DataFrame:
    """Diffs that don't follow the diff before them: symbol, seq, first_id, expected_id. A plain window where the feed is clean."""
    d = tape.where("kind = 'depth' AND NOT is_snapshot").select("symbol", "seq", "ts_ns", "first_id", "final_id")
    d = running(d, ["symbol"], ["seq"], {"expected_id": ("last", F.col("final_id") + 1)}, before=True)
    return d.where("expected_id IS NOT NULL AND first_id <> expected_id").select("symbol", "seq", "first_id", "expected_id")


def not_stale(tape: DataFrame) -> DataFrame:
    """Diffs that end after all that came before them."""
    d = tape.where("kind = 'depth' AND NOT is_snapshot").select("symbol", "seq", "ts_ns", "first_id", "final_id")
    d = running(d, ["symbol"], ["seq"], {"before": ("max", F.col("final_id"))}, before=True)
    return d.where("before IS NULL OR final_id > before").drop("before", "ts_ns")


def is_zero(text: Column) -> Column:
    return text.rlike(r"^[0.]+$")


def checksum_payload(levels: DataFrame, price: str = "price", size: str = "size") -> DataFrame:
    """Per symbol the top levels of both sides in turn, as ``price:size`` joined by colons, and their signed CRC-32.

    ``levels``: symbol, side, rank (1 is best) and the venue's own strings of price and size.
    """
    top = levels.where(F.col("rank") <= CHECKSUM_LEVELS)
    place = F.struct(F.col("rank").alias("k"), (F.col("side") != BUY).cast("int").alias("s"), F.concat_ws(":", price, size).alias("x"))
    p = top.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["x"]), ":").alias("payload"))
    crc = F.crc32(F.col("payload").cast("binary"))
    return p.withColumn("checksum", F.when(crc > 2**31 - 1, crc - 2**32).otherwise(crc).cast("int"))


class Strings:
    """A ladder that keeps a venue's strings, with the venue's own sequence numbers."""

    def __init__(self) -> None:
        self.synced = False
        self.last = 0
        self.sides: tuple[dict[str, tuple], dict[str, tuple]] = ({}, {})

    def apply(self, side: int, rows: list) -> None:
        from decimal import Decimal

        for row in rows or []:
            if len(row) < 2:
                continue
            key = Decimal(row[0])
            if row[1] and not row[1].strip("0."):
                self.sides[side].pop(key, None)
            else:
                self.sides[side][key] = (row[0], row[1])

    def payload(self) -> str:
        bids = [self.sides[0][k] for k in sorted(self.sides[0], reverse=True)[:CHECKSUM_LEVELS]]
        asks = [self.sides[1][k] for k in sorted(self.sides[1])[:CHECKSUM_LEVELS]]
        return ":".join(x for k in range(max(len(bids), len(asks))) for side in (bids, asks) if k < len(side) for x in side[k])


def _crc(text: str) -> int:
    import zlib

    crc = zlib.crc32(text.encode())
    return crc - 2**32 if crc > 2**31 - 1 else crc


def _continuity(s: Strings, row: tuple) -> list[tuple]:
    seq, action, prev, last, checksum, bids, asks = row
    if action == "snapshot":
        s.sides = ({}, {})
    elif not s.synced:
        return [(seq, "waiting", False)]
    elif prev != s.last:
        s.synced, s.sides = False, ({}, {})
        return [(seq, "gap", False)]
    s.apply(0, bids)
    s.apply(1, asks)
    if checksum and checksum != _crc(s.payload()):
        s.synced, s.sides = False, ({}, {})
        return [(seq, "checksum", False)]
    s.synced, s.last = True, last
    return [(seq, "ok", action == "snapshot" or bool(bids or asks))]


def continuity(books: DataFrame) -> DataFrame:
    """Book pushes with chained sequence numbers: seq, outcome (ok, waiting, gap or checksum), published.

    A gap or a checksum that doesn't fit asks for a new snapshot; 0 means that the venue gave no checksum. An update without
    levels moves the sequence on and is not published.
    """
    return fold(books, ["seq"], ["seq", "action", "prev_id", "last_id", "checksum", "bids", "asks"], Strings, _continuity, "seq bigint, outcome string, published boolean")
