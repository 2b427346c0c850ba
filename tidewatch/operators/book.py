"""Order books: levels, epochs, level changes, and the state of the ladder after each message."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.fixedpoint import idiv, real
from tidewatch.operators.fold import fold
from tidewatch.operators.scan import STRETCH, running
from tidewatch.types import BUY, LEVELS, SELL


def _with_epoch(messages: DataFrame) -> DataFrame:
    return running(messages, ["symbol"], ["seq"], {"epoch": ("sum", F.col("is_snapshot").cast("bigint"))})


def exploded(messages: DataFrame, *keep: str) -> DataFrame:
    each = lambda c, side: F.transform(F.col(c), lambda x: F.struct(F.lit(side).alias("side"), x["p"].alias("price_raw"), x["q"].alias("qty_raw")))
    x = messages.select("seq", "ts_ns", "symbol", "is_snapshot", *keep, F.posexplode(F.concat(each("bids", BUY), each("asks", SELL))).alias("pos", "l"))
    return x.select("seq", "ts_ns", "symbol", "is_snapshot", *keep, "pos", "l.side", "l.price_raw", "l.qty_raw")


def levels(tape: DataFrame) -> DataFrame:
    """One row for each level of a depth message, bids first: seq, ts_ns, symbol, is_snapshot, pos, side, price_raw, qty_raw."""
    return exploded(tape.where("kind = 'depth'"))


def epochs(tape: DataFrame) -> DataFrame:
    """Depth messages with their epoch: how many snapshots of the symbol came up to and with them; 0 is before any."""
    return _with_epoch(tape.where("kind = 'depth'").select("seq", "ts_ns", "symbol", "is_snapshot"))


def _levels_by_epoch(tape: DataFrame) -> DataFrame:
    """Levels of synced symbols with their epoch; those of a snapshot need a positive size."""
    d = _with_epoch(tape.where("kind = 'depth'").select("seq", "ts_ns", "symbol", "is_snapshot", "bids", "asks"))
    return exploded(d.where("epoch > 0"), "epoch").where("NOT is_snapshot OR qty_raw > 0")


def deltas(tape: DataFrame) -> DataFrame:
    """Changes of level sizes: seq, ts_ns, symbol, epoch, pos, side, price_raw, old_raw, new_raw, added.

    Messages before a first snapshot are void, snapshots reset the book without changes, and a price that repeats in a message
    changes twice.
    """
    w = W.partitionBy("symbol", "epoch", "side", "price_raw").orderBy("seq", "pos")
    l = _levels_by_epoch(tape).withColumn("old_raw", F.coalesce(F.lag("qty_raw").over(w), F.lit(0).cast("bigint")))
    l = l.where("NOT is_snapshot AND old_raw <> qty_raw")
    return l.select("seq", "ts_ns", "symbol", "epoch", "pos", "side", "price_raw", "old_raw", F.col("qty_raw").alias("new_raw"), (F.col("qty_raw") > F.col("old_raw")).alias("added"))


class Ladder:
    """Both sides of a book: sizes by price, and the prices in order."""

    def __init__(self) -> None:
        self.synced = False
        self.sizes: tuple[dict[int, int], dict[int, int]] = ({}, {})
        self.prices: tuple[list[int], list[int]] = ([], [])

    def apply(self, snapshot: bool, changes: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Take in a message of (side, price, size); returns (position, side, price, old, new) of what changed."""
        if snapshot:
            self.sizes, self.prices, self.synced = ({}, {}), ([], []), True
        elif not self.synced:
            return []
        out = []
        for k, (side, price, qty) in enumerate(changes):
            old = self.sizes[side].get(price, 0)
            if old == qty or (snapshot and qty <= 0):
                continue
            if not old:
                insort(self.prices[side], price)
            if qty:
                self.sizes[side][price] = qty
            else:
                del self.sizes[side][price]
                del self.prices[side][bisect_left(self.prices[side], price)]
            if not snapshot:
                out.append((k, side, price, old, qty))
        return out

    def top(self, side: int, n: int = 1) -> list[tuple[int, int]]:
        """Up to ``n`` (price, size), best first."""
        p = self.prices[side]
        return [(x, self.sizes[side][x]) for x in (p[: -n - 1 : -1] if side == BUY else p[:n])]

    def depth(self, side: int) -> int:
        return len(self.prices[side])

    def mid(self) -> float | None:
        bids, asks = self.prices
        return (bids[-1] / 1e8 + asks[0] / 1e8) / 2 if bids and asks else None


def _pairs(bids: list, asks: list) -> list[tuple[int, int, int]]:
    """(side, price, size) of the (price, size) pairs of a message, bids first."""
    return [(side, p, q) for side, all_ in ((BUY, bids or []), (SELL, asks or [])) for p, q in all_]


class Carried:
    """Levels at the end of all stretches so far."""

    def __init__(self) -> None:
        self.synced = False
        self.sizes: dict[tuple[int, int], int] = {}


def _carry(book: Carried, row: tuple) -> list[tuple]:
    """The book before a stretch, if there is one; then take in what the stretch leaves behind: (side, price, size, seq)."""
    k, levels = row
    out = []
    if book.synced:
        sides = [[(p, q) for (side, p), q in book.sizes.items() if side == s] for s in (BUY, SELL)]
        out.append((k, *([x[i] for x in side] for side in sides for i in (0, 1))))
    reset = next((seq for side, _, _, seq in levels if side == _MARK), None)
    if reset is not None:
        book.synced, book.sizes = True, {}
    if book.synced:
        for side, price, qty, seq in levels:
            if side != _MARK and (reset is None or seq >= reset):
                if qty:
                    book.sizes[side, price] = qty
                else:
                    book.sizes.pop((side, price), None)
    return out


_MARK = -1  # the side of a row that tells that a stretch is there, and its last snapshot


def _seeds(tape: DataFrame, ahead: int, stretch: int) -> DataFrame:
    """Books as they are ``ahead`` before each stretch in which a synced symbol has rows: symbol, k, bids, asks.

    The last size of a level in a stretch is all that later ones need of it, unless a snapshot voids it. These are combined on the map
    side, and so a symbol's fold sees one row a stretch, as wide as what the stretch changed, rather than its messages.
    """
    own, at = idiv(F.col("ts_ns"), stretch), idiv(F.col("ts_ns") + ahead, stretch)
    nought, snapshot = F.lit(0).cast("bigint"), F.coalesce("is_snapshot", F.lit(False))
    empty = F.expr(f"cast(array() as {LEVELS})")
    depth = lambda c: F.coalesce(F.when(F.col("kind") == "depth", _last_of_each(c)), empty)
    # Marks (stretch, whether it is a snapshot's) tell of a stretch and of its snapshots; a diff with levels tells of its stretch by these.
    mark = lambda k, one: F.struct(k.alias("p"), one.cast("bigint").alias("q"))
    wanted, ahead_of = snapshot | (F.size("b") + F.size("a") == 0), own != at
    of_at, of_own = mark(at, snapshot), mark(own, F.lit(0))
    marks = F.when(wanted & ahead_of, F.array(of_at, of_own)).when(wanted, F.array(of_at)).when(ahead_of, F.array(of_own)).otherwise(empty)
    each = tape.withColumns({"b": depth("bids"), "a": depth("asks")})
    each = each.select("symbol", "seq", snapshot.alias("is_snapshot"), at.alias("k"), F.size("b").alias("n_bids"), F.size("a").alias("n_asks"), F.posexplode(F.concat("b", "a", marks)).alias("i", "l"))
    side = F.when(F.col("i") < F.col("n_bids"), BUY).when(F.col("i") < F.col("n_bids") + F.col("n_asks"), SELL).otherwise(_MARK)
    each = each.select("symbol", "seq", "is_snapshot", "k", side.alias("side"), "l.p", "l.q").where(f"side = {_MARK} OR NOT is_snapshot OR q > 0")
    of = lambda level, m: F.when(F.col("side") == _MARK, m).otherwise(level)
    each = each.select("symbol", of(F.col("k"), F.col("p")).alias("k"), "side", of(F.col("p"), nought).alias("price_raw"), of(F.col("q"), nought).alias("qty_raw"), of(F.col("seq"), F.when(F.col("q") == 1, F.col("seq"))).alias("seq"))
    last = each.groupBy("symbol", "k", "side", "price_raw").agg(F.max_by("qty_raw", "seq").alias("qty_raw"), F.max("seq").alias("seq"))
    last = last.groupBy("symbol", "k").agg(F.collect_list(F.struct("side", "price_raw", "qty_raw", "seq")).alias("levels"))
    found = fold(last, ["k"], ["k", "levels"], Carried, _carry, "k bigint, bp array<bigint>, bq array<bigint>, ap array<bigint>, aq array<bigint>")
    side = lambda p, q: F.transform(F.arrays_zip(F.col(p), F.col(q)), lambda x: F.struct(x[p].alias("p"), x[q].alias("q")))
    return found.select("symbol", "k", side("bp", "bq").alias("bids"), side("ap", "aq").alias("asks"))


def _last_of_each(levels: str) -> Column:
    """Levels of a message without those whose price comes again."""
    c = F.col(levels)
    again = lambda x, i: F.exists(F.slice(c, i + 2, F.size(c)), lambda y: y["p"] == x["p"])
    return F.when(F.size(c) < 2, c).when(F.size(F.array_distinct(F.transform(c, lambda x: x["p"]))) < F.size(c), F.filter(c, lambda x, i: ~again(x, i))).otherwise(c)


def _both(own: Column, reach: Column) -> Column:
    return F.when(reach > own, F.array(own, reach)).otherwise(F.array(own))


def by_stretch(tape: DataFrame, ahead: int = 0, stretch: int = STRETCH) -> DataFrame:
    """Rows of a tape for folds of the book over (symbol, k), stretches of time that know nothing of one another.

    Each begins with a snapshot without seq: the book as it was ``ahead`` before the stretch. Then come that time's rows, which are
    not ``own``, and those of the stretch. Time must not go back in the order of a symbol's rows.
    """
    own, reach = idiv(F.col("ts_ns"), stretch), idiv(F.col("ts_ns") + ahead, stretch)
    rows = tape.withColumn("k", F.explode(_both(own, reach)) if ahead else own).withColumn("own", F.col("k") == own)
    seeds = _seeds(tape, ahead, stretch).withColumns({"kind": F.lit("depth"), "is_snapshot": F.lit(True), "own": F.lit(False)})
    return rows.unionByName(seeds, allowMissingColumns=True)


def _state(n: int):
    def step(book: Ladder, row: tuple) -> list[tuple]:
        seq, ts, snapshot, bids, asks = row
        book.apply(snapshot, _pairs(bids, asks))
        if not book.synced or seq is None:
            return []
        bid, ask = book.top(BUY, n), book.top(SELL, n)
        best = lambda x: x[0] if x else (None, None)
        return [(seq, ts, *best(bid), *best(ask), sum(q for _, q in bid), sum(q for _, q in ask), len(book.prices[BUY]), len(book.prices[SELL]))]

    return step


def state(tape: DataFrame, n: int = 5, stretch: int = STRETCH) -> DataFrame:
    """The book after each depth message of a synced symbol: best prices and sizes (null where a side is empty), sizes of the
    top ``n`` levels, and how many levels there are. Stretches of a symbol are folded apart, so a busy one is spread over tasks."""
    d = by_stretch(tape.where("kind = 'depth'"), 0, stretch)
    out = "seq bigint, ts_ns bigint, bid_raw bigint, bid_qty_raw bigint, ask_raw bigint, ask_qty_raw bigint, bid_top_raw bigint, ask_top_raw bigint, bid_depth bigint, ask_depth bigint"
    return fold(d, ["seq"], ["seq", "ts_ns", "is_snapshot", "bids", "asks"], Ladder, _state(n), out, by=("symbol", "k"))


def with_prices(s: DataFrame) -> DataFrame:
    """Mid, microprice (the mid if both sizes are 0), exact spread and order-flow imbalance; null where a side is empty."""
    bid, ask, bq, aq = real(F.col("bid_raw")), real(F.col("ask_raw")), real(F.col("bid_qty_raw")), real(F.col("ask_qty_raw"))
    mid = (bid + ask) / 2
    top = F.col("bid_top_raw") + F.col("ask_top_raw")
    return s.withColumns({
        "mid": mid,
        "micro": F.when(bq + aq == 0, mid).otherwise((bid * aq + ask * bq) / F.when(bq + aq != 0, bq + aq)),
        "spread_raw": F.col("ask_raw") - F.col("bid_raw"),
        "ofi": F.when(top > 0, (real(F.col("bid_top_raw")) - real(F.col("ask_top_raw"))) / F.when(top > 0, real(F.col("bid_top_raw")) + real(F.col("ask_top_raw")))).otherwise(F.lit(0.0)),
    })


def last_levels(tape: DataFrame) -> DataFrame:
    """Live levels of every symbol at the end of the tape, with their rank on their side: symbol, side, rank, price_raw, qty_raw."""
    l = _levels_by_epoch(tape)
    now = epochs(tape).groupBy("symbol").agg(F.max("epoch").alias("epoch"))
    l = l.join(now, ["symbol", "epoch"]).groupBy("symbol", "side", "price_raw").agg(F.max_by("qty_raw", F.struct("seq", "pos")).alias("qty_raw")).where("qty_raw <> 0")
    rank = F.row_number().over(W.partitionBy("symbol", "side").orderBy(F.when(F.col("side") == BUY, -F.col("price_raw")).otherwise(F.col("price_raw"))))
    return l.withColumn("rank", rank).select("symbol", "side", "rank", "price_raw", "qty_raw")

