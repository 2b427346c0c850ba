"""A book whose levels stay in a keyed store: only the buckets of prices that a batch touches are read and written.

A bucket holds the levels of one side whose prices fall in a range of equal width. The width comes from the snapshot and is halved or
doubled when buckets grow too full or too many, so a bucket has some dozens of levels however the market quotes. Which buckets there
are is known in order; so the best prices are found in the first bucket or two, whatever the depth of the book.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from typing import Protocol

from tidewatch.types import BUY

FULL = 64  # levels that a bucket should have


class Store(Protocol):
    """What a map of state variables does. Keys and values are tuples."""

    def get(self, key: tuple) -> tuple | None: ...
    def put(self, key: tuple, value: tuple) -> None: ...
    def remove(self, key: tuple) -> None: ...
    def items(self) -> list[tuple[tuple, tuple]]: ...
    def clear(self) -> None: ...


class BucketLadder:
    """The interface of ``book.Ladder`` over two stores: ``levels``, (side, bucket) -> ([(price, size)],), and ``index``,
    (side,) -> ([bucket],). ``head`` is what else must be kept: synced, width, buckets at the last change of width, levels of both sides."""

    def __init__(self, levels: Store, index: Store, head: list | None = None) -> None:
        self.levels, self.index = levels, index
        self.synced, self.width, self.buckets, self.count = (*head[:3], head[3:]) if head else (False, 1, FULL, [0, 0])
        self._ids: list[list[int] | None] = [None, None]
        self._open: dict[tuple[int, int], tuple[list[int], dict[int, int]]] = {}
        self._dirty: set[tuple[int, int]] = set()
        self._stored: set[tuple[int, int]] = set()  # of those that are open
        self._moved = {BUY: False, 1 - BUY: False}
        self._wiped = self._full = False

    def head(self) -> list:
        return [self.synced, self.width, self.buckets, *self.count]

    def ids(self, side: int) -> list[int]:
        if self._ids[side] is None:
            known = None if self._wiped else self.index.get((side,))
            self._ids[side] = list(known[0]) if known else []
        return self._ids[side]

    def _bucket(self, side: int, k: int) -> tuple[list[int], dict[int, int]]:
        key = (side, k)
        if key not in self._open:
            at = bisect_left(self.ids(side), k)
            there = not self._wiped and at < len(self.ids(side)) and self.ids(side)[at] == k
            kept = self.levels.get(key) if there else None
            if kept:
                self._stored.add(key)
            sizes = dict(map(tuple, kept[0])) if kept else {}
            self._open[key] = (sorted(sizes), sizes)
        return self._open[key]

    def _set(self, side: int, price: int, qty: int) -> int:
        """Size before."""
        k = price // self.width
        prices, sizes = self._open.get((side, k)) or self._bucket(side, k)
        old = sizes.get(price, 0)
        if old == qty:
            return old
        self._dirty.add((side, k))
        ids = self.ids(side)
        if not old:
            if not prices:
                insort(ids, k)
                self._moved[side] = True
            insort(prices, price)
            self.count[side] += 1
            self._full = self._full or len(prices) > 4 * FULL
        if qty:
            sizes[price] = qty
        else:
            del sizes[price]
            del prices[bisect_left(prices, price)]
            self.count[side] -= 1
            if not prices:
                del ids[bisect_left(ids, k)]
                self._moved[side] = True
        return old

    def _wipe(self, width: int) -> None:
        self._open, self._dirty, self._stored, self._ids, self.count, self.width, self._wiped = {}, set(), set(), [[], []], [0, 0], max(1, width), True
        self._moved, self._full = dict.fromkeys(self._moved, True), False

    def _fit(self) -> None:
        """Halve the width while a bucket that was touched is too full; double it when buckets have doubled and are nearly empty."""
        bids, asks = self._ids
        n = len(bids) + len(asks) if bids is not None and asks is not None else 0
        if not self._full and n <= 2 * self.buckets:
            return
        crowded, self._full = self._full and self.width > 1 and any(len(self._open[k][0]) > 4 * FULL for k in self._dirty), False
        if crowded or (n > 2 * self.buckets and 8 * sum(self.count) < FULL * n):
            every = [(side, p, q) for side in (0, 1) for k in list(self.ids(side)) for p, q in self._bucket(side, k)[1].items()]
            self._wipe(self.width // 2 if crowded else self.width * 2)
            for side, p, q in every:
                self._set(side, p, q)
            self.buckets = max(FULL, sum(map(len, self._ids)))
            self._fit()

    def apply(self, snapshot: bool, changes: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Take in a message of (side, price, size); returns (position, side, price, old, new) of what changed."""
        if snapshot:
            prices = [p for _, p, q in changes if q > 0]
            self._wipe((max(prices) - min(prices)) * FULL // len(prices) if prices else 1)
            self.synced, self.buckets = True, FULL
        elif not self.synced:
            return []
        out = []
        for k, (side, price, qty) in enumerate(changes):
            if snapshot and qty <= 0:
                continue
            old = self._set(side, price, qty)
            if not snapshot and old != qty:
                out.append((k, side, price, old, qty))
        self._fit()
        return out

    def top(self, side: int, n: int = 1) -> list[tuple[int, int]]:
        """Up to ``n`` (price, size), best first."""
        out: list[tuple[int, int]] = []
        ids = self.ids(side)
        for k in reversed(ids) if side == BUY else ids:
            prices, sizes = self._bucket(side, k)
            out += [(p, sizes[p]) for p in (reversed(prices[-(n - len(out)) :]) if side == BUY else prices[: n - len(out)])]
            if len(out) >= n:
                break
        return out

    def best(self, side: int) -> int | None:
        if not (ids := self.ids(side)):
            return None
        k, at = (ids[-1], -1) if side == BUY else (ids[0], 0)
        return (self._open.get((side, k)) or self._bucket(side, k))[0][at]

    def mid(self) -> float | None:
        bid, ask = self.best(BUY), self.best(1 - BUY)
        return None if bid is None or ask is None else (bid / 1e8 + ask / 1e8) / 2

    def depth(self, side: int) -> int:
        return self.count[side]

    def flush(self) -> None:
        """Write the buckets that were changed, and the order of buckets where it was."""
        if self._wiped:
            self.levels.clear()
        for side, k in sorted(self._dirty):
            _, sizes = self._open[side, k]
            if sizes:
                self.levels.put((side, k), (sorted(sizes.items()),))
                self._stored.add((side, k))
            elif (side, k) in self._stored:
                self.levels.remove((side, k))
                self._stored.discard((side, k))
        for side, moved in self._moved.items():
            if moved:
                self.index.put((side,), (self.ids(side),))
        self._dirty, self._wiped, self._moved = set(), False, dict.fromkeys(self._moved, False)
