"""Sliding windows that end at a row, cooldowns, and indexes over a whole table.

A window holds the rows of its symbol with ts in [now - length, now] up to the row itself: rows of the same time count only if
they come before in the order. Time is cut into stretches; each row belongs to its stretch and, if a window of the next one can
reach it, is sent there too. So a busy symbol is spread over tasks, and no task holds more than a stretch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.fixedpoint import idiv
from tidewatch.operators.fold import keys_of, values
from tidewatch.operators.scan import STRETCH
from tidewatch.shipping import ship

_PEERS = 1 << 22  # rows of a symbol with one time are told apart up to half of this; beyond it, an error


def sliding(rows: DataFrame, length: int, order: list[str], aggregates: dict[str, callable], stretch: int = STRETCH) -> DataFrame:
    """``rows`` with a column for each aggregate, called with the window of ``length`` nanoseconds that ends at the row."""
    if length >= stretch:
        raise ValueError("a window must be shorter than a stretch")
    if 2 * stretch * _PEERS >= 1 << 63:
        raise ValueError("a stretch is too long for time and place to fit one number")
    own = idiv(F.col("ts_ns"), stretch)
    reach = idiv(F.col("ts_ns") + length, stretch)
    r = rows.withColumn("__own", own).withColumn("__in", F.explode(F.when(reach > own, F.array(own, reach)).otherwise(F.array(own))))
    r = r.repartition("symbol", "__in")  # serves both windows; by themselves each has its own shuffle
    place = W.partitionBy("symbol", "__in")
    tie = F.row_number().over(W.partitionBy("symbol", "__in", "ts_ns").orderBy(*order)) - 1
    at = (F.col("ts_ns") - (F.col("__in") - 1) * stretch) * _PEERS + F.col("__tie")
    frame = place.orderBy("__at").rangeBetween(-(length * _PEERS + _PEERS // 2), 0)
    r = r.withColumn("__tie", tie).withColumn("__at", at).withColumns({name: f(frame) for name, f in aggregates.items()})
    # Beside the windows, not in their order: there it would be evaluated for each comparison.
    told = F.raise_error(F.lit(f"more than {_PEERS // 2} rows of a symbol have one time")).cast("boolean")
    return r.where(F.when(F.col("__tie") < _PEERS // 2, F.col("__own") == F.col("__in")).otherwise(told)).drop("__own", "__in", "__at", "__tie")


def span(frame: WindowSpec) -> Column:
    """For ``sliding``: nanoseconds between the oldest row of a window and its last."""
    return F.max("ts_ns").over(frame) - F.min("ts_ns").over(frame)


def cooldown(rows: DataFrame, wait: int | Column, order: list[str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows of each key at least ``wait`` after the last one kept; the clock starts at 0, so times below ``wait`` are void.

    A key is one task here, which reads times only and filters whole batches: for candidates that are few beside the rows they come
    from. Others use ``cooldown_by_stretch``. ``wait`` may be a column that is the same for all rows of a key.
    """
    ship(rows.sparkSession)
    wait = F.lit(wait) if isinstance(wait, int) else wait
    dealt = rows.withColumns({"__wait": wait.cast("bigint"), "__last": F.lit(0).cast("bigint")}).repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(_kept(list(keys), rows.columns), rows.schema)


def _exits(keys: list[str], stretch: int):
    """Of each stretch, whose rows come backwards in time: for each time at which a chain of kept rows may begin in it, the time at which
    that chain ends. A chain begins within a cooldown of the stretch's start, or else with the first row behind that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, later, behind = None, [], deque(), None

        def flush() -> None:
            if behind is not None:
                found.append((*at, *behind))

        for b in batches:
            for key, ts, wait in zip(keys_of(b, keys), values(b.column("ts_ns")), values(b.column("__wait")), strict=True):
                if key != at:
                    flush()
                    at, later, behind = key, deque(), None
                if later and later[-1][0] == ts:
                    continue
                while len(later) > 1 and later[1][0] >= ts + wait:
                    later.popleft()
                end = later[0][1] if later and later[0][0] >= ts + wait else ts
                later.append((ts, end))
                if ts < key[-1] * stretch + wait:
                    found.append((*key, ts, end, wait))
                else:
                    behind = ts, end, wait
            yield _batch(found, keys, b, ["ts_ns", "end", "wait"])
            found = []
        if at is not None:
            flush()
            yield _batch(found, keys, b, ["ts_ns", "end", "wait"])

    return run


def _batch(rows: list[tuple], keys: list[str], like: pa.RecordBatch, more: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (len(keys) + len(more))
    types = [like.schema.field(c).type for c in keys] + [pa.int64()] * len(more)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*keys, *more])


def _entries(keys: list[str]):
    """Of each key, from the ends of chains in order: the time of the last kept row before each stretch in which rows are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, done = None, 0, None
        for b in batches:
            found = []
            for key, ts, end, wait in zip(keys_of(b, keys), *(values(b.column(c)) for c in ("ts_ns", "end", "wait")), strict=True):
                if key[:-1] != at:
                    at, last, done = key[:-1], 0, None
                if key[-1] != done and ts - last >= wait:
                    found.append((*key, last))
                    last, done = end, key[-1]
            yield _batch(found, keys, b, ["last"])

    return run


def _kept(keys: list[str], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, 0
        for b in batches:
            keep = []
            for key, ts, wait, before in zip(keys_of(b, keys), *(values(b.column(c)) for c in ("ts_ns", "__wait", "__last")), strict=True):
                if key != at:
                    at, last = key, before
                keep.append(ts - last >= wait)
                if keep[-1]:
                    last = ts
            yield b.select(columns).filter(pa.array(keep, pa.bool_()))

    return run


def cooldown_by_stretch(rows: DataFrame, wait: int | Column, order: list[str], keys: tuple[str, ...] = ("symbol",), stretch: int = STRETCH) -> DataFrame:
    """``cooldown`` by any keys, with a hot key spread over tasks.

    Which rows are kept depends on those kept before, yet stretches are thinned apart: of each, one backward pass tells where every
    chain that can enter it ends; entries are followed from stretch to stretch over these few rows; then each stretch is thinned from
    its entry. The first and the last pass read one shuffle. ``wait`` may be a column that is the same for all rows of a key.
    """
    ship(rows.sparkSession)
    at = [*keys, "__stretch"]
    wait = F.lit(wait) if isinstance(wait, int) else wait
    dealt = rows.withColumns({"__stretch": idiv(F.col("ts_ns"), stretch), "__wait": wait.cast("bigint")}).repartition(*at)
    kinds = dict(dealt.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in at)
    ends = dealt.sortWithinPartitions(*at, F.col("ts_ns").desc()).mapInArrow(_exits(at, stretch), f"{ddl}, ts_ns bigint, end bigint, wait bigint")
    entries = ends.repartition(*keys).sortWithinPartitions(*keys, "ts_ns").mapInArrow(_entries(at), f"{ddl}, last bigint")
    entries = entries.select(*[F.col(c).alias(f"__e{i}") for i, c in enumerate(at)], F.col("last").alias("__last"))
    both = dealt.join(entries, [F.col(c).eqNullSafe(F.col(f"__e{i}")) for i, c in enumerate(at)])
    return both.sortWithinPartitions(*at, *order).mapInArrow(_kept(at, rows.columns), rows.schema)


def numbered(rows: DataFrame, order: list[str], by: Column | None = None, name: str = "n") -> DataFrame:
    """1-based index of each row in the order of the whole table: ``by`` cuts it into ascending stretches that are numbered apart.

    Without ``by`` one task numbers all rows, for tables that are known to be small.
    """
    if by is None:
        return rows.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))
    r = rows.withColumn("__by", by)
    before = r.groupBy("__by").agg(F.count(F.lit(1)).alias("__k"))
    before = before.select("__by", (F.sum("__k").over(W.orderBy("__by").rowsBetween(W.unboundedPreceding, 0)) - F.col("__k")).alias("__before"))
    r = r.withColumn("__n", F.row_number().over(W.partitionBy("__by").orderBy(*order))).join(before, "__by")
    return r.withColumn(name, (F.col("__before") + F.col("__n")).cast("bigint")).drop("__by", "__n", "__before")
