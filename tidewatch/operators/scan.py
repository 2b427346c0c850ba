"""Running totals and as-of joins over very long keys: prefix scans on two levels.

Rows of a key are cut by time into stretches. Inside a stretch a window gives each row what came before it there; of whole stretches
only totals are kept, one row each, and a window over these gives what to carry in. So no window and no task holds more than a
stretch, however many rows a key has. Time must not go back in the order of a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.fixedpoint import idiv
from tidewatch.types import SEC

STRETCH = 600 * SEC

#: What can be carried: (total of rows, total of totals, two totals together). Nulls count as nothing.
_KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (lambda c, _: F.sum(c), F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "max": (lambda c, _: F.max(c), F.max, lambda a, b: F.greatest(a, b)),
    "min": (lambda c, _: F.min(c), F.min, lambda a, b: F.least(a, b)),
    "last": (lambda c, order: F.max(F.when(c.isNotNull(), F.struct(*order, c.alias("__x"))))["__x"], lambda c: F.last(c, True), lambda a, b: F.coalesce(b, a)),
}


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, tuple[str, Column]], *, before: bool = False, time: str = "ts_ns", stretch: int = STRETCH) -> DataFrame:
    """``rows`` with a column for each total, (sum, max, min or last, column), over the rows of its key up to it in ``order``.

    ``before`` leaves the row itself out. Nulls are passed over, so a total is null until something came. Null keys are a key; ``order``
    must tell the rows of a key apart.
    """
    r = rows.withColumn("__s", idiv(F.col(time), stretch)).withColumns({f"__v_{n}": c for n, (_, c) in totals.items()})
    at = [*keys, "__s"]
    whole = r.groupBy(*at).agg(*[_KINDS[k][0](F.col(f"__v_{n}"), order).alias(f"__t_{n}") for n, (k, _) in totals.items()])
    earlier = W.partitionBy(*keys).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    carry = whole.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(at)], *[_KINDS[k][1](F.col(f"__t_{n}")).over(earlier).alias(f"__c_{n}") for n, (k, _) in totals.items()])
    upto = W.partitionBy(*at).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    inside = {f"__i_{n}": F.last(f"__v_{n}", True).over(upto) if k == "last" else _KINDS[k][1](F.col(f"__v_{n}")).over(upto) for n, (k, _) in totals.items()}
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(at)]
    out = r.withColumns(inside).join(carry, same)
    return out.select(*rows.columns, *[_KINDS[k][2](F.col(f"__c_{n}"), F.col(f"__i_{n}")).alias(n) for n, (k, _) in totals.items()])


def overlapping(rows: DataFrame, reach: int, *, time: str = "ts_ns", stretch: int = STRETCH, name: str = "__in") -> DataFrame:
    """Rows with their stretch as ``name``, once more with the next one if it begins within ``reach``; ``own`` tells which is which."""
    if reach >= stretch:
        raise ValueError("what is looked back on must be shorter than a stretch")
    own, to = idiv(F.col(time), stretch), idiv(F.col(time) + reach, stretch)
    return rows.withColumn(name, F.explode(F.when(to > own, F.array(own, to)).otherwise(F.array(own)))).withColumn("own", F.col(name) == own)


def recent(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, within: int, *, name: str = "match", time: str = "ts_ns", stretch: int = STRETCH) -> DataFrame:
    """``rows`` with ``name``, the last value that is not null of earlier rows of the key, if at most ``within`` ago, else null.

    One shuffle, by key and stretch: what can be seen from the next stretch is sent there too.
    """
    found = F.when(value.isNotNull(), F.struct(F.col(time).alias("at"), value.alias("value")))
    r = overlapping(rows.withColumn("__v", found), within, time=time, stretch=stretch)
    r = r.withColumn("__v", F.last("__v", True).over(W.partitionBy(*keys, "__in").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))).where("own")
    return r.select(*rows.columns, F.when(F.col(time) - F.col("__v.at") <= within, F.col("__v.value")).alias(name))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], *, take: Sequence[str], name: str = "match", equal: bool = True, within: int | None = None, time: str = "ts_ns", stretch: int = STRETCH) -> DataFrame:
    """``left`` with ``name``, a struct of ``take`` from the last row of ``right`` of its keys that is not after it in ``order``.

    Both have ``keys``, ``order`` and ``time``. Of rows equal in ``order``, those of the right come first if ``equal``, else last.
    ``within``: matches further back in time count as none. Left rows without a match stay, with null; null keys meet null keys.
    """
    spot = [f"__o{i}" for i in range(len(order))]
    l = left.select(F.struct(*left.columns).alias("__left"), *[F.col(c).alias(f"__key{i}") for i, c in enumerate(keys)], *[F.col(c).alias(s) for c, s in zip(order, spot, strict=True)], F.col(time).alias("__t"))
    found = F.struct(*[F.col(c).alias(c) for c in take], F.col(time).alias("__at"))
    r = right.select(found.alias("__right"), *[F.col(c).alias(f"__key{i}") for i, c in enumerate(keys)], *[F.col(c).alias(s) for c, s in zip(order, spot, strict=True)], F.col(time).alias("__t"))
    both = l.withColumn("__is_left", F.lit(1 if equal else 0)).unionByName(r.withColumn("__is_left", F.lit(0 if equal else 1)), allowMissingColumns=True)
    at = [f"__key{i}" for i in range(len(keys))], [*spot, "__is_left"]
    if within is None or within >= stretch:
        both = running(both, *at, {"__found": ("last", F.col("__right"))}, time="__t", stretch=stretch)
    else:
        both = recent(both, *at, F.col("__right"), within, name="__found", time="__t", stretch=stretch)
    near = F.col("__found").isNotNull() if within is None else F.col("__t") - F.col("__found.__at") <= within
    return both.where("__left IS NOT NULL").select("__left.*", F.when(near, F.struct(*[F.col("__found")[c].alias(c) for c in take])).alias(name))
