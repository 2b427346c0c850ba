"""Prefix scans and as-of joins against lists, with ties, nulls and stretches without rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import scan, windows


def rows(seed, n=300):
    r = random.Random(seed)
    t, out = -50, []
    for k in range(n):
        t += r.choice((0, 0, 1, 7, 60))
        out.append((r.choice(["a", "a", "a", "b", None]), k, t, r.choice([None, r.randint(-9, 9)])))
    return out


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("stretch", [1, 10, 10**6])
def test_running(spark, before, stretch):
    data = rows(stretch)
    df = spark.createDataFrame(data, "symbol string, seq long, ts_ns long, v long").repartition(5)
    got = scan.running(df, ["symbol"], ["seq"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "now": ("last", F.col("v")), "n": ("sum", F.lit(1))}, before=before, stretch=stretch)
    assert got.columns == ["symbol", "seq", "ts_ns", "v", "total", "top", "low", "now", "n"]
    want, seen = [], {}
    for row in data:
        past = seen.setdefault(row[0], [])
        given = past if before else [*past, row[3]]
        v = [x for x in given if x is not None]
        want.append((*row, *((sum(v), max(v), min(v), v[-1]) if v else (None,) * 4), len(given) or None))
        past.append(row[3])
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == want


@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("within", [None, 12])
def test_asof(spark, equal, within):
    left, right = rows(3), [(s, k + random.Random(k).choice((0, 0, 400)), t, v) for s, k, t, v in rows(4)]
    at = lambda data: [(s, t, t, v) for s, k, t, v in data]
    left, right = at(left), list({(s, t): (s, t, u, v) for s, t, u, v in at(right)}.values())  # one right row a key and time
    l = spark.createDataFrame([(*x, k) for k, x in enumerate(left)], "symbol string, seq long, ts_ns long, v long, k long").repartition(3)
    r = spark.createDataFrame(right, "symbol string, seq long, ts_ns long, price long").repartition(4)
    got = scan.asof(l, r, ["symbol"], ["seq"], take=["ts_ns", "price"], equal=equal, within=within, stretch=30)
    assert got.columns == [*l.columns, "match"] and got.count() == len(left)
    for x in got.collect():
        before = [y for y in right if y[0] == x.symbol and (y[1] <= x.seq if equal else y[1] < x.seq)]
        last = max(before, key=lambda y: y[1], default=None)
        if last is not None and within is not None and x.ts_ns - last[2] > within:
            last = None
        assert (x.match and tuple(x.match)) == (last and (last[2], last[3]))


@pytest.mark.parametrize("within", [0, 5, 29])
def test_recent(spark, within):
    data = rows(9)
    df = spark.createDataFrame(data, "symbol string, seq long, ts_ns long, v long").repartition(5)
    got = scan.recent(df, ["symbol"], ["seq"], F.col("v"), within, stretch=30)
    for x in got.collect():
        last = max((y for y in data if y[0] == x.symbol and y[1] < x.seq and y[3] is not None), key=lambda y: y[1], default=None)
        assert x.match == (last[3] if last and x.ts_ns - last[2] <= within else None)
    assert got.count() == len(data) and got.columns == [*df.columns, "match"]


def test_no_task_has_a_whole_key(spark):
    """One key with all rows: windows are cut into stretches, and only their totals meet."""
    df = spark.range(20000).selectExpr("IF(id < 0, 'b', 'a') AS symbol", "id AS seq", "id AS ts_ns", "id % 7 AS v")
    got = scan.running(df, ["symbol"], ["seq"], {"total": ("sum", F.col("v"))}, stretch=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    specs = set(re.findall(r"sum\((\w+)#\w+\) windowspecdefinition\(symbol#\d+, __s#\d+L( ASC)?", plan))
    assert specs == {("__v_total", ""), ("__t_total", " ASC")}  # the first is cut by stretches, the second goes over their totals
    assert got.where("seq = 19999").first().total == sum(k % 7 for k in range(20000))


@pytest.mark.parametrize(("seed", "stretch"), [(1, 4), (2, 9), (3, 40), (4, 10**6)])
def test_cooldown_by_stretches(spark, seed, stretch):
    """Dense and sparse chains, ties, times below the cooldown, waits longer than a stretch, null keys."""
    r = random.Random(seed)
    waits = {"a": 7, "b": 1, None: 25}
    data, t = [], -20
    for k in range(600):
        t += r.choice((0, 0, 1, 1, 3, 5)) if k % 100 else r.choice((0, 200))
        data.append((r.choice(["a", "a", "b", None]), k, t, f"row {k}"))
    df = spark.createDataFrame(data, "symbol string, seq long, ts_ns long, note string").repartition(5)
    wait = F.coalesce(*[F.when(F.col("symbol") == s, w) for s, w in waits.items() if s], F.lit(waits[None]))
    got = windows.cooldown_by_stretch(df, wait, ["seq"], stretch=stretch)
    last, want = {}, []
    for row in data:
        if row[2] - last.get(row[0], 0) >= waits[row[0]]:
            last[row[0]] = row[2]
            want.append(row)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=lambda x: x[1]) == want
    assert windows.cooldown_by_stretch(df.where("seq < 0"), 5, ["seq"]).count() == 0


def test_cooldown_spreads_a_hot_symbol(spark):
    """One symbol: rows lie in many partitions, and the passes over them read one shuffle."""
    df = spark.range(0, 4000, 1, 4).select(F.lit("S").alias("symbol"), F.col("id").alias("seq"), (F.col("id") * 10).alias("ts_ns"))
    out = windows.cooldown_by_stretch(df, 35, ["seq"], stretch=1000)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, False)
    try:
        assert out.count() == 999 and out.select(F.spark_partition_id()).distinct().count() == 4
        out.collect()
        assert out._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1
    finally:
        spark.conf.unset(key)
