"""Routing by many patterns against the matching of one, and its plan."""

import random

from pyspark.sql import functions as F

from tidewatch.functions import subjects
from tidewatch.operators import routing


def some(r, wild):
    pool = ["md", "features", "a", "b", "", "x1"] + (["*", "*", ">"] if wild else ["*"])
    return ".".join(r.choice(pool) for _ in range(r.randint(1, 4)))


def test_equals_matching_one_by_one(spark):
    r = random.Random(7)
    patterns = sorted({some(r, True) for _ in range(120)} | {">", "md.>", "*", "*.*", "md.>.x", "a.b"})
    names = sorted({some(r, False) for _ in range(400)} | {"md", "md.", "", "md.>", "a.*"})
    subs = spark.createDataFrame([(f"s{k % 50}", p) for k, p in enumerate(patterns)] + [("nobody", None)], "sink string, pattern string")
    rows = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "subject string")
    got = {(x.subject, x.sink) for x in routing.matched(rows, subs).collect()}
    flags = rows.distinct().select("subject", *[subjects.matches(F.col("subject"), p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    assert got == {(x.subject, f"s{k % 50}") for x in flags for k in range(len(patterns)) if x[k + 1]} and len(got) > 1000


def test_ten_thousand_patterns_without_a_cross_join(spark, tmp_path):
    n = 10_000
    subs = spark.range(n).selectExpr("concat('s', id % 100) AS sink", "CASE id % 3 WHEN 0 THEN concat('md.*.', id) WHEN 1 THEN concat('md.x.', id, '.>') ELSE concat('md.', id, '.*') END AS pattern")
    rows = spark.range(100_000).selectExpr("id", "concat('md.x.', id % 30000) AS subject")
    out = routing.routed(rows, F.col("subject"), subs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and plan.count("NestedLoop") <= 2  # lengths by shapes, both few
    got = {x.id: x.sinks for x in out.collect()}
    assert got == {k: [f"s{k % 30000 % 100}"] for k in range(100_000) if k % 30000 < n and k % 30000 % 3 == 0}
    routing.deliver(out, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(got) and back.select("sink").distinct().count() == len({s for x in got.values() for s in x})


def test_nothing_to_route(spark):
    none = spark.createDataFrame([], "sink string, pattern string")
    rows = spark.createDataFrame([("md.a",)], "subject string")
    assert routing.routed(rows, F.col("subject"), none).count() == 0 and routing.matched(rows.limit(0), none).count() == 0
