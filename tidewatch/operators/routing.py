"""Many patterns against many subjects: who gets what, from equality joins only.

A pattern's shape is its number of tokens, which of them are ``*``, and whether ``>`` follows. There are few shapes however many
patterns there are. A subject gives one key for each shape that its length allows, with the shape's wildcards put in, and keys meet
the patterns by equality. So the work grows with subjects times shapes, plus what matches, and never with subjects times patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shaped(subscriptions: DataFrame) -> DataFrame:
    """sink, n (tokens before a ``>``), mask (whether each is ``*``), rest (whether ``>`` follows), key."""
    s = subscriptions.where("pattern IS NOT NULL").select("sink", F.split("pattern", r"\.").alias("tokens")).withColumn("at", F.array_position("tokens", ">"))
    s = s.withColumn("head", F.when(F.col("at") > 0, F.slice("tokens", 1, (F.col("at") - 1).cast("int"))).otherwise(F.col("tokens")))
    return s.select("sink", F.size("head").alias("n"), F.transform("head", lambda x: x == "*").alias("mask"), (F.col("at") > 0).alias("rest"), F.array_join("head", ".").alias("key")).distinct()


def matched(subjects: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subject, sink) for each distinct subject and each sink with a pattern that takes it, as ``subjects.matches`` does.

    ``subscriptions``: sink, pattern. ``*`` takes one token, empty ones too; ``>`` takes what follows, and what stands behind it in a
    pattern has no effect; ``>`` alone takes all. A sink that matches by several patterns comes once. Null subjects match nothing.
    """
    shaped = _shaped(subscriptions)
    shapes = shaped.select("n", "mask", "rest").distinct()
    each = subjects.where("subject IS NOT NULL").select("subject").distinct().withColumn("tokens", F.split("subject", r"\.")).withColumn("size", F.size("tokens"))
    # Lengths of subjects by shapes that take them: both are few.
    sizes = each.select("size").distinct()
    fits = sizes.join(shapes, F.when(F.col("rest"), (F.col("size") > F.col("n")) | (F.col("n") == 0)).otherwise(F.col("size") == F.col("n")))
    keyed = each.join(fits, "size").select("subject", "n", "mask", "rest", F.array_join(F.transform(F.slice("tokens", F.lit(1), F.col("n")), lambda x, i: F.when(F.get("mask", i), "*").otherwise(x)), ".").alias("key"))
    return keyed.join(shaped, ["n", "mask", "rest", "key"]).select("subject", "sink").distinct()


def routed(rows: DataFrame, subject: Column, subscriptions: DataFrame, name: str = "sinks") -> DataFrame:
    """``rows`` that some sink takes, with the sinks in order. Each distinct subject is matched once, however many rows it has."""
    r = rows.withColumn("__subject", subject)
    sinks = matched(r.select(F.col("__subject").alias("subject")), subscriptions).groupBy("subject").agg(F.array_sort(F.collect_list("sink")).alias(name))
    return r.join(sinks.withColumnRenamed("subject", "__subject"), "__subject").select(*rows.columns, name)


def deliver(rows: DataFrame, path: str, name: str = "sinks", mode: str = "append") -> None:
    """Write routed rows once a sink, in one job: a folder of ``path`` for each. In ``foreachBatch``, give each batch its own path and
    overwrite it, so that a batch that comes again replaces itself."""
    rows.withColumn("sink", F.explode(name)).drop(name).write.mode(mode).partitionBy("sink").parquet(path)
