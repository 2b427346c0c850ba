"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key. Within a source the keys are cut into ``2**BITS`` equal ranges; sums per (source, range)
are combined on the map side and give each range its offset, and a window inside the range gives each document its own prefix sum.
No range holds more than about rows / 2**BITS documents even if one source holds all rows. Each source is cut exactly at its
budget: whole epochs first, then the documents in key order, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.scratch import written

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
HEX_DIGITS = 3  # 16**3 ranges of keys in each source


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Words to take from each source: (src, source_size) -> (src, source_size, target).

    Sources, by code point with null last, weigh ``weights`` in turn. Targets share the total of all sizes by weight; one that
    would exceed ``most`` times its source's size stops there and the rest is shared again. Ordered by ``most * size / weight``
    the sources that stop come first, so the share of a unit of weight is that of the first source that doesn't stop.
    A single sort of one row a source; an empty table has no rows.
    """
    by_name = W.orderBy("src")
    cap = F.lit(float(most)) * F.col("source_size")
    by_ratio = W.orderBy("ratio", "src")
    upto, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    s = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("ratio", cap / F.col("w"))
    s = s.withColumns({"k": F.row_number().over(by_ratio), "left": F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).cast("double") - F.coalesce(F.sum(cap).over(upto), F.lit(0.0)), "ws": F.sum("w").over(after)})
    s = s.withColumn("unit", F.col("left") / F.col("ws"))
    first = F.min(F.when(F.col("unit") <= F.col("ratio"), F.struct("k", "unit"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("first", first)
    return s.select("src", "source_size", F.when(F.col("k") < F.col("first.k"), cap).otherwise(F.least(cap, F.col("first.unit") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix", carry: Column | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words taken, repeats counted), and ``carry`` as carried, if given.

    Null texts have no words and give none; a null source is a source of its own; rows that repeat are documents of their own;
    ties in the key go by doc_id and size (and what is carried), so reruns agree. Other columns are not read.
    """
    d = docs.select("doc_id", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("src"), n_words(F.col("text")).alias("size"), *([] if carry is None else [carry.alias("carried")]))
    d = written(d.withColumn("key", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(seed)).cast("binary"))), "mix-sizes")
    d = d.withColumn("range", F.substring("key", 1, HEX_DIGITS))
    ranges = written(d.groupBy("src", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    goal = targets(ranges.groupBy("src").agg(F.sum("words").alias("source_size")), weights, most)
    offsets = ranges.select("src", "range", (F.sum("words").over(W.partitionBy("src").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("offset"))
    offsets = written(offsets.join(goal, "src"), "mix-offsets")
    inside = W.partitionBy("src", "range").orderBy("key", "doc_id", "size", *([] if carry is None else [F.xxhash64("carried")])).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("before", F.sum("size").over(inside) - F.col("size")).join(offsets, ["src", "range"])
    budget, whole = F.floor("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget % whole - F.col("offset") - F.col("before")))
    return d.select("doc_id", "size", "source_size", "target", (F.floor(budget / whole).cast("long") * F.col("size") + rest).cast("long").alias("taken"), *([] if carry is None else ["carried"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(documents: str = "documents", seed: str = "mix") -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, md5(concat_ws(':', doc_id::VARCHAR, '{seed}')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {documents}
), s AS (
  SELECT none, src, sum(size)::BIGINT AS source_size, [1.0::DOUBLE, 2.0, 3.0][(row_number() OVER (ORDER BY none, src) - 1) % 3 + 1] AS w FROM d GROUP BY none, src
), r AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM s
), u AS (
  SELECT *, row_number() OVER o AS k,
    (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM r WINDOW o AS (ORDER BY ratio, none, src)
), f AS (SELECT min(k) AS fk, arg_min(unit, k) AS fu FROM u WHERE unit <= ratio),
g AS (SELECT none, src, source_size, CASE WHEN k < fk THEN cap ELSE least(cap, fu * w) END AS target FROM u, f),
c AS (
  SELECT d.*, sum(size) OVER (PARTITION BY none, src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before FROM d
)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  (floor(target)::BIGINT // source_size) * size + greatest(0, least(size, floor(target)::BIGINT % source_size - before)) END::BIGINT AS taken
FROM c JOIN g USING (none, src)
"""


SQL = sql()
