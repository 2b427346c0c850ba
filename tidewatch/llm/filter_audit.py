"""How filters interact: what each removes at each step of every order in which they can be applied.

A document's outcome depends only on the mask of the filters that it fails, so the corpus is reduced to cells, counts by part
and mask, with map-side combine. The orders are then visited by adjacent transpositions (plain changes): each swap changes only
the two steps that it touches, and these are summed again from the cells; the Shapley totals accumulate along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.scratch import written
from tidewatch.shipping import ship

FILTERS = "ABCDE"
#: Thresholds and characters of the five filters.
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, MARKS = 200, 50, 3, "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
COPY = FILTERS.index("E")


def _masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the whole text, and the mask of the filters that look at one text alone."""
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body"))
    d = d.withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
    d = d.select("doc_id", "part", "body", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("k"))
    fails = (
        F.col("n") < MIN_WORDS, 100 * F.col("k") < MIN_DISTINCT * F.col("n"),
        100 * F.regexp_count("body", F.lit("[A-Z]")).cast("long") > MAX_UPPER * F.char_length("body"), F.col("body").rlike(MARKS),
    )
    mask: Column = F.lit(0)
    for k, fail in enumerate(fails):
        mask = mask.bitwiseOR(F.when(fail, F.lit(1 << k)).otherwise(F.lit(0)))
    return d.select("doc_id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: fails the k-th filter), n, good and toxic: documents, and those that a label marks so.

    A text is a copy if a smaller doc_id has the same text in any part. Of one text and part only its sums and its smallest id are
    kept, summed on the map side, so a text that a third of all rows share never comes together. A document of several labels is
    good, or toxic, if one of them says so. Rows that repeat a doc_id count each, and are no copies of one another; a null doc_id is
    neither smaller nor larger than others, so such a row is no copy, makes none, and has no label. Null texts are empty, null
    languages are the empty part.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    one = _masks(docs).join(marks, "doc_id", "left").groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"), F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    times = lambda c: (F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    one = one.select("doc_id", "digest", "part", "mask", F.col("doc_id").isNotNull().alias("known"), "n", times("good"), times("toxic"))
    first = F.min(F.when(F.col("known"), F.struct("doc_id", "n", "good", "toxic"))).alias("first")
    texts = written(one.groupBy("digest", "part", "mask", "known").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), first), "audit-texts")
    smallest = texts.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    t = texts.join(smallest, "digest")
    lone = lambda c: F.when(~F.col("known"), F.col(c)).when(F.col("first.doc_id") == F.col("smallest"), F.col(f"first.{c}")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), *[lone(c).alias(c) for c in ("n", "good", "toxic")]),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << COPY)).alias("mask"), *[(F.col(c) - lone(c)).alias(c) for c in ("n", "good", "toxic")]),
    )
    t = t.select("part", F.explode(sides).alias("c")).groupBy("part", F.col("c.mask").alias("mask"))
    return t.agg(F.sum("c.n").alias("n"), F.sum("c.good").alias("good"), F.sum("c.toxic").alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places k of swaps (k, k + 1) that visit every permutation of ``n`` things once, beginning at any of them."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        yield k + 1 if down else k  # the largest stands in front of the others, or behind them
        down = not down


def walk(counts: np.ndarray, filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(orders, steps, shapley) from ``counts`` by [part, mask, documents or good or toxic].

    steps: [order, step, part, (kept, removed, good lost, toxic lost)]; shapley: [part, filter], removed in all orders together.
    """
    n = len(filters)
    masks = np.arange(1 << n)
    order = list(range(n))
    removed = np.empty((n, len(counts), 3), np.int64)

    def look(step: int) -> None:
        before = sum(1 << f for f in order[:step])
        removed[step] = counts[:, (masks & before == 0) & (masks >> order[step] & 1 == 1)].sum(axis=1)

    for step in range(n):
        look(step)
    kept = counts[:, :, 0].sum(axis=1) - removed[:, :, 0].cumsum(axis=0)
    names, steps, shapley = [], np.empty((factorial(n), n, len(counts), 4), np.int64), np.zeros((len(counts), n), np.int64)
    changes = plain_changes(n)
    for visit in range(factorial(n)):
        if visit:
            k = next(changes)
            order[k], order[k + 1] = order[k + 1], order[k]
            kept[k] += removed[k, :, 0]
            look(k)
            look(k + 1)
            kept[k] -= removed[k, :, 0]
        names.append("".join(filters[f] for f in order))
        steps[visit, :, :, 0], steps[visit, :, :, 1:] = kept, removed
        shapley[:, order] += removed[:, :, 0].T
    return names, steps, shapley


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_PARTS = 256  # parts that are walked together; a part gives 600 rows


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = len(FILTERS)
    for whole in batches:
        for at in range(0, len(whole), _PARTS):
            b = whole.iloc[at : at + _PARTS]
            counts = np.zeros((len(b), 1 << n, 3), np.int64)
            for p, each in enumerate(b["cells"]):
                for c in each:
                    counts[p, c["mask"]] = c["n"], c["good"], c["toxic"]
            names, steps, shapley = walk(counts)
            masks = np.arange(1 << n)
            fails = np.stack([counts[:, masks >> f & 1 == 1, 0].sum(axis=1) for f in range(n)], axis=1)
            alone = counts[:, 1 << np.arange(n), 0]
            own = np.array([[FILTERS.index(x) for x in name] for name in names])
            by_filter = lambda a: a.T[own].reshape(-1)  # [order, step, part]  # noqa: B023, E731
            k = lambda c: steps[:, :, :, c].reshape(-1)  # noqa: B023, E731
            yield pd.DataFrame({
                "part": np.tile(b["part"].to_numpy(), len(names) * n), "filter_order": np.repeat(names, n * len(b)), "step": np.tile(np.repeat(np.arange(1, n + 1), len(b)), len(names)).astype("int32"),
                "kept": k(0), "removed": k(1), "redundant": by_filter(fails) - k(1), "unique_fails": by_filter(alone), "good_lost": k(2), "toxic_lost": k(3), "shapley": by_filter(shapley),
            })


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (value of lang), each of the 120 orders of the five filters and each step: documents kept after it, removed at
    it, failing its filter but removed before (redundant), failing its filter only, good and toxic ones removed at it, and what its
    filter removes in all orders together. Parts without documents have no rows, so an empty table gives none. Columns other than
    doc_id, text and lang are not read. A document without words fails only the first filter (and the last, if it repeats)."""
    ship(docs.sparkSession)
    one = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 a part
    return one.mapInPandas(_walks, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(words) < {MIN_WORDS}, 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words), 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > {MAX_UPPER} * length(body),
     regexp_matches(body, '{MARKS}'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), o AS (
  SELECT '' AS filter_order UNION ALL SELECT filter_order || substr('{FILTERS}', k, 1) FROM o, range(1, 6) r(k) WHERE NOT contains(filter_order, substr('{FILTERS}', k, 1))
), s AS (
  SELECT filter_order, step::INTEGER AS step, ascii(substr(filter_order, step, 1)) - 64 AS own, list_transform(range(1, step + 1), lambda j: ascii(substr(filter_order, j, 1)) - 64) AS upto, [j for j in range(1, 6) if j <> ascii(substr(filter_order, step, 1)) - 64] AS rest
  FROM o, range(1, 6) t(step) WHERE length(filter_order) = 5
), g AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS here, len(list_filter(upto, lambda j: fails[j])) AS failed, len(list_filter(rest, lambda j: fails[j])) AS others FROM s, c
), r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (failed = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND failed = 1), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (here AND failed > 1), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (here AND others = 0), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (here AND failed = 1), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND failed = 1), 0)::BIGINT AS toxic_lost
  FROM g GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
