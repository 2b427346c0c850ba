"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams is the input. Executors count, over the training rows, in how many toxic and other rows each
bucket occurs; the buckets that tell the two apart best become features, scaled by their log-count ratios, and the driver fits
a logistic regression on those few a row. Scoring needs one table of fixed size. The training rows are a hash-ordered sample of
at most ``MAX_TRAIN`` labelled rows outside the held-out fold; everything else covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._ngrams import mix64
from tidewatch.scratch import written
from tidewatch.shipping import ship

ORDERS = (3, 4, 5, 6)
BITS = 20
REACH = 1 << 20
MAX_TRAIN = 8000
MAX_FEATURES = 4000
TRAIN_TASKS = 3
MIN_ROWS = 4  # training rows that a feature must occur in
STEPS, RATE, RIDGE = 300, 0.03, 3e-4


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams, an array for each order and stretch of ``REACH`` characters; letters compare in lower case,
    spaces stand around the text, and stretches overlap so that none is missed."""
    whole = f" {(text or '').lower()} "
    for at in range(0, len(whole), REACH):
        yield from _buckets(whole[at : at + REACH + max(ORDERS) - 1])


def _buckets(text: str) -> Iterator[np.ndarray]:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    each = mix64(c + np.uint64(1))
    h = each
    for n in range(2, max(ORDERS) + 1):
        if len(each) < n:
            return
        h = h[:-1] * np.uint64(0x100000001B3) + each[n - 1 :]
        if n in ORDERS:
            g = h ^ np.uint64(n)
            g = (g ^ (g >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            yield (g >> np.uint64(64 - BITS)).astype(np.int64)


def present(text: str | None, table: np.ndarray) -> np.ndarray:
    """Distinct values of ``table``, -1 aside, that the text's buckets have."""
    found = [x[x >= 0] for b in buckets(text) for x in (table[b],)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, table.dtype)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = np.arange(1 << BITS, dtype=np.int32)
    counts = np.zeros((2, 1 << BITS), np.int64)
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            counts[label][present(text, every)] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "neg", "pos"])


def _rows(table_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of.value
        for b in batches:
            found = [present(t, table).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "features"])

    return run


def _score(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights, bias = model_of.value
        for b in batches:
            s = np.array([bias + weights[present(t, table)].sum() for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s, -500, 500))))], ["doc_id", "score"])

    return run


def _fit(features: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on the ratio-scaled features; weights come back already scaled."""
    n = len(labels)
    col = np.concatenate([*features, np.empty(0, np.int32)])
    row = np.repeat(np.arange(n), [len(x) for x in features])
    val = ratio[col]
    w, b = np.zeros(len(ratio) + 1), 0.0
    first, second = np.zeros(len(w)), np.zeros(len(w))
    w[-1] = np.log((labels.sum() + 1) / (n - labels.sum() + 1))
    for k in range(1, STEPS + 1):
        s = np.bincount(row, weights=w[col] * val, minlength=n) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - labels) / max(n, 1)
        g = np.append(np.bincount(col, weights=e[row] * val, minlength=len(ratio)) + RIDGE * w[:-1], e.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    b = float(w[-1])
    return w[:-1] * ratio, b


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature of each bucket or -1, weight of each feature, bias) from labelled rows outside the held-out fold.

    Labels without doc_id or toxic are void; of labels that repeat for a doc_id one counts, 1 before 0. Without any usable
    label every score is 0.5; with labels of one kind the bias alone decides. Of rows that repeat a doc_id one text counts, the least by hash.
    """
    sc = ship(docs.sparkSession).sparkContext
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # what is broadcast has this bound
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(F.col("doc_id").cast("string").alias("doc_id"), "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = written(rows, "toxic-train")
    rows = rows.coalesce(TRAIN_TASKS)  # each task counts up to 2**BITS buckets
    counted = rows.select("text", "label").mapInArrow(_count, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counted = counted.where(F.col("neg") + F.col("pos") >= MIN_ROWS).toPandas()  # 2**BITS rows at most
    of = dict(rows.groupBy("label").count().collect())
    n_neg, n_pos = of.get(0, 0), of.get(1, 0)
    pos, neg = counted["pos"].to_numpy(float), counted["neg"].to_numpy(float)
    share = (n_pos + 1) / (n_pos + n_neg + 2)
    tells = np.abs(pos - (pos + neg) * share) / np.sqrt((pos + neg) * share * (1 - share) + 1e-9)
    best = np.lexsort((counted["bucket"].to_numpy(), -tells))[:MAX_FEATURES] if n_pos and n_neg else np.empty(0, int)
    table = np.full(1 << BITS, -1, np.int32)
    table[counted["bucket"].to_numpy()[best]] = np.arange(len(best))
    ratio = np.log((pos[best] + 1) / (n_pos + 2)) - np.log((neg[best] + 1) / (n_neg + 2))
    kept = rows.mapInArrow(_rows(sc.broadcast(table)), "doc_id string, label int, features binary").toPandas().sort_values("doc_id")
    weights, bias = _fit([np.frombuffer(x, np.int32) for x in kept["features"]], kept["label"].to_numpy(float), ratio)
    return table, weights, bias


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null texts score like empty ones: by the bias alone. Rows that repeat are each scored. Only doc_id and text are read, and of
    labels doc_id and toxic. A null doc_id is not held out.
    """
    model = ship(docs.sparkSession).sparkContext.broadcast(train(docs, labels, max_train))
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
