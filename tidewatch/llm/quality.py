"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and marks, and pairs of them, are hashed to buckets. The raw model counts all documents; the target model counts a
hash-ordered sample of at most ``MAX_TARGET`` documents labelled good. A document's log weight is the sum of the log ratios of
its buckets; with a Gumbel number drawn from a hash of its id added, the k largest are a sample without replacement with
probabilities in proportion to the weights. The k-th largest is found by histograms of fixed size, so nothing is sorted in one
place, and reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm._names import free
from tidewatch.llm._ngrams import mix64, span_hashes
from tidewatch.scratch import written
from tidewatch.shipping import ship

BITS = 16
REACH = 1 << 21
MAX_TARGET = 8000
MARGIN = 3.0  # standard errors of the share of good labels that are added to it
STEP = 1e-6  # keys closer than this count as ties
BINS = 4096

_CLASS = np.array([0 if c <= 32 or c == 127 else 1 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 2 for c in range(256)], np.uint8)


def parts(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the runs of letters and digits, of the runs of other visible characters, and of neighbouring pairs of runs, for
    stretches of about ``REACH`` bytes that are cut between runs."""
    whole = np.frombuffer((text or "").lower().encode(), np.uint8)
    at, before = 0, np.empty(0, np.uint64)
    while at < len(whole):
        to = min(len(whole), at + REACH)
        while to < len(whole) and _CLASS[whole[to - 1]] and _CLASS[whole[to]] == _CLASS[whole[to - 1]]:
            to += 1
        data = whole[at:to]
        kind = np.concatenate([[0], _CLASS[data], [0]]).astype(np.int8)
        edge = kind[1:] != kind[:-1]
        starts, ends = np.flatnonzero(edge & (kind[1:] > 0)), np.flatnonzero(edge & (kind[:-1] > 0))
        at = to
        if len(starts):
            one = span_hashes(data, starts, ends)
            near = np.concatenate([before, one])
            two = mix64(near[:-1] * np.uint64(0x9E3779B97F4A7C15) + near[1:])
            before = one[-1:]
            yield (np.concatenate([one, two]) >> np.uint64(64 - BITS)).astype(np.int64)


def buckets(text: str | None) -> np.ndarray:
    return np.concatenate([*parts(text), np.empty(0, np.int64)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BITS, np.int64)
    for b in batches:
        for text in b.column("text").to_pylist():
            for x in parts(text):
                if len(x) > 5000:
                    counts += np.bincount(x, minlength=1 << BITS)
                else:
                    np.add.at(counts, x, 1)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])


def _model(docs: DataFrame) -> np.ndarray:
    counted = docs.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2**BITS rows at most
    n = np.ones(1 << BITS)
    n[counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    return np.log(n) - np.log(n.sum())


def _weigh(ratio_of, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = ratio_of.value
        for b in batches:
            s = [float(sum(ratio[x].sum() for x in parts(t))) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    return run


def ratios(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Log of target over raw probability of each bucket."""
    ship(docs.sparkSession)
    return _model(target) - _model(docs)


def weighed(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", name: str = "log_weight") -> DataFrame:
    """All rows and columns, and ``name``: log of target over raw likelihood; 0 for null, empty and blank texts."""
    sc = ship(docs.sparkSession).sparkContext
    return docs.mapInArrow(_weigh(sc.broadcast(ratio), text_col, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def gumbel(doc_id: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int) -> int | None:
    """The k-th largest of the integers in the only column of ``values``: each pass counts ``BINS`` bins and goes on in one."""
    c = values.columns[0]
    lo, hi = values.agg(F.min(c), F.max(c)).first()
    if lo is None or k <= 0:
        return None
    while lo < hi:
        width = -(-(hi - lo + 1) // BINS)
        bins = values.where(F.col(c).between(lo, hi)).groupBy(F.floor((F.col(c) - F.lit(lo)) / F.lit(width)).cast("long").alias("bin")).count().collect()
        for b, n in sorted(bins, reverse=True):
            if k <= n:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= n
        else:
            return lo
    return lo


def _rank(key: Column) -> Column:
    return F.floor(key / F.lit(STEP)).cast("long")


def _cut(docs: DataFrame, labels: DataFrame, fraction: float | None, max_target: int, seed: int) -> tuple[DataFrame, np.ndarray, int | None]:
    """Scores of all rows, the ratios behind them, and the least rank that is kept."""
    label = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good, n = label.agg(F.sum((F.col("quality") > 0).cast("long")), F.count(F.lit(1))).first()
    ids = label.where("quality > 0").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)  # what is broadcast has this bound
    ratio = ratios(docs, docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))
    if fraction is None:
        share = (good or 0) / n if n else 1.0
        fraction = min(1.0, share + MARGIN * math.sqrt(share * (1 - share) / n)) if good else 1.0
    scored = weighed(docs.select("doc_id", "text"), ratio).select("doc_id", "log_weight")
    scored = written(scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "weights")
    return scored, ratio, kth_largest(scored.select(_rank(F.col("key")).alias("key")), math.ceil(fraction * scored.count()))


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, max_target: int = MAX_TARGET, seed: int = 17) -> DataFrame:
    """Per row: doc_id, log_weight, key (log weight plus Gumbel number), kept.

    ``fraction`` of all rows are kept, those with the largest keys; by default the share of good ones among the labels plus
    ``MARGIN`` standard errors, so that what goes is what least resembles the target. Keys that tie with the last one kept are
    kept as well. Null and empty texts weigh as much as raw text does, and so go only after what is unlike the target. Rows that
    repeat have equal keys. Labels that are null are void; without good labels all rows stay. Other columns are not read.
    """
    scored, _, least = _cut(docs, labels, fraction, max_target, seed)
    return scored.withColumn("kept", _rank(F.col("key")) >= F.lit(least) if least is not None else F.lit(True))


def keep_good(docs: DataFrame, labels: DataFrame, fraction: float | None = None, max_target: int = MAX_TARGET, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with all columns; weighed once more rather than joined, so no text is shuffled."""
    _, ratio, least = _cut(docs, labels, fraction, max_target, seed)
    (name,) = free(docs, "log_weight")
    rank = _rank(F.col(name) + gumbel(F.col("doc_id"), seed))
    return weighed(docs, ratio, name=name).where(rank >= F.lit(least) if least is not None else F.lit(True)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
