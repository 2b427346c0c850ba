"""Product codes of vectors: integer codebooks, trained and applied in Arrow batches.

Codebooks are small (entries x dimensions) and are broadcast. A batch computes the distances of all its parts to all entries by
norm expansion with exact 64-bit integer products, and takes the first smallest. In a round each task adds up the parts of every
entry; these sums are merged by a grouped shuffle, and only the new entries reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.scratch import written
from tidewatch.shipping import ship

PARTS, ENTRIES, ROUNDS, UNIT = 16, 64, 2, 256


def usable(vector: Column) -> Column:
    """Whether a vector is there, with finite components only."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """Components as whole numbers: floor(256 x). Raises where a squared distance might not fit a long."""
    x = np.floor(vectors.astype(np.float64) * UNIT)
    if x.size and 4.0 * x.shape[1] * float(np.abs(x).max()) ** 2 >= 2.0**63:
        raise ArithmeticError("components are too large: squared distances would not fit a long")
    return x.astype(np.int64)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors differ in length: {width} and {lengths[lengths != width][0]}")
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, ties to the lower, and the squared distance, both by [row, part]."""
    parts, _, d = books.shape
    at, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p, book in enumerate(books):
        part = x[:, p * d : (p + 1) * d]
        distances = (part * part).sum(axis=1)[:, None] - 2 * (part @ book.T) + (book * book).sum(axis=1)
        at[:, p] = distances.argmin(axis=1)
        far[:, p] = np.take_along_axis(distances, at[:, p : p + 1], axis=1)[:, 0]
    return at, far


def _sums(books, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's parts by entry: their number and the sum of each component, one batch a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        parts, entries, d = book.shape
        sums, counts = np.zeros(book.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _rows(b.column(0), width)
            at, _ = nearest(x, book)
            for p in range(parts):
                np.add.at(sums[p], at[:, p], x[:, p * d : (p + 1) * d])
                counts[p] += np.bincount(at[:, p], minlength=entries)
        part, entry, place = (i.reshape(-1).astype(np.int32) for i in np.indices(book.shape))
        n = np.repeat(counts.reshape(-1), d)
        used = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in (part, entry, place, sums.reshape(-1), n)], names=["part", "entry", "place", "total", "n"])

    return run


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, entry, component] from usable vectors: parts of those with the smallest ids, then ``rounds`` of replacing
    each entry by the mean of its parts, rounded down. Entries without parts stay.

    Rows of one id come in the order of their vectors, null ids last. ``entries`` rows and, each round, the entries reach the driver.
    """
    spark = ship(vectors.sparkSession)
    first = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(first[0].v)
    if width % parts or any(len(r.v) != width for r in first):
        raise ValueError(f"vectors must be of one length, a multiple of {parts}")
    books = whole(np.array([list(r.v) for r in first], np.float64).reshape(len(first), width)).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = vectors.select(vector_col).mapInArrow(_sums(shared, width), "part int, entry int, place int, total long, n long")
        merged = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        books = books.copy()
        at = tuple(merged.column(c).to_numpy() for c in ("part", "entry", "place"))
        books[at] = merged.column("total").to_numpy() // merged.column("n").to_numpy()  # numpy rounds down
        shared.unpersist()
    return books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _codes(books, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        arrow = to_arrow_schema(schema)
        for b in batches:
            if not len(b):
                continue
            at, far = nearest(_rows(b.column("vector"), book.shape[0] * book.shape[2]), book)
            code = [r.tobytes().hex() for r in at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(arrow.types[0]), b.column("label").cast(arrow.types[1]), pa.array(code), pa.array(far.sum(axis=1))], schema=arrow)

    return run


def encode(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distances summed) of usable vectors."""
    spark = ship(vectors.sparkSession)
    if books.shape[1] > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    v = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    schema = T.StructType([v.schema["id"], v.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return v.mapInArrow(_codes(spark.sparkContext.broadcast(books), schema), schema)


def compress(embeddings: DataFrame) -> DataFrame:
    """Per usable vector: vec_id, code, error, label_error (error summed over rows of its label, nulls together), codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out. Repeated ids are rows of their own; other columns are
    not read. An empty table gives no rows; with fewer than 64 usable vectors the codebooks are as short. Empty vectors have 16 empty
    parts, code zeros. Vectors of several lengths, or of one that 16 does not divide, are an error, and so are components so large
    that a squared distance would not fit a long. The table is read four times; write it first if it is dear to compute.
    """
    usables = embeddings.where(usable(F.col("embedding")))
    books = train(usables)
    coded = written(encode(usables, books), "vector-codes")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels")
    # A plain join with a written table: broadcast only if Spark finds it small, else a hot label is split by adaptive execution.
    return coded.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label"))).select(
        F.col("c.id").alias("vec_id"), "c.code", "c.error", "t.label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(n: int) -> str:
    """Assign all parts to the entries of round ``n``, and make the entries of the next."""
    return f"""a{n} AS MATERIALIZED (
  SELECT r, part, min(far * {ENTRIES} + e) AS best FROM (
    SELECT r, p.part, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM p JOIN c{n} c ON c.part = p.part) GROUP BY r, part
), m{n} AS (
  SELECT part, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT p.part, best % {ENTRIES} AS e, x, unnest(range(1, len(x) + 1)) AS i FROM p JOIN a{n} USING (r, part)) GROUP BY part, e, i
), c{n + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(u.c, c.c) AS c FROM c{n} c LEFT JOIN (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{n} GROUP BY part, e) u ON u.part = c.part AND u.e = c.e
)"""


SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda x: floor({UNIT} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT r, j AS part, v[j * (len(v) // {PARTS}) + 1 : (j + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) t(j)
), c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= {ENTRIES}
), {", ".join(map(_round, range(ROUNDS + 1)))},
codes AS (SELECT r, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM k JOIN codes USING (r)
"""
