"""Exact deduplication against a persistent digest index.

The index is an external table of one row per distinct text, bucketed and sorted by the SHA-256 of the normalised text.
New rows are reduced to one row per digest (with map-side combine, so a text that a third of the rows share costs one row
per task), anti-joined with the index by sort-merge over equal buckets, and what is left is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.scratch import scratch_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


class DigestIndex:
    """Digests of every text taken in so far, at ``path``; opening it again in another session finds what is there.

    Empty batches add nothing. Batch columns other than the id and the text are ignored, so no name can clash.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Take in a batch; per row: doc_id, keep_id, group_size (rows of the batch with that text), kept, text_sha256.

        Of equal texts in the batch the row with the largest id stays, unless the index has the text already: then its
        entry stays and no row of the batch is kept. Null ids are lost to comparison and so are never kept. Repeated
        rows with the same id each appear, and each is marked as kept.
        """
        rows = written(batch.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("batch_id"), F.count(F.lit(1)).alias("group_size"))
        old = self.entries().withColumnRenamed("keep_id", "old_id")
        groups = written(
            groups.join(old.hint("merge"), "digest", "left").select("digest", F.coalesce("old_id", "batch_id").alias("keep_id"), "group_size"),
            "digest-groups",
        )
        fresh = groups.select("digest", "keep_id").join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)
        # Plain exchanges on both sides, so that a digest with very many rows is split by adaptive execution.
        return rows.join(groups, "digest").select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )

    def close(self) -> None:
        """Forget the session's name for the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, scratch_path(spark, "digest-index"))
    out = index.add(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    index.close()
    return out


SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
