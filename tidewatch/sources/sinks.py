"""Tables that a tape, its alerts and its features are written to. Partitions by symbol let readers of a few symbols skip the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(tape: DataFrame, path: str, mode: str = "append") -> None:
    """Write a tape by symbol, in order inside each file; rows without a symbol or of no known kind are left out."""
    rows = tape.where("symbol IS NOT NULL AND kind IN ('trade', 'depth')").withColumn("symbol", F.upper("symbol"))
    rows.repartition("symbol").sortWithinPartitions("symbol", "seq").write.mode(mode).partitionBy("symbol").parquet(path)


def published(spark: SparkSession, path: str, *symbols: str) -> DataFrame:
    """A published tape, or only some of its symbols, for which Spark lists no other partitions."""
    t = spark.read.parquet(path)
    return t.where(F.col("symbol").isin(*[s.upper() for s in symbols])) if symbols else t


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    alerts.write.mode(mode).partitionBy("detector").parquet(path)


def write_features(vectors: DataFrame, path: str, mode: str = "append") -> None:
    vectors.repartition("symbol").write.mode(mode).partitionBy("symbol").parquet(path)


def all_alerts(*tables: DataFrame) -> DataFrame:
    """Alerts of the rules and advisory ones as one table; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
