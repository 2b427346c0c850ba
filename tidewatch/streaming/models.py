"""Anomalies on a stream: models as persisted state, samples scored before they are learnt from.

A ``Scorer`` is called with each micro-batch of feature vectors. What it must remember lies beside its output: the last samples, from
which the next models are fitted, the model in force, the times of the last alerts, and the counts of samples and alerts, whose
row is written last. A batch starts from what the batch before left and replaces what it wrote itself, so one that comes
again changes nothing. Batches must come in the order of samples; the outcome is that of ``anomaly`` over all of them at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import anomaly
from tidewatch.operators.features import vectorized
from tidewatch.shipping import ship

SAMPLE = "symbol string, seq bigint, ts_ns bigint, n bigint, version bigint, vector array<double>"
MODEL = "version bigint, size int, roots int, offset double, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"
FIRED = "symbol string, ts_ns bigint"
HEAD = "samples bigint, alerts bigint, version bigint"
_ARRAYS = ("feature", "cut", "left", "right", "depth")


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    f = anomaly.Forest(np.stack(rows.sort_values("n")["vector"].to_list()))
    return pd.DataFrame({"version": [rows["version"].iloc[0]], "size": [f.size], "roots": [f.roots], "offset": [f.offset], **{c: [getattr(f, c)] for c in _ARRAYS}})


def _scored(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    out = rows[["symbol", "seq", "ts_ns", "n", "version"]].copy()
    if len(rows):
        m = model.iloc[0]
        f = anomaly.Forest.of(int(m["size"]), int(m["roots"]), float(m["offset"]), {c: np.asarray(m[c]) for c in _ARRAYS})
        out["decision"] = f.decision(np.stack(rows["vector"].to_list()))
    else:
        out["decision"] = pd.Series(dtype=float)
    return out


class Scorer:
    """Writes ``decisions`` and ``alerts`` below ``path``, a folder a batch. ``path`` must be one that all executors share."""

    def __init__(self, path: str, warmup: int = anomaly.WARMUP, refit: int = anomaly.REFIT, buffer: int = anomaly.BUFFER) -> None:
        self.path, self.warmup, self.refit, self.buffer = path.rstrip("/"), warmup, refit, buffer

    def _at(self, what: str, batch_id: int) -> str:
        return f"{self.path}/{what}/batch={batch_id}"

    def _left(self, spark: SparkSession, what: str, schema: str, batch_id: int) -> DataFrame:
        """What the batch before left; nothing before the first."""
        return spark.read.schema(schema).parquet(self._at(f"state/{what}", batch_id - 1)) if batch_id else spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, what: str, batch_id: int, files: int | None = None) -> None:
        (df if files is None else df.coalesce(files)).write.mode("overwrite").parquet(self._at(what, batch_id))

    def __call__(self, vectors: DataFrame, batch_id: int) -> None:
        """``vectors``: symbol, seq, ts_ns and the features, as columns or as a map. A batch may be empty."""
        spark = ship(vectors.sparkSession)
        head = self._left(spark, "head", HEAD, batch_id).first()
        before, told, version = head if head else (0, 0, 0)
        new = anomaly.schedule(vectorized(vectors), self.warmup, self.refit, before).select("symbol", "seq", "ts_ns", "n", "version", "vector").persist(StorageLevel.DISK_ONLY)
        after = before + new.count()
        samples = self._left(spark, "samples", SAMPLE, batch_id).unionByName(new)
        # The model that is in force when the next sample comes, if there is one by then.
        latest = (after - self.warmup) // self.refit + 1 if after >= self.warmup else 0
        models = self._left(spark, "model", MODEL, batch_id)
        known = new.where(F.col("version") == version).groupBy("version").cogroup(models.groupBy("version")).applyInPandas(_scored, anomaly.DECISION) if version else None
        rest = anomaly.decided(samples, new.where(F.col("version") > version), version, self.warmup, self.refit, self.buffer)
        self._write(rest if known is None else known.unionByName(rest), "decisions", batch_id)
        fit = anomaly.learning(samples, version, self.warmup, self.refit, self.buffer).where(F.col("version") == latest)
        self._write(fit.groupBy("version").applyInPandas(_fitted, MODEL) if latest > version else models, "state/model", batch_id, 1)
        self._write(samples.where(F.col("n") > after - self.buffer - self.refit), "state/samples", batch_id, 1)
        fired = self._left(spark, "fired", FIRED, batch_id)
        decisions = spark.read.schema(anomaly.DECISION).parquet(self._at("decisions", batch_id))
        alerts = anomaly.told(decisions, fired, told).persist(StorageLevel.DISK_ONLY)
        self._write(alerts, "alerts", batch_id)
        self._write(fired.unionByName(alerts.select("symbol", "ts_ns")).groupBy("symbol").agg(F.max("ts_ns").alias("ts_ns")), "state/fired", batch_id)
        self._write(spark.createDataFrame([(after, told + alerts.count(), max(latest, version))], HEAD), "state/head", batch_id, 1)
        alerts.unpersist()
        new.unpersist()
        self._forget(spark, batch_id - 2)

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """State that no batch can start from any more: only the last one may come again."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for what in ("head", "samples", "model", "fired"):
            at = jvm.org.apache.hadoop.fs.Path(self._at(f"state/{what}", batch_id))
            at.getFileSystem(conf).delete(at, True)

    def observe(self, features: DataFrame, batch_id: int) -> None:
        """For ``engine.start``: vectors as the stream tells them, symbol, seq, ts_ns and body (JSON)."""
        self(features.select("symbol", "seq", "ts_ns", F.from_json("body", "map<string,double>").alias("features")), batch_id)
