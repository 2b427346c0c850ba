"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the session names none, a local one is made if the master is local, as in
    tests; on a cluster executors could not share it, so that is an error."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


_cleared_at_exit: set[str] = set()


def _own(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/tidewatch/{spark.sparkContext.applicationId}"
    if path not in _cleared_at_exit:
        _cleared_at_exit.add(path)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        atexit.register(_clear, jvm, conf, path)
    return path


def _clear(jvm, conf, path: str) -> None:
    """Delete what this application has written there, when the driver ends."""
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the JVM may be gone before the interpreter  # noqa: BLE001
        return


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and lost executors cost nothing.

    ``files``: how many files are enough, from a count of the rows.
    """
    spark = df.sparkSession
    df = df if files is None else df.coalesce(files)
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
