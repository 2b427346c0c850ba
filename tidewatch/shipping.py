"""Prepares a session for Python workers: this package, whatever their path, and batches of bounded size."""

from __future__ import annotations

import sys
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


@contextmanager
def by_value():
    """Functions of this package are pickled whole meanwhile: the process that prepares a stateful stream beside the driver sees none
    of the files that executors fetch."""
    package = sys.modules[__name__.split(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)

#: Spark's own default of 10,000 rows a batch may be gigabytes of long texts, several times over in a worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(16 << 20))}


def ship(spark: SparkSession) -> SparkSession:
    """Have executors fetch the package from the driver, once an application, and limit batches unless the session says how."""
    sc = spark.sparkContext
    for key, (default, limit) in BATCHES.items():
        if sc.getConf().get(key) is None and spark.conf.get(key, default) in (default, str(64 << 20), str(2**63 - 1)):
            spark.conf.set(key, limit)
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="tidewatch-")) / f"{here.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark
