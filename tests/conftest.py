from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TIDEWATCH_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip(f"no tables at {DATA}")
    return DATA


@pytest.fixture(scope="session")
def rows_of():
    """Rows of a pandas frame as sorted tuples of text, columns by name, floats to nine places."""

    def show(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9))
        return str(v)

    return lambda df: sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
