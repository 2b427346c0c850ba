import os

import duckdb
import pytest

from tidewatch.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    path = f"{data}/sf0.001/events.parquet"
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'" if os.path.isfile(path) else f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, db, rows_of, name):
    got = QUERIES[name](spark, f"{data}/sf0.001").toPandas()
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        fix = lambda d: rows_of(d.map(lambda v: float(v) if isinstance(v, int) and abs(v) < 2**53 and not isinstance(v, bool) else v))
        assert fix(got) == fix(want)
    else:
        assert len(got.columns)
