"""Every query with an oracle against DuckDB on the smallest tables, by rows and values."""

import math
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexiloom.plans import registry


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float | Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, np.ndarray | list | tuple):
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
