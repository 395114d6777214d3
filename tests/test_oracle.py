"""Every query with SQL gives the same rows as that SQL does, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from cairn.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(float(value)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, tables, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, row)) for row in df.select(*columns).collect())
    found = tables.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0
