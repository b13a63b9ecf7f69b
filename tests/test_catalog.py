"""Every catalog query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def clean(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(clean(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted(names) == cols and got == want
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {catalog.oracle_sql()[name]}").fetchall()}
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
