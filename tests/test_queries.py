"""Every core query with SQL against the SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return float(value) if type(value).__name__ == "Decimal" else str(value)


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    for path in Path(DATA).glob("*.parquet"):
        db.sql(f"create view {path.stem} as from '{path}'")
    return db


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    relation = tables.sql(SQL[name])
    order = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert ours == sorted(repr(tuple(plain(row[i]) for i in order)) for row in relation.fetchall())
