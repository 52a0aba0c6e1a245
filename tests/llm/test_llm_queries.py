"""The queries with SQL against the SQL on the smallest tables; the others must run."""

from pathlib import Path

import duckdb
import pytest

from tessera.llm.oracle import ORACLE_SQL
from tessera.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DATA)
    ours = found.collect()
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for path in Path(DATA).glob("*.parquet"):
            db.sql(f"create view {path.stem} as from '{path}'")
        relation = db.sql(ORACLE_SQL[name])
        order = [relation.columns.index(c) for c in found.columns]
        assert sorted(map(repr, map(tuple, ours))) == sorted(repr(tuple(r[i] for i in order)) for r in relation.fetchall())
