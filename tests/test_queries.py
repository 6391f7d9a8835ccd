"""Each Avro query against its SQL on a small table set."""

import duckdb
import pytest

from avrolith.operators.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda found: sorted(map(repr, found))
    assert rows(tuple(r[c] for c in order) for r in got.collect()) == rows(want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall())
