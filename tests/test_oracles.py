"""Every registered query of the graph engine against its SQL on the smallest tables."""

import duckdb
import pytest

from tidegraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=repr)
    assert got == want and (got or name == "category_anti")
