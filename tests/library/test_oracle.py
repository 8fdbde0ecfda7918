"""Every query with SQL gives DuckDB's rows at sf0.001; the others run."""

import duckdb
import pytest

from fanweave.plans import registry

from ..conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    return None if value is None else str(value) if isinstance(value, bool) or not isinstance(value, float) else f"{value:.6f}"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_those_of_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(([plain(row[names.index(c)]) for c in columns] for row in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0
