"""Every query of the library that has SQL gives the rows of that SQL."""

import duckdb
import pytest

from tessera import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "part", "events", "documents", "labels", "embeddings", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda x: format(x, ".8g") if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)
    return sorted(tuple(text(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def test_entry_module_imports():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
